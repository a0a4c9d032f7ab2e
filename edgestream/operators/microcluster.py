"""Microcluster scores of an edge stream with exact counts, and the fixed-size sketch they are also kept in."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import cut_lineage, global_number, global_sum
from .grouped import fold_groups

FADE = 0.5
#: Ticks of history that a decayed count looks back; 0.5^64 is below the precision of a double.
FRAME = 64


def chi_score(a: Column, s: Column, t: Column) -> Column:
    """((a - s / t) t)^2 / (s (t - 1)); 0 where s is 0 or t is 1."""
    return F.when((s == 0) | (t <= 1), F.lit(0.0)).otherwise(F.pow((a - s / t) * t, 2) / (s * (t - 1)))


def normal(edges: DataFrame) -> DataFrame:
    """seq, score: an edge's count in its tick against its count so far."""
    pair = Window.partitionBy("src", "dst").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    tick = Window.partitionBy("src", "dst", "t").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = edges.withColumns({"s": F.count("*").over(pair).cast("double"), "a": F.count("*").over(tick).cast("double")})
    return held.select("seq", "t", "label", chi_score(F.col("a"), F.col("s"), F.col("t")).alias("score"))


def tick_numbers(edges: DataFrame) -> DataFrame:
    """t, j: ticks of the whole stream, numbered; one row a tick."""
    return global_number(edges.select("t").distinct(), "j", "t")


def decayed_counts(keyed: DataFrame, fade: float = FADE) -> DataFrame:
    """key, t, before_s, before_a: a key's count before each of its ticks, plain and decayed by the ticks that passed."""
    per = keyed.groupBy("key", "t", "j").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("j").rangeBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("key").orderBy("j").rangeBetween(-FRAME, -1)
    held = per.withColumns({"before_s": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "_h": F.collect_list(F.struct("j", "n")).over(near)})
    faded = F.aggregate("_h", F.lit(0.0), lambda s, x: s + x["n"] * F.pow(F.lit(fade), F.col("j") - x["j"]))
    return held.select("key", "t", "before_s", faded.alias("before_a"))


def relational(edges: DataFrame, fade: float = FADE) -> DataFrame:
    """seq, score: the largest of the scores of the edge, its source and its target, with decayed current counts.

    An edge's three keys go through one pass together, and its best one is aggregated back.
    """
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), a.alias("a"), b.alias("b")) for k, (a, b) in enumerate(((F.col("src"), F.col("dst")), (F.col("src"), F.lit("")), (F.col("dst"), F.lit(""))))))
    keyed = edges.join(tick_numbers(edges), "t").select("seq", "t", "j", "label", F.explode(keys).alias("key"))
    in_tick = F.row_number().over(Window.partitionBy("key", "t").orderBy("seq"))
    held = keyed.withColumn("_k", in_tick).join(decayed_counts(keyed, fade), ["key", "t"])
    score = chi_score(F.col("before_a") + F.col("_k"), (F.col("before_s") + F.col("_k")).cast("double"), F.col("t"))
    return held.groupBy("seq").agg(F.first("t").alias("t"), F.first("label").alias("label"), F.max(score).alias("score"))


def _filter_fold(threshold: float, fade: float):
    """A key's state before each of its ticks, from its counts by tick alone: (t, n, number of the tick, growth).

    Between two of them, each tick of the stream either adds the fading current count to the total (a
    geometric sum), or multiplies the total by 1 + 1 / (p - 1) for the tick p before; growth is the sum of these
    factors' logarithms over all ticks before.
    """

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        total = current = score = 0.0
        out, before, grown = [], rows[0][2], rows[0][3]
        for t, n, now, growth in rows:
            passed = fade ** (now - before)
            if score < threshold:
                total += current * ((1 - passed) / (1 - fade) if fade < 1 else now - before)
            else:
                total *= math.exp(growth - grown)
            current *= passed
            before, grown = now, growth
            out.append((*key, t, current, total))
            current += n
            score = 0.0 if total == 0 else (current + total - current * t) ** 2 / (total * (t - 1))
        return out

    return fold


def filtering(edges: DataFrame, threshold: float, fade: float = FADE) -> DataFrame:
    """seq, score: totals take a tick's counts only when the tick is over, and not from keys that scored above threshold.

    A key is folded over its counts by tick, which bring the tick's number and growth along, so a hot key is
    as many rows as there are ticks. The three keys of an edge go through one pass.
    """
    factor = F.log(1 + F.when(F.col("t") > 1, 1 / (F.col("t") - 1)).otherwise(0.0))
    ticks = global_sum(tick_numbers(edges), factor, "upto", "t").select("t", "j", (F.col("upto") - factor).alias("growth"))
    joined = F.concat_ws("\u0001", "src", "dst")
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in enumerate((joined, F.col("src"), F.col("dst")))))
    keyed = edges.select("seq", "t", "label", F.explode(keys).alias("k")).select("seq", "t", "label", "k.*")
    counts = keyed.groupBy("kind", "key", "t").agg(F.count("*").alias("n")).join(ticks, "t").select("kind", "key", "t", "n", "j", "growth")
    state = fold_groups(counts, ["kind", "key"], ["t"], _filter_fold(threshold, fade), "kind int, key string, t long, before_a double, total double")
    in_tick = F.row_number().over(Window.partitionBy("kind", "key", "t").orderBy("seq"))
    a, s = F.col("before_a") + F.col("_k"), F.col("total")
    score = F.when(s == 0, F.lit(0.0)).otherwise(F.pow(a + s - a * F.col("t"), 2) / (s * (F.col("t") - 1)))
    held = keyed.withColumn("_k", in_tick).join(state, ["kind", "key", "t"])
    return held.groupBy("seq").agg(F.first("t").alias("t"), F.first("label").alias("label"), F.max(score).alias("score"))


# --- the sketch --------------------------------------------------------------------------------


def wrap32(x: Column) -> Column:
    """A 64-bit value as a 32-bit one that wraps."""
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def sketch_column(a: Column, b: Column, factor: int, shift: int, columns: int) -> Column:
    """The sketch column of a key pair in one row: ((a + 104729 b) factor + shift) modulo columns, in 32 bits."""
    mixed = wrap32(wrap32(a + 104729 * b) * factor + shift)
    left = mixed % columns
    return F.when(left < 0, left + columns).otherwise(left).cast("int")


def sketch_counts(edges: DataFrame, factors: list[tuple[int, int]], columns: int) -> DataFrame:
    """row, column, value: a sketch of edge counts (u, v numeric) as a table of its cells."""
    cells = F.array(*(F.struct(F.lit(r).alias("row"), sketch_column(F.col("u"), F.col("v"), p, q, columns).alias("column")) for r, (p, q) in enumerate(factors)))
    return edges.select(F.inline(cells)).groupBy("row", "column").agg(F.count("*").alias("value"))


def sketch_estimates(edges: DataFrame, factors: list[tuple[int, int]], columns: int) -> DataFrame:
    """u, v, n, estimate: the exact count of each pair beside its least cell. The cells are a bounded table.

    Each row of the sketch is looked up beside the pair, so pairs are grouped once.
    """
    found = edges.groupBy("u", "v").agg(F.count("*").alias("n"))
    cells = cut_lineage(sketch_counts(edges, factors, columns))
    for r, (p, q) in enumerate(factors):
        own = cells.where(F.col("row") == r).select(F.col("column").alias(f"_c{r}"), F.col("value").alias(f"_v{r}"))
        found = found.withColumn(f"_c{r}", sketch_column(F.col("u"), F.col("v"), p, q, columns)).join(F.broadcast(own), f"_c{r}")
    values = [f"_v{r}" for r in range(len(factors))]
    return found.select("u", "v", "n", (F.least(*values) if len(values) > 1 else F.col(*values)).alias("estimate"))


#: Sketch columns of scores are taken modulo this prime first.
PRIME = 2**31 - 1


def cells_of(rows: int, columns: int, seed: int, relational: bool) -> Column:
    """kind, row, cell of an edge (u, v): the pair's own sketch, and with relational those of its source and target."""
    p = F.lit(PRIME).cast("long")
    factors = sketch_factors(rows, seed)

    def cell(a: Column, b: Column, r: int) -> Column:
        mixed = F.pmod(F.pmod(a, p) + 104729 * F.pmod(b, p), p)
        return F.pmod(F.pmod(mixed * factors[r][0] + factors[r][1], p), F.lit(columns))

    u, v, zero = F.col("u"), F.col("v"), F.lit(0).cast("long")
    kinds = ((u, v), (u, zero), (v, zero)) if relational else ((u, v),)
    return F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r).alias("row"), cell(a, b, r).alias("cell")) for k, (a, b) in enumerate(kinds) for r in range(rows)))


def sketch_factors(rows: int, seed: int) -> list[tuple[int, int]]:
    draw = np.random.Generator(np.random.PCG64(seed))
    return [(int(a), int(b)) for a, b in draw.integers(1, PRIME, (rows, 2))]


def sketch_scores(edges: DataFrame, rows: int = 2, columns: int = 1024, fade: float | None = None, seed: int = 7, stream: str = "stream_id") -> DataFrame:
    """seq, score with counts kept in sketches of fixed size, as they stand after each edge of its stream.

    A cell's total is its count so far, its current value the count decayed by the ticks that passed (without
    fade, the tick's own count). Both are windows over the cell's updates, so a stream is folded by cells and
    not in one task; an edge takes the least of its cells.
    """
    ticks = edges.select(stream, "t").distinct().withColumn("j", F.row_number().over(Window.partitionBy(stream).orderBy("t")))
    keyed = edges.join(ticks, [stream, "t"]).select("seq", "t", "j", stream, F.inline(cells_of(rows, columns, seed, fade is not None))).withColumn("key", F.struct(stream, "kind", "row", "cell"))
    in_tick = F.row_number().over(Window.partitionBy("key", "t").orderBy("seq")).cast("double")
    held = keyed.withColumn("_k", in_tick)
    if fade is None:
        so_far = F.row_number().over(Window.partitionBy("key").orderBy("seq")).cast("double")
        held = held.withColumns({"a": F.col("_k"), "s": so_far})
    else:
        held = held.join(decayed_counts(keyed, fade), ["key", "t"]).withColumns({"a": F.col("before_a") + F.col("_k"), "s": F.col("before_s") + F.col("_k")})
    least = held.groupBy("seq", "t", "kind").agg(F.min("a").alias("a"), F.min("s").alias("s"))
    return least.groupBy("seq").agg(F.max(chi_score(F.col("a"), F.col("s"), F.col("t"))).alias("score"))
