"""Controlled anomalies: attack logs spliced into benign ones, and links added, removed or rewired."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, draw_int, draws_of, least
from ..plans.ordering import RANGE, cut_lineage, global_number, in_order, numbered
from .grouped import fold_groups
from .sequence import strictly_increasing


def organised(benign: DataFrame, malicious: DataFrame, clock: str = "clock") -> DataFrame:
    """Both logs (seq, clock, path, label) in one order by clock, benign rows first at a tie; seq renumbered from 1."""
    both = benign.withColumn("_side", F.lit(0)).unionByName(malicious.withColumn("_side", F.lit(1)))
    return renumbered(both, clock, "_side", "seq").drop("_side")


def renumbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with seq replaced by 1, 2, ... in the given order: range partitions, with their counts carried over."""
    return global_number(in_order(df, *order), "_new", "_m", RANGE).withColumn("seq", F.col("_new").cast("long")).drop("_m", "_new")


def into_gap(benign: DataFrame, malicious: DataFrame, after_seq: int | None, clock: str = "clock") -> DataFrame:
    """The malicious log spliced in behind one benign row, its clock shifted to begin one tick after it.

    No row is lost where there is nothing to begin at: without that benign row the clock is null, and with no place
    at all (None) the malicious log comes last.
    """
    anchor = benign.where(F.col("seq") == after_seq).agg(F.max(clock).alias("_at"))
    first = malicious.agg(F.min(clock).alias("_first"))
    moved = malicious.crossJoin(F.broadcast(anchor)).crossJoin(F.broadcast(first)).withColumn(clock, F.col(clock) - F.col("_first") + F.col("_at") + 1).drop("_at", "_first")
    both = benign.withColumn("_p", F.col("seq")).withColumn("_side", F.lit(0)).unionByName(moved.withColumn("_p", F.lit(after_seq).cast("long")).withColumn("_side", F.lit(1)))
    return renumbered(both, F.col("_p").asc_nulls_last(), "_side", "seq").drop("_p", "_side")


def continuous(benign: DataFrame, malicious: DataFrame, after_seq: int, clock: str = "clock") -> DataFrame:
    """As into_gap, but the malicious rows take consecutive ticks, and all clocks are then made strictly increasing."""
    numbered = global_number(malicious, "_k").withColumn(clock, F.col("_k")).drop("_k")
    spliced = into_gap(benign, numbered, after_seq, clock)
    return strictly_increasing(spliced, clock).withColumn(clock, F.col("fixed")).drop("fixed")


def at_random(benign: DataFrame, malicious: DataFrame, seed: int = 1) -> DataFrame:
    """Malicious rows at seeded places among the benign ones."""
    n = benign.agg(F.max("seq").alias("_n"))
    placed = malicious.crossJoin(F.broadcast(n)).withColumn("_p", F.pmod(draw_int(seed, "seq"), F.col("_n") + 1)).drop("_n")
    both = benign.withColumn("_p", F.col("seq")).withColumn("_side", F.lit(0)).unionByName(placed.withColumn("_side", F.lit(1)))
    return renumbered(both, "_p", "_side", "seq").drop("_p", "_side")


def densify(series: DataFrame, percent: float) -> DataFrame:
    """src, dst, t: ticks added to each pair, each in the middle of the largest gap left (the first of equal ones)."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        ticks, added = [t for (t,) in rows], []
        gaps = [(a - b, a) for a, b in zip(ticks, ticks[1:], strict=False)]  # the largest first, then the first
        heapq.heapify(gaps)
        for _ in range(int(len(rows) * percent / 100) if gaps else 0):
            gap, a = gaps[0]
            middle = a + -gap // 2
            heapq.heapreplace(gaps, (a - middle, a))
            heapq.heappush(gaps, (middle - a + gap, middle))
            added.append((*key, middle))
        return added

    return fold_groups(series.select("src", "dst", "t"), ["src", "dst"], ["t"], fold, "src string, dst string, t long")


def sparsify(series: DataFrame, percent: float) -> DataFrame:
    """src, dst, t: ticks taken from each pair, each the later end of the smallest gap left (the first of equal ones)."""

    def fold(key: tuple, rows: list[tuple]) -> list[tuple]:
        ticks, gone = [t for (t,) in rows], []
        after = list(range(1, len(ticks) + 1))  # the next tick that is left
        gaps = [(b - a, k) for k, (a, b) in enumerate(zip(ticks, ticks[1:], strict=False))]
        heapq.heapify(gaps)
        while gaps and len(gone) < int(len(rows) * percent / 100):
            gap, k = heapq.heappop(gaps)
            late = after[k] if k >= 0 and after[k] is not None else None
            if late is None or late >= len(ticks) or ticks[late] - ticks[k] != gap:
                continue  # one of its ends is gone, or it has grown
            gone.append((*key, ticks[late]))
            after[k], after[late] = after[late], None
            if after[k] < len(ticks):
                heapq.heappush(gaps, (ticks[after[k]] - ticks[k], k))
        return gone

    return fold_groups(series.select("src", "dst", "t"), ["src", "dst"], ["t"], fold, "src string, dst string, t long")


def rewire(stream: DataFrame, tick: int, share: float, seed: int = 1) -> DataFrame:
    """src, dst, t, change: a seeded share of tick's edges removed, each replaced by a past neighbour of its source not met at tick."""
    now = stream.where(F.col("t") == tick).select("src", "dst").distinct()
    gone = now.where(draw(seed, "src", "dst") < share)
    past = stream.where(F.col("t") < tick).select("src", "dst").distinct().join(now, ["src", "dst"], "left_anti")
    rank = lambda salt: F.row_number().over(Window.partitionBy("src").orderBy(draw_int(salt, "dst"), "dst"))
    added = past.withColumn("k", rank(seed)).join(gone.withColumn("k", rank(seed + 1)).select("src", "k"), ["src", "k"], "left_semi").select("src", "dst")
    t = F.lit(tick).cast("long").alias("t")
    return gone.select("src", "dst", t, F.lit("removed").alias("change")).unionAll(added.select("src", "dst", t, F.lit("added").alias("change")))


def spread_over_out_edges(weights: DataFrame, node: str, number: int) -> DataFrame:
    """src, dst, extra: number dealt over a node's out-edges by whole shares, the rest to the first."""
    own = numbered(weights.where(F.col("src") == node), [], ["dst"], "_k", "_n")
    share = F.expr(f"{number} div _n")
    return own.select("src", "dst", (share + F.when(F.col("_k") == 0, number - share * F.col("_n")).otherwise(0)).alias("extra")).where("extra > 0")


def clique(nodes: DataFrame) -> DataFrame:
    """src, dst of every pair of the given nodes, the smaller one first: each node names those before it, so no pair is formed twice."""
    placed = cut_lineage(numbered(nodes.select("node").distinct(), [], ["node"]))
    later = placed.where("number > 0").select(F.col("node").alias("dst"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("number") - 1)).alias("number"))
    return later.join(placed.select(F.col("node").alias("src"), "number"), "number").select("src", "dst")


def even_ticks(stream: DataFrame, number: int, first: int | None = None) -> DataFrame:
    """t: number ticks at which to inject, evenly spaced from first (or the stream's first tick) up to its last."""
    span = stream.agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a is not null")
    held = span.withColumn("a", F.lit(first).cast("long")) if first is not None else span
    return held.select("a", "z", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("k")).select(F.expr(f"a + k * (z - a) div {number}").alias("t"))


def _drawn_pairs(firsts: pa.Array, lasts: pa.Array, ticks: int, limits: tuple[int, int], seed: int, rows: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in firsts, places in lasts and ticks of the pairs drawn, of nodes (node, name, block), a step of draws at a time."""
    a, b = ([x.field(k).to_pylist() for k in ("node", "name", "block")] for x in (firsts, lasts))
    order = {x: k for k, x in enumerate(sorted({*a[0], *b[0]}))}
    low, high = (np.array([order[x] for x in side[0]]) for side in (a, b))
    kinds = {x: k for k, x in enumerate({*a[2], *b[2]})}
    mine, yours = (np.array([kinds[x] for x in side[2]]) for side in (a, b))
    heads = [f"{seed}-{x}-".encode() for x in a[1]]
    tails = [(k, t, f"{x}-{t}".encode()) for k, x in enumerate(b[1]) for t in range(1, ticks + 1)]
    by_length = lambda held: [list(g) for _, g in groupby(sorted(range(len(held)), key=lambda k: len(held[k])), key=lambda k: len(held[k]))]
    for same_tails in by_length([x for _, _, x in tails]):
        for tail in (same_tails[k : k + rows] for k in range(0, len(same_tails), rows)):
            place, tick = np.array([tails[k][0] for k in tail]), np.array([tails[k][1] for k in tail], np.int32)
            for head in by_length(heads):
                step = max(1, rows // len(tail))
                for some in (np.array(head[k : k + step]) for k in range(0, len(head), step)):
                    some = some[low[some] < high[place].max()]
                    if not len(some):
                        continue
                    drawn = draws_of([heads[k] for k in some], [tails[k][2] for k in tail])
                    limit = np.where(mine[some, None] == yours[None, place], np.uint32(limits[0]), np.uint32(limits[1]))
                    i, j = np.nonzero((drawn < limit) & (low[some, None] < high[None, place]))
                    yield some[i], place[j], tick[j]


def block_model(nodes: DataFrame, ticks: int, inside: float, across: float, seed: int = 1, tile: int = 256) -> DataFrame:
    """src, dst, t of a synthetic stream over the given nodes (node, block): a pair's presence at a tick by its blocks' probability.

    Nodes stand in tiles by name, and what is dealt out is pairs of tiles: the digests of all their pairs and ticks are drawn as
    arrays, a step at a time, and only the pairs drawn become rows.
    """
    placed = numbered(nodes.where("node is not null").select("node", "block"), [], ["node", "block"])
    held = F.struct("node", F.col("node").cast("string").alias("name"), "block")
    tiles = cut_lineage(placed.groupBy(F.expr(f"number div {tile}").alias("tile")).agg(F.collect_list(held).alias("held")))
    n = tiles.count()
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * (n + 1) // 16)
    firsts = tiles.select("tile", F.col("held").alias("_a"), F.explode(F.sequence("tile", F.lit(n - 1).cast("long"))).alias("other")) if n else tiles.select("tile", F.col("held").alias("_a"), F.col("tile").alias("other"))
    dealt = firsts.join(tiles.select(F.col("tile").alias("other"), F.col("held").alias("_b")), "other").repartition(parts, "tile", "other")
    limits = least(inside), least(across)

    def draw_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, last = batch.column("_a")[k].values, batch.column("_b")[k].values
                names, held, size = (first.field("node"), last.field("node")), [], 0
                for found in chain(_drawn_pairs(first, last, ticks, limits, seed), [None]):
                    if found:
                        held, size = [*held, found], size + len(found[0])
                    if size >= 1 << 16 or size and not found:
                        i, j, t = (pa.array(np.concatenate(x)) for x in zip(*held, strict=True))
                        yield pa.RecordBatch.from_arrays([names[0].take(i), names[1].take(j), t], names=["src", "dst", "t"])
                        held, size = [], 0

    schema = dealt.select(F.col("_a")[0]["node"].alias("src"), F.col("_b")[0]["node"].alias("dst"), F.lit(1).alias("t")).schema
    return dealt.select("_a", "_b").mapInArrow(draw_all, schema)
