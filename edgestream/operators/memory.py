"""Node-memory scores: decayed feature memories of an edge's ends, and the online z-score model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_distance
from .embedding import drift_score

DECAY = 0.5
#: Updates of a chunk of a node's history, and updates before it that its fold begins with. The decay is at most one
#: half, so what lies before these weighs below 2^-1280: less than the smallest double holds of any value up to 2^200.
CHUNK = 1 << 14
BEFORE = 1280
#: Values of a feature vector.
WIDTH = 3


def _ends(featured: DataFrame) -> DataFrame:
    """Two updates an edge, the source's first: node, seq, end, f, a (updates of the node before)."""
    both = featured.select("seq", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("end")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("end")))).alias("e"), "f").select("e.node", "seq", "e.end", "f")
    return both.withColumn("a", F.row_number().over(Window.partitionBy("node").orderBy("seq", "end")) - 1)


def _remembered(updates: DataFrame, width: int) -> DataFrame:
    """updates (node, a, f, ...) with memory: the first f as it is, then d m + (1 - d) f, d = .5 (1 - .3 a / (a + 10)).

    A history is cut into chunks, each followed in order by one task from BEFORE updates before its own. Small values are
    kept too: a feature that stays 0 leaves the memory at what has decayed, however little that is.
    """
    own = F.expr(f"a div {CHUNK}")
    chunks = F.when(F.col("a") % CHUNK >= CHUNK - BEFORE, F.array(own, own + 1)).otherwise(F.array(own))
    values = {f"_x{k}": F.coalesce(F.col("f")[k], F.lit(0.0)) for k in range(width)}
    begins = F.col("a") == F.greatest(F.col("_c") * CHUNK - BEFORE, F.lit(0))
    laid = updates.withColumns(values).withColumn("_c", F.explode(chunks)).withColumns({"_begins": begins, "_kept": own == F.col("_c")})
    names = updates.columns

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [0.0] * width
        for batch in batches:
            a, begins = batch.column("a").to_numpy(zero_copy_only=False), batch.column("_begins").to_numpy(zero_copy_only=False)
            d = DECAY * (1 - 0.3 * (a / (a + 10)))
            out = np.empty((len(a), width))
            for k in range(width):
                x = batch.column(f"_x{k}").to_numpy(zero_copy_only=False)
                m, new = held[k], []
                for fade, y, first in zip(d.tolist(), np.where(begins, x, (1 - d) * x).tolist(), begins.tolist(), strict=True):
                    m = y if first else fade * m + y
                    new.append(m)
                held[k], out[:, k] = m, new
            kept = batch.column("_kept").to_numpy(zero_copy_only=False)
            memory = pa.array(list(out[kept]), pa.list_(pa.float64()))
            rows = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), memory], names=[*names, "memory"])

    schema = updates.select("*", F.array(F.lit(0.0)).alias("memory")).schema
    return laid.repartition("node", "_c").sortWithinPartitions("node", "_c", "a").mapInArrow(follow, schema)


def memories(featured: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, seq, end, memory after each update (rows seq, src, dst, f array<double> of width values)."""
    return _remembered(_ends(featured), width).select("node", "seq", "end", "memory")


def edge_scores(featured: DataFrame, width: int = WIDTH) -> DataFrame:
    """seq, score: distance of the two ends' memories after the edge's own updates."""
    m = memories(featured, width)
    both = m.groupBy("seq").agg(F.max(F.when(F.col("end") == 0, F.col("memory"))).alias("p"), F.max(F.when(F.col("end") == 1, F.col("memory"))).alias("q"))
    return both.select("seq", l2_distance(F.col("p"), F.col("q")).alias("score"))


def window_scores(windowed: DataFrame, lag: int = 2, width: int = WIDTH) -> DataFrame:
    """window, score of rows (window, seq, src, dst, f): how far the memories moved since lag windows before.

    Windows overlap, and an edge updates again in each. The score is .5 p75 + .3 median + .2 mean of the
    distances over the nodes of both windows; 0 for the first windows and where none is shared.
    """
    both = windowed.select("window", "seq", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("end")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("end")))).alias("e"), "f").select("window", "seq", "e.node", "e.end", "f")
    order = Window.partitionBy("node").orderBy("window", "seq", "end")
    held = _remembered(both.withColumn("a", F.row_number().over(order) - 1), width)
    last = held.groupBy("node", "window").agg(F.max_by("memory", "a").alias("m"))
    before = last.select("node", (F.col("window") + lag).alias("window"), F.col("m").alias("m0"))
    moved = last.join(before, ["node", "window"]).withColumn("d", l2_distance(F.col("m"), F.col("m0")))
    scores = moved.groupBy("window").agg((0.5 * F.percentile("d", F.lit(0.75)) + 0.3 * F.median("d") + 0.2 * F.avg("d")).alias("score"))
    return windowed.select("window").distinct().join(scores, "window", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def z_scores(log: DataFrame, threshold: float, compat: bool = False, stream: str = "stream_id") -> DataFrame:
    """seq, predicted of rows (stream, seq, idle, depth_delta, time_delta): learns from rows it calls benign.

    Sequential by nature, so each stream is folded in order in a task of its own. compat keeps the
    published model's variance update and its use of the depth alone; the default has Welford's update
    and both deviations. Idle rows are 0 and do not count; the first two others only train.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        mean, var, size, out = [0.0, 0.0], [0.0, 0.0], 0, []
        for idle, *deltas in zip(frame["idle"], frame["depth_delta"], frame["time_delta"], strict=True):
            if idle:
                out.append(0)
                continue
            size += 1
            malicious = False
            if size >= 3:
                var = [v or 0.001 for v in var]
                z = [abs(x - m) / v**0.5 for x, m, v in zip(deltas, mean, var, strict=True)]
                malicious = (z[0] if compat else sum(z)) / 2 > threshold
            out.append(int(malicious))
            if not malicious:
                new = [m + (x - m) / (size + 1) for x, m in zip(deltas, mean, strict=True)]
                centre = var if compat else mean
                var = [max(0.0, ((size - 1) * v + (x - c) * (x - n)) / size) if not compat else ((size - 1) * v + (x - c) * (x - n)) / size for x, v, c, n in zip(deltas, var, centre, new, strict=True)]
                mean = new
        return pd.DataFrame({"seq": frame["seq"], "predicted": out})

    return log.select(stream, "seq", "idle", "depth_delta", "time_delta").groupBy(stream).applyInPandas(run, "seq long, predicted int")


def node_drift(featured: DataFrame, edges: DataFrame, t: str = "t", width: int = WIDTH) -> DataFrame:
    """node, t, score of each tick that a node meets after its first: (2 - drift - recovery) / 4.

    Drift compares its memory at the tick's end with the one at the end of its tick before, recovery with the mean
    memory of those it met in the tick.
    """
    at = edges.select("seq", t)
    last = memories(featured, width).join(at, "seq").groupBy("node", t).agg(F.max_by("memory", F.struct("seq", "end")).alias("m"))
    held = last.withColumn("before", F.lag("m").over(Window.partitionBy("node").orderBy(t)))
    met = edges.select(t, F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select(t, "e.*").distinct()
    others = met.join(last.withColumnsRenamed({"node": "other", "m": "o"}), [t, "other"])
    rebuilt = others.groupBy("node", t).agg(F.array(*(F.avg(F.col("o")[k]) for k in range(width))).alias("rebuilt"))
    return held.where("before is not null").join(rebuilt, ["node", t]).select("node", t, drift_score(F.col("m"), F.col("before"), F.col("rebuilt")).alias("score"))
