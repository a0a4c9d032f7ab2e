"""Structured Streaming forms: file and row streams into bins, keyed scores with state, late-data policies."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.microcluster import chi_score
from ..plans.ordering import cut_lineage
from .versions import Versions

EDGE = "seq long, t long, src string, dst string, label int"


def edge_file_stream(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """Lines "t src dst [label]" as they arrive; an unreadable line is skipped, a missing label is 0."""
    f = F.split(F.trim("value"), r"\s+" if separator == " " else separator)
    rows = spark.readStream.text(path).where(F.size(f) >= 3)
    read = rows.select(f[0].try_cast("long").alias("t"), f[1].alias("src"), f[2].alias("dst"), F.coalesce(F.get(f, F.lit(3)).try_cast("int"), F.lit(0)).alias("label"))
    return read.where("t is not null")


def tumbling_counts(events: DataFrame, ts: str, width: str, delay: str) -> DataFrame:
    """start, n, attacks by event-time window; rows later than delay behind are dropped by the watermark."""
    held = events.withWatermark(ts, delay).groupBy(F.window(ts, width))
    return held.agg(F.count("*").alias("n"), F.sum("label").alias("attacks")).select(F.col("window.start").alias("start"), "n", "attacks")


def session_counts(events: DataFrame, ts: str, delay: str, gap: str = "300 seconds") -> DataFrame:
    """stream_id, start, end, n by sessions; a gap of 301 seconds ends one, as does gap_rows()."""
    held = events.withWatermark(ts, delay).groupBy("stream_id", F.session_window(ts, gap))
    return held.agg(F.count("*").alias("n")).select("stream_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def binned_scores(edges: DataFrame, width: int, limit: int, late: str = "fold") -> DataFrame:
    """stream_id, bin, n, attacks, label: closed bins of each stream's ticks, the empty ones between as well.

    late "fold": an edge of a closed bin counts in the stream's current bin (never dropped); "drop": it
    does not count. A bin is closed, and emitted, when a later one begins.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, now, n, attacks = state.get if state.exists else (None, 0, 0, 0)
        out = []
        for frame in frames:
            for t, label in zip(frame["t"], frame["label"], strict=True):
                first = t if first is None else first
                b = max(0, int(t - first) // width)
                while b > now:
                    out.append((key[0], now, n, attacks, int(attacks >= limit)))
                    now, n, attacks = now + 1, 0, 0
                if b == now or late == "fold":
                    n, attacks = n + 1, attacks + int(label)
        state.update((int(first), now, n, attacks))
        yield pd.DataFrame(out, columns=["stream_id", "bin", "n", "attacks", "label"])

    kind = edges.schema["stream_id"].dataType.simpleString()
    return edges.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, bin long, n long, attacks long, label int", "first long, now long, n long, attacks long", "append", GroupStateTimeout.NoTimeout)


def microcluster_scores(edges: DataFrame) -> DataFrame:
    """seq, score of each edge as it arrives, from its pair's count in the tick and so far (state: three numbers a pair).

    A late tick does not rewind the state; its score uses the late tick. A pair's rows of a micro-batch are
    put in order together, whichever files they came from. sketch_stream() has a state that does not grow with the pairs.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, a, s = state.get if state.exists else (1, 0.0, 0.0)
        frame = pd.concat(list(frames)).sort_values("seq")
        scores = []
        for t in frame["t"]:
            if t > now:
                now, a = int(t), 0.0
            a, s = a + 1, s + 1
            scores.append(0.0 if t <= 1 else float(((a - s / t) * t) ** 2 / (s * (t - 1))))
        state.update((now, a, s))
        yield pd.DataFrame({"seq": frame["seq"], "score": scores})

    return edges.groupBy("src", "dst").applyInPandasWithState(run, "seq long, score double", "now long, a double, s double", "append", GroupStateTimeout.NoTimeout)


PAIRS = "src string, dst string, now long, a double, s double"


def score_pairs(edges: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, score) of a batch (seq, t, src, dst) and the state after it (PAIRS), as microcluster_scores() has them.

    A pair's state stands before its rows of the batch, in one window for all pairs: no function is called for a pair.
    """
    one = F.lit(1.0)
    own = edges.select("src", "dst", F.lit(1).alias("side"), "seq", "t", F.greatest("t", F.lit(1).cast("long")).alias("now"), one.alias("a"), one.alias("s"))
    before = state.select("src", "dst", F.lit(0).alias("side"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("t"), "now", "a", "s")
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy("side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    timed = own.unionAll(before).withColumns({"now": F.max("now").over(so_far("src", "dst")), "s": F.sum("s").over(so_far("src", "dst"))})
    held = cut_lineage(timed.withColumn("a", F.sum("a").over(so_far("src", "dst", "now"))))
    scores = held.where("side = 1").select("seq", chi_score(F.col("a"), F.col("s"), F.col("t")).alias("score"))
    after = held.groupBy("src", "dst").agg(F.max_by(F.struct("now", "a", "s"), F.struct("side", "seq")).alias("last"))
    return scores, after.select("src", "dst", "last.*")


def microcluster_stream(stream: DataFrame, folder: str, **options: bool | str) -> StreamingQuery:
    """Score a stream of edges (seq, t, src, dst) batch by batch into folder/out, as microcluster_scores() does.

    The state is a table with a row for each pair in folder (shared), a version for each micro-batch; microcluster_scores()
    calls a function for each pair of a micro-batch, which suits batches of few pairs.
    """
    held = Versions(stream.sparkSession, f"{folder}/state", {"pairs": PAIRS})

    def apply(batch: DataFrame, number: int) -> None:
        edges = batch.select("seq", F.col("t").cast("long").alias("t"), "src", "dst")
        scores, after = score_pairs(edges, held.before(number)["pairs"])
        scores.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        held.put(number, pairs=after)

    return stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(**(options or {"availableNow": True})).foreachBatch(apply).start()


def in_batches(stream: DataFrame, apply: Any, checkpoint: str) -> Any:
    """A query that hands each micro-batch (frame, id) to apply, exactly once per id if apply is idempotent by id."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).start()
