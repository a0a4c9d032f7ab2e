"""Sketch scores of an edge stream whose state has a fixed size: a table of cells, a version for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.microcluster import FRAME, cells_of, chi_score
from ..plans.ordering import cut_lineage, global_max, global_number
from .versions import Versions

CELL = ["kind", "row", "cell"]
STATE = "kind int, row int, cell long, a double, s double, j long, t long"


def cell_state(spark: SparkSession, folder: str) -> Versions:
    """Versions of the cells: kind, row, cell, current value a and total s, as of tick number j (tick t).

    A cell that no edge has met has no row, so a version has kinds x rows x columns rows at the most, whatever has passed.
    """
    return Versions(spark, folder, {"cells": STATE})


def score_batch(edges: DataFrame, state: DataFrame, rows: int, columns: int, fade: float | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(seq, score) of a batch (seq, t, u, v) and the state after it.

    An edge is worked on at the greatest tick so far, so a late one rewinds nothing; its score uses its own tick.
    Between ticks a cell's current value fades (without fade, it starts anew). A cell's updates are windows
    over the batch's counts by cell and tick with the cell's last state as their first row.
    """
    clock = state.agg(F.coalesce(F.max("j"), F.lit(0)).alias("j"), F.max("t").alias("t")).first()
    floor = F.lit(clock["t"]).cast("long")
    timed = cut_lineage(global_max(edges, F.greatest(F.col("t"), floor), "now"))
    new = global_number(timed.select(F.col("now").alias("t")).distinct().where(F.lit(True) if clock["t"] is None else F.col("t") > clock["t"]), "k", "t")
    numbers = new.select(F.col("t").alias("now"), (F.col("k") + clock["j"]).alias("j"))
    ticks = numbers if clock["t"] is None else numbers.unionAll(edges.sparkSession.createDataFrame([(clock["t"], clock["j"])], "now long, j long"))
    keyed = timed.join(ticks, "now").select("seq", "t", "j", F.inline(cells_of(rows, columns, seed, fade is not None)))
    counts = keyed.groupBy(*CELL, "j").agg(F.count("*").cast("double").alias("a"))
    # the state stands before the counts of its own tick
    held = counts.select(*CELL, "j", (2 * F.col("j") + 1).alias("at"), "a", F.col("a").alias("s")).unionAll(state.select(*CELL, "j", (2 * F.col("j")).alias("at"), "a", "s"))
    order = Window.partitionBy(*CELL).orderBy("at")
    near = order.rangeBetween(-2 * FRAME - 1, -1) if fade is not None else order.rangeBetween(-1, -1)
    history = F.collect_list(F.struct("j", "a")).over(near)
    faded = F.aggregate(history, F.lit(0.0), lambda z, x: z + x["a"] * (F.pow(F.lit(fade), F.col("j") - x["j"]) if fade is not None else F.lit(1.0)))
    before = held.withColumns({"before_a": faded, "before_s": F.coalesce(F.sum("s").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0))}).where("at % 2 = 1").select(*CELL, "j", "before_a", "before_s")
    k = F.row_number().over(Window.partitionBy(*CELL, "j").orderBy("seq"))
    stood = keyed.withColumn("_k", k).join(before, [*CELL, "j"])
    least = stood.groupBy("seq", "t", "kind").agg(F.min(F.col("before_a") + F.col("_k")).alias("a"), F.min(F.col("before_s") + F.col("_k")).alias("s"))
    scores = least.groupBy("seq").agg(F.max(chi_score(F.col("a"), F.col("s"), F.col("t"))).alias("score"))

    end = ticks.agg(F.max("j").alias("j"), F.max("now").alias("t")).first()
    if end["j"] is None:
        return scores, state
    passed = F.lit(end["j"]) - F.col("j")
    left = F.col("a") * (F.pow(F.lit(fade), passed) if fade is not None else (passed == 0).cast("double"))
    after = held.groupBy(*CELL).agg(F.sum(left).alias("a"), F.sum("s").alias("s"))
    return scores, after.select(*CELL, "a", "s", F.lit(end["j"]).cast("long").alias("j"), F.lit(end["t"]).cast("long").alias("t"))


def sketch_stream(stream: DataFrame, folder: str, rows: int = 2, columns: int = 1024, fade: float | None = None, seed: int = 7, **options: bool | str) -> StreamingQuery:
    """Score a stream of edges (seq, t, u, v) batch by batch into folder/out; folder (shared) keeps the state and the progress.

    State is rows x columns cells (three times that with fade: pairs, sources, targets), however long the
    stream: it has no row for a pair or a node. The result equals sketch_scores() of the whole stream.
    """
    held = cell_state(stream.sparkSession, f"{folder}/state")

    def apply(batch: DataFrame, number: int) -> None:
        edges = cut_lineage(batch.select("seq", F.col("t").cast("long").alias("t"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
        scores, after = score_batch(edges, held.before(number)["cells"], rows, columns, fade, seed)
        scores.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        held.put(number, cells=after)

    return stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(**(options or {"availableNow": True})).foreachBatch(apply).start()
