"""Neighbour reservoirs and a walk corpus that follow an edge stream: a batch repairs the walks it changes, and emits those alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.draws import draw, draw_int
from ..plans.ordering import cut_lineage
from .versions import Versions

SLOTS = "node string, slot int, other string"
SEEN = "node string, d long"
WALKS = "start string, walk int, path array<string>"


def arrived(edges: DataFrame, seen: DataFrame, slots: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(node, slot, other) that a batch (seq, src, dst) puts into slots, and (node, d) of its nodes: arrivals so far.

    A slot takes a node's d-th neighbour with probability 1 / d, by a draw of (node, slot, d), as in
    neighbour_reservoirs(); so all that has to be known of a node's past is its number of arrivals.
    """
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.lit(1).alias("end"), F.col("dst").alias("node"), F.col("src").alias("other")))
    both = edges.select("seq", F.explode(ends).alias("e")).select("seq", "e.*")
    placed = both.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("seq", "end")))
    held = placed.join(seen.withColumnRenamed("d", "_before"), "node", "left").withColumn("d", F.coalesce("_before", F.lit(0).cast("long")) + F.col("k"))
    tried = held.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).where(draw(seed, "node", "slot", "d") * F.col("d") < 1)
    return tried.groupBy("node", "slot").agg(F.max_by("other", "d").alias("other")), held.groupBy("node").agg(F.max("d").alias("d"))


def step_slot(k: int | str, slots: int, seed: int):
    """The slot that a walk's k-th step reads: a draw of (start, walk, k)."""
    return F.pmod(draw_int(seed, "start", "walk", F.col(k) if isinstance(k, str) else F.lit(k)), F.lit(slots)).cast("int")


def continued(begun: DataFrame, reservoirs: DataFrame, length: int, slots: int, seed: int = 1) -> DataFrame:
    """start, walk, path of length steps from beginnings of any length: a join with the reservoirs a step."""
    table = reservoirs.select(F.col("node").alias("_at"), F.col("slot").alias("_slot"), "other")
    now = begun
    for k in range(length):
        moved = now.withColumns({"_at": F.when(F.size("path") == k + 1, F.element_at("path", -1)), "_slot": step_slot(k, slots, seed)})
        now = moved.join(table, ["_at", "_slot"], "left").select("start", "walk", F.when(F.col("other").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("other"))).alias("path"))
    return now


def reservoir_walks(reservoirs: DataFrame, length: int, slots: int, per_start: int = 1, seed: int = 1) -> DataFrame:
    """start, walk, path: walks from every node over the slots of a reservoir (node, slot, other)."""
    starts = reservoirs.select(F.col("node").alias("start")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(per_start - 1))))
    return continued(starts.withColumn("path", F.array("start")), reservoirs, length, slots, seed)


def repaired(walks: DataFrame, changed: DataFrame, length: int, slots: int, seed: int = 1) -> DataFrame:
    """start, walk, path of the walks that read a changed slot (node, slot), cut before their first such step.

    The walks' steps are their own index: (node, slot) of each step is known from the path and the draws.
    """
    steps = walks.select("start", "walk", F.posexplode(F.slice("path", 1, length)).alias("k", "node"))
    hit = steps.withColumn("slot", step_slot("k", slots, seed)).join(changed.select("node", "slot"), ["node", "slot"], "left_semi")
    first = hit.groupBy("start", "walk").agg(F.min("k").alias("k"))
    return walks.join(first, ["start", "walk"]).select("start", "walk", F.slice("path", F.lit(1), F.col("k") + 1).alias("path"))


def walk_stream(stream: DataFrame, folder: str, length: int = 4, slots: int = 4, per_start: int = 1, seed: int = 1) -> StreamingQuery:
    """Follow a stream of edges (seq, src, dst): folder/out has, by batch, the walks that are new or have changed.

    folder/state keeps the arrivals of each node, its slots, and the walks. After every batch these are what
    neighbour_reservoirs() and reservoir_walks() give for all edges so far, but a batch walks on only from where
    a slot that a walk reads has changed: its joins are of the changed slots and walks, beside one scan of the state.
    """
    state = Versions(stream.sparkSession, f"{folder}/state", {"seen": SEEN, "slots": SLOTS, "walks": WALKS})

    def apply(batch: DataFrame, number: int) -> None:
        edges = batch.select("seq", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
        old = state.before(number)
        put, counts = arrived(edges, old["seen"], slots, seed)
        put, counts = cut_lineage(put), cut_lineage(counts)
        held = old["slots"].withColumnRenamed("other", "_old")
        changed = cut_lineage(put.join(held, ["node", "slot"], "left").where(~F.col("other").eqNullSafe(F.col("_old"))))
        reservoirs = cut_lineage(old["slots"].join(put, ["node", "slot"], "left_anti").unionByName(put))
        fresh = counts.join(old["seen"], "node", "left_anti").select(F.col("node").alias("start")).withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(per_start - 1)))).withColumn("path", F.array("start"))
        begun = repaired(old["walks"], changed, length, slots, seed).unionByName(fresh)
        told = cut_lineage(continued(begun, reservoirs, length, slots, seed))
        told.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        seen = old["seen"].join(counts, "node", "left_anti").unionByName(counts)
        walks = old["walks"].join(told, ["start", "walk"], "left_anti").unionByName(told)
        state.put(number, seen=seen, slots=reservoirs, walks=walks)

    return stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(apply).start()
