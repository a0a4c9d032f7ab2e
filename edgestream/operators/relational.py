"""Joins, set membership and aggregates over edge streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import RANGE, cut_lineage, global_last, global_number, in_order, with_scalars

#: Nodes of a block of complement_pairs().
BLOCK = 4096


def malicious_pairs(edges: DataFrame) -> DataFrame:
    return edges.where("label = 1").select("src", "dst").distinct()


def restrict_to_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(pairs, ["src", "dst"], "left_semi")


def subset_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (column node)."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def subset_bipartite(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return edges.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(right.select(F.col("node").alias("dst")), "dst", "left_semi")


def subset_time(edges: DataFrame, start: int, end: int, t: str = "t") -> DataFrame:
    return edges.where((F.col(t) >= start) & (F.col(t) < end))


def absent_pairs(candidates: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    return candidates.join(edges, on, "left_anti")


def join_scores(scores: DataFrame, labels: DataFrame, on: list[str], order: str = "seq") -> DataFrame:
    """Scores with labels; of repeated label keys the last by order counts."""
    last = labels.groupBy(*on).agg(F.max_by("label", order).alias("label"))
    return scores.join(last, on)


def fill_missing_labels(scores: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    return scores.join(labels, on, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def recent_neighbours(edges: DataFrame, n: int, clock: str = "clock") -> DataFrame:
    """seq, neighbours: the last n nodes that src met, in either role, strictly before this tick.

    Both directions form one event list a node; the frame ends before the tick, so it is an as-of join
    without a range join.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(0).alias("end")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(1).alias("end")))).alias("e"), "seq", clock).select("e.*", "seq", clock)
    w = Window.partitionBy("node").orderBy("seq", "end")
    # at most n entries of earlier ticks matter: the last n rows before the tick's first row
    history = F.collect_list("other").over(w.rowsBetween(-n, -1))
    first_of_tick = both.withColumn("h", history).withColumn("k", F.row_number().over(Window.partitionBy("node", clock).orderBy("seq", "end"))).where("k = 1").select("node", F.col(clock).alias("c"), "h")
    return edges.join(first_of_tick, (edges.src == first_of_tick.node) & (edges[clock] == first_of_tick.c)).select("seq", F.col("h").alias("neighbours"))


def nearest(points: DataFrame, targets: DataFrame, point: str = "position", target: str = "target") -> DataFrame:
    """target, position: the nearest point of each target, the upper one at a tie; no row where there is no point.

    Points and targets are merged into one order, cut into ranges, and the last point below and the first one
    above are carried along it: no pair is formed, and no task sees all rows.
    """
    merged = points.select(F.col(point).alias("x"), F.col(point).alias("p"), F.lit(None).cast("double").alias("q"), F.lit(0).alias("k")).unionAll(targets.select(F.col(target).alias("x"), F.lit(None), F.col(target).cast("double"), F.lit(1)))
    ordered = in_order(merged, "x", "k")  # a point at a target's place comes before it, so it counts as below
    found = global_last(global_last(ordered, {"below": "p"}, "_m", RANGE), {"above": "p"}, "_m", RANGE, backwards=True).where("k = 1")
    choice = F.when(F.col("below").isNull() | (F.col("above") - F.col("q") <= F.col("q") - F.col("below")), F.coalesce("above", "below")).otherwise(F.col("below"))
    return found.select(F.col("q").cast("long").alias(target), choice.alias(point)).where(F.col(point).isNotNull())


def edge_totals(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("total"))


def activity(edges: DataFrame, t: str = "t") -> DataFrame:
    return edges.groupBy(t).agg(F.sum("weight").alias("activity"))


def stream_stats(edges: DataFrame, t: str = "t") -> DataFrame:
    """size (distinct triplets), n_nodes, n_times, first_t, last_t."""
    triplets = edges.select("src", "dst", t).distinct()
    nodes = triplets.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.count_distinct("node").alias("n_nodes"))
    rest = triplets.agg(F.count("*").alias("size"), F.count_distinct(t).alias("n_times"), F.min(t).alias("first_t"), F.max(t).alias("last_t"))
    return rest.crossJoin(F.broadcast(nodes))


def empty_slices(edges: DataFrame, t: str = "t") -> DataFrame:
    """The ticks from 0 up to the last one, without it, that have no edge."""
    top = edges.agg(F.max(t).alias("top")).where("top > 0")
    spine = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") - 1)).alias(t))
    return spine.join(edges.select(t).distinct(), t, "left_anti")


def link_stream(edges: DataFrame, t: str = "t") -> DataFrame:
    """One row a triplet, the last weight written."""
    return edges.groupBy("src", "dst", t).agg(F.max_by("weight", "seq").alias("weight"))


def time_series_view(edges: DataFrame, t: str = "t") -> DataFrame:
    """src, dst, ticks: each pair's ticks, ascending, repeats kept."""
    return edges.groupBy("src", "dst").agg(F.sort_array(F.collect_list(t)).alias("ticks"))


def snapshot_rollup(scores: DataFrame, how: str = "max", t: str = "t") -> DataFrame:
    """t, score (max, mean or sum), attack (any label)."""
    agg = {"max": F.max, "mean": F.avg, "sum": F.sum}[how]
    return scores.groupBy(t).agg(agg("score").alias("score"), F.max("label").alias("attack"))


def bin_attack_label(edges: DataFrame, limit: int, t: str = "t") -> DataFrame:
    return edges.groupBy(t).agg(F.sum("label").alias("attacks")).withColumn("label", (F.col("attacks") >= limit).cast("int"))


def degree_stats(edges: DataFrame) -> DataFrame:
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return degree.agg(F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("std_degree"))


def delta_counts(edges: DataFrame, t: str = "t") -> DataFrame:
    return edges.groupBy(t, "src", "dst").agg(F.count("*").alias("n"))


def past_minus_present(edges: DataFrame, tick: int, t: str = "t") -> DataFrame:
    """node, other: neighbours before tick that the node does not meet at it."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"), t).select("e.*", t)
    return both.where(F.col(t) < tick).select("node", "other").subtract(both.where(F.col(t) == tick).select("node", "other"))


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def spine_labels(anomalous: DataFrame, edges: DataFrame, t: str = "t") -> DataFrame:
    """A label for each tick of the stream's span: 1 where anomalous."""
    span = edges.agg(F.min(t).alias("a"), F.max(t).alias("z")).where("a is not null")
    spine = span.select(F.explode(F.sequence("a", "z")).alias(t))
    marked = anomalous.select(t).distinct()
    return spine.join(marked, t, "left_anti").withColumn("label", F.lit(0)).unionAll(marked.withColumn("label", F.lit(1)))


def frequency_with_decay(counts: DataFrame, alpha: float, t: str = "t") -> DataFrame:
    """src, dst, f: counts by tick decayed to the last tick, (1 - alpha) * sum n * alpha^(last - t)."""
    held = with_scalars(counts, _top=F.max(t))
    return held.groupBy("src", "dst").agg(((1 - alpha) * F.sum(F.col("n") * F.pow(F.lit(alpha), F.col("_top") - F.col(t)))).alias("f"))


def top_frequencies(frequencies: DataFrame, most: int) -> DataFrame:
    return frequencies.orderBy(F.desc("f"), "src", "dst").limit(most)


def reciprocal_rank(scores: DataFrame, group: str, positive: str = "positive") -> DataFrame:
    """mrr: mean of one over the rank of each group's positive among its scores."""
    r = F.rank().over(Window.partitionBy(group).orderBy(F.desc("score")))
    return scores.withColumn("_r", r).where(positive).agg(F.avg(1 / F.col("_r")).alias("mrr"))


def largest_graphs(edges: DataFrame, number: int, graph: str = "graph") -> DataFrame:
    """graph, n_nodes, n_edges of the number largest graphs by nodes; the first one wins a tie."""
    nodes = edges.select(graph, F.explode(F.array("src", "dst")).alias("node")).groupBy(graph).agg(F.count_distinct("node").alias("n_nodes"))
    sizes = edges.groupBy(graph).agg(F.count("*").alias("n_edges")).join(nodes, graph)
    return sizes.orderBy(F.desc("n_nodes"), graph).limit(number).select(graph, "n_nodes", "n_edges")


def merged_graph(edges: DataFrame, chosen: DataFrame, graph: str = "graph") -> DataFrame:
    """src, dst, n: the edges of the chosen graphs as one graph, with their multiplicity."""
    return edges.join(chosen.select(graph), graph, "left_semi").groupBy("src", "dst").agg(F.count("*").alias("n"))


def merged_nodes(nodes: DataFrame, chosen: DataFrame, graph: str = "graph", order: str = "seq") -> DataFrame:
    """id, value: nodes of the chosen graphs by id, though ids start again in each graph; the last one's value stays."""
    held = nodes.join(chosen.select(graph), graph, "left_semi")
    return held.groupBy("id").agg(F.max_by("value", order).alias("value"))


def first_values(rows: DataFrame, column: str, number: int) -> DataFrame:
    """The rows that hold one of the column's first distinct values."""
    few = rows.select(column).distinct().orderBy(column).limit(number)
    return rows.join(F.broadcast(few), column, "left_semi")


def last_message(messages: DataFrame, t: str = "t") -> DataFrame:
    """node, x, last: the mean of each node's messages (arrays x) by dimension, and their latest time."""
    flat = messages.select("node", t, F.posexplode("x").alias("d", "v")).groupBy("node", "d").agg(F.avg("v").alias("v"), F.max(t).alias("last"))
    return flat.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("x"), F.max("last").alias("last"))


def positions_in(rows: DataFrame, table: DataFrame, value: str, order: str) -> DataFrame:
    """rows with position: the 1-based place of value among the table's distinct values in order of first occurrence, 0 if it is not there."""
    firsts = table.groupBy(value).agg(F.min(order).alias("_first"))
    placed = global_number(in_order(firsts, "_first", value), "position", "_m", RANGE).select(value, "position")
    return rows.join(placed, value, "left").withColumn("position", F.coalesce("position", F.lit(0).cast("long")))


def dense_adjacency(edges: DataFrame, size: int) -> DataFrame:
    """u, row: the symmetric 0/1 matrix of a graph of nodes 1 .. size, a row each (size bounds a row, not the edges)."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    held = both.where(F.col("v").between(1, size)).groupBy("u").agg(F.collect_set("v").alias("_s"))
    rows = edges.sparkSession.range(1, size + 1).select(F.col("id").alias("u")).join(held, "u", "left").withColumn("_s", F.sort_array(F.coalesce("_s", F.array().cast("array<bigint>"))))
    zeros = lambda n: F.array_repeat(F.lit(0), n.cast("int"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("_s"))  # one more than there are: zip_with fills up with null
    parts = F.zip_with(F.col("_s"), before, lambda s, p: F.when(s.isNull(), zeros(F.lit(size) - p)).otherwise(F.concat(zeros(s - p - 1), F.array(F.lit(1)))))
    return rows.select("u", F.flatten(parts).alias("row"))


def complement_pairs(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst: all pairs of a left and another right node without an edge, which are as many as their product.

    The right side is dealt into blocks of about BLOCK nodes. A left node meets each block once, as one array, from
    which those it has an edge to are taken; so no row holds more than a block, and no pair is joined to be dropped.
    """
    others = cut_lineage(right.select("node").distinct())
    blocks = max(1, -(-others.count() // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias("_block")
    every = others.groupBy(block("node")).agg(F.collect_set("node").alias("_all"))
    known = edges.groupBy(F.col("src").alias("node"), block("dst")).agg(F.collect_set("dst").alias("_known"))
    asked = left.select("node").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    held = asked.join(known, ["node", "_block"], "left").join(every, "_block")
    rest = F.array_except("_all", F.array_append(F.coalesce("_known", F.array().cast("array<string>")), F.col("node")))
    return held.select(F.col("node").alias("src"), F.explode(rest).alias("dst"))


def injected_stream(stream: DataFrame, changes: DataFrame, t: str = "t") -> DataFrame:
    """src, dst, t, label: the stream without the removed and with the added triplets of changes (src, dst, t, change);
    a tick with a change is labelled."""
    kept = stream.select("src", "dst", t).distinct().join(changes.where("change = 'removed'").select("src", "dst", t), ["src", "dst", t], "left_anti")
    grown = kept.unionByName(changes.where("change = 'added'").select("src", "dst", t)).distinct()
    marked = changes.select(t).distinct().withColumn("label", F.lit(1))
    return grown.join(marked, t, "left").select("src", "dst", t, F.coalesce("label", F.lit(0)).alias("label"))


def members(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, members: the ascending values of each group."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("members"))


def group_sizes(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def pool_queries(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """query, node: every node of a pool beside each of a few stated queries, which travel as one array."""
    few = queries.agg(F.array_sort(F.collect_set("query")).alias("_q"))
    return pool.select("node").distinct().crossJoin(F.broadcast(few)).select(F.explode("_q").alias("query"), "node")


def first_rows(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Of the rows of each key the first one, as where vectors are saved once a node."""
    held = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return held.select("_row.*")
