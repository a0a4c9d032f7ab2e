"""Walks, neighbour samples and batches, all by seeded draws, so that reruns and lost executors repeat them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, draw_int
from ..plans.ordering import RANGE, cut_lineage, global_last, global_number, global_sum, in_order, with_scalars


def neighbour_table(edges: DataFrame) -> DataFrame:
    """u, k, v, fan: each node's distinct out-neighbours, numbered from 0."""
    w = Window.partitionBy("u")
    return edges.select("u", "v").distinct().withColumns({"k": F.row_number().over(w.orderBy("v")) - 1, "fan": F.count("*").over(w)})


def walks(edges: DataFrame, starts: DataFrame, length: int, seed: int = 1, restart: float = 0.0, stop: float = 0.0, per_start: int = 1, cut_every: int = 8) -> DataFrame:
    """start, walk, path: per_start uniform walks of up to length steps from each start (column node).

    At each step a walk goes back to its start with probability restart, or ends for good with probability
    stop (a geometric length); it also ends at a node without out-edges. All walks advance together, a
    join a step, on a table of numbered neighbours.
    """
    table = cut_lineage(neighbour_table(edges))
    fans = table.where("k = 0").select(F.col("u").alias("at"), "fan")
    steps = table.select(F.col("u").alias("at"), F.col("k").alias("pick"), "v")
    now = starts.select(F.col("node").alias("start")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(per_start - 1))))
    now = now.withColumns({"path": F.array("start"), "at": F.col("start")})
    for k in range(length):
        keys = ("start", "walk", F.lit(k))
        back = draw(f"{seed}r", *keys) < restart if restart else F.lit(False)
        ends = draw(f"{seed}s", *keys) < stop if stop else F.lit(False)
        now = now.withColumn("at", F.when(ends, F.lit(None)).otherwise(F.col("at")))
        now = now.withColumn("back", F.coalesce(back & F.col("at").isNotNull(), F.lit(False)))
        moved = now.join(fans, "at", "left").withColumn("pick", F.pmod(draw_int(seed, *keys), F.col("fan")).cast("int")).join(steps, ["at", "pick"], "left")
        following = F.when(F.col("back"), F.col("start")).otherwise(F.col("v"))
        moved = moved.withColumn("next", following)
        now = moved.select("start", "walk", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("next"))).alias("path"), F.col("next").alias("at"))
        if (k + 1) % cut_every == 0 and k + 1 < length:
            now = cut_lineage(now)
    return now.select("start", "walk", "path")


def walk_words(walked: DataFrame) -> DataFrame:
    """node, n: how often each node stands in the corpus of walks."""
    return walked.select(F.explode("path").alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def walk_lines(walked: DataFrame) -> DataFrame:
    """line: each walk as a line of text, for files of a walk corpus."""
    return walked.select(F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("line"))


def context_pairs(walked: DataFrame) -> DataFrame:
    """node, context: the start of each walk with every later node that is another one."""
    return walked.select(F.col("start").alias("node"), F.explode(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(1)))).alias("context")).where("node <> context")


def neighbour_reservoirs(edges: DataFrame, slots: int, seed: int = 1) -> DataFrame:
    """node, slot, other: each node's slots after all edges (seq, src, dst).

    A slot takes a node's d-th neighbour (in either role, repeats included) with probability 1 / d, so it holds
    the last arrival whose draw was low enough: no state has to be kept, and prefixes of a stream answer alike.
    """
    both = edges.select("seq", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.lit(1).alias("end"), F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("seq", "e.*")
    arrived = both.withColumn("d", F.row_number().over(Window.partitionBy("node").orderBy("seq", "end")))
    tried = arrived.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).where(draw(seed, "node", "slot", "d") * F.col("d") < 1)
    return tried.groupBy("node", "slot").agg(F.max_by("other", "d").alias("other"))


def regenerated_walks(old: DataFrame, edges: DataFrame, touched: DataFrame, length: int, seed: int = 1, per_start: int = 1) -> DataFrame:
    """The corpus after an update: walks of touched starts (column node) are dropped and walked anew on the grown graph."""
    kept = old.join(touched.select(F.col("node").alias("start")).distinct(), "start", "left_anti")
    return kept.unionByName(walks(edges, touched, length, seed, per_start=per_start))


def hops(edges: DataFrame, roots: DataFrame, fanouts: list[int], seed: int = 1) -> DataFrame:
    """root, hop, place, node: fanouts[h] sampled neighbours of every node of the hop before; hop 0 is the root.

    Neighbours are drawn with replacement, a draw for each place; a node without out-edges has none.
    """
    table = neighbour_table(edges)
    fans = table.where("k = 0").select(F.col("u").alias("node"), "fan")
    steps = table.select(F.col("u").alias("node"), F.col("k").alias("pick"), "v")
    now = roots.select(F.col("node").alias("root"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("place"), "node")
    out = now
    for h, fanout in enumerate(fanouts, 1):
        wide = now.join(fans, "node").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1)))).withColumn("place", F.col("place") * fanout + F.col("i"))
        picked = wide.withColumn("pick", F.pmod(draw_int(seed, "root", F.lit(h), "place"), F.col("fan")).cast("int"))
        now = picked.join(steps, ["node", "pick"]).select("root", F.lit(h).alias("hop"), "place", F.col("v").alias("node"))
        out = out.unionAll(now)
    return out


def weighted_choice(weights: DataFrame, draws: DataFrame, draw_column: str = "x") -> DataFrame:
    """draws with node: the one whose share of the summed weights (node, weight) a draw x in [0, 1) falls into.

    Weights are added up in order of the node, and draws merged into that order: the upper end of a draw's
    share is carried back to it, so neither a table of shares nor a pair of draw and node is formed.
    Decimal weights are added up exactly, whatever the ranges; sums of others end in digits that depend on them.
    """
    exact = weights.schema["weight"].dataType.typeName() == "decimal"
    held = weights.where("weight > 0").select("node", (F.col("weight") if exact else F.col("weight").cast("double")).alias("weight"))
    upto = global_sum(in_order(held, "node"), F.col("weight"), "upto", "_m", RANGE).withColumn("upto", F.col("upto").cast("double"))
    total = upto.agg(F.max("upto").alias("_total"))
    marks = upto.select(F.col("upto").alias("at"), F.col("node").alias("_node"), F.lit(0).alias("_side"), F.lit(None).cast(draws.schema.simpleString()).alias("row"))
    asked = draws.crossJoin(F.broadcast(total)).select((F.col(draw_column) * F.col("_total")).alias("at"), F.lit(None).cast(held.schema["node"].dataType).alias("_node"), F.lit(1).alias("_side"), F.struct(*draws.columns).alias("row"))
    ordered = in_order(marks.unionAll(asked), "at", "_side")  # a draw at an upper end belongs to the next share
    return global_last(ordered, {"node": "_node"}, "_m", RANGE, backwards=True).where("_side = 1").select("row.*", "node")


def weighted_neighbours(edges: DataFrame, queries: DataFrame, seed: int = 1) -> DataFrame:
    """query, node, other: one weighted draw among each queried node's out-edges (u, v, w); the table is a running sum by node.

    A query may carry an edge that is not in the graph yet (extra_v, extra_w): it joins the draw at its source.
    """
    virtual = queries.where("extra_v is not null").select("query", F.col("node").alias("u"), F.col("extra_v").alias("v"), F.col("extra_w").alias("w"))
    merged = edges.groupBy("u", "v").agg(F.sum("w").alias("w"))
    own = queries.select("query", F.col("node").alias("u")).join(merged, "u").select("query", "u", "v", "w").unionAll(virtual)
    own = own.groupBy("query", "u", "v").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("query")
    shares = own.withColumns({"upto": F.sum("w").over(w.orderBy("v")), "total": F.sum("w").over(w)})
    hit = shares.where(F.col("upto") > draw(seed, "query") * F.col("total"))
    return hit.groupBy("query", F.col("u").alias("node")).agg(F.min_by("v", "upto").alias("other"))


def negative_samples(edges: DataFrame, per_edge: int, seed: int = 1, power: float = 0.75) -> DataFrame:
    """u, v, i, negative: per_edge nodes for each edge, drawn by degree to the power, with replacement."""
    both = edges.select(F.explode(F.array("u", "v")).alias("node"))
    weights = both.groupBy("node").agg(F.round(F.pow(F.count("*").cast("double"), F.lit(power)), 6).cast("decimal(18, 6)").alias("weight"))
    draws = edges.select("u", "v").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1)))).withColumn("x", draw(seed, "u", "v", "i"))
    return weighted_choice(weights, draws).select("u", "v", "i", F.col("node").alias("negative"))


def shuffled_batches(rows: DataFrame, key: str, size: int, seed: int = 1, epoch: int = 0) -> DataFrame:
    """rows with batch and place: a seeded order of each epoch, cut into batches of size; the last one may be shorter."""
    ordered = in_order(rows.withColumn("_d", draw_int(seed, F.lit(epoch), key)), "_d", key)
    n = F.col("_k") - 1
    return global_number(ordered, "_k", "_m", RANGE).withColumns({"batch": F.floor(n / size), "place": F.pmod(n, F.lit(size))}).drop("_d", "_m", "_k")


def cross_cluster_pairs(clusters: DataFrame, edges: DataFrame, number: int, seed: int = 1, tries: int = 4) -> DataFrame:
    """u, v: number pairs (u < v) of nodes of different clusters (node, cluster) without an edge, as fake edges.

    Both ends of a try are drawn by their place among all nodes; tries * number of them are made, and the first
    number that hold are taken. Fewer come back only where the graph has hardly any such pair.
    """
    placed = with_scalars(global_number(in_order(clusters, "node"), "_k", "_m", RANGE).select("node", "cluster", (F.col("_k") - 1).alias("place")), _n=F.count("*"))
    count = placed.select("_n").limit(1)
    asked = clusters.sparkSession.range(number * tries).crossJoin(F.broadcast(count))
    drawn = asked.select("id", F.pmod(draw_int(f"{seed}a", "id"), F.col("_n")).alias("a"), F.pmod(draw_int(f"{seed}b", "id"), F.col("_n")).alias("b"))
    left = placed.select(F.col("place").alias("a"), F.col("node").alias("x"), F.col("cluster").alias("cx"))
    right = placed.select(F.col("place").alias("b"), F.col("node").alias("y"), F.col("cluster").alias("cy"))
    pairs = drawn.join(left, "a").join(right, "b").where("cx <> cy").select("id", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    known = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    fresh = pairs.groupBy("u", "v").agg(F.min("id").alias("id")).join(known, ["u", "v"], "left_anti")
    return fresh.orderBy("id").limit(number).select("u", "v")


def sample_rows(rows: DataFrame, key: str, number: int, seed: int = 1) -> DataFrame:
    """number rows without replacement: those of the lowest draws."""
    return rows.withColumn("_d", draw_int(seed, key)).orderBy("_d", key).limit(number).drop("_d")


def noisy(vectors: DataFrame, key: str, x: str = "x", most: float = 0.1, seed: int = 1) -> DataFrame:
    """vectors with uniform noise from 0 to most added to each value of x."""
    return vectors.withColumn(x, F.transform(x, lambda v, i: v + most * draw(seed, F.col(key), i)))
