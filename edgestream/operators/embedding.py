"""Scores over node embeddings: edge encodings against cluster centres, neighbour aggregation, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, encode_edge, l2_distance


def encoded_edges(edges: DataFrame, vectors: DataFrame, kind: str = "hadamard") -> DataFrame:
    """u, v, code of rows u, v from vectors (node, x): two equi-joins."""
    left = vectors.select(F.col("node").alias("u"), F.col("x").alias("_p"))
    right = vectors.select(F.col("node").alias("v"), F.col("x").alias("_q"))
    return edges.join(left, "u").join(right, "v").select("u", "v", encode_edge(F.col("_p"), F.col("_q"), kind).alias("code"))


def class_centres(vectors: DataFrame, group: str = "label") -> DataFrame:
    """group, centre, n: the mean of each dimension."""
    flat = vectors.select(group, F.posexplode("x").alias("d", "v")).groupBy(group, "d").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return flat.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centre"), F.max("n").alias("n"))


def nearest_centre(vectors: DataFrame, centres: DataFrame, group: str = "label") -> DataFrame:
    """node, centre, distance: the nearest of a few centres (a stated set; the smaller group at a tie), held in one row as an array."""
    few = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col("centre").alias("c")))).alias("_all"))
    distance = F.transform("_all", lambda s: F.struct(l2_distance(F.col("x"), s["c"]).alias("d"), s["g"].alias("g")))
    return vectors.crossJoin(F.broadcast(few)).withColumn("_best", F.array_min(distance)).select("node", F.col("_best.g").alias("centre"), F.col("_best.d").alias("distance"))


def moved_centre(old: Column, n_old: Column, new: Column, n_new: Column, alpha: float) -> Column:
    """(a c0 n0 + (1 - a) c n) / (a n0 + (1 - a) n) in each dimension."""
    return F.zip_with(old, new, lambda p, q: (alpha * p * n_old + (1 - alpha) * q * n_new) / (alpha * n_old + (1 - alpha) * n_new))


def kmeans(vectors: DataFrame, k: int, seed: int = 1, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """node, centre of every vector, and the centres, by the library's distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    held = vectors.select("node", array_to_vector(F.col("x").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds).fit(held)
    centres = vectors.sparkSession.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(model.clusterCenters())], "label int, centre array<double>")
    return model.transform(held).select("node", F.col("prediction").alias("centre")), centres


def _pooled(edges: DataFrame, vectors: DataFrame, how: str) -> DataFrame:
    """u, d, value over the neighbours v of u; own rows are joined by the caller."""
    flat = vectors.select(F.col("node").alias("v"), F.posexplode("x").alias("d", "value"))
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    return edges.join(flat, "v").groupBy("u", "d").agg(agg("value").alias("value"), F.count("*").alias("n"))


def aggregate_neighbours(edges: DataFrame, vectors: DataFrame, how: str = "mean") -> DataFrame:
    """node, x: mean, sum or max of the neighbours' vectors by dimension."""
    held = _pooled(edges, vectors, how)
    return held.groupBy(F.col("u").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "value"))), lambda s: s["value"]).alias("x"))


def gcn_aggregate(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """node, x: the mean over a node and its neighbours."""
    loops = vectors.select(F.col("node").alias("u"), F.col("node").alias("v"))
    return aggregate_neighbours(edges.select("u", "v").unionAll(loops), vectors, "mean")


def gin_aggregate(edges: DataFrame, vectors: DataFrame, eps: float = 0.0) -> DataFrame:
    """node, x: the neighbours' sum plus (1 + eps) times the node's own vector."""
    own = vectors.select("node", F.col("x").alias("own"))
    held = own.join(aggregate_neighbours(edges, vectors, "sum"), "node", "left")
    return held.select("node", F.when(F.col("x").isNull(), F.transform("own", lambda p: (1 + eps) * p)).otherwise(F.zip_with("x", "own", lambda q, p: q + (1 + eps) * p)).alias("x"))


def attention(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """node, x: neighbours' vectors weighted by the softmax of scaled dot products. A node without neighbours is not listed."""
    own = vectors.select(F.col("node").alias("u"), F.col("x").alias("q"))
    others = vectors.select(F.col("node").alias("v"), F.col("x").alias("k"))
    scored = edges.join(own, "u").join(others, "v").withColumn("s", dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q").cast("double")))
    top = scored.groupBy("u").agg(F.max("s").alias("m"))
    weighed = scored.join(top, "u").withColumn("w", F.exp(F.col("s") - F.col("m"))).select("u", "w", F.posexplode("k").alias("d", "value"))
    mixed = weighed.groupBy("u", "d").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return mixed.groupBy(F.col("u").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "value"))), lambda s: s["value"]).alias("x"))


def graph_readout(vectors: DataFrame, graph: str = "graph", how: str = "sum") -> DataFrame:
    """graph, x: the nodes' vectors pooled by graph."""
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    flat = vectors.select(graph, F.posexplode("x").alias("d", "v")).groupBy(graph, "d").agg(agg("v").alias("v"))
    return flat.groupBy(graph).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("x"))


def drift_score(memory: Column, before: Column, rebuilt: Column) -> Column:
    """(2 - drift - recovery) / 4 of a node: cosines of its memory with the one before and with the rebuilt one."""
    from ..functions.vectors import cosine

    return (2 - cosine(memory, before) - cosine(memory, rebuilt)) / 4


def edge_outliers(codes: DataFrame, centres: DataFrame, group: str = "label") -> DataFrame:
    """u, v, t, part, score, outlier of edge codes (u, v, t, part, code): the distance to the nearest centre, and
    whether it is above that of every training edge."""
    keyed = codes.select(F.struct("u", "v", "t", "part").alias("node"), F.col("code").alias("x"))
    scored = nearest_centre(keyed, centres, group).select("node.*", F.col("distance").alias("score"))
    most = scored.where("part = 'train'").agg(F.max("score").alias("_most"))
    return scored.crossJoin(F.broadcast(most)).withColumn("outlier", F.coalesce(F.col("score") > F.col("_most"), F.lit(True))).drop("_most")


def snapshot_distance(scored: DataFrame, t: str = "t") -> DataFrame:
    """t, score: the mean distance of a snapshot's edges."""
    return scored.groupBy(t).agg(F.avg("score").alias("score"))
