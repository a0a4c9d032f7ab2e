"""Splits, layers of given weights, masked measures and running means: what training code around the graphs needs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.vectors import dot
from ..plans.ordering import CHUNK, cut_lineage, global_lag, global_lead, global_number, numbered
from .embedding import aggregate_neighbours
from .graphs import dealt_by, laid_out

RELU = "relu"


def stratified_folds(rows: DataFrame, k: int, label: str = "label", key: str = "seq") -> DataFrame:
    """rows with fold 0 .. k - 1: the rows of a label dealt in turn, in the order of their key's digest."""
    placed = numbered(rows, [label], [F.md5(F.col(key).cast("string"))], "_n", "_size")
    return placed.withColumn("fold", F.col("_n") % k).drop("_n", "_size")


def random_split(rows: DataFrame, train: float = 0.7, valid: float = 0.85, group: str = "t", key: str = "seq", seed: int = 7) -> DataFrame:
    """rows with part train, valid or test, by the rank of a seeded digest within each group."""
    placed = numbered(rows, [group], [F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))], "_n", "_size")
    p = F.when(F.col("_size") > 1, F.col("_n") / (F.col("_size") - 1)).otherwise(0.0)
    return placed.withColumn("part", F.when(p < train, "train").when(p < valid, "valid").otherwise("test")).drop("_n", "_size")


def train_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The edges (u, v) whose ends are both training nodes (node, part): what a model may see while it learns."""
    own = parts.where("part = 'train'").select("node")
    return edges.join(own.withColumnRenamed("node", "u"), "u", "left_semi").join(own.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v")


def usable_nodes(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """node, part, degree of the nodes that are not isolated: training nodes by training edges, others by all edges."""
    count = lambda e: e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    seen = count(train_edges(edges, parts)).withColumn("_train", F.lit(True)).unionAll(count(edges).withColumn("_train", F.lit(False)))
    return parts.join(seen, "node").where((F.col("part") == "train") == F.col("_train")).select("node", "part", "degree")


def pruned_valid_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges outside the training set none of whose ends is a training node without a training edge, which a model never met."""
    seen = train_edges(edges, parts).select(F.explode(F.array("u", "v")).alias("node")).distinct()
    lost = parts.where("part = 'train'").select("node").join(seen, "node", "left_anti")
    rest = edges.select("u", "v").join(train_edges(edges, parts).distinct(), ["u", "v"], "left_anti")
    return rest.join(lost.withColumnRenamed("node", "u"), "u", "left_anti").join(lost.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v")


def dense(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None, activation: str | None = None) -> Column:
    """A layer of given weights (a row for each output), as one expression over an array column."""
    rows = [dot(x, F.array(*(F.lit(float(w)) for w in row))) + F.lit(float(b)) for row, b in zip(weights, bias or [0.0] * len(weights), strict=True)]
    return F.array(*(F.greatest(r, F.lit(0.0)) if activation == RELU else r for r in rows))


def merge_mlp(a: Column, b: Column, first: Sequence[Sequence[float]], second: Sequence[Sequence[float]]) -> Column:
    """Two joined vectors through a hidden layer and an output layer."""
    return dense(dense(F.concat(a, b), first, activation=RELU), second)


def pooled_neighbours(edges: DataFrame, vectors: DataFrame, weights: Sequence[Sequence[float]], how: str = "max") -> DataFrame:
    """node, x: the neighbours' vectors through a layer, then the max or mean of each output."""
    return aggregate_neighbours(edges, vectors.withColumn("x", dense(F.col("x"), weights, activation=RELU)), how)


def masked_measures(rows: DataFrame, loss: str = "loss", right: str = "right", mask: str = "mask") -> DataFrame:
    """loss, accuracy: means over masked-in rows, as the mask normalised by its mean gives them."""
    weight = F.sum(F.col(mask).cast("double"))
    return rows.agg(F.try_divide(F.sum(F.col(loss) * F.col(mask)), weight).alias("loss"), F.try_divide(F.sum(F.col(right) * F.col(mask)), weight).alias("accuracy"))


def shadow_mean(rows: DataFrame, value: str, rate: float = 0.01, seq: str = "seq", chunk: int = 4096) -> DataFrame:
    """rows with shadow: m -= rate * (m - value) from the first value on, row after row.

    Rows are numbered and cut into chunks, over which the mean is a weighted running sum; of the chunk before
    only its last mean is carried, since earlier ones weigh below a double's precision by then.
    """
    keep = 1 - rate
    if keep**chunk > 1e-17 or keep**-chunk > 1e290:
        raise ValueError("the chunk is too short or too long for the rate")
    held = global_number(rows, "_k", seq, CHUNK).withColumns({"_c": F.floor((F.col("_k") - 1) / chunk), "_i": F.pmod(F.col("_k") - 1, F.lit(chunk))})
    first = (F.col("_k") == 1).cast("double")  # the first value weighs whole
    weighed = F.col(value) * F.when(F.col("_k") == 1, 1.0).otherwise(rate) * F.pow(F.lit(keep), -F.col("_i"))
    run = F.sum(weighed).over(Window.partitionBy("_c").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    own = held.withColumn("_own", run * F.pow(F.lit(keep), F.col("_i"))).withColumn("_first", first)
    last = own.groupBy("_c").agg(F.max_by("_own", "_i").alias("_m")).select((F.col("_c") + 1).alias("_c"), "_m")
    carried = own.join(last, "_c", "left").withColumn("shadow", F.col("_own") + F.coalesce("_m", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_i") + 1))
    return carried.select(*rows.columns, "shadow")


def gradient(series: DataFrame, value: str, seq: str = "seq") -> DataFrame:
    """series with gradient: half the difference of the neighbours, one-sided at the ends."""
    held = global_lead(global_lag(series, {"_a": value}, seq), {"_b": value}, seq)
    both = (F.col("_b") - F.col("_a")) / 2
    slope = F.when(F.col("_a").isNull(), F.col("_b") - F.col(value)).when(F.col("_b").isNull(), F.col(value) - F.col("_a")).otherwise(both)
    return held.withColumn("gradient", slope).drop("_a", "_b")


def class_predictions(vectors: DataFrame, seed: int = 1, rounds: int = 50) -> DataFrame:
    """node, label, predicted, dummy: a logistic classifier learned on half the nodes (by digest), beside the most frequent class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    held = vectors.select("node", F.col("label").cast("double").alias("label"), array_to_vector(F.col("x").cast("array<double>")).alias("features"), F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(2)).alias("half"))
    train = held.where("half = 0")
    model = LogisticRegression(maxIter=rounds).fit(train)
    usual = train.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", "label")).alias("dummy"))
    told = model.transform(held.where("half = 1")).select("node", "label", F.col("prediction").alias("predicted"))
    return told.crossJoin(F.broadcast(usual))


def gru(x: Column, h: Column, update: tuple, reset: tuple, new: tuple) -> Column:
    """A gated update of the state h by the message x; each gate has weights (of x, of h) as rows of numbers."""
    size = len(update[0])
    rows = lambda gate: (dense(x, gate[0]), dense(h, gate[1]))
    sigmoid = lambda v: 1 / (1 + F.exp(-v))
    (zx, zh), (rx, rh), (nx, nh) = rows(update), rows(reset), rows(new)
    out = []
    for k in range(size):
        z, r = sigmoid(zx[k] + zh[k]), sigmoid(rx[k] + rh[k])
        out.append((1 - z) * F.tanh(nx[k] + r * nh[k]) + z * h[k])
    return F.array(*out)


def graph_predictions(edges: DataFrame, vectors: DataFrame, seed: int = 1, layers: int = 2) -> DataFrame:
    """As class_predictions, on vectors that layers of mean aggregation over node and neighbours have mixed."""
    from .embedding import gcn_aggregate

    own = vectors
    for _ in range(layers):
        own = gcn_aggregate(edges, own.select("node", "x")).join(vectors.select("node", "label"), "node")
    return class_predictions(own, seed)


def walk_vectors(walked: DataFrame, size: int = 16, seed: int = 1, least: int = 1, span: int = 5, rounds: int = 10) -> DataFrame:
    """node, x: vectors of the nodes that stand in walks (start, walk, path) at least `least` times, in place of an autoencoder over their cliques.

    How often two stand within span places of each other is counted and factorised by the library's alternating least squares
    (one that meets nobody gets zeros). Names, counts and vectors are tables: the driver holds none of them.
    """
    from pyspark.ml.recommendation import ALS

    spark = walked.sparkSession
    known = walked.select(F.explode(F.col("path").cast("array<string>")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).where((F.col("n") >= least) & F.col("node").isNotNull())
    named = cut_lineage(numbered(known.select("node"), [], ["node"], "id", "_of"))
    placed = walked.select("start", "walk", F.posexplode(F.col("path").cast("array<string>")).alias("place", "node")).join(named.select("node", "id"), "node")
    told = placed.groupBy("start", "walk").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("told"))
    told = told.select(F.posexplode("told").alias("p", "one"), "told").select(F.col("one.id").alias("a"), F.explode(F.expr(f"filter(told, (x, k) -> k <> p and abs(k - p) <= {span})")).alias("far"))
    met = cut_lineage(told.groupBy("a", F.col("far.id").alias("b")).agg(F.count("*").alias("n")))
    if met.isEmpty():
        return named.select("node", F.array_repeat(F.lit(0.0), size).alias("x"))
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    als = ALS(rank=size, maxIter=rounds, seed=seed, implicitPrefs=True, numUserBlocks=blocks, numItemBlocks=blocks, userCol="a", itemCol="b", ratingCol="n")
    found = als.fit(met.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("n").cast("float").alias("n"))).userFactors
    held = found.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("x"))
    return named.join(held, "id", "left").select("node", F.coalesce("x", F.array_repeat(F.lit(0.0), size)).alias("x"))


def spectral_clusters(edges: DataFrame, k: int, rounds: int = 20, seed: int = 1) -> DataFrame:
    """node, cluster of a weighted undirected graph (u, v long, w), by power iteration clustering.

    A seeded normal value of each node is averaged over its weighted neighbours, at most rounds times, until the change
    of the normalised values changes by less than 1e-5 / nodes (1e-8 at least); k-means of the values follows. Edges are laid
    out by node once, so a round exchanges one value a link and holds no graph in memory.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    one = edges.where("u <> v").select(F.col("u").cast("long").alias("node"), F.col("v").cast("long").alias("other"), F.col("w").cast("double").alias("w"))
    both = dealt_by(one.unionAll(one.select(F.col("other").alias("node"), F.col("node").alias("other"), "w")), "node").groupBy("node", "other").agg(F.sum("w").alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy("node"))
    shares = laid_out(dealt_by(both.select(F.col("other").alias("node"), F.col("node").alias("other"), share.alias("share")), "node").sortWithinPartitions("node"))
    first = F.sqrt(-2 * F.log(1 - draw(seed, "node", F.lit("r")))) * F.cos(2 * math.pi * draw(seed, "node", F.lit("a")))
    now = laid_out(shares.select("node").distinct().withColumn("x", first).sortWithinPartitions("node"))
    n, size = now.agg(F.count("*"), F.sum(F.abs("x"))).first()
    least, moved = max(1e-5 / n, 1e-8) if n else 0.0, 0.0
    for _ in range(rounds):
        if not n or not size:
            break
        given = now.join(shares.hint("merge"), "node").select(F.col("other").alias("node"), (F.col("x") * F.col("share")).alias("y"))
        both = laid_out(given.groupBy("node").agg(F.sum("y").alias("y")).join(now.hint("merge"), "node").sortWithinPartitions("node"))
        total = both.agg(F.sum(F.abs("y"))).first()[0]
        by = both.agg(F.sum(F.abs(F.col("y") / (total or 1.0) - F.col("x") / size))).first()[0]
        now, size, change, moved = both.select("node", F.col("y").alias("x")), total, abs(by - moved), by
        if change <= least:
            break
    points = cut_lineage(now.select("node", array_to_vector(F.array(F.col("x") * (n / size if size else 1.0))).alias("features")))
    if not n:
        return points.select("node", F.lit(0).alias("cluster"))
    return KMeans(k=k, seed=seed, tol=0.0).fit(points).transform(points).select("node", F.col("prediction").alias("cluster"))
