"""Node vectors by a sparse autoencoder over walks taken as cliques; its weights are tables, its gradients sums by node.

The input of a walk's place is the one-hot of its node, so the encoder is a table of rows: h = sigmoid(a row).
The loss of a pass over all walks adds up, for each place, the reconstruction of its one-hot (its own output
near 1, and drawn other nodes' outputs near 0), the squared distances between the codes of a walk's places
(a walk is a clique), and a divergence that keeps the mean activity of each code value near a small share.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw, draw_int
from ..plans.ordering import cut_lineage, numbered


class Terms(NamedTuple):
    """Weights of the clique term, of sparsity, the share of activity it asks for, and drawn outputs a place."""

    clique: float = 0.3
    sparsity: float = 0.5
    activity: float = 0.3
    drawn: int = 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss_and_gradient(terms: Terms, mean: np.ndarray, walk: np.ndarray, code: np.ndarray, out: np.ndarray, others: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Summed loss of places (rows sorted by walk), and its gradients by place: of code rows, of own output rows (a
    bias at the end), and of the drawn ones (places x drawn x width + 1). mean: the activity over all places, held fixed.
    """
    h = sigmoid(code)
    with_one = np.concatenate([h, np.ones((len(h), 1))], axis=1)
    own = (with_one * out).sum(axis=1)
    far = np.einsum("pd,pkd->pk", with_one, others)
    loss = np.logaddexp(0, -own).sum() + np.logaddexp(0, far).sum()
    d_own, d_far = -sigmoid(-own), sigmoid(far)
    d_h = d_own[:, None] * out[:, :-1] + np.einsum("pk,pkd->pd", d_far, others[:, :, :-1])
    starts = np.flatnonzero(np.diff(walk, prepend=walk[0] - 1)) if len(walk) else np.zeros(0, int)
    size = np.diff(np.append(starts, len(walk)))
    sums = np.repeat(np.add.reduceat(h, starts, axis=0), size, axis=0) if len(walk) else h
    n = np.repeat(size, size)[:, None]
    spread = n * h - sums
    loss += terms.clique * (h * spread).sum()  # the sum over pairs of squared distances
    d_h += 2 * terms.clique * spread
    rho = terms.activity
    loss += terms.sparsity * len(h) * (rho * np.log(rho / mean) + (1 - rho) * np.log((1 - rho) / (1 - mean))).sum()
    d_h += terms.sparsity * ((1 - rho) / (1 - mean) - rho / mean)
    return float(loss), d_h * h * (1 - h), d_own[:, None] * with_one, d_far[:, :, None] * with_one[:, None, :]


def _step(terms: Terms, mean: list[float], width: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["walk", "place", "role"])
        weights = np.stack(frame["w"].to_numpy()).reshape(-1, 1 + terms.drawn, 2 * width + 1)  # role 0 is the place itself
        node = frame["node"].to_numpy().reshape(-1, 1 + terms.drawn)
        walk = frame["walk"].to_numpy()[:: 1 + terms.drawn]
        loss, d_code, d_out, d_far = loss_and_gradient(terms, np.array(mean), walk, weights[:, 0, :width], weights[:, 0, width:], weights[:, 1:, width:])
        none = np.zeros(width)
        names = [*node[:, 0], *node[:, 1:].ravel()]
        values = [*np.concatenate([d_code, d_out], axis=1), *(np.concatenate([none, g]) for g in d_far.reshape(-1, width + 1))]
        summed = pd.DataFrame({"node": names, "g": values}).groupby("node", sort=False)["g"].sum().reset_index()  # in the task first
        return pd.concat([summed, pd.DataFrame({"node": [None], "g": [np.full(1, loss)]})])

    return run


def clique_vectors(walks: DataFrame, width: int = 8, epochs: int = 8, rate: float = 0.2, terms: Terms | None = None, seed: int = 1, parts: int | None = None) -> tuple[DataFrame, list[float]]:
    """node, x of all nodes of the walks (start, walk, path), and each epoch's loss a place.

    An epoch joins the walks' places with the table of weights, sums gradients in each task, and then by node
    across tasks; the update is a join with these sums. Nothing but the mean activity (width numbers) and the
    loss passes through the driver, and no task holds the table.
    """
    terms = terms or Terms()
    parts = parts or int(walks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = cut_lineage(numbered(walks.select("start", "walk", "path").where(F.size("path") > 0), [], ["start", "walk"]).select(F.col("number").alias("walk"), F.posexplode("path").alias("place", "node")))
    nodes = cut_lineage(numbered(told.select("node").distinct(), [], ["node"]))
    total = nodes.agg(F.max("edges")).first()[0] or 0
    if not total:
        return walks.sparkSession.createDataFrame([], "node string, x array<double>"), []
    negatives = told.select("walk", "place", F.explode(F.sequence(F.lit(1), F.lit(terms.drawn))).alias("role")).withColumn("number", F.pmod(draw_int(f"{seed}-other", "walk", "place", "role"), F.lit(total)))
    rows = told.withColumn("role", F.lit(0)).unionByName(negatives.join(nodes.select("node", "number"), "number").select("walk", "place", "node", "role"))
    rows = cut_lineage(rows.withColumn("part", F.pmod(F.xxhash64("walk"), F.lit(parts))))
    first: Column = F.transform(F.sequence(F.lit(0), F.lit(2 * width)), lambda k: (draw(seed, F.col("node"), k) - 0.5))
    weights = cut_lineage(nodes.select("node", first.alias("w"), F.array_repeat(F.lit(0.0), 2 * width + 1).alias("size")))
    counts = cut_lineage(told.groupBy("node").agg(F.count("*").alias("n")))
    losses, places = [], told.count()
    for _ in range(epochs):
        active = [F.sum(F.col("n") / (1 + F.exp(-F.col("w")[k]))) / F.sum("n") for k in range(width)]
        mean = [float(x) for x in weights.join(counts, "node").agg(*active).first()]
        found = cut_lineage(rows.join(weights.select("node", "w"), "node").groupBy("part").applyInPandas(_step(terms, mean, width), "node string, g array<double>"))
        losses.append(found.where("node is null").agg(F.sum(F.col("g")[0])).first()[0] / places)
        sums = found.where("node is not null").groupBy("node").agg(F.array(*(F.sum(F.col("g")[k]) for k in range(2 * width + 1))).alias("g"))
        moved = weights.join(sums, "node", "left").withColumn("g", F.coalesce("g", F.array_repeat(F.lit(0.0), 2 * width + 1)))
        size = F.zip_with("size", "g", lambda s, g: 0.9 * s + 0.1 * g * g)
        step = F.zip_with("g", "size", lambda g, s: rate * g / (F.sqrt(s) + 1e-8))
        weights = cut_lineage(moved.withColumn("size", size).select("node", F.zip_with("w", step, lambda w, d: w - d).alias("w"), "size"))
    return weights.select("node", F.transform(F.slice("w", 1, width), lambda a: 1 / (1 + F.exp(-a))).alias("x")), losses
