"""A memory of each node, kept by a gated update that is trained in time order, and drift scores of the frozen model.

A stream is cut into batches of ticks. Within a batch, a node's links become one message (the mean of its
neighbours' memories and the log of its number of links), so all nodes of a batch are updated at the same time,
and batches follow each other in order, as tables of the shared folder. Training is the same pass: each task works
out the gradient of its nodes, the cluster adds the tasks' sums up, and the driver holds the weights alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import cut_lineage
from .embedding import drift_score
from .factorise import first_vectors
from .learning import dense, gru


class Weights(NamedTuple):
    """Gates over message (w) and memory (u), and the layer that rebuilds a memory from its message."""

    wz: np.ndarray
    uz: np.ndarray
    wr: np.ndarray
    ur: np.ndarray
    wn: np.ndarray
    un: np.ndarray
    back: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self])

    def like(self, flat: np.ndarray) -> Weights:
        ends = np.cumsum([w.size for w in self])
        return Weights(*(part.reshape(w.shape) for part, w in zip(np.split(flat, ends[:-1]), self, strict=True)))


def first_weights(width: int, seed: int = 1) -> Weights:
    draw = np.random.Generator(np.random.PCG64(seed))
    shape = {"w": (width, width + 1), "u": (width, width), "b": (width, width + 1)}
    return Weights(*(draw.normal(size=shape[name[0]]) / np.sqrt(width) for name in Weights._fields))


def loss_and_gradient(w: Weights, x: np.ndarray, m: np.ndarray, others: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, float, np.ndarray]:
    """New memories, the summed loss and its gradient (flat) for rows of messages x and memories m.

    The contrast: a node's new memory should be nearer to its own old one than to the mean of all old ones (others);
    log(1 + exp(-difference / scale)). The recovery: half the squared distance of the rebuilt memory from the old one.
    """
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    z, r = sigmoid(x @ w.wz.T + m @ w.uz.T), sigmoid(x @ w.wr.T + m @ w.ur.T)
    h = m @ w.un.T
    n = np.tanh(x @ w.wn.T + r * h)
    new = (1 - z) * n + z * m
    gap = m - others
    contrast = (new * gap).sum(axis=1) / scale
    miss = x @ w.back.T - m
    loss = float(np.logaddexp(0.0, -contrast).sum() + 0.5 * (miss * miss).sum())
    d_new = -sigmoid(-contrast)[:, None] * gap / scale
    d_n = d_new * (1 - z) * (1 - n * n)
    d_z = d_new * (m - n) * z * (1 - z)
    d_r = d_n * h * r * (1 - r)
    parts = (d_z.T @ x, d_z.T @ m, d_r.T @ x, d_r.T @ m, d_n.T @ x, (d_n * r).T @ m, miss.T @ x)
    return new, loss, np.concatenate([p.ravel() for p in parts])


def in_batches(edges: DataFrame, every: int) -> DataFrame:
    """batch, node, other: both ends of every edge, by batch of `every` ticks from the stream's first."""
    first = edges.agg(F.min("t").alias("a"))
    both = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    return edges.crossJoin(F.broadcast(first)).select(F.expr(f"(t - a) div {every}").alias("batch"), F.explode(both).alias("e")).select("batch", "e.*")  # one row


def messages(links: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """node, x, m: each node's message of a batch's links (node, other), and its memory (state: node, m).

    Every batch joins the state anew: it is merged (so are _kept()'s tables), as what is broadcast goes through the driver.
    """
    state = state.hint("merge")
    met = links.join(state.select(F.col("node").alias("other"), F.col("m").alias("_o")), "other")
    mean = met.groupBy("node").agg(*(F.avg(F.col("_o")[k]).alias(f"_{k}") for k in range(width)), F.log1p(F.count("*").cast("double")).alias("_n"))
    return mean.select("node", F.array(*(f"_{k}" for k in range(width)), "_n").alias("x")).join(state, "node")


def _kept(state: DataFrame, moved: DataFrame) -> DataFrame:
    """The state after a batch: moved (node, m), and the rest as it was."""
    return state.join(moved.hint("merge"), "node", "left_anti").unionByName(moved.select("node", "m"))


def _step(w: Weights, others: list[float], scale: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n = np.zeros(w.flat().size), 0.0, 0
        for frame in frames:
            if len(frame):
                new, more, g = loss_and_gradient(w, np.stack(frame["x"].to_numpy()), np.stack(frame["m"].to_numpy()), np.array(others), scale)
                total, loss, n = total + g, loss + more, n + len(frame)
                yield pd.DataFrame({"node": frame["node"], "v": list(new)})
        if n:
            yield pd.DataFrame({"node": [None], "v": [np.concatenate([[loss, n], total])]})

    return run


def train(edges: DataFrame, every: int, width: int = 8, epochs: int = 2, rate: float = 0.05, scale: float = 1.0, seed: int = 1) -> tuple[Weights, list[float]]:
    """The weights, and each epoch's mean loss. An epoch passes over all batches in order, from the same first memories.

    A batch is one pass over its nodes' rows, written once: their new memories, and a row a task with its sums of
    loss and gradient. These are added up by place, so the driver reads as many numbers as there are weights.
    """
    links = cut_lineage(in_batches(edges, every))
    last = links.agg(F.max("batch")).first()[0]
    begun = cut_lineage(first_vectors(links.select("node"), width, seed).select("node", F.col("h").alias("m")))
    w, size, told = first_weights(width, seed), 0.0, []
    for _ in range(epochs):
        state, losses, nodes = begun, 0.0, 0
        for k in range((-1 if last is None else last) + 1):
            rows = cut_lineage(messages(links.where(F.col("batch") == k), state, width))
            means = rows.agg(*(F.avg(F.col("m")[d]) for d in range(width))).first()
            if means[0] is None:
                continue
            done = cut_lineage(rows.mapInPandas(_step(w, [float(x) for x in means], scale), "node string, v array<double>"))
            sums = done.where("node is null").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
            values = np.array([r["v"] for r in sums])
            losses, nodes, g = losses + values[0], nodes + values[1], values[2:] / values[1]
            size = 0.9 * size + 0.1 * g * g
            w = w.like(w.flat() - rate * g / (np.sqrt(size) + 1e-8))
            moved = done.where("node is not null").select("node", F.col("v").alias("m"))
            state = cut_lineage(_kept(state, moved))
        told.append(losses / max(nodes, 1))
    return w, told


def updated(x: Column, m: Column, w: Weights) -> Column:
    """The new memory, as an expression."""
    return gru(x, m, (w.wz.tolist(), w.uz.tolist()), (w.wr.tolist(), w.ur.tolist()), (w.wn.tolist(), w.un.tolist()))


def drift_scores(edges: DataFrame, w: Weights, every: int, seed: int = 1) -> DataFrame:
    """batch, node, score of the frozen model: how far a node's memory moves, and how badly its neighbours' rebuild it. DataFrame functions only."""
    width = w.uz.shape[0]
    links = cut_lineage(in_batches(edges, every))
    last = links.agg(F.max("batch")).first()[0]
    state = cut_lineage(first_vectors(links.select("node"), width, seed).select("node", F.col("h").alias("m")))
    out: DataFrame | None = None
    for k in range((-1 if last is None else last) + 1):
        rows = messages(links.where(F.col("batch") == k), state, width)
        done = cut_lineage(rows.select("node", F.col("m").alias("_before"), updated(F.col("x"), F.col("m"), w).alias("m"), dense(F.col("x"), w.back.tolist()).alias("_rebuilt")))
        scored = done.select(F.lit(k).cast("long").alias("batch"), "node", drift_score(F.col("m"), F.col("_before"), F.col("_rebuilt")).alias("score"))
        out = scored if out is None else out.unionAll(scored)
        state = cut_lineage(_kept(state, done))
    return out if out is not None else edges.sparkSession.createDataFrame([], "batch long, node string, score double")
