"""Message passing with trained weights: sums over neighbours, two-layer perceptrons, batch norm, a read-out of every layer.

Nodes' values are tables and a layer is a join of the edges with them, forward and, on turned edges, backward. Weights
are few: tasks work out their nodes' share of each gradient, the cluster adds the shares up by place, and
the driver takes the step. Batch norm's means are such sums too, so a pass equals the one over the whole graph
at once, however its rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import cut_lineage
from .embedding import aggregate_neighbours

SMALL = 1e-5


class Layer(NamedTuple):
    eps: np.ndarray
    first: np.ndarray
    second: np.ndarray
    scale: np.ndarray
    shift: np.ndarray


class Model(NamedTuple):
    """Layers, and the read-out (classes x width) of the input and of each layer."""

    layers: list[Layer]
    read: list[np.ndarray]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (*(x for layer in self.layers for x in layer), *self.read)])

    def like(self, flat: np.ndarray) -> Model:
        shapes = [a.shape for a in (*(x for layer in self.layers for x in layer), *self.read)]
        parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        arrays = [p.reshape(s) for p, s in zip(parts, shapes, strict=True)]
        n = 5 * len(self.layers)
        return Model([Layer(*arrays[k : k + 5]) for k in range(0, n, 5)], arrays[n:])


def first_model(inputs: int, classes: int, width: int = 8, layers: int = 2, seed: int = 1) -> Model:
    draw = np.random.Generator(np.random.PCG64(seed))
    rows = lambda a, b: draw.normal(size=(a, b)) / np.sqrt(b)
    sizes = [inputs, *[width] * layers]
    return Model([Layer(np.zeros(1), rows(width, sizes[k]), rows(width, width), np.ones(width), np.zeros(width)) for k in range(layers)], [rows(classes, s) for s in sizes])


def _mapped(df: DataFrame, work: Callable[[pd.DataFrame], tuple[pd.DataFrame, np.ndarray]], columns: str) -> DataFrame:
    """Rows (node, columns) that work makes of each frame, and a row a task (node null) with the sum of its second results in total."""
    names = ["node", *(c.split()[0] for c in columns.split(", ")), "total"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                rows, part = work(frame)
                total = part if total is None else total + part
                yield rows.assign(total=None)[names]
        if total is not None:
            yield pd.DataFrame([{n: None for n in names} | {"total": total}])[names]

    kind = df.schema["node"].dataType.simpleString()
    return cut_lineage(df.mapInPandas(run, f"node {kind}, {columns}, total array<double>"))


def _total(done: DataFrame) -> np.ndarray:
    rows = done.where("total is not null").select(F.posexplode("total").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return np.array([r["v"] for r in rows])


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _normed(z: np.ndarray, mean: np.ndarray, var: np.ndarray, layer: Layer) -> tuple[np.ndarray, np.ndarray]:
    """Normalised values, and what the layer gives."""
    unit = (z - mean) / np.sqrt(var + SMALL)
    return unit, np.maximum(layer.scale * unit + layer.shift, 0)


def _forward(edges: DataFrame, nodes: DataFrame, model: Model) -> tuple[list[DataFrame], list[tuple[np.ndarray, np.ndarray]], DataFrame]:
    """Tables (node, p, z) and the moments of z of each layer, and (node, h0, h1, ..) of all nodes."""
    told = nodes.select("node", F.col("x").alias("h0"))
    tables, moments = [], []
    for k, layer in enumerate(model.layers):
        h = told.select("node", F.col(f"h{k}").alias("x"))
        near = aggregate_neighbours(edges, h, "sum").withColumnRenamed("x", "near")

        def work(frame: pd.DataFrame, layer: Layer = layer) -> tuple[pd.DataFrame, np.ndarray]:
            own = _stack(frame["x"])
            around = np.array([np.zeros(own.shape[1]) if n is None else n for n in frame["near"]], float)
            p = (1 + layer.eps[0]) * own + around
            z = np.maximum(p @ layer.first.T, 0) @ layer.second.T
            return pd.DataFrame({"node": frame["node"], "p": list(p), "z": list(z)}), np.concatenate([[len(z)], z.sum(axis=0), (z * z).sum(axis=0)])

        done = _mapped(h.join(near, "node", "left"), work, "p array<double>, z array<double>")
        sums, width = _total(done), len(layer.scale)
        mean = sums[1 : width + 1] / sums[0]
        moments.append((mean, np.maximum(sums[width + 1 :] / sums[0] - mean * mean, 0.0)))
        tables.append(done.where("total is null").select("node", "p", "z"))

        def out(frame: pd.DataFrame, layer: Layer = layer, at: tuple = moments[-1]) -> tuple[pd.DataFrame, np.ndarray]:
            return pd.DataFrame({"node": frame["node"], "h": list(_normed(_stack(frame["z"]), *at, layer)[1])}), np.zeros(1)

        h_next = _mapped(tables[-1], out, "h array<double>").where("total is null").select("node", F.col("h").alias(f"h{k + 1}"))
        told = cut_lineage(told.join(h_next, "node"))
    return tables, moments, told


def loss_and_gradient(edges: DataFrame, nodes: DataFrame, model: Model) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of the nodes that train (node, x, label from 0, train), and its gradient (flat). edges: u, v, node u reads v."""
    tables, moments, told = _forward(edges, nodes, model)
    n = len(model.layers)
    trained = max(nodes.where("train").count(), 1)

    def read_out(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        hs = [_stack(frame[f"h{k}"]) for k in range(n + 1)]
        logits = sum(h @ u.T for h, u in zip(hs, model.read, strict=True))
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        label, on = frame["label"].to_numpy().astype(int), frame["train"].to_numpy().astype(float)
        loss = -(np.log(p[np.arange(len(p)), label]) * on).sum() / trained
        p[np.arange(len(p)), label] -= 1
        d = p * on[:, None] / trained
        back = {f"d{k}": list(d @ model.read[k]) for k in range(1, n + 1)}
        return pd.DataFrame({"node": frame["node"], **back}), np.concatenate([[loss], *((d.T @ h).ravel() for h in hs)])

    done = _mapped(told.join(nodes.select("node", "label", "train"), "node"), read_out, ", ".join(f"d{k} array<double>" for k in range(1, n + 1)))
    sums = _total(done)
    loss, reads = float(sums[0]), sums[1:]
    grads: list[np.ndarray] = []
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    arriving = done.where("total is null").select("node", *(f"d{k}" for k in range(1, n + 1)))
    now = arriving.select("node", F.col(f"d{n}").alias("d"))
    for k in range(n - 1, -1, -1):
        layer, at = model.layers[k], moments[k]
        width = len(layer.scale)
        held = cut_lineage(tables[k].join(now, "node").join(told.select("node", F.col(f"h{k}").alias("h")), "node"))

        def norm_sums(frame: pd.DataFrame, layer: Layer = layer, at: tuple = at) -> tuple[pd.DataFrame, np.ndarray]:
            unit, out = _normed(_stack(frame["z"]), *at, layer)
            g = _stack(frame["d"]) * (out > 0)
            return pd.DataFrame({"node": frame["node"], "g": list(g)}), np.concatenate([[len(g)], (g * unit).sum(axis=0), g.sum(axis=0)])

        moved = _mapped(held, norm_sums, "g array<double>")
        totals = _total(moved)
        count, d_scale, d_shift = totals[0], totals[1 : width + 1], totals[width + 1 :]

        def back(frame: pd.DataFrame, layer: Layer = layer, at: tuple = at, count: float = count, d_scale: np.ndarray = d_scale, d_shift: np.ndarray = d_shift) -> tuple[pd.DataFrame, np.ndarray]:
            p, z = _stack(frame["p"]), _stack(frame["z"])
            unit = _normed(z, *at, layer)[0]
            d_z = layer.scale / np.sqrt(at[1] + SMALL) * (_stack(frame["g"]) - d_shift / count - unit * d_scale / count)
            a = np.maximum(p @ layer.first.T, 0)
            d_a = (d_z @ layer.second) * (a > 0)
            d_p = d_a @ layer.first
            eps = (d_p * _stack(frame["h"])).sum()
            return pd.DataFrame({"node": frame["node"], "d": list(d_p)}), np.concatenate([[eps], (d_a.T @ p).ravel(), (d_z.T @ a).ravel()])

        done = _mapped(held.join(moved.where("total is null").select("node", "g"), "node"), back, "d array<double>")
        sums = _total(done)
        grads.insert(0, np.concatenate([sums, d_scale, d_shift]))
        if k:
            d_p = done.where("total is null").select("node", F.col("d").alias("x"))
            near = aggregate_neighbours(turned, d_p, "sum").withColumnRenamed("x", "near")
            own = F.zip_with("x", F.transform("x", lambda v: F.lit(1 + float(layer.eps[0]))), lambda v, e: v * e)
            whole = F.zip_with(own, F.coalesce("near", F.transform("x", lambda v: F.lit(0.0))), lambda a, b: a + b)
            now = cut_lineage(d_p.join(near, "node", "left").select("node", whole.alias("_d")).join(arriving.select("node", F.col(f"d{k}").alias("_o")), "node").select("node", F.zip_with("_d", "_o", lambda a, b: a + b).alias("d")))
    return loss, np.concatenate([*grads, reads])


def train(edges: DataFrame, nodes: DataFrame, classes: int, width: int = 8, layers: int = 2, epochs: int = 10, rate: float = 0.05, seed: int = 1) -> tuple[Model, list[float]]:
    """The model after epochs over the whole graph, and each epoch's loss."""
    held, links = cut_lineage(nodes.select("node", "x", "label", "train")), cut_lineage(edges.select("u", "v").distinct())
    first = held.select(F.size("x")).first()
    model, size, losses = first_model(first[0] if first else 1, classes, width, layers, seed), 0.0, []
    for _ in range(epochs if first else 0):
        loss, g = loss_and_gradient(links, held, model)
        size = 0.9 * size + 0.1 * g * g
        model = model.like(model.flat() - rate * g / (np.sqrt(size) + 1e-8))
        losses.append(loss)
    return model, losses


def predictions(edges: DataFrame, nodes: DataFrame, model: Model) -> DataFrame:
    """node, predicted: the class of the highest read-out."""
    told = _forward(edges.select("u", "v").distinct(), nodes, model)[2]

    def best(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        logits = sum(_stack(frame[f"h{k}"]) @ u.T for k, u in enumerate(model.read))
        return pd.DataFrame({"node": frame["node"], "predicted": logits.argmax(axis=1)}), np.zeros(1)

    return _mapped(told, best, "predicted int").where("total is null").select("node", "predicted")
