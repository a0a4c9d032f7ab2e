"""Temporal attention: a node at a time, seen through its last links before it and theirs, by heads over features and time codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import cut_lineage


class Layer(NamedTuple):
    """Weights of one hop: query (of the time code), key, value (of features and time code), output; frequencies and phases of the time code."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray


def first_layer(features: int, frequencies: Sequence[float], size: int, seed: int = 1) -> Layer:
    """Seeded weights for features of that width; all heads together are size wide."""
    draw, code = np.random.Generator(np.random.PCG64(seed)), len(frequencies)
    rows = lambda width: draw.normal(size=(size, width)) / np.sqrt(width)
    return Layer(rows(code), rows(features + code), rows(features + code), rows(size), np.array(frequencies, float), np.zeros(code))


def fitted_frequencies(links: DataFrame, width: int) -> list[float]:
    """A time code fitted to a stream: one over the gaps' quantiles between a node's links (node, clock, links), from short to long ones."""
    gaps = links.select(F.explode(F.transform("links", lambda x: F.col("clock") - x["at"])).alias("gap"))
    found = gaps.agg(F.percentile_approx("gap", [(k + 0.5) / width for k in range(width)], 10_000).alias("q")).first()["q"] or [1.0] * width
    return [1.0 / max(float(q), 1.0) for q in found]


def link_histories(edges: DataFrame, n: int, clock: str = "clock") -> DataFrame:
    """node, clock, links: the last n links (other, at) of each node, in either role, strictly before each of its ticks.

    All that is asked for at any hop is a node at the time of one of its own links, so this one table answers
    every hop by an equality join: the as-of join is a window frame of n rows.
    """
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(0).alias("end")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(1).alias("end")))
    both = edges.select(F.explode(ends).alias("e"), "seq", F.col(clock).cast("long").alias("clock")).select("e.*", "seq", "clock")
    order = Window.partitionBy("node").orderBy("clock", "seq", "end")
    held = both.withColumn("links", F.collect_list(F.struct("other", F.col("clock").alias("at"))).over(order.rowsBetween(-n, -1)))
    first = F.row_number().over(Window.partitionBy("node", "clock").orderBy("seq", "end"))
    return held.withColumn("_k", first).where("_k = 1").select("node", "clock", "links")


def attended(histories: DataFrame, features: DataFrame, layer: Layer, heads: int = 2) -> DataFrame:
    """node, clock, x of one hop over the links' features (other, at, x); features without at hold at any time.

    Each head weighs the links by the softmax of its part of query and key; a place without a link has no weight, and
    a node without links gives zeros.
    """
    size, width = layer.key.shape
    part, first = size // heads, width - len(layer.frequencies)
    asked = layer.query @ np.cos(layer.phases)  # the query is the time code of now
    weighs = [(asked[h * part : (h + 1) * part] @ layer.key[h * part : (h + 1) * part] / np.sqrt(part)).tolist() for h in range(heads)]
    links = histories.select("node", "clock", F.explode("links").alias("l")).select("node", "clock", "l.*")
    met = links.join(features, ["other", "at"] if "at" in features.columns else "other", "left")
    dt = (F.col("clock") - F.col("at")).cast("double")
    code = [F.cos(dt * F.lit(float(w)) + F.lit(float(p))) for w, p in zip(layer.frequencies, layer.phases, strict=True)]
    seen = met.select("node", "clock", *(F.col("x")[k].alias(f"_i{k}") for k in range(first)), *(F.when(F.col("x").isNotNull(), c).alias(f"_i{first + k}") for k, c in enumerate(code)))
    weighed = lambda name, row: reduce(add, (F.col(f"{name}{k}") * F.lit(float(w)) for k, w in enumerate(row)))
    scored = seen.select("node", "clock", *(weighed("_i", row).alias(f"_s{h}") for h, row in enumerate(weighs)), *(weighed("_i", row).alias(f"_v{k}") for k, row in enumerate(layer.value)))
    # a moment's links are exchanged once: their greatest scores and sums are taken where they meet
    moment = Window.partitionBy("node", "clock")
    shares = scored.select("node", "clock", *(F.exp(F.col(f"_s{h}") - F.max(f"_s{h}").over(moment)).alias(f"_w{h}") for h in range(heads)), *(f"_v{k}" for k in range(size)))
    mixed = shares.groupBy("node", "clock").agg(*((F.sum(F.col(f"_w{k // part}") * F.col(f"_v{k}")) / F.sum(f"_w{k // part}")).alias(f"_m{k}") for k in range(size)))
    none: Column = F.array_repeat(F.lit(0.0), size)
    found = mixed.select("node", "clock", F.when(F.col("_m0").isNull(), none).otherwise(F.array(*(weighed("_m", row) for row in layer.out))).alias("x"))
    return found.unionAll(histories.where(F.size("links") == 0).select("node", "clock", none.alias("x")))


def temporal_attention(edges: DataFrame, vectors: DataFrame, layers: Sequence[Layer], n: int = 5, heads: int = 2, clock: str = "clock") -> DataFrame:
    """node, clock, x: every node at each of its ticks, through as many hops as there are layers; vectors: node, x.

    The first layer sees the neighbours' own vectors, each further one what the layer before made of a neighbour
    at the time of the link.
    """
    histories = cut_lineage(link_histories(edges, n, clock))
    features = vectors.select(F.col("node").alias("other"), "x")
    now = None
    for layer in layers:
        now = cut_lineage(attended(histories, features, layer, heads))
        features = now.select(F.col("node").alias("other"), F.col("clock").alias("at"), "x")
    return now
