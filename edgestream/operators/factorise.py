"""Frequency factorisation of an edge stream: state as tables, fits in strata that share no node, scores as joins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import BITS, draw, draw_int
from ..plans.ordering import cut_lineage, numbered

#: Nodes of a group: a block of the fit is a dense matrix of two groups.
GROUP = 1024


def first_vectors(nodes: DataFrame, width: int, seed: int = 1) -> DataFrame:
    """node, h: a seeded vector of length 1 with entries from 0 to 1."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: draw(seed, F.col("node"), i) + F.lit(1e-9))
    held = nodes.select("node").distinct().withColumn("_h", raw).withColumn("_n", F.sqrt(F.aggregate("_h", F.lit(0.0), lambda a, x: a + x * x)))
    return held.select("node", F.transform("_h", lambda x: x / F.col("_n")).alias("h"))


def mixing_matrix(width: int, seed: int = 1) -> np.ndarray:
    """The fixed matrix between a source's and a target's vector."""
    return np.random.Generator(np.random.PCG64(seed)).random((width, width))


def decayed(state: DataFrame, counts: DataFrame, alpha: float, at: int) -> DataFrame:
    """src, dst, t, f: the last tick of each pair and its frequency, (1 - alpha) times its counts, each faded by alpha a tick, as of at."""
    new = counts.select("src", "dst", "t", ((1 - alpha) * F.col("n") * F.pow(F.lit(alpha), at - F.col("t"))).alias("f"))
    return state.select("src", "dst", "t", "f").unionAll(new).groupBy("src", "dst").agg(F.max("t").alias("t"), F.sum("f").alias("f"))


def pair_rates(pairs: DataFrame, vectors: DataFrame, q: np.ndarray, floor: float) -> DataFrame:
    """pairs with rate: exp(h_s Q h_d), or floor where a node has no vector."""
    turned = [F.aggregate(F.zip_with("h", F.array(*(F.lit(float(x)) for x in row)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for row in q]
    sources = vectors.select(F.col("node").alias("src"), F.col("h").alias("_s"))
    targets = vectors.select(F.col("node").alias("dst"), F.array(*turned).alias("_d"))
    inner = F.aggregate(F.zip_with("_s", "_d", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rate = F.when(F.col("_s").isNull() | F.col("_d").isNull(), F.lit(floor)).otherwise(F.exp(inner))
    return pairs.join(sources, "src", "left").join(targets, "dst", "left").withColumn("rate", rate).drop("_s", "_d")


def detect(events: DataFrame, counts: DataFrame, state: DataFrame, vectors: DataFrame, q: np.ndarray, floor: float) -> DataFrame:
    """seq, score of a period's events (seq, t, src, dst): the largest frequency over its rate of the edge, its source's and its target's edges in the tick.

    A pair's first event in a tick has the frequency 1 / (gap - 1 + 1 / n), gap its distance to the tick it was last
    seen in, or floor if it was not; the tick's other events have n. Groups have the sums of n and of rates.
    """
    known = state.select("src", "dst", F.col("t").alias("_seen"), F.lit(0).cast("long").alias("n"))
    by_pair = Window.partitionBy("src", "dst").orderBy("t")
    rows = counts.select("src", "dst", "t", "n", "first").unionByName(known.select("src", "dst", F.col("_seen").alias("t"), "n", F.lit(None).cast("long").alias("first")))
    gaps = rows.withColumn("before", F.lag("t").over(by_pair)).where("n > 0")
    rated = pair_rates(gaps, vectors, q, floor)
    outs = rated.groupBy("t", "src").agg((F.sum("n") / F.sum("rate")).alias("_out"))
    ins = rated.groupBy("t", "dst").agg((F.sum("n") / F.sum("rate")).alias("_in"))
    begun = F.when(F.col("before").isNull(), F.lit(floor)).otherwise(1 / (F.col("t") - F.col("before") - 1 + 1 / F.col("n")))
    scored = rated.join(outs, ["t", "src"]).join(ins, ["t", "dst"]).select("t", "src", "dst", "first", F.greatest(begun / F.col("rate"), "_out", "_in").alias("_first"), F.greatest(F.col("n") / F.col("rate"), "_out", "_in").alias("_others"))
    return events.select("seq", "t", "src", "dst").join(scored, ["t", "src", "dst"]).select("seq", F.when(F.col("seq") == F.col("first"), F.col("_first")).otherwise(F.col("_others")).alias("score"))


# --- the fit -------------------------------------------------------------------------------------


def rounds_of(groups: int) -> Iterator[list[tuple[int, int]]]:
    """Pairs of groups, so that each meets each other once and no group is in two pairs of a round (groups is even)."""
    ring = list(range(groups))
    for _ in range(groups - 1):
        yield [(min(a, b), max(a, b)) for a, b in zip(ring[: groups // 2], ring[: groups // 2 - 1 : -1], strict=True)]
        ring = [ring[0], ring[-1], *ring[1:-1]]


def block_loss(h: np.ndarray, q: np.ndarray, freq: np.ndarray, wanted: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of log rate + frequency / rate over the wanted pairs of nodes, and its gradient."""
    z = h @ q @ h.T
    pull = freq * np.exp(-z)
    loss = float((z + pull)[wanted].sum())
    g = np.where(wanted, 1 - pull, 0.0)
    return loss, g @ h @ q.T + g.T @ h @ q


def fit_block(h: np.ndarray, q: np.ndarray, freq: np.ndarray, wanted: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Gradient steps scaled by each value's running size; one that would raise the block's loss is halved instead."""
    loss, g = block_loss(h, q, freq, wanted)
    size = np.zeros_like(h)
    for _ in range(steps):
        size = 0.9 * size + 0.1 * g * g
        tried = h - rate * g / (np.sqrt(size) + 1e-8)
        now, slope = block_loss(tried, q, freq, wanted)
        if now <= loss:
            h, loss, g = tried, now, slope
        else:
            rate /= 2
    return h


def _stepper(q: np.ndarray, floor: float, own: bool, rate: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One gradient step of the nodes of two groups by the pairs between them, and own: by those within them too."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        here = frame[frame["dst"].isna()].sort_values("src")
        at = {x: k for k, x in enumerate(here["src"])}
        if not at:
            return pd.DataFrame({"node": [], "h": [], "size": []})
        h, size, side = np.stack(here["h"].to_numpy()), np.stack(here["size"].to_numpy()), here["a"].to_numpy()
        freq = np.full((len(at), len(at)), floor)
        known = frame[frame["dst"].notna()]
        freq[[at[x] for x in known["src"]], [at[x] for x in known["dst"]]] = known["f"]
        wanted = (side[:, None] != side[None, :]) | own
        np.fill_diagonal(wanted, False)
        g = block_loss(h, q, freq, wanted)[1]
        size = 0.9 * size + 0.1 * g * g
        return pd.DataFrame({"node": list(at), "h": list(h - rate * g / (np.sqrt(size) + 1e-8)), "size": list(size)})

    return run


def fit(vectors: DataFrame, state: DataFrame, floor: float, q: np.ndarray, groups: int = 4, epochs: int = 4, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """node, h after epochs of strata: all pairs of nodes weigh in, those of the state by their frequency, the others by floor.

    Nodes are dealt into groups by a seeded draw. A round pairs the groups off; each pair's blocks (source in
    one, target in the other, and in an epoch's first round both in one) give a step, scaled by each value's
    running size, in a task of their own. No node is in two tasks of a round, so they need not agree on
    anything, and the next round reads what they wrote.
    """
    n = vectors.count()
    groups = max(2, groups, -(-n // GROUP))
    groups += groups % 2
    group = lambda c: F.pmod(draw_int(f"{seed}-group", c), F.lit(groups)).cast("int")
    none = F.lit(None).cast("array<double>")
    pairs = cut_lineage(state.where("src <> dst").select(group("src").alias("a"), group("dst").alias("b"), none.alias("h"), none.alias("size"), "src", "dst", "f"))
    now = vectors.select("node", "h", F.transform("h", lambda x: F.lit(0.0)).alias("size"))
    for _ in range(epochs):
        for turn, round_ in enumerate(rounds_of(groups)):
            stratum = {g: k for k, x in enumerate(round_) for g in x}
            mate = {a: b for x in round_ for a, b in (x, x[::-1])}
            of, other = (F.element_at(F.create_map(*(F.lit(v) for kv in sorted(m.items()) for v in kv)), F.col("a")) for m in (stratum, mate))
            own = turn == 0
            inside = pairs.where((F.col("b") == other) | (F.col("a") == F.col("b") if own else F.lit(False)))
            nodes = now.select(group("node").alias("a"), F.lit(None).cast("int").alias("b"), "h", "size", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("f"))
            rows = nodes.unionByName(inside).withColumn("part", of)
            now = cut_lineage(rows.groupBy("part").applyInPandas(_stepper(q, floor, own, rate), "node string, h array<double>, size array<double>"))
    return now.select("node", "h")


def whole_loss(vectors: DataFrame, state: DataFrame, floor: float, q: np.ndarray) -> float:
    """The fit's loss over all pairs of nodes, in blocks of sources: each block of vectors meets all vectors once.

    For tests and reports on a bounded number of nodes: the vectors are read by the driver.
    """
    rows = vectors.orderBy("node").collect()
    at = {r["node"]: k for k, r in enumerate(rows)}
    h = np.array([r["h"] for r in rows])
    freq = np.full((len(at), len(at)), floor)
    for r in state.where("src <> dst").collect():
        freq[at[r["src"]], at[r["dst"]]] = r["f"]
    return block_loss(h, q, freq, ~np.eye(len(at), dtype=bool))[0]


# --- the stream ----------------------------------------------------------------------------------


def factor_scores(edges: DataFrame, most: int = 100, alpha: float = 0.999, width: int = 8, setup: int = 24, every: int = 24, floor: float = 0.001, groups: int = 4, epochs: int = 4, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """seq, score of every event of one stream (seq, t, src, dst); 0 up to the first fit, at tick setup.

    Between fits (every `every` ticks) nothing depends on the order in which rows are worked on: frequencies are
    sums, gaps are lags by pair, rates are joins with the vectors, groups are sums by tick. So a period is a
    few joins and exchanges, over as many tasks as its rows need, and the state handed on is two tables: the
    pairs of highest frequency, `most` at the most, and a vector for each of their nodes. The least frequency
    kept then is the floor of the next period, for pairs and nodes that it does not know.
    (Pairs are dropped at fits, not at every tick: a pair seen twice in a period has a gap, however rare it is.)
    """
    held = cut_lineage(edges.select("seq", F.col("t").cast("long").alias("t"), "src", "dst"))
    counts = cut_lineage(held.groupBy("t", "src", "dst").agg(F.count("*").alias("n"), F.min("seq").alias("first")))
    ends = held.agg(F.min("t").alias("a"), F.max("t").alias("z")).first()
    spark, q = edges.sparkSession, mixing_matrix(width, seed)
    state = spark.createDataFrame([], "src string, dst string, t long, f double")
    if ends["a"] is None:
        return spark.createDataFrame([], "seq long, score double")
    vectors: DataFrame | None = None
    scores: list[DataFrame] = []
    start, end = ends["a"], ends["a"] + setup
    while start <= ends["z"]:
        inside: Column = (F.col("t") >= start) & (F.col("t") <= end)
        now = counts.where(inside)
        if vectors is None:
            scores.append(held.where(inside).select("seq", F.lit(0.0).alias("score")))
        else:
            scores.append(detect(held.where(inside), now, state, vectors, q, floor))
        if end < ends["z"]:
            faded = state.withColumn("f", F.col("f") * alpha ** (end - start + 1 if vectors is not None else 0))
            ranked = cut_lineage(numbered(decayed(faded, now, alpha, end), [], [F.col("f").desc(), F.col("src"), F.col("dst")]).where(F.col("number") < most))
            told = ranked.agg(F.count("*").alias("n"), F.min("f").alias("f")).first()
            if told["n"] >= most:
                floor = told["f"]
            state = ranked.where(F.col("f") >= floor).select("src", "dst", "t", "f")
            fresh = first_vectors(state.select(F.explode(F.array("src", "dst")).alias("node")), width, seed)
            if vectors is not None:
                fresh = fresh.join(vectors.select("node", F.col("h").alias("_old")), "node", "left").select("node", F.coalesce("_old", "h").alias("h"))
            vectors = fit(cut_lineage(fresh), state, floor, q, groups, epochs, rate, seed) if state.take(1) else cut_lineage(fresh)
        start, end = end + 1, end + every
    out = scores[0]
    for more in scores[1:]:
        out = out.unionAll(more)
    return out


def drawn(seed: int | str, *keys: object) -> float:
    """draw() of the same keys, for a single value."""
    return int(hashlib.md5("-".join(map(str, (seed, *keys))).encode()).hexdigest()[: BITS // 4], 16) / float(1 << BITS)


def fold_factor_scores(edges: DataFrame, most: int = 100, alpha: float = 0.999, width: int = 8, setup: int = 24, every: int = 24, floor: float = 0.001, steps: int = 16, rate: float = 0.1, seed: int = 1, stream: str = "stream_id") -> DataFrame:
    """seq, score as factor_scores gives it, for many small streams at once: each is folded tick by tick in its own task.

    Pairs beyond `most` are dropped at every tick, and a fit is one block of all nodes (2 most at the most).
    """
    q = mixing_matrix(width, seed)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        held: dict[tuple[str, str], tuple[int, float]] = {}
        vectors: dict[str, np.ndarray] | None = None
        low, due, scores = floor, int(frame["t"].min()) + setup, {}

        def refit(at: int) -> dict[str, np.ndarray]:
            names = sorted({x for pair in held for x in pair})
            place = {x: k for k, x in enumerate(names)}
            h = np.array([[drawn(seed, x, k) + 1e-9 for k in range(width)] for x in names]).reshape(-1, width)
            h /= np.sqrt((h * h).sum(axis=1, keepdims=True))
            for x in names:
                if vectors and x in vectors:
                    h[place[x]] = vectors[x]
            freq = np.full((len(h), len(h)), low)
            for (s, d), (t, f) in held.items():
                freq[place[s], place[d]] = f * alpha ** (at - t)
            return dict(zip(names, fit_block(h, q, freq, ~np.eye(len(h), dtype=bool), steps, rate), strict=True))

        for t, rows in frame.groupby("t"):
            while t > due:
                vectors, due = refit(due), due + every
            counts = {p: (len(g), int(g.min())) for p, g in rows.groupby(["src", "dst"])["seq"]}
            if vectors is not None:
                rates = {(s, d): float(np.exp(vectors[s] @ q @ vectors[d])) if s in vectors and d in vectors else low for s, d in counts}
                outs, ins = {}, {}
                for (s, d), (n, _) in counts.items():
                    for sums, x in ((outs, s), (ins, d)):
                        both = sums.setdefault(x, [0.0, 0.0])
                        both[0] += n
                        both[1] += rates[s, d]
                for (s, d), (n, _) in counts.items():
                    begun = 1 / (t - held[s, d][0] - 1 + 1 / n) if (s, d) in held else low
                    group = max(outs[s][0] / outs[s][1], ins[d][0] / ins[d][1])
                    scores[t, s, d] = max(begun / rates[s, d], group), max(n / rates[s, d], group)
            for p, (n, _) in counts.items():
                was, f = held.get(p, (t, 0.0))
                held[p] = t, f * alpha ** (t - was) + (1 - alpha) * n
            ranked = sorted(((f * alpha ** (t - was), p) for p, (was, f) in held.items()), key=lambda x: (-x[0], x[1]))
            if len(ranked) >= most:
                low = ranked[most - 1][0]
            held = {p: held[p] for f, p in ranked[:most] if f >= low}
            for p, (_, first) in counts.items():
                if (t, *p) in scores:
                    scores[t, *p] = (*scores[t, *p], first)
        pick = [scores.get((t, s, d)) for t, s, d in zip(frame["t"], frame["src"], frame["dst"], strict=True)]
        return pd.DataFrame({"seq": frame["seq"], "score": [0.0 if p is None else p[0] if seq == p[2] else p[1] for seq, p in zip(frame["seq"], pick, strict=True)]})

    return edges.select(stream, "seq", "t", "src", "dst").groupBy(stream).applyInPandas(run, "seq long, score double")
