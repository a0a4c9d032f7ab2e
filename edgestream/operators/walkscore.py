"""Bridge-edge scores by walks over a priority sample: the sample's versions are found first, then its events scored in batches."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import BITS, draw_int
from ..plans.ordering import cut_lineage, numbered
from .grouped import fold_groups

#: Events of a batch: each batch is scored by itself, from the sample that stood when it began.
BATCH = 4096


def with_priority(edges: DataFrame, seed: int = 1, stream: str = "stream_id") -> DataFrame:
    """edges with place (from 0 in its stream, by seq) and priority: log10(u) over the tick's rate, (t - the tick before) / events of t."""
    counts = edges.groupBy(stream, "t").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.lag("t").over(Window.partitionBy(stream).orderBy("t")), F.lit(-1))  # a row a tick
    rates = counts.select(stream, "t", ((F.col("t") - before) / F.col("_n")).alias("_rate"))
    u = (draw_int(seed, "seq") + 1) / F.lit(float((1 << BITS) + 1))
    placed = numbered(edges, [stream], ["seq"], "place", "_size").drop("_size")
    return placed.join(rates, [stream, "t"]).withColumn("priority", F.log10(u) / F.col("_rate")).drop("_rate")


def entrants(placed: DataFrame, sample: int, stream: str = "stream_id") -> DataFrame:
    """stream, place, leave, src, dst, weight of all events that the priority sample ever held; leave: the place of the event that drove it out.

    An event enters if fewer than sample of those before it have a higher priority. Places are cut where they double:
    within a stretch only events above the sample-th priority of all stretches before can enter, which is about sample
    of them, so few events remain to be replayed in order, one stream a task.
    """
    stretch = F.when(F.col("place") < sample, 0).otherwise(1 + F.floor(F.log2(F.floor(F.col("place") / sample).cast("double") + 1e-9))).cast("int")
    held = placed.withColumn("_part", stretch)
    best = Window.partitionBy(stream, "_part").orderBy(F.desc("priority"), "place")
    top = held.select(stream, "_part", "priority", "place").withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= sample)
    parts = held.select(stream, "_part").distinct()
    later = top.select(stream, "priority", "place", F.col("_part").alias("_of")).join(parts, stream).where("_of < _part")
    rank = Window.partitionBy(stream, "_part").orderBy(F.desc("priority"), "place")
    bars = later.withColumn("_k", F.row_number().over(rank)).where(F.col("_k") == sample).select(stream, "_part", F.col("priority").alias("_bar"))
    able = held.join(bars, [stream, "_part"], "left").where(F.col("_bar").isNull() | (F.col("priority") > F.col("_bar")))

    def replay(key: tuple, rows: list[tuple]) -> list[tuple]:
        heap: list[tuple[float, int]] = []
        told = {place: (src, dst, weight) for place, _, src, dst, weight in rows}
        out = []
        for place, priority, *_ in rows:
            if len(heap) < sample:
                heapq.heappush(heap, (priority, place))
            elif priority > heap[0][0]:
                out.append((*key, heapq.heapreplace(heap, (priority, place))[1], place))
        out += [(*key, place, None) for _, place in heap]
        return [(k, place, leave, *told[place]) for k, place, leave in out]

    kind = placed.schema[stream].dataType.simpleString()
    return fold_groups(able.select(stream, "place", "priority", "src", "dst", "weight"), [stream], ["place"], replay, f"{stream} {kind}, place long, leave long, src string, dst string, weight double")


class AliasTable:
    """Weighted draws in constant time; weights may grow and shrink, and the table is built anew only when it is asked for.

    It depends on the weights alone, not on the order in which they came and went.
    """

    def __init__(self) -> None:
        self.parts: dict[str, list[float]] = {}
        self._built: tuple[list[str], np.ndarray, np.ndarray, float] | None = None

    def increment(self, key: str, by: float) -> None:
        self.parts.setdefault(key, []).append(by)
        self._built = None

    def decrement(self, key: str, by: float) -> None:
        """Take one increment back."""
        self.parts[key].remove(by)
        if not self.parts[key]:
            del self.parts[key]
        self._built = None

    def table(self) -> tuple[list[str], np.ndarray, np.ndarray, float]:
        """keys, the share of its slot that each key keeps, the place of the key that has the rest, and the whole weight."""
        if self._built is None:
            keys = sorted(self.parts)
            w = np.array([math.fsum(self.parts[k]) for k in keys])
            part, other = w * len(w) / w.sum(), np.arange(len(w))
            poor, rich = [int(k) for k in np.flatnonzero(part < 1)], [int(k) for k in np.flatnonzero(part >= 1)]
            keep = np.ones(len(w))
            while poor and rich:
                p, r = poor.pop(), rich.pop()
                keep[p], other[p] = part[p], r
                part[r] -= 1 - part[p]
                (poor if part[r] < 1 else rich).append(r)
            self._built = keys, keep, other, float(w.sum())
        return self._built


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _stirred(x: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    x = (x + _STEP) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(place).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _uniform(x: np.ndarray, place: int) -> np.ndarray:
    """A number in [0, 1) of what was stirred so far and a place: the same in every batch and on every rerun."""
    return (_stirred(x, place) >> np.uint64(11)).astype(np.float64) / 2.0**53


class Sample:
    """The edges held, both ways."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.next: dict[str, AliasTable] = {}

    def node(self, x: str) -> int:
        return self.number.setdefault(x, len(self.number))

    def add(self, src: str, dst: str, weight: float) -> None:
        for a, b in ((src, dst), (dst, src)):
            self.node(a)
            self.next.setdefault(a, AliasTable()).increment(b, weight)

    def drop(self, src: str, dst: str, weight: float) -> None:
        for a, b in ((src, dst), (dst, src)):
            self.next[a].decrement(b, weight)
            if not self.next[a].parts:
                del self.next[a]

    def flat(self) -> tuple[np.ndarray, ...]:
        """All tables one after the other: start, size and total weight of each node's, then keys, keep and other."""
        n = len(self.number)
        start, size, total, parts, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), [], 0
        for x, table in self.next.items():
            keys, keep, other, weight = table.table()
            parts.append((np.array([self.number[k] for k in keys]), keep, other))
            k = self.number[x]
            start[k], size[k], total[k] = at, len(keys), weight
            at += len(keys)
        joined = [np.concatenate(p) for p in zip(*parts, strict=True)] or [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        return start, size, total, *joined


def _walked(sample: Sample, seq: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, walks: int, restart: float, seed: int) -> np.ndarray:
    """Visits at dst per step of walks from src, with the edge less without it, at least 0; all events of a version at once.

    A walk has a geometric number of steps, all of which count, even if it ends where no edge leads on. The
    event's own edge joins the draw at its source in proportion to its weight.
    """
    start, size, total, keys, keep, other = sample.flat()
    n = len(seq) * walks
    of, turn = np.repeat(np.arange(len(seq)), walks), np.tile(np.arange(walks), len(seq))
    found = []
    key = _stirred((seq.astype(np.uint64) + np.uint64(seed))[of], turn)
    for virtual in (0, 1):
        walk = _stirred(key, virtual)  # of the seed, the event, the walk and its kind
        steps = 1 + np.floor(np.log1p(-_uniform(walk, 0)) / np.log1p(-restart)).astype(np.int64)
        at, hits, live = src[of].copy(), np.zeros(n, np.int64), np.arange(n)
        k = 0
        while len(live):
            hits[live] += at[live] == dst[of[live]]
            k += 1
            live = live[k < steps[live]]
            e, here = of[live], at[live]
            can = size[here] > 0
            if virtual:
                own = here == src[e]
                to = live[own]
                own[own] = _uniform(walk[to], 3 * k) * (total[at[to]] + weight[of[to]]) < weight[of[to]]
                at[live[own]] = dst[e[own]]
                can &= ~own
                live = live[own | can]
            else:
                live = live[can]
            # only those that follow an edge held draw one
            e, here = e[can], here[can]
            to = live if not virtual else live[can[own | can]]
            x = walk[to]
            slot = start[here] + np.minimum((_uniform(x, 3 * k + 1) * size[here]).astype(np.int64), size[here] - 1)
            at[to] = np.where(_uniform(x, 3 * k + 2) < keep[slot], keys[slot], keys[start[here] + other[slot]])
        found.append(np.bincount(of, hits, len(seq)) / np.bincount(of, steps, len(seq)))
    return np.maximum(found[1] - found[0], 0.0)


#: Nodes whose walks are followed together.
_TOGETHER = 256


def _arrivals(sample: Sample, u: np.ndarray, v: np.ndarray, restart: float, rounds: int) -> tuple[np.ndarray, ...]:
    """Mass by step (rows) that is at u and at v of what leaves u, and at u and at v of what leaves v, over the edges held; and both ends' weights.

    Each different node that has edges is followed once, whatever number of events names it.
    """
    edges = [(sample.number[a], sample.number[b], w) for a, table in sample.next.items() for b, parts in table.parts.items() for w in parts]
    uu, uv, vu, vv = out = np.zeros((4, rounds, len(u)))
    uu[0], vv[0], uv[0], vu[0] = 1.0, 1.0, u == v, u == v
    if not edges:
        return *out, np.zeros(len(u)), np.zeros(len(u))
    x, y, w = (np.array(c) for c in zip(*edges, strict=True))
    plain = np.bincount(x, w, len(sample.number))
    known = np.unique(x)  # edges are held both ways, so these are all ends
    place = np.full(len(sample.number), -1)
    place[known] = np.arange(len(known))
    order = np.argsort(y, kind="stable")
    a, b, share = place[x[order]], place[y[order]], ((1 - restart) * w / plain[x])[order, None]
    heads = np.flatnonzero(np.diff(b, prepend=-1))
    pu, pv = place[u], place[v]
    asked = np.unique(np.concatenate([pu, pv]))
    asked = asked[asked >= 0]
    for k in range(0, len(asked), _TOGETHER):
        now = asked[k : k + _TOGETHER]
        col = np.full(len(known) + 1, -1)
        col[now] = np.arange(len(now))
        takes = []
        for one, other, own, cross in ((pu, pv, uu, uv), (pv, pu, vv, vu)):
            e = np.flatnonzero(col[one] >= 0)
            met = e[other[e] >= 0]
            takes.append((own, e, one[e], col[one[e]], cross, met, other[met], col[one[met]]))
        mass = np.zeros((len(known), len(now)))
        mass[now, np.arange(len(now))] = 1.0
        for step in range(1, rounds):
            mass = np.add.reduceat(mass[a] * share, heads, axis=0)
            for own, e, row, c, cross, met, end, d in takes:
                own[step, e] = mass[row, c]
                cross[step, met] = mass[end, d]
    return *out, plain[u], plain[v]


def _gain(uu: np.ndarray, uv: np.ndarray, vu: np.ndarray, vv: np.ndarray, total: np.ndarray, weight: np.ndarray, restart: float) -> np.ndarray:
    """How much more mass is ever at v of what leaves u once the edge stands beside u's others, per step of a walk.

    The edge changes one row of the transitions, so what it changes follows from the plain arrivals: as power series in
    the step, the gain is uu * c / (1 - d), where c and d are the change of u's row carried on to v and to u.
    """
    rounds, whole = len(uu), total + weight
    part = np.divide(weight, whole, out=np.zeros(len(whole)), where=whole > 0)
    to = (1 - restart) * part
    c, d = -part * uv, -part * uu
    c[0] = d[0] = 0.0
    c[1:] += to * vv[:-1]
    d[1:] += to * vu[:-1]
    ratio = np.zeros_like(c)
    for k in range(1, rounds):
        ratio[k] = c[k] + (d[1:k] * ratio[k - 1 : 0 : -1]).sum(axis=0)
    gain = (ratio * np.cumsum(uu, axis=0)[::-1]).sum(axis=0)
    return np.maximum(gain, 0.0) / sum((1 - restart) ** k for k in range(rounds))


def _expected(sample: Sample, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, restart: float, rounds: int) -> list[np.ndarray]:
    """The same in expectation, both ways: visits by a power iteration over the edges held, per step of a walk; all events of a version at once."""
    uu, uv, vu, vv, at_u, at_v = _arrivals(sample, src, dst, restart, rounds)
    return [_gain(uu, uv, vu, vv, at_u, weight, restart), _gain(vv, vu, uv, uu, at_v, weight, restart)]


def bridge_scores(edges: DataFrame, sample: int = 500, restart: float = 0.15, rounds: int = 30, walks: int | None = None, seed: int = 1, batch: int = BATCH, stream: str = "stream_id") -> DataFrame:
    """seq, score: how much the edge raises the share of walk steps from src that are at dst (both directions averaged).

    The edges held are a priority sample of fixed size, as it stood just before the event; scores are 0 until it is
    full. walks: so many sampled walks, by alias tables; None: their exact expectation, by a truncated power iteration.
    (With w walks the sampled score's standard error is below 1 / sqrt(w), since a visit's share lies in [0, 1].)

    Which events the sample holds, and until when, depends on priorities alone. So it is found first, and then
    every batch of a stream's events is scored by itself, from the edges that were held when it began and
    those that came and went during it: one stream is as many tasks as it has batches.
    """
    placed = cut_lineage(with_priority(edges.select(stream, "seq", "t", "src", "dst", F.col("weight").cast("double").alias("weight")), seed, stream))
    held = entrants(placed, sample, stream)
    last = placed.groupBy(stream).agg(F.max("place").alias("_last"))
    # an edge that came at place p and left at q is held before p + 1 .. q
    until = F.coalesce("leave", "_last")
    lives = held.join(last, stream).where(F.col("place") < until).select(stream, F.explode(F.sequence(F.expr(f"(place + 1) div {batch}"), F.floor(until / batch))).alias("batch"), F.col("place"), F.col("leave"), F.lit(None).cast("long").alias("seq"), "src", "dst", "weight")
    events = placed.select(stream, F.expr(f"place div {batch}").alias("batch"), "place", F.lit(None).cast("long").alias("leave"), "seq", "src", "dst", "weight")

    def score(key: tuple, rows: list[tuple]) -> list[tuple]:
        held, now = [], []
        for place, leave, seq, src, dst, weight in rows:
            if seq is None or seq != seq:
                held.append((int(place), None if leave is None or leave != leave else int(leave), src, dst, weight))
            else:
                now.append((int(place), int(seq), src, dst, weight))
        ready = [x for x in now if x[0] >= sample]
        out = [(x[1], 0.0) for x in now if x[0] < sample]
        if not ready:
            return out
        state = Sample()
        first = ready[0][0]
        changes: dict[int, list[tuple]] = {}
        for place, leave, *edge in held:
            if leave is None or leave >= first:
                changes.setdefault(max(place + 1, first), []).append((1, *edge))
                if leave is not None:
                    changes.setdefault(leave + 1, []).append((0, *edge))
        k = 0
        while k < len(ready):
            begin = ready[k][0]
            for come, *edge in sorted(changes.pop(begin, [])):  # those that leave first
                (state.add if come else state.drop)(*edge)
            end = min((p for p in changes if p > begin), default=None)
            run = []
            while k < len(ready) and (end is None or ready[k][0] < end):
                run.append(ready[k])
                k += 1
            seq, weight = np.array([x[1] for x in run]), np.array([x[4] for x in run])
            u, v = (np.array([state.node(x[c]) for x in run]) for c in (2, 3))
            if walks is None:
                both = _expected(state, u, v, weight, restart, rounds)
            else:
                both = [_walked(state, seq, a, b, weight, walks, restart, 2 * seed + side) for side, (a, b) in enumerate(((u, v), (v, u)))]
            out += zip(seq.tolist(), ((both[0] + both[1]) / 2).tolist(), strict=True)
        return out

    return fold_groups(lives.unionByName(events), [stream, "batch"], ["place"], score, "seq long, score double")
