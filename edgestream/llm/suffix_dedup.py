"""Removal of repeated strings: sampled suffixes, sorted by a distributed merge that knows common prefixes.

Every 400-byte window has one anchor, chosen by its own bytes alone: the leftmost least 8-byte hash among its
first 256 places. Equal windows so have their anchors at the same place, and an anchor serves a run of
consecutive windows. What stands from the anchor on to the end of its last window is the anchor's suffix; the
bytes before it, back to its first window's start, are its context.

1. `anchors`: hashes of the 144 bytes after each anchor, which all of its windows hold, are counted. An anchor
   whose hash is found once cannot have a repeated window.
2. `runs`: the other anchors' suffixes and contexts are sorted in each task (by that hash, then by bytes; a range of
   hashes is then an even share of the order, and equal prefixes never part) and front-coded: the length of the
   prefix common with the suffix before, and the rest. Ranges of these runs are exchanged.
3. `merged`: a loser tree combines a range's runs. It carries the common prefix of each run's head with the
   last winner: a comparison looks at bytes only if these are equal, and then only at what follows.
4. `repeated`: in the merged order, suffixes that agree for 400 - d bytes are neighbours, and so are, in the order of
   contexts, those that agree for d bytes before. A window that starts d bytes before its anchor is repeated
   if both hold for another anchor. What is compared is bytes; hashes only choose what to compare.

An anchor hash that more than `hot` anchors share (a passage that a large part of all documents holds) is no
business of one task: its windows are counted by 128-bit digests, summed in each task before they are exchanged.

Defined results: null is empty; texts under 400 bytes have no window and lose nothing; repeated rows are
documents of their own, so texts that occur twice lose all bytes that a window covers; an empty table gives an empty
result with the same columns. Rows are named by two 64-bit hashes of their text, so that no numbered copy of the
table is needed (equal texts have equal results). Tasks hold steps of some MB, or one document if it is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, drop, in_arrow, materialise, mix, powers, steps

LENGTH = 400
#: Places among which a window's anchor is chosen, and bytes that are hashed at each.
PLACES, GRAM = 256, 8
#: Bytes after an anchor that all of its windows hold.
CORE = LENGTH - PLACES
#: Suffixes of a run; suffixes of a range (on average).
RUN, RANGE = 16_384, 65_536
#: Anchors of one hash that a task takes together: no more than a range's.
HOT = RANGE

_HEAD = 8
_WIDTH = _HEAD + LENGTH + PLACES
_STIR = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_HIGH = np.uint64(0xFFFFFFFF00000000)


def names(text: str | Column = "text") -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(t).alias("g1"), F.xxhash64(F.lit(12), t).alias("g2")]


def find_anchors(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents of a step: document, place in the step, and the least and greatest distance back to a window's start."""
    starts = len(raw) - LENGTH + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 4
    grams = np.ndarray((len(raw) - GRAM + 1,), "<u8", raw.tobytes(), 0, (1,))
    key = ((grams * _STIR) ^ (grams >> np.uint64(29))) * _BASE
    key = (key & _HIGH) | np.arange(len(key), dtype=np.uint64)
    step = 1
    while step < PLACES:  # the least of 2, 4, .. places
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    anchor = (key[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(bounds)
    # windows must not leave their document: starts from bounds[i] to bounds[i + 1] - LENGTH
    edge = np.zeros(starts + 1, np.int64)
    long = sizes >= LENGTH
    np.add.at(edge, bounds[:-1][long], 1)
    np.add.at(edge, bounds[1:][long] - LENGTH + 1, -1)
    s = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    a = anchor[s]
    first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(s, prepend=-2) != 1))
    last = np.append(first[1:], len(s)) - 1
    a = a[first]
    return np.searchsorted(bounds, a, side="right") - 1, a, a - s[last], a - s[first]


def core_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of the CORE bytes from each place on."""
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), out=run[1:])
    return mix((run[at + CORE] - run[at]) * powers(_BASE_INV, len(raw) + 1)[at])


def anchors(docs: DataFrame) -> DataFrame:
    """(g1, g2, h, at, least, most): the anchors of all texts, h the hash of their first CORE bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch):
                raw, bounds = buffer_of(piece.column(2))
                doc, at, least, most = find_anchors(raw, bounds)
                g = [piece.column(k).take(pa.array(doc)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*g, pa.array(core_hashes(raw, at).view(np.int64)), pa.array((at - bounds[doc]).astype(np.int32)), pa.array(least.astype(np.int16)), pa.array(most.astype(np.int16))],
                    names=["g1", "g2", "h", "at", "least", "most"],
                )

    long = docs.where(F.octet_length("text") >= LENGTH)
    return in_arrow(long.select(*names(), "text"), run, "g1 long, g2 long, h long, at int, least short, most short")


# --- suffixes and runs ---------------------------------------------------------------------------


def cut(raw: np.ndarray, h: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A row for each anchor: hash, suffix and reversed context, filled up with zero bytes."""
    out = np.zeros((len(at), _WIDTH), np.uint8)
    out[:, :_HEAD] = (h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, _HEAD)  # in the order of signed hashes
    ahead, back = np.arange(LENGTH), np.arange(1, PLACES + 1)
    places = at[:, None] + ahead
    inside = ahead < (LENGTH - least)[:, None]
    out[:, _HEAD : _HEAD + LENGTH] = np.where(inside, raw[np.minimum(places, len(raw) - 1)], 0)
    inside = back <= most[:, None]
    out[:, _HEAD + LENGTH :] = np.where(inside, raw[np.maximum(at[:, None] - back, 0)], 0)
    return out


def common_prefix(rows: np.ndarray) -> np.ndarray:
    """Of each row with the one before (0 for the first)."""
    if not len(rows):
        return np.zeros(0, np.int64)
    other = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])])


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common prefixes with the row before, lengths of the rest without trailing zeros, and the rests."""
    lcp = common_prefix(rows)
    width = rows.shape[1]
    end = width - (rows[:, ::-1] != 0).argmax(axis=1)
    end = np.where(rows.any(axis=1), end, 0)
    place = np.arange(width)
    rest = rows[(place >= lcp[:, None]) & (place < end[:, None])]
    return lcp, np.maximum(end - lcp, 0), rest


def decoded(lcp: list[int], size: list[int], rest: bytes) -> list[bytes]:
    """The rows of a front-coded run."""
    out, last, a = [], b"", 0
    for common, n in zip(lcp, size, strict=True):
        last = (last[:common] + rest[a : a + n]).ljust(_WIDTH, b"\0")
        a += n
        out.append(last)
    return out


class LoserTree:
    """Merges sorted runs of rows. Each run's head knows the prefix that it has in common with the last winner."""

    def __init__(self, runs: list[list[bytes]], prefixes: list[list[int]]) -> None:
        self.runs, self.prefixes = runs, prefixes
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.at = [0] * len(runs)
        self.known = [0] * self.size  # of a run's head with the winner it last lost to, or with the last output
        self.loser = [-1] * self.size
        self.top = self._fill(1)

    def _fill(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        return self._play(node, self._fill(2 * node), self._fill(2 * node + 1))

    def _head(self, run: int) -> bytes | None:
        return self.runs[run][self.at[run]] if run >= 0 and self.at[run] < len(self.runs[run]) else None

    def _play(self, node: int, a: int, b: int) -> int:
        """The run with the lesser head wins (the earlier one of equal heads); the other one stays at the node."""
        x, y = self._head(a), self._head(b)
        if y is None or x is None:
            a, b = (a, b) if y is None else (b, a)
        elif self.known[a] != self.known[b]:  # the one that shares more with the last output comes first, and their prefix is the lesser
            if self.known[a] < self.known[b]:
                a, b = b, a
        else:
            k = self.known[a]
            if x[k:] == y[k:]:
                k = len(x)
                if b < a:
                    a, b = b, a
            else:
                gap = int.from_bytes(x[k:], "big") ^ int.from_bytes(y[k:], "big")
                k = len(x) - (gap.bit_length() + 7) // 8
                if y[k] < x[k]:
                    a, b = b, a
            self.known[b] = k
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """Run, place in it, and the common prefix with the row before, in sorted order."""
        while self._head(self.top) is not None:
            won = self.top
            yield won, self.at[won], self.known[won]
            self.at[won] += 1
            if self.at[won] < len(self.runs[won]):
                self.known[won] = self.prefixes[won][self.at[won]]
            node, best = (won + self.size) // 2, won
            while node:
                best = self._play(node, best, self.loser[node])
                node //= 2
            self.top = best


# --- windows -------------------------------------------------------------------------------------


def repeated_windows(forward: np.ndarray, context: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which distances d back from each anchor start a repeated window (rows x PLACES), anchors in merged order.

    forward: common prefixes of neighbouring suffixes, below 0 where the hash changes. context: reversed contexts.
    """
    n = len(forward)
    out = np.zeros((n, PLACES), bool)
    group = np.cumsum(forward < 0)
    order = np.lexsort((np.ascontiguousarray(context).view(f"S{PLACES}").ravel(), group))
    back = common_prefix(context[order])
    back[np.diff(group[order], prepend=-1) != 0] = -1
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    for d in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        some = np.flatnonzero((least <= d) & (d <= most))
        if len(some) < 2:
            continue
        ahead = np.cumsum(forward < LENGTH - d)[some]
        behind = np.cumsum(back < d)[rank[some]]
        pair = ahead * np.int64(n + 1) + behind
        by = np.argsort(pair, kind="stable")
        same = np.diff(pair[by]) == 0
        twice = np.zeros(len(some), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[some[by[twice]], d] = True
    return out


def spans(at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor's row, first and last start of each maximal run of repeated windows."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)
    return row, at[row] - far + 1, at[row] - near


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a range, range after range: their merged order, then its repeated windows."""
    now, pieces = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["range"] != now and pieces:
                yield from _resolved(pieces)
                pieces = []
            now = row["range"]
            pieces.append(row)
    if pieces:
        yield from _resolved(pieces)


def _resolved(pieces: list[dict]) -> Iterator[pa.RecordBatch]:
    prefixes = [np.frombuffer(p["lcp"], np.int16).tolist() for p in pieces]
    runs = [decoded(lcp, np.frombuffer(p["size"], np.int16).tolist(), p["rest"]) for lcp, p in zip(prefixes, pieces, strict=True)]
    which, place, prefix = (np.array(x, np.int64) for x in zip(*LoserTree(runs, prefixes), strict=True))
    starts = np.cumsum([0, *(len(r) for r in runs)])[:-1]
    flat = starts[which] + place
    columns = {k: np.concatenate([np.frombuffer(p[k], kind) for p in pieces])[flat].astype(np.int64) for k, kind in (("g1", np.int64), ("g2", np.int64), ("at", np.int32), ("least", np.int16), ("most", np.int16))}
    context = np.frombuffer(b"".join(runs[r][k][_HEAD + LENGTH :] for r, k in zip(which.tolist(), place.tolist(), strict=True)), np.uint8).reshape(-1, PLACES)
    forward = np.where(prefix < _HEAD, -1, prefix - _HEAD)
    heads = np.flatnonzero(forward < 0)
    for a, b in _chunks(heads, len(forward)):
        found = repeated_windows(forward[a:b], context[a:b], columns["least"][a:b], columns["most"][a:b])
        row, first, last = spans(columns["at"][a:b], found)
        yield pa.RecordBatch.from_pydict({"g1": columns["g1"][a:b][row], "g2": columns["g2"][a:b][row], "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32())})


def _chunks(heads: np.ndarray, n: int, most: int = RUN) -> Iterator[tuple[int, int]]:
    """Whole groups, some thousand rows at a time."""
    a = 0
    for b in [*heads[1:].tolist(), n]:
        if b - a >= most or b == n:
            yield a, b
            a = b


def _runs(n_ranges: int):
    """Sort and front-code the suffixes of a task, run after run, and cut each run by ranges of the hash."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rows, g1, g2, at, least, most = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{_WIDTH}").ravel(), kind="stable")
        rows = rows[order]
        top = rows[:, :4].copy().view(">u4").ravel().astype(np.int64)
        part = top * n_ranges >> 32
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
            lcp, size, rest = front_coded(rows[a:b])
            own = order[a:b]
            blobs = {"lcp": lcp.astype(np.int16), "size": size.astype(np.int16), "rest": rest, "g1": g1[own], "g2": g2[own], "at": at[own].astype(np.int32), "least": least[own].astype(np.int16), "most": most[own].astype(np.int16)}
            yield pa.RecordBatch.from_pydict({"range": pa.array([int(part[a])], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for text, g1, g2, marks in _documents(batches):
            for a in range(0, len(marks), RUN):
                own = marks[a : a + RUN]
                h, at, least, most = own.T
                held.append((cut(text, h, at, least, most), np.full(len(own), g1), np.full(len(own), g2), at, least, most))
                n += len(own)
                if n >= RUN:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """Text, names and marks (h, at, least, most) of each row. Of equal texts that follow one another, two stand for all."""
    last, times = None, 0
    for batch in batches:
        column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            name = column["g1"][i].as_py(), column["g2"][i].as_py()
            last, times = name, times + 1 if name == last else 1
            if times > 2:
                continue
            marks = column["marks"][i].values
            own = np.stack([marks.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "at", "least", "most")], axis=1)
            text = np.frombuffer(column["text"][i].as_buffer(), np.uint8)
            yield text, *name, own


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of hot anchors by their digests."""
    for text, g1, g2, marks in _documents(batches):
        raw = text.tobytes()
        for a in range(0, len(marks), RUN):
            starts = [(at - d) for _, at, least, most in marks[a : a + RUN].tolist() for d in range(least, most + 1)]
            hashed = np.frombuffer(b"".join(hashlib.blake2b(raw[s : s + LENGTH], digest_size=16).digest() for s in starts), np.int64).reshape(-1, 2)
            for k in range(0, len(starts), RUN):
                w = hashed[k : k + RUN]
                yield pa.RecordBatch.from_pydict({"w1": w[:, 0].copy(), "w2": w[:, 1].copy(), "g1": np.full(len(w), g1), "g2": np.full(len(w), g2), "first": pa.array(starts[k : k + RUN], pa.int32())})


# --- the operator --------------------------------------------------------------------------------

_RUN_SCHEMA = "range int, lcp binary, size binary, rest binary, g1 binary, g2 binary, at binary, least binary, most binary"


def repeated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(g1, g2, first, last): runs of starts of repeated windows, by the names of their texts; runs may meet or overlap."""
    found = materialise(anchors(docs), "anchors")
    counts = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    kept = materialise(found.join(counts, "h").withColumn("hot", F.col("n") > hot).drop("n").dropDuplicates(["g1", "g2", "at", "h"]), "kept")
    drop(found)
    state = kept.agg(F.count("*").alias("n"), F.max("hot").alias("hot")).first()
    n_ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-state["n"] // RANGE))
    texts = docs.where(F.octet_length("text") >= LENGTH).select(*names(), "text")

    def marked(some: Column) -> DataFrame:
        marks = kept.where(some).groupBy("g1", "g2").agg(F.collect_list(F.struct("h", "at", "least", "most")).alias("marks"))
        return texts.join(marks, ["g1", "g2"])

    sorted_runs = in_arrow(marked(~F.col("hot")), _runs(n_ranges), _RUN_SCHEMA)
    out = in_arrow(sorted_runs.repartition(n_ranges, "range").sortWithinPartitions("range"), _merge, "g1 long, g2 long, first int, last int")
    if state["hot"]:
        digests = materialise(in_arrow(marked(F.col("hot")), _digests, "w1 long, w2 long, g1 long, g2 long, first int"), "digests")
        # both written first: a window that very many texts hold is then a key that Spark can split in the join
        twice = materialise(digests.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "twice")
        hit = materialise(digests.join(twice, ["w1", "w2"], "left_semi").select("g1", "g2", "first", F.col("first").alias("last")), "hit")
        drop(digests, twice)
        out = out.unionAll(hit)
    return out.distinct()


def removed_spans(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows starting in those runs cover."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH)
        else:
            out.append([a, b + LENGTH])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and the spans (start, end in bytes) of every document."""
    found = repeated(docs, hot).groupBy("g1", "g2").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    texts = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"), *names())
    joined = texts.join(found, ["g1", "g2"], "left").select("key", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.cast(batch.column(1), pa.large_binary())
            rows = []
            for i, starts in enumerate(batch.column(2)):
                raw = text[i].as_buffer()
                gone = removed_spans([(x["first"], x["last"]) for x in starts.as_py()]) if starts.is_valid else []
                kept, a = hashlib.sha256(), 0
                for b, c in [*gone, (len(raw), len(raw))]:
                    kept.update(memoryview(raw)[a:b])
                    a = c
                rows.append((len(raw), sum(c - b for b, c in gone), len(gone), kept.hexdigest(), [{"start": b, "end": c} for b, c in gone]))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return in_arrow(joined, run, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>").withColumnRenamed("key", key)
