"""Operator 1, n-gram Jaccard join: block-skipped index lists, and answers derived from a similar set's.

The exact self-join of the documents' 5-word shingle sets at Jaccard 0.8 or more, returned as classes.
Sets are named by a 64-bit hash of their content, so exact copies are one set from the start.

1. Order. Shingles are counted over all documents (sorted, delta-coded arrays instead of rows go through
   the shuffle); the most frequent of them, at most MOST_FREQUENT, are put last in the global order. The
   order decides how long lists get, never which pairs are found.
2. Index. The first n - ceil(0.8 n) + 1 shingles of a set's order are posted. A list is cut into blocks by
   set size (a size band meets only itself and the next), and a block in which every posting is late is
   skipped: two sets that link have their first common shingle at positions that add up to at most
   (n + m) / 9, so one of the two is early there.
3. Leaders. A block sends no pairs: each member goes to the block's leader, a row each. Before any set is sent,
   a leader's group falls into the parts within which sets may link at all: each set has a sketch of parity bits
   (a shingle flips one), and two sketches differ in no more bits than their sets differ in shingles. Chance
   meetings end there; a part is led by one of its own members.
4. Derived answers. A leader's group holds each member as its difference from the leader, D. From these,
   |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)| gives every answer within the group without the sets, and
   x, y link where 9 |x ^ y| <= n + m. Members that link with the leader are one class already; only the
   others (outliers) are compared, with all of the group, in tiles of bounded size.
5. Classes. Links that join two classes become edges of star-shaped component rounds.

Each linked pair lies in one block at its first common shingle, hence in one leader's group, so no link
is lost, and nothing is capped, sampled or emitted as all pairs of a group.

Defined results: null and empty texts have the empty set, which links with nothing, not even another
empty one; fewer than five words are one shingle; repeated rows and equal texts are copies (one class); a
null doc_id takes part but never names a class while another id is there; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, buffer_of, drop, drop_since, in_arrow, materialise, mix, span_hashes, steps, tidy, window_hashes, word_spans, written
from .stars import components

WIDTH = 5
#: Frequent shingles that every task knows (9 bytes each): the bound of what is broadcast in step 1.
MOST_FREQUENT = 1 << 20
#: A shingle in fewer texts than this is never counted as frequent.
LEAST_COUNT = 4
#: Shingles a task holds before it sends them on.
HELD = 1 << 19
#: Shingles that a part of the exchanges is sized for.
PART_SHINGLES = 1 << 22
#: Postings that a part ranks at a time.
RANKED = 1 << 17
#: Leader and member names that are broadcast to pick sets (8 bytes each); beyond it they are joined by shuffle.
MOST_BROADCAST = 1 << 20
#: Names of rows that drop_duplicates() broadcasts.
MOST_NAMES = 1 << 18
#: Members of a group that one row of the group's own set serves in step 4.
SALTED = 256
#: Members, and bytes of their differences, on each side of a tile in step 4.
TILE = 1024
TILE_BYTES = 4 << 20
#: Members of a group that is cut by sketches; a larger one stays whole.
KIN = 4096
#: Bits of the largest sketch.
SKETCH_BITS = 1 << 15
#: Names of sets sent that a task remembers, so that copies are not sent again.
REMEMBERED = 1 << 18

_EMPTY = np.zeros(0, np.uint64)


class Sets(NamedTuple):
    """The distinct shingle sets of a block of documents, one behind the other, ascending."""

    shingles: np.ndarray
    bounds: np.ndarray
    names: np.ndarray


def shingle_sets(text: pa.Array) -> Sets:
    """One set for each row (copies included)."""
    raw, bounds = buffer_of(text)
    starts, ends, first = word_spans(raw, bounds, SPACE)
    words = span_hashes(raw, starts, ends)
    n_docs = len(bounds) - 1
    count = np.diff(first)
    windows = window_hashes(words, WIDTH)
    doc = np.repeat(np.arange(n_docs), count)
    whole = doc[: len(windows)] == doc[WIDTH - 1 :] if len(windows) else np.zeros(0, bool)
    owner, value = doc[: len(windows)][whole], windows[whole]
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(short):
        alone = np.array([mix(window_hashes(words[first[d] : first[d + 1]], int(count[d])) + np.uint64(count[d]))[0] for d in short], np.uint64)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, alone])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    at = np.searchsorted(owner, np.arange(n_docs + 1))
    run = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value), out=run[1:])
    names = mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64))
    return Sets(value, at, names)


def distinct_sets(s: Sets) -> Sets:
    """Without empty sets and copies."""
    size = np.diff(s.bounds)
    _, first = np.unique(s.names, return_index=True)
    keep = np.sort(first[size[first] > 0])
    mask = np.repeat(np.isin(np.arange(len(size)), keep), size)
    return Sets(s.shingles[mask], np.concatenate([[0], np.cumsum(size[keep])]), s.names[keep])


def sketches(s: Sets) -> list[bytes]:
    """The parity bits of each set: a shingle flips the bit of its hash modulo a power of two, the set's size or more (64 to SKETCH_BITS)."""
    size = np.diff(s.bounds)
    bits = np.minimum(1 << np.ceil(np.log2(np.maximum(size, 64))).astype(np.int64), SKETCH_BITS)
    at = np.concatenate([[0], np.cumsum(bits)])
    flipped = np.repeat(at[:-1], size) + (mix(s.shingles) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(flipped, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little")
    return [packed[a // 8 : z // 8].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from steps(batch)


def _text_column(piece: pa.RecordBatch) -> pa.Array:
    return piece.column(piece.schema.get_field_index("text"))


# --- documents ---------------------------------------------------------------------------------


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        s = shingle_sets(_text_column(piece))
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(s.bounds).astype(np.int64)), pa.array(s.names.view(np.int64)), pa.array(sketches(s), pa.binary())], ["doc_id", "n_shingles", "node", "sketch"])


# --- step 1: the order -------------------------------------------------------------------------

#: Counted shingles keep their upper 40 bits.
_LOW = np.uint64(24)


def _cut(values: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the parts of ascending 64-bit values, by equal ranges."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def _sent(part: list[int], blobs: dict[str, list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs.values())], ["part", *blobs])


def _deltas(values: np.ndarray) -> bytes:
    """Ascending values as 32-bit steps; a wider step is written as a marker and 64 bits."""
    step = np.diff(values, prepend=np.uint64(0))
    wide = step >= np.uint64(0xFFFFFFFF)
    out = np.where(wide, np.uint64(0xFFFFFFFF), step).astype(np.uint32)
    return np.uint32(wide.sum()).tobytes() + step[wide].tobytes() + out.tobytes()


def _undeltas(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    step = np.frombuffer(blob, np.uint32, -1, 4 + 8 * n).astype(np.uint64)
    step[step == np.uint64(0xFFFFFFFF)] = np.frombuffer(blob, np.uint64, n, 4)
    return np.cumsum(step, dtype=np.uint64)


def _counts(count: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 or more follow as 64 bits."""
    wide = count >= 255
    return np.uint32(wide.sum()).tobytes() + count[wide].astype(np.int64).tobytes() + np.where(wide, 255, count).astype(np.uint8).tobytes()


def _uncounts(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    count = np.frombuffer(blob, np.uint8, -1, 4 + 8 * n).astype(np.int64)
    count[count == 255] = np.frombuffer(blob, np.int64, n, 4)
    return count


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each place begins a run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _send_shingles(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def send() -> pa.RecordBatch:
        # a shingle goes once a block with its count there, so that a frequent one is no hot spot
        values = np.concatenate(held)
        values.sort()
        at = np.flatnonzero(_first_of(values >> _LOW))
        count = np.diff(np.r_[at, len(values)])
        values = values[at]
        cuts = _cut(values, parts)
        values >>= _LOW
        full = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
        spans = [slice(cuts[k], cuts[k + 1]) for k in full]
        return _sent(full, {"blob": [_deltas(values[x]) for x in spans], "counts": [_counts(count[x]) for x in spans]})

    for piece in _pieces(batches):
        s = distinct_sets(shingle_sets(_text_column(piece)))
        held.append(s.shingles)
        size += len(s.shingles)
        if size >= HELD:
            yield send()
            held, size = [], 0
    if size:
        yield send()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of one part after the other, from a partition sorted by part."""
    now, held = None, []
    for batch in batches:
        part = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, z in zip(cuts, [*cuts[1:], len(part)], strict=True):
            if part[a] != now:
                if held:
                    yield now, held
                now, held = part[a], []
            held.append(batch.slice(a, z - a))
    if held:
        yield now, held


def _blobs(held: list[pa.RecordBatch], name: str) -> Iterator[bytes]:
    for b in held:
        yield from b.column(b.schema.get_field_index(name)).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in LEAST_COUNT texts or more, in classes by the logarithm of their count."""
    for _, held in _parts(batches):
        value = np.concatenate([_undeltas(b) for b in _blobs(held, "blob")])
        count = np.concatenate([_uncounts(b) for b in _blobs(held, "counts")])
        by = np.argsort(value, kind="stable")  # merges the ascending runs
        value = value[by]
        at = np.flatnonzero(_first_of(value))
        count = np.add.reduceat(count[by], at) if len(at) else count
        value = value[at][count >= LEAST_COUNT]
        count = count[count >= LEAST_COUNT]
        level = np.floor(4 * np.log2(count)).astype(np.int32)
        for k in np.unique(level):
            own = value[level == k]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["level", "n", "blob"])


class Order(NamedTuple):
    """The frequent shingles (upper 40 bits, ascending) and their levels; all others are level 0."""

    shingles: np.ndarray
    levels: np.ndarray

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(shingles), np.int64)
        high = shingles >> _LOW
        at = np.searchsorted(self.shingles, high)
        at[at == len(self.shingles)] = 0
        return np.where(self.shingles[at] == high, self.levels[at], 0)


def _by_part(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("part"))  # one part a partition


def frequent(texts: DataFrame, parts: int, most: int = MOST_FREQUENT) -> Order:
    """The levels of count that hold at most `most` shingles in all, from the highest down."""
    sent = in_arrow(texts, lambda it: _send_shingles(it, parts), "part int, blob binary, counts binary")
    levels = materialise(in_arrow(_by_part(sent, parts), _count, "level int, n long, blob binary").hint("rebalance"), "counts")
    del sent
    tidy(texts.sparkSession)
    total, least = 0, 1 << 30
    for r in sorted(levels.groupBy("level").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r.level):
        total += r.n
        if total > most:
            break
        least = r.level
    rows = levels.where(F.col("level") >= least).collect()  # at most `most` shingles
    drop(levels)
    if not rows:
        return Order(_EMPTY, np.zeros(0, np.int64))
    value = np.concatenate([np.frombuffer(r.blob, np.uint64) for r in rows])
    level = np.concatenate([np.full(r.n, r.level, np.int64) for r in rows])
    value, at = np.unique(value, return_index=True)
    return Order(value, level[at])


# --- step 2: the index -------------------------------------------------------------------------


def _band_edges() -> np.ndarray:
    """Sizes at which a band begins; sizes a band apart or more cannot link. The bands overlap nowhere."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 5 // 4)))
    return np.array(edges, np.int64)


BANDS = _band_edges()


#: Posted shingles keep their upper 48 bits, sent as steps; a chance meeting makes a candidate, never a link.
_KEY = np.uint64(16)
#: Marks of a posting beside its band: it is late in its own block, and in the next one.
_LATE, _LATE_NEXT = 1 << 8, 1 << 9


def marks(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Band of each set, and whether a place is late: i + j <= (n + m) / 9 and n, m lie below a block's end, so one of two is at most half of that."""
    band = np.searchsorted(BANDS, size, "right") - 1
    own, following = 9 * place > BANDS[band + 1], 9 * place > BANDS[band + 2]
    return (band + _LATE * own + _LATE_NEXT * following).astype(np.uint16)


def _send_postings(batches: Iterator[pa.RecordBatch], order, parts: int) -> Iterator[pa.RecordBatch]:
    own: Order = order.value
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def send() -> pa.RecordBatch:
        key, node, mark = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(key)
        key, node, mark = key[by], node[by], mark[by]
        at = _cut(key, parts)
        key >>= _KEY
        full = [k for k in range(parts) if at[k] < at[k + 1]]
        cut = lambda x: [x[at[k] : at[k + 1]].tobytes() for k in full]
        return _sent(full, {"keys": [_deltas(key[at[k] : at[k + 1]]) for k in full], "nodes": cut(node), "marks": cut(mark)})

    for piece in _pieces(batches):
        s = distinct_sets(shingle_sets(_text_column(piece)))
        n = np.diff(s.bounds)
        doc = np.repeat(np.arange(len(n)), n)
        by = np.lexsort((s.shingles, own.of(s.shingles), doc))
        place = np.arange(len(doc)) - np.repeat(s.bounds[:-1], n)
        posted = place < np.repeat(n - (4 * n + 4) // 5 + 1, n)
        d = doc[posted]
        held.append((s.shingles[by][posted], s.names[d], marks(n[d], place[posted])))
        size += len(d)
        if size >= HELD:
            yield send()
            held, size = [], 0
    if held:
        yield send()


def lead(key: np.ndarray, node: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leader and member rows of all blocks of the lists. A block is a key and two neighbouring bands."""
    by = np.lexsort((node, key))
    key, node, mark = key[by], node[by], mark[by].astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # a copy posts the same again
    key, node, mark = key[new], node[new], mark[new]
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    key, node, mark = key[shared], node[shared], mark[shared]
    # a set is in the block of its band, as the larger one, and in that of the next, as the smaller one
    band = mark & 0xFF
    key, node, block, late = np.r_[key, key], np.r_[node, node], np.r_[band, band + 1], np.r_[mark & _LATE, mark & _LATE_NEXT] > 0
    by = np.lexsort((node, late, block, key))
    key, node, block, late = key[by], node[by], block[by], late[by]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(key)])
    leader, skip = np.repeat(node[at], size), np.repeat(late[at], size)  # the first is early unless all are late
    pair = ~first & ~skip
    return leader[pair], node[pair]


def _lead(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for _, held in _parts(batches):
        key = np.concatenate([_undeltas(b) for b in _blobs(held, "keys")])
        node = np.concatenate([np.frombuffer(b, np.uint64) for b in _blobs(held, "nodes")])
        mark = np.concatenate([np.frombuffer(b, np.uint16) for b in _blobs(held, "marks")])
        by = np.argsort(key)
        key, node, mark = key[by], node[by], mark[by]
        del by
        at = 0
        while at < len(key):  # whole lists, some RANKED postings at a time
            end = int(np.searchsorted(key, key[min(at + RANKED, len(key)) - 1], "right"))
            leader, member = lead(key[at:end], node[at:end], mark[at:end])
            at = end
            if len(leader):
                yield _pairs_sent(leader, member, parts)


def _unique_pairs(leader: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((member, leader))
    leader, member = leader[by], member[by]
    new = np.ones(len(leader), bool)
    new[1:] = (leader[1:] != leader[:-1]) | (member[1:] != member[:-1])
    return leader[new], member[new]


def _pairs_sent(leader: np.ndarray, member: np.ndarray, parts: int) -> pa.RecordBatch:
    leader, member = _unique_pairs(leader, member)
    by = np.argsort(member, kind="stable")  # dealt by member: a leader may have very many
    leader, member = leader[by], member[by]
    at = _cut(member, parts)
    full = [k for k in range(parts) if at[k] < at[k + 1]]
    return _sent(full, {"leaders": [leader[at[k] : at[k + 1]].tobytes() for k in full], "members": [member[at[k] : at[k + 1]].tobytes() for k in full]})


def _memberships(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held in _parts(batches):
        leader, member = _unique_pairs(*(np.concatenate([np.frombuffer(x, np.uint64) for x in _blobs(held, name)]) for name in ("leaders", "members")))
        yield pa.RecordBatch.from_arrays([pa.array(leader.view(np.int64)), pa.array(member.view(np.int64))], ["leader", "member"])


# --- steps 3 and 4: groups ---------------------------------------------------------------------


def kin(sizes: np.ndarray, sketched: list[np.ndarray]) -> np.ndarray:
    """For each set of a group the place of its part's first one; sets of different parts cannot link."""
    width = np.array([len(x) for x in sketched])
    # a sketch folds onto a shorter one's length, since lengths are powers of two
    folded = {w: np.array([np.bitwise_xor.reduce(x.reshape(-1, w), axis=0) if len(x) >= w else np.zeros(w, np.uint64) for x in sketched]) for w in np.unique(width)}

    def near(x: int, others: np.ndarray) -> np.ndarray:
        apart = np.abs(sizes[others] - sizes[x])
        common = np.minimum(width[others], width[x])
        for w in np.unique(common):
            at = common == w
            apart[at] = np.maximum(apart[at], np.bitwise_count(folded[w][others[at]] ^ folded[w][x]).sum(axis=1, dtype=np.int64))
        return others[9 * apart <= sizes[others] + sizes[x]]

    part = np.full(len(sizes), -1)
    for first in range(len(sizes)):
        if part[first] >= 0:
            continue
        part[first], todo = first, [first]
        left = np.flatnonzero(part < 0)
        while todo and len(left):
            found = near(todo.pop(), left)
            part[found] = first
            todo.extend(found.tolist())
            left = left[part[left] < 0]
    return part


def _kin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leader, role, member, n, sketch), sorted by the first three: each part's leader and its other members."""
    now, held = None, []

    def answer() -> pa.RecordBatch:
        member, n, sketch = zip(*held, strict=True)
        part = kin(np.array(n, np.int64), [np.frombuffer(x, np.uint64) for x in sketch])
        member, others = np.array(member, np.int64), np.flatnonzero(part != np.arange(len(part)))
        return pa.RecordBatch.from_arrays([pa.array(member[part[others]]), pa.array(member[others])], ["leader", "member"])

    for batch in batches:
        for leader, _, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if leader != now:
                if held:
                    yield answer()
                now, held = leader, []
            held.append(row)
    if held:
        yield answer()


def kindred(member: DataFrame, described: DataFrame, parts: int) -> DataFrame:
    """The groups (leader, member) cut into parts by the sketches of described (n_shingles, node, sketch), as a written table."""
    sizes = member.groupBy("leader").agg(F.count("*").alias("size"))
    both = member.join(sizes, "leader")
    small = both.where(F.col("size") < KIN)
    rows = small.select("leader", F.lit(1).alias("role"), "member").unionAll(sizes.where(F.col("size") < KIN).select("leader", F.lit(0), "leader"))
    needed = materialise(rows.select(F.col("member").alias("node")).distinct(), "needed")
    wanted = F.broadcast(needed) if needed.count() <= MOST_BROADCAST else needed
    known = described.select("node", F.col("n_shingles").alias("n"), "sketch").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    dealt = rows.join(known, F.col("member") == F.col("node")).select("leader", "role", "member", "n", "sketch").repartition(parts, "leader").sortWithinPartitions("leader", "role", "member")
    cut = in_arrow(dealt, _kin, "leader long, member long").unionAll(both.where(F.col("size") >= KIN).select("leader", "member"))
    out = materialise(cut.distinct(), "kindred")
    drop(needed)
    return out


def _send_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sent = _EMPTY  # names of the sets that this task has sent lately
    for piece in _pieces(batches):
        s = distinct_sets(shingle_sets(_text_column(piece)))
        new = np.flatnonzero(~np.isin(s.names, sent))
        sent = s.names[new] if len(sent) >= REMEMBERED else np.concatenate([sent, s.names[new]])
        yield pa.RecordBatch.from_arrays([pa.array(s.names[new].view(np.int64)), pa.array([s.shingles[s.bounds[k] : s.bounds[k + 1]].tobytes() for k in new], pa.binary())], ["node", "shingles"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (leader, salt, role, member, shingles), the leader's own first: each member's difference, once."""
    now, own, before, names = None, _EMPTY, None, ["leader", "member", "n_leader", "n", "difference"]
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for leader, salt, role, member, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if role == 0:
                if now != (leader, salt):
                    now, own, before = (leader, salt), np.frombuffer(blob, np.uint64), None
                continue
            if now != (leader, salt):
                raise RuntimeError("a member came before its leader")
            if member != before:  # a set may come from several blocks of documents
                before, shingles = member, np.frombuffer(blob, np.uint64)
                for column, x in zip(out, (leader, member, len(own), len(shingles), np.setxor1d(own, shingles, assume_unique=True).tobytes()), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)


def derive(names: np.ndarray, sizes: np.ndarray, differences: list[np.ndarray], outlier: np.ndarray, compared: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join classes within a group, as pairs of names: outliers (those compared here, or all) against all members.

    Members that link with the leader (not outlier) are one class from the start; every outlier begins as its own.
    """
    flat = np.concatenate(differences) if differences else _EMPTY
    _, token = np.unique(flat, return_inverse=True)
    length = np.array([len(d) for d in differences], np.int64)
    bounds = np.concatenate([[0], np.cumsum(length)])
    mark = np.zeros(int(token.max()) + 1 if len(token) else 1, np.int32)
    label = np.where(outlier, np.arange(len(names)) + 1, 0)
    edges = []
    for o in np.flatnonzero(outlier if compared is None else compared):
        own = token[bounds[o] : bounds[o + 1]]
        mark[own] = 1
        run = np.concatenate([[0], np.cumsum(mark[token])])
        mark[own] = 0
        apart = length[o] + length - 2 * (run[bounds[1:]] - run[bounds[:-1]])
        for x in np.flatnonzero((9 * apart <= sizes[o] + sizes) & (label != label[o])):
            if label[x] != label[o]:
                edges.append((int(names[o]), int(names[x])))
                label[label == label[x]] = label[o]
    return edges


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leader, tile, outlier, compared, member, n, difference), sorted by leader and tile."""
    now, held = None, []

    def answer() -> pa.RecordBatch:
        member, n, difference, outlier, compared = zip(*held, strict=True)
        links = derive(np.array(member), np.array(n), [np.frombuffer(d, np.uint64) for d in difference], np.array(outlier), np.array(compared))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for leader, tile, outlier, compared, member, n, difference in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if (leader, tile) != now:
                if held:
                    yield answer()
                now, held = (leader, tile), []
            held.append((member, n, difference, outlier, compared))
    if held:
        yield answer()


def groups_of(texts: DataFrame, described: DataFrame, parts: int) -> DataFrame:
    """The leaders' groups, each member as its difference from the leader (texts: one column text), as a written table."""
    spark = texts.sparkSession
    order = spark.sparkContext.broadcast(frequent(texts, parts))
    postings = in_arrow(texts, lambda it: _send_postings(it, order, parts), "part int, keys binary, nodes binary, marks binary")
    rows = in_arrow(_by_part(postings, parts), lambda it: _lead(it, parts), "part int, leaders binary, members binary")
    met = materialise(in_arrow(_by_part(rows, parts), _memberships, "leader long, member long"), "members")
    del postings, rows
    tidy(spark)
    member = kindred(met, described, parts)
    drop(met)
    # a leader is a member of its own group; every set is joined to its groups once
    sizes = member.groupBy("leader").agg(F.count("*").alias("size"))
    led = sizes.select("leader", F.floor((F.col("size") + SALTED - 1) / SALTED).cast("int").alias("salts"))
    salt = F.array(F.pmod(F.xxhash64("member"), F.col("salts")).cast("int"))
    own = led.select("leader", F.col("leader").alias("member"), F.sequence(F.lit(0), F.col("salts") - 1).alias("salt"), F.lit(0).alias("role"))
    groups = materialise(own.unionAll(member.join(led, "leader").select("leader", "member", salt.alias("salt"), F.lit(1).alias("role"))), "groups")
    needed = materialise(groups.select(F.col("member").alias("node")).distinct(), "needed")
    wanted = F.broadcast(needed) if needed.count() <= MOST_BROADCAST else needed
    sets = in_arrow(texts, _send_sets, "node long, shingles binary").join(wanted, "node", "left_semi")
    placed = sets.join(groups, F.col("node") == F.col("member")).select("leader", F.explode("salt").alias("salt"), "role", "member", "shingles")
    dealt = placed.repartition(parts, "leader", "salt").sortWithinPartitions("leader", "salt", "role", "member")
    apart = materialise(in_arrow(dealt, _differences, "leader long, member long, n_leader long, n long, difference binary"), "apart")
    del sets, placed, dealt, wanted
    drop(member, groups, needed)
    tidy(spark)
    return apart


def group_links(apart: DataFrame, parts: int) -> DataFrame:
    """Edges a, b of the groups, from every member's difference to its leader."""
    outlier = 9 * F.length("difference") / 8 > F.col("n") + F.col("n_leader")
    apart = apart.withColumn("outlier", outlier)
    direct = apart.where(~F.col("outlier")).select(F.col("leader").alias("a"), F.col("member").alias("b"))

    # a tile is a block of outliers against a block of members; a group of up to TILE members is one tile
    own = F.length("difference").cast("long")
    counted = apart.groupBy("leader").agg(F.count("*").alias("size"), F.count_if("outlier").alias("out"), F.sum(own).alias("bytes"), F.sum(F.when(F.col("outlier"), own)).alias("out_bytes")).where("out > 0 and size > 1")
    cut = lambda c, b: F.greatest(F.ceil(F.col(c) / TILE), F.ceil(F.col(b) / TILE_BYTES)).cast("int")
    grid = counted.select("leader", cut("out", "out_bytes").alias("rows"), cut("size", "bytes").alias("cols"))
    placed = apart.join(grid, "leader").withColumn("h", F.xxhash64("member"))
    row, col = F.pmod("h", "rows").cast("int"), F.pmod("h", "cols").cast("int")
    # an outlier of another row is not compared here, but is no friend of the leader either
    as_member = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r")).select("leader", (F.col("r") * F.col("cols") + col).alias("tile"), "member", "n", "difference", "outlier", (F.col("outlier") & (F.col("r") == row)).alias("compared"))
    as_outlier = placed.where("outlier and cols > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c")).where(F.col("c") != col).select("leader", (row * F.col("cols") + F.col("c")).alias("tile"), "member", "n", "difference", "outlier", F.col("outlier").alias("compared"))
    tiles = as_member.unionAll(as_outlier).select("leader", "tile", "outlier", "compared", "member", "n", "difference").repartition(parts, "leader", "tile").sortWithinPartitions("leader", "tile")
    return direct.unionAll(in_arrow(tiles, _tiles, "a long, b long"))


def partitions(described: DataFrame, per_part: int = PART_SHINGLES) -> int:
    """Parts of the exchanges: as many as the counted shingles need, at least those of the session and 16."""
    total = described.agg(F.sum("n_shingles").alias("n")).first().n or 0
    return max(16, int(described.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // per_part))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, node (the set's name), class_node of every row."""
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long, sketch binary"
    described = materialise(in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), _describe, kind), "described")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    parts = partitions(described)
    apart = groups_of(texts, described, parts)
    found = components(group_links(apart, parts))
    drop(apart)
    tidy(docs.sparkSession)
    # a set's least document, then a class's
    least = described.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = materialise(least.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("class_node"), "least"), "named")
    drop(found)
    by_class = named.groupBy("class_node").agg(F.min("least").alias("component_id"))
    named = named.join(by_class, "class_node").select("node", "class_node", "component_id")
    full = described.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node", "class_node")
    empty = described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node", "node")
    return full.unionAll(empty)


def drop_duplicates(docs: DataFrame, most_broadcast: int = MOST_NAMES) -> DataFrame:
    """One document of each class, the least by doc_id, with all its columns; documents without words all stay.

    docs should be a written table, since it is read several times. Rows are named by 128 bits of key and text.
    The names of dropped rows, and of those kept rows that are there more than once, are broadcast if their
    counted number is within most_broadcast (some 60 bytes each), else joined by shuffle; of rows of one name,
    which differ in other columns at most, the first one stays.
    """
    start = written()
    text, key = F.col("text").cast("string"), F.col("doc_id")
    name = {"_name_1": F.xxhash64(F.lit(1), key.isNull(), key, text), "_name_2": F.xxhash64(F.lit(2), text, key)}
    found = classes(docs.select(F.struct(key.isNull().alias("none"), key.alias("id"), name["_name_1"].alias("a"), name["_name_2"].alias("b")).alias("doc_id"), text.alias("text")))
    worded = found.where("n_shingles > 0").groupBy(F.col("doc_id.a").alias("_a"), F.col("doc_id.b").alias("_b"))
    decided = worded.agg(F.first(F.col("doc_id") == F.col("component_id")).alias("_keep"), F.count("*").alias("_n")).where("not _keep or _n > 1").drop("_n")
    decided = materialise(decided, "decided")
    state = decided.agg(F.count("*").alias("n"), F.count_if("_keep").alias("repeated")).first()
    drop_since(start, but=(decided,))
    side = F.broadcast(decided) if state.n <= most_broadcast else decided
    named = docs.select(F.struct(*docs.columns).alias("row"), *(c.alias(n) for n, c in name.items()))
    same = (F.col("_name_1") == F.col("_a")) & (F.col("_name_2") == F.col("_b"))
    if not state.repeated:
        return named.join(side, same, "left_anti").select("row.*")
    joined = named.join(side, same, "left")
    once = joined.where("_keep is null").select("row")
    again = joined.where("_keep").groupBy("_name_1", "_name_2").agg(F.first("row").alias("row")).select("row")
    return once.unionAll(again).select("row.*")
