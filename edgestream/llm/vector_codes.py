"""Vector code compression: product codes whose codebooks are refined by rounds of exact nearest search.

A vector is cut into parts; each part is named by the nearest entry of its codebook. Each round broadcasts one
kd-tree for every codebook (parts x 256 entries at most, whatever the table), searches it by branch and bound,
and sums the parts of every entry in integers: in the task first, then across tasks by one small exchange. So
every result is exact, and alike on every rerun and for every way of dealing the rows.

Defined results: rows whose vector is null, or holds a null or non-finite component, are dropped, and so are
rows of another length than that of the row with the smallest key. Lengths that are no multiple of the parts
are filled up with zeros; empty vectors are parts of nothing, at distance 0. A table with fewer rows than
entries has as many entries as rows; an empty table gives an empty result with the same columns. Null keys come
last; repeated rows are rows of their own (of repeated keys, the lesser vector comes first). Components beyond
what 64-bit sums of squares can hold (about 10^5 at 64 components) are held at that limit; an error sum of a
label beyond 64 bits is null. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialise
from .embeddings import floored, length_of_first, limit_for, matrix, usable

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
LEAF = 8
#: Vectors that one search step holds.
STEP = 4096


@dataclass
class Tree:
    """A kd-tree in arrays: the box of each node, its children (-1: a leaf), and the slice of entries below it."""

    entries: np.ndarray  # in the tree's order
    index: np.ndarray  # an entry's place in the codebook
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    slices: np.ndarray


def build_tree(codebook: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halve the widest side of each box at its median until a leaf is left."""
    order, nodes = np.arange(len(codebook)), []

    def grow(a: int, b: int) -> int:
        here, own = len(nodes), codebook[order[a:b]]
        node = [own.min(0), own.max(0), (-1, -1), (a, b)]
        nodes.append(node)
        if b - a > leaf and codebook.shape[1]:
            side = int(np.argmax(node[1] - node[0]))
            order[a:b] = order[a:b][np.argsort(own[:, side], kind="stable")]
            node[2] = (grow(a, (a + b) // 2), grow((a + b) // 2, b))
        return here

    grow(0, len(codebook))
    low, high, child, slices = (np.array([n[k] for n in nodes]) for k in range(4))
    return Tree(codebook[order], order, low, high, child, slices)


def nearest(tree: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry; the lower index of equal ones.

    Every point goes to its home leaf first. Then all points of a step go down the tree together: each node
    takes those whose bound does not exceed the best distance they have found so far. A bound equal to it is
    followed too, since an equal distance may have a lower index.
    """
    best, place = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(tree.index))
    exact = bool(points.size) and max(int(np.abs(points).max()), int(np.abs(tree.entries).max())) < 2**21

    def bound(node: int, some: np.ndarray) -> np.ndarray:
        own = points[some]
        gap = np.maximum(np.maximum(tree.low[node] - own, own - tree.high[node]), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def at_leaf(node: int, some: np.ndarray) -> None:
        a, b = tree.slices[node]
        entries, own = tree.entries[a:b], points[some]
        if exact:  # all sums stay below 2^53
            x, e = own.astype(np.float64), entries.astype(np.float64)
            far = ((x * x).sum(1)[:, None] - 2 * (x @ e.T) + (e * e).sum(1)).astype(np.int64)
        else:
            far = np.stack([((own - e) ** 2).sum(1) for e in entries], axis=1)
        by_index = np.argsort(tree.index[a:b])
        k = by_index[np.argmin(far[:, by_index], axis=1)]
        dist, idx = far[np.arange(len(some)), k], tree.index[a:b][k]
        won = (dist < best[some]) | ((dist == best[some]) & (idx < place[some]))
        best[some[won]], place[some[won]] = dist[won], idx[won]

    def home(node: int, some: np.ndarray) -> None:
        """Down to the leaf whose boxes are nearer, each time."""
        if not len(some):
            return
        if tree.child[node, 0] < 0:
            return at_leaf(node, some)
        left, right = tree.child[node]
        nearer = bound(left, some) <= bound(right, some)
        home(left, some[nearer])
        home(right, some[~nearer])
        return None

    def visit(node: int, some: np.ndarray) -> None:
        some = some[bound(node, some) <= best[some]]
        if not len(some):
            return
        if tree.child[node, 0] < 0:
            return at_leaf(node, some)
        for c in tree.child[node]:
            visit(c, some)
        return None

    home(0, np.arange(len(points)))
    visit(0, np.arange(len(points)))
    return place, best


def quantised(embeddings: DataFrame, vector: str, key: str, label: str) -> tuple[DataFrame, int]:
    """(key, label, q) of the rows that take part, q filled up to a multiple of the parts; and the width of a part."""
    rows = embeddings.where(usable(vector)).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
    n = length_of_first(rows, "v", "key")
    width = -(-n // PARTS)
    whole = floored("v", SCALE, limit_for(width, 60))
    filled = F.concat(whole, F.array_repeat(F.lit(0), width * PARTS - n)) if width * PARTS > n else whole
    return rows.where(F.size("v") == n).select("key", "label", filled.alias("q")), width


def first_codebooks(rows: DataFrame, width: int) -> np.ndarray:
    """The parts of the first rows by key: parts x entries x width."""
    first = rows.orderBy(F.col("key").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    return np.array([r["q"] for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, STEP):
            piece = batch.slice(k, STEP)
            yield piece, matrix(piece.column(piece.schema.get_field_index("q")), PARTS * width).reshape(piece.num_rows, PARTS, width)


def refined(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """One round: every part goes to its nearest entry, every entry to the floor of its parts' mean."""
    shared = rows.sparkSession.sparkContext.broadcast([build_tree(b) for b in books])
    entries = books.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for _, parts in _steps(batches, width):
            for p, tree in enumerate(shared.value):
                at = nearest(tree, parts[:, p])[0]
                order = np.argsort(at, kind="stable")
                heads = np.flatnonzero(np.diff(at[order], prepend=-1))
                if len(heads):
                    total[p, at[order][heads]] += np.add.reduceat(parts[order, p], heads, axis=0)
                    count[p] += np.bincount(at, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e])} | {f"s{k}": pa.array(total[p, e, k]) for k in range(width)})

    columns = [f"s{k}" for k in range(width)]
    partial = in_arrow(rows.select("q"), sums, ", ".join(["part int", "entry int", "n long", *(f"{c} long" for c in columns)]))
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).collect()  # parts x entries rows at most
    out = books.copy()
    for r in found:
        out[r["part"], r["entry"]] = [r[c] // r["n"] for c in columns]  # // floors
    shared.unpersist()
    return out


def encode(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of every row that takes part, and the final codebooks."""
    found, width = quantised(embeddings, vector, key, label)
    rows = materialise(found, "quantised")
    books = first_codebooks(rows, width)
    for _ in range(ROUNDS if books.size else 0):
        books = refined(rows, books, width)
    shared = rows.sparkSession.sparkContext.broadcast([build_tree(b) for b in books] if books.shape[1] else [])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, parts in _steps(batches, width):
            at, far = zip(*(nearest(tree, parts[:, p]) for p, tree in enumerate(shared.value)), strict=True)
            hexed = np.stack(at, axis=1).astype(np.uint8).tobytes().hex()
            code = [hexed[k : k + 2 * PARTS] for k in range(0, len(hexed), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(code, pa.string()), pa.array(np.sum(far, axis=0))], names=["key", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return in_arrow(rows, codes, f"key {kinds['key']}, label {kinds['label']}, code string, error long"), books


def digest(books: np.ndarray) -> str:
    """Of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: codes, errors, the error of equal labels, and the codebooks' digest."""
    found, books = encode(embeddings)
    coded = materialise(found, "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
