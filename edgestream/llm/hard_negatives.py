"""Hard-negative mining: exact inner-product search in a score window, by ball trees with bounds on both sides.

Rows are dealt by ranges of (label, vector) and each range becomes a ball tree: a node's ball (centre, radius)
bounds the inner products with an anchor from above and below, and its least and greatest label tell whether it
can hold a row that counts. A node is pruned if all it can hold lies outside the score window, strictly
beneath the k-th best found so far, or under labels that do not count. Equal scores are followed, since a smaller
key may win. Anchors travel in blocks: each block visits each tree once, in the task that holds the tree, and a
tree returns k rows a query at most; so a task holds one tree and one block, however many rows and anchors
there are. (All anchors against all rows is what is asked for: the work grows with their product where the
bounds do not cut it, as they cannot in vectors without structure.)

Defined results: rows with a null label, a null vector or a null or non-finite component take no part, nor do
rows of another length than that of the row with the smallest key. Rows are told apart by themselves, not by
key: repeated rows each count, an anchor that occurs twice is mined twice, and one may be the other's positive.
Null keys are no anchors and come last among equal scores. A positive score of 0 asks for scores of 0, one below 0
for nothing. An empty table gives an empty result. Components are held within a limit for which scores times
100 fit 64 bits (about 10^5 at 64 components). Extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialise
from .embeddings import floored, length_of_first, limit_for, matrix, usable

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: The window of negative scores, in hundredths of the positive score.
LEAST, MOST = 30, 90
#: Fixed values of the contract: which rows are anchors, and whose labels move on.
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
#: Rows of a tree (on average), of a leaf, and anchors of a block.
TREE_ROWS, LEAF, BLOCK = 16_384, 64, 512
_FAR = np.iinfo(np.int64).max // 200


@dataclass
class BallTree:
    vectors: np.ndarray  # in the tree's order, as all the rest
    label: np.ndarray
    uid: np.ndarray
    key: np.ndarray  # 0 where null
    rank: np.ndarray  # by key, nulls last
    center: np.ndarray
    radius: np.ndarray
    least: np.ndarray  # labels
    most: np.ndarray
    child: np.ndarray
    slices: np.ndarray
    null_rank: int  # ranks from here on have no key


def build_tree(vectors: np.ndarray, label: np.ndarray, uid: np.ndarray, key: np.ndarray, key_null: np.ndarray, leaf: int = LEAF) -> BallTree:
    """Halve the rows along the component that spreads most, until a leaf is left; leaves keep the order of keys."""
    by_key = np.lexsort((uid, key, key_null))
    rank = np.empty(len(uid), np.int64)
    rank[by_key] = np.arange(len(uid))
    order, nodes = np.arange(len(uid)), []

    def grow(a: int, b: int) -> int:
        own = vectors[order[a:b]].astype(np.float64)
        center = own.mean(0)
        radius = float(np.sqrt(((own - center) ** 2).sum(1).max(initial=0.0)))
        marks = label[order[a:b]]
        here = len(nodes)
        node = [center, radius, marks.min(), marks.max(), (-1, -1), (a, b)]
        nodes.append(node)
        if b - a > leaf and radius > 0:
            side = int(np.argmax(own.max(0) - own.min(0)))
            order[a:b] = order[a:b][np.argsort(own[:, side], kind="stable")]
            node[4] = (grow(a, (a + b) // 2), grow((a + b) // 2, b))
        return here

    grow(0, len(order))
    center, radius, least, most, child, slices = (np.array([n[k] for n in nodes]) for k in range(6))
    return BallTree(vectors[order], label[order], uid[order], key[order], rank[order], center, radius, least, most, child, slices, int((~key_null).sum()))


def search(tree: BallTree, q: np.ndarray, label: np.ndarray, uid: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of each query with low <= score <= high and the same (or another) label, but not the row itself.

    Scores and places in the tree, by score from high to low and then by key; place -1 where there are fewer.
    """
    n = len(q)
    score, place = np.full((n, k), -_FAR), np.full((n, k), -1)
    ranks = np.append(tree.rank, len(tree.rank))  # of place -1: the last
    length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    size = max(int(np.abs(q).max(initial=0)), int(np.abs(tree.vectors).max(initial=0)))
    exact = max(q.shape[1], 1) * size * size < 2**53
    real = q.astype(np.float64)

    def alive(node: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the queries the node may serve, and its upper bounds."""
        middle, spread = real[some] @ tree.center[node], length[some] * tree.radius[node]
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6  # of rounding
        upper = middle + spread + slack
        ok = (upper >= np.maximum(low[some], score[some, k - 1])) & (middle - spread - slack <= high[some])
        least, most = tree.least[node], tree.most[node]
        ok &= (least <= label[some]) & (label[some] <= most) if same else (least != most) | (label[some] != least)
        return ok, upper

    def at_leaf(node: int, some: np.ndarray) -> None:
        a, b = tree.slices[node]
        rows = tree.vectors[a:b]
        got = (real[some] @ rows.T.astype(np.float64)).astype(np.int64) if exact else q[some] @ rows.T
        marks = label[some][:, None] == tree.label[None, a:b]
        fits = (marks if same else ~marks) & (got >= np.maximum(low[some], score[some, k - 1])[:, None]) & (got <= high[some][:, None])
        fits &= tree.uid[None, a:b] != uid[some][:, None]
        hit = np.flatnonzero(fits.any(axis=1))
        if not len(hit):
            return
        mine = some[hit]
        all_scores = np.concatenate([score[mine], np.where(fits[hit], got[hit], -_FAR)], axis=1)
        all_places = np.concatenate([place[mine], np.where(fits[hit], np.arange(a, b), -1)], axis=1)
        best = np.lexsort((ranks[all_places], -all_scores), axis=-1)[:, :k]
        score[mine], place[mine] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_places, best, 1)

    seen: dict[int, list[np.ndarray]] = {}  # leaves that queries have visited as their home

    def home(node: int, some: np.ndarray) -> None:
        """Down to the leaf with the higher bound each time, to find a first k-th score."""
        if not len(some):
            return
        if tree.child[node, 0] < 0:
            at_leaf(node, some)
            seen.setdefault(node, []).append(some)
            return
        left, right = (np.where(ok, upper, -np.inf) for ok, upper in (alive(c, some) for c in tree.child[node]))
        home(tree.child[node, 0], some[left >= right])
        home(tree.child[node, 1], some[left < right])

    def visit(node: int, some: np.ndarray) -> None:
        some = some[alive(node, some)[0]]
        if tree.child[node, 0] < 0:
            for done in seen.get(node, []):
                some = np.setdiff1d(some, done, assume_unique=True)
            if len(some):
                at_leaf(node, some)
        elif len(some):
            for c in tree.child[node]:
                visit(c, some)

    home(0, np.arange(n))
    visit(0, np.arange(n))
    return score, place


def _trees(rows: DataFrame, width: int) -> DataFrame:
    """(tree, kind 0, blob): a ball tree of each range of (label, vector)."""
    n = rows.count()
    few = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (LEAF * 8)))
    dealt = rows.repartitionByRange(max(1, few, -(-n // TREE_ROWS)), "label", "q", "key", "uid")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(matrix(b.column(3), width), *(b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2)), b.column(1).fill_null(0).to_numpy(zero_copy_only=False), b.column(1).is_null().to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if got:
            vectors, uid, label, key, null = (np.concatenate(x) for x in zip(*got, strict=True))
            tree = build_tree(vectors.astype(np.int32), label.astype(np.int64), uid, key.astype(np.int64), null)
            yield pa.RecordBatch.from_pydict({"tree": pa.array([TaskContext.get().partitionId()], pa.int32()), "kind": pa.array([0], pa.int32()), "blob": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    return materialise(in_arrow(dealt.select("uid", "key", "label", "q"), build, "tree int, kind int, blob binary"), "trees")


def _blocks(queries: DataFrame, width: int, n_trees: int) -> DataFrame:
    """(tree, kind 1, blob): queries (uid, turn, label, low, high, q) in blocks, each sent to every tree."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                b = batch.slice(k, BLOCK)
                columns = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
                yield pa.RecordBatch.from_pydict({"blob": pa.array([pickle.dumps((*columns, matrix(b.column(5), width)), 5)], pa.binary())})

    packed = in_arrow(queries.select("uid", "turn", "label", "low", "high", "q"), pack, "blob binary")
    return packed.select(F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), F.lit(1).alias("kind"), "blob")


def _found(trees: DataFrame, queries: DataFrame, width: int, n_trees: int, same: bool, k: int) -> DataFrame:
    """(uid, turn, place, score, key): the k best rows of each query in all trees, place from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tree = None, None
        for batch in batches:
            for t, kind, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                if kind.as_py() == 0:
                    number, tree = t.as_py(), pickle.loads(blob.as_py())
                    continue
                if number != t.as_py():
                    continue  # a range without rows has no tree
                uid, turn, label, low, high, q = pickle.loads(blob.as_py())
                score, place = search(tree, q, label, uid, same, low, high, k)
                at, _ = np.nonzero(place >= 0)
                got = place[place >= 0]
                yield pa.RecordBatch.from_pydict({"uid": uid[at], "turn": pa.array(turn[at], pa.int32()), "score": score[place >= 0], "key": pa.array(tree.key[got], pa.int64(), mask=tree.rank[got] >= tree.null_rank)})

    met = trees.unionAll(_blocks(queries, width, n_trees)).repartition(n_trees, "tree").sortWithinPartitions("tree", "kind")
    best = in_arrow(met, run, "uid long, turn int, score long, key long")
    order = Window.partitionBy("uid", "turn").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors."""
    named = embeddings.where(usable(vector) & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    width = length_of_first(named, "v", "key")
    moved = F.when(F.col("key") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = materialise(named.where(F.size("v") == width).select(F.monotonically_increasing_id().alias("uid"), "key", moved.alias("label"), floored("v", SCALE, limit_for(width, 55)).alias("q")), "vectors")
    anchors = rows.where(F.col("key") % ANCHOR_EVERY == 0)
    trees = _trees(rows, width)
    n_trees = (trees.agg(F.max("tree")).first()[0] or 0) + 1

    asked = anchors.select("uid", F.lit(0).alias("turn"), "label", F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"), "q")
    positives = materialise(_found(trees, asked, width, n_trees, True, POSITIVES).select("uid", F.col("place").alias("turn"), F.col("score").alias("positive_score"), F.col("key").alias("positive_id")), "positives")
    pairs = positives.join(anchors, "uid")
    window = pairs.where("positive_score >= 0").select("uid", "turn", "label", F.expr(f"(positive_score * {LEAST} + 99) div 100").alias("low"), F.expr(f"positive_score * {MOST} div 100").alias("high"), "q")
    negatives = _found(trees, window, width, n_trees, False, NEGATIVES)
    return pairs.select("uid", "turn", F.col("key").alias("anchor_id"), "positive_id", "positive_score").join(negatives, ["uid", "turn"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
