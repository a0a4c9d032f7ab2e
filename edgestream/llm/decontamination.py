"""Operator 4, benchmark decontamination: a stored, distributed positional inverted index.

1. Index. Documents are cut into blocks, and every block is written as one row of the index table: its
   terms (64-bit hashes in order, with their spelling), and for each term the ascending list of positions
   at which it stands in the block's texts. All tokens are posted, whatever is asked later; an index cut by
   documents needs no exchange of postings, and a lost executor costs the blocks it was about to write.
2. Questions. The benchmark's items are compiled, a block of bounded size at a time and in the cluster, to
   distinct windows of term numbers. Compiled blocks are sent to the tasks together up to PASS_BYTES of
   counted bytes; a larger benchmark is asked in several passes over the stored index, each the same plan,
   whose answers are merged by document.
3. Answers. In each block, all windows whose terms it has are answered at once: the list of a window's
   rarest term gives its first candidates, which are intersected, offset-adjusted, with the lists of its
   other terms from the next rarest on. Terms are compared by spelling, so that a hash never decides.

matches() returns the places, of exact phrases or of windows whose words stand near each other.

Defined results: null and empty texts have no words, no hits and no items; an item without words has
no window; a null item_id marks hits but is not listed; equal item_ids count once; repeated documents
are answered each; extra columns are not read (drop_contaminated() returns them all).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, NOT_ALNUM, buffer_of, drop, drop_since, in_arrow, materialise, span_hashes, steps, word_spans, written

WINDOW = 10
#: Compiled questions (bytes) that every task holds in one pass over the index.
PASS_BYTES = 32 << 20
#: Bytes of benchmark text that are compiled together.
COMPILED_BYTES = 1 << 19
#: Names of contaminated texts (about 50 bytes each) that drop_contaminated() broadcasts; beyond it they are joined by shuffle.
MOST_BROADCAST = 200_000

_TO_WORDS = bytes(32 if NOT_ALNUM[LOWER_BYTES[b]] else LOWER_BYTES[b] for b in range(256))
#: Ends of words in unfolded bytes: A-Z are word bytes too.
NOT_ALNUM_FOLDED = NOT_ALNUM[np.frombuffer(LOWER_BYTES, np.uint8)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


# --- the index ---------------------------------------------------------------------------------


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) to one index row a block."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in steps(batch):
            raw, bounds = buffer_of(piece.column(1))
            starts, ends, first = word_spans(raw, bounds, NOT_ALNUM_FOLDED)
            hashes = span_hashes(raw, starts, ends)
            at = np.argsort(hashes, kind="stable")  # a term's positions stay in order
            hashes = hashes[at]
            new = np.ones(len(at), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            begin = np.flatnonzero(new)
            step = np.diff(at, prepend=0)
            step[begin] = at[begin]
            spelled = b" ".join(raw[starts[p] : ends[p]].tobytes() for p in at[begin]).translate(LOWER_BYTES)
            blobs = [np.diff(first).astype(np.int32), hashes[begin], spelled, np.diff(np.r_[begin, len(at)]).astype(np.int32), step.astype(np.uint32)]
            rows = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), rows, *(pa.array([b if isinstance(b, bytes) else b.tobytes()], pa.binary()) for b in blobs)], ["block", "rows", "n_words", "terms", "spelled", "counts", "steps"])
            number += 1


def build_index(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The written index table of docs: block, rows (the carried columns of its documents) and its lists."""
    rows = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    kind = f"block long, rows array<{rows.schema['row'].dataType.simpleString()}>, n_words binary, terms binary, spelled binary, counts binary, steps binary"
    return materialise(in_arrow(rows, _index_batches, kind), "index")


class Index(NamedTuple):
    """One block of the index, read."""

    terms: np.ndarray  # ascending hashes
    words: list[bytes]
    bounds: np.ndarray  # of each term's list
    positions: np.ndarray
    first: np.ndarray  # first position of each document, and the end

    @classmethod
    def read(cls, n_words: bytes, terms: bytes, spelled: bytes, counts: bytes, steps_: bytes) -> Index:
        bounds = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)])
        run = np.cumsum(np.frombuffer(steps_, np.uint32), dtype=np.int64)
        before = np.concatenate([[0], run])[bounds[:-1]]
        return cls(np.frombuffer(terms, np.uint64), spelled.split(b" "), bounds, run - np.repeat(before, np.diff(bounds)), np.concatenate([[0], np.cumsum(np.frombuffer(n_words, np.int32), dtype=np.int64)]))

    def numbers(self, terms: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The place of each asked term in the block, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        for k in np.flatnonzero(self.terms[at] == terms):
            if self.words[at[k]] != words[k]:
                at[k] = -1
        at[(at >= 0) & (self.terms[at] != terms)] = -1
        return at

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.bounds[term] : self.bounds[term + 1]]

    def phrases(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and first position of every match of phrases (a matrix of term places, all of them present)."""
        n = phrases.shape[1]
        counts = np.diff(self.bounds)
        rarest = np.argsort(counts[phrases], axis=1, kind="stable")
        size = counts[np.take_along_axis(phrases, rarest[:, :1], axis=1)[:, 0]]
        which = np.repeat(np.arange(len(phrases)), size)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        start = self.positions[np.repeat(self.bounds[np.take_along_axis(phrases, rarest[:, :1], axis=1)[:, 0]], size) + inside] - rarest[which, 0]
        doc = np.searchsorted(self.first, start, "right") - 1
        whole = (start >= 0) & (doc >= 0) & (start + n <= self.first[np.minimum(doc + 1, len(self.first) - 1)])
        which, start = which[whole], start[whole]
        # the lists behind one another, as (term, position) in one ascending order
        width = np.int64(self.first[-1] + 1)
        postings = np.repeat(np.arange(len(self.terms)), counts) * width + self.positions
        for k in range(1, n):
            if not len(start):
                break
            offset = rarest[which, k]
            wanted = phrases[which, offset] * width + start + offset
            at = np.searchsorted(postings, wanted)
            at[at == len(postings)] = 0
            held = postings[at] == wanted
            which, start = which[held], start[held]
        return which, start

    def near(self, terms: np.ndarray, within: int) -> list[tuple[int, int]]:
        """Shortest spans (first, last position) of at most within words that hold all the terms, in any order."""
        lists = sorted((self.list_of(t) for t in np.unique(terms)), key=len)
        out = []
        for p in lists[0]:  # every span holds the rarest term
            doc = np.searchsorted(self.first, p, "right") - 1
            low, high = max(self.first[doc], p - within + 1), min(self.first[doc + 1], p + within)
            got = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
            if all(map(len, got)):
                ends = np.unique(np.concatenate(got))
                best = None
                for s in ends[ends <= p]:
                    firsts = [x[np.searchsorted(x, s)] if np.searchsorted(x, s) < len(x) else high + within for x in got]
                    e = max(*firsts, p)
                    if e - s < within and (best is None or e - s < best[1] - best[0]):
                        best = (int(s), int(e))
                if best:
                    out.append(best)
        return sorted(set(out))


# --- questions ---------------------------------------------------------------------------------


class Questions(NamedTuple):
    """The distinct windows of some items. Terms are numbered; windows of one length form one matrix."""

    terms: np.ndarray  # hashes of the distinct words
    words: list[bytes]
    phrases: dict[int, np.ndarray]  # length -> windows x length term numbers
    items: dict[int, list[np.ndarray]]  # length -> for each window, the numbers of its items
    names: list[str | None]


def compile_items(items: list[tuple[Any, str | None]], width: int = WINDOW) -> Questions:
    split = [words_of(text) for _, text in items]
    words = sorted({w for ws in split for w in ws})
    number = {w: k for k, w in enumerate(words)}
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, np.int64)
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for k, ws in enumerate(split):
        n = min(width, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(tuple(number[w] for w in ws[i : i + n]), set()).add(k)
    return Questions(
        span_hashes(raw, ends - np.array([len(w) for w in words], np.int64), ends),
        words,
        {n: np.array(list(p), np.int64).reshape(-1, n) for n, p in found.items()},
        {n: [np.array(sorted(s)) for s in p.values()] for n, p in found.items()},
        [None if i is None else str(i) for i, _ in items],
    )


def _compile_batches(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in steps(batch, most=most):
            made = compile_items(list(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)), width)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["questions"])


def passes(benchmark: DataFrame, width: int = WINDOW, most: int = PASS_BYTES, compiled: int = COMPILED_BYTES) -> list[Broadcast]:
    """The compiled questions, in groups of at most most bytes (or one block): one pass over the index each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    made = materialise(in_arrow(items, lambda it: _compile_batches(it, width, compiled), "questions binary"), "questions")
    groups: list[list[bytes]] = [[]]
    size = 0
    for r in made.toLocalIterator():
        if groups[-1] and size + len(r.questions) > most:
            groups.append([])
            size = 0
        groups[-1].append(bytes(r.questions))
        size += len(r.questions)
    drop(made)
    return [spark.sparkContext.broadcast(g) for g in groups]


def _asked(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[tuple[pa.RecordBatch, int, Index, list[tuple[Questions, np.ndarray]]]]:
    """Each block of the index with the questions and their terms' places in it."""
    questions: list[Questions] = [pickle.loads(b) for b in sent.value]
    for batch in batches:
        for k in range(batch.num_rows):
            index = Index.read(*(batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("n_words", "terms", "spelled", "counts", "steps")))
            yield batch, k, index, [(q, index.numbers(q.terms, q.words)) for q in questions]


def _answers(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """For each document of each block: the positions that are hit, and the items found."""
    for batch, k, index, asked in _asked(batches, sent):
        n_docs, total = len(index.first) - 1, int(index.first[-1])
        cover = np.zeros(total + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(n_docs)]
        for q, places in asked:
            for n, phrases in q.phrases.items():
                there = places[phrases]
                known = np.flatnonzero((there >= 0).all(axis=1))
                if not len(known):
                    continue
                which, start = index.phrases(there[known])
                np.add.at(cover, start, 1)
                np.add.at(cover, start + n, -1)
                for w, d in {*zip(known[which].tolist(), (np.searchsorted(index.first, start, "right") - 1).tolist(), strict=True)}:
                    items[d].update(q.names[i] for i in q.items[n][w] if q.names[i] is not None)
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        bounds = np.searchsorted(hit, index.first)
        own = hit - np.repeat(index.first[:-1], np.diff(bounds))
        rows = batch.column(1)[k].values
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n_docs, batch.column(0)[k].as_py())),
                pa.array(np.arange(n_docs, dtype=np.int32)),
                rows,
                pa.array(np.diff(index.first)),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(own, pa.int32())),
                pa.array([sorted(s) for s in items], pa.list_(pa.string())),
            ],
            ["block", "doc", "row", "n_words", "hit", "items"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), most: int = PASS_BYTES, compiled: int = COMPILED_BYTES) -> DataFrame:
    """row (a struct of the carried columns), n_words, n_hit, n_items, items_sha256, items, contaminated."""
    index = build_index(docs, carry)
    row = index.schema["rows"].dataType.elementType.simpleString()
    kind = f"block long, doc int, row {row}, n_words long, hit array<int>, items array<string>"
    found = None
    sent = passes(benchmark, width, most, compiled)
    for group in sent:
        answers = in_arrow(index, lambda it, g=group: _answers(it, g), kind)
        found = answers if found is None else found.unionAll(answers)
    if len(sent) > 1:
        merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit", "items")]
        found = found.groupBy("block", "doc").agg(F.first("row").alias("row"), F.first("n_words").alias("n_words"), *merged)
    return found.select(
        "row",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "items",
        (F.size("hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    return contamination(docs, benchmark, width).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The documents without any hit, with all their columns. A text's hits are its own, so texts are named by
    their digest, and rows whose text is one of the contaminated ones go; the index is deleted once these are known."""
    start = written()
    name = F.sha2(F.col("text").cast("string"), 256)
    named = docs.select(name.alias("name"), "text")
    bad = materialise(contamination(named, benchmark, width, ("name",)).where("contaminated").select(F.col("row.name").alias("_contaminated")).distinct(), "contaminated")
    n = bad.count()
    drop_since(start, but=(bad,))
    return docs.join(F.broadcast(bad) if n <= most_broadcast else bad, name == F.col("_contaminated"), "left_anti")


def _matches(batches: Iterator[pa.RecordBatch], sent: Broadcast, within: int | None) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("doc_id", pa.string()), ("item", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    for batch, k, index, asked in _asked(batches, sent):
        ids, rows = batch.column(1)[k].values.field("doc_id").to_pylist(), []
        for q, places in asked:
            for n, phrases in q.phrases.items():
                there = places[phrases]
                known = np.flatnonzero((there >= 0).all(axis=1))
                if not len(known):
                    continue
                if within is None:
                    which, start = index.phrases(there[known])
                    spans = [(int(w), int(s), int(s) + n - 1) for w, s in zip(known[which], start, strict=True)]
                else:
                    spans = [(int(w), a, b) for w in known for a, b in index.near(there[w], max(within, n))]
                for w, a, b in spans:
                    d = int(np.searchsorted(index.first, a, "right") - 1)
                    rows += [(ids[d], q.names[i], a - int(index.first[d]), b - int(index.first[d])) for i in q.items[n][w]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], schema=kinds)


def matches(docs: DataFrame, phrases: DataFrame, within: int | None = None, width: int = WINDOW) -> DataFrame:
    """doc_id (as a string), item, first_word, last_word of every match of every window of the phrases.

    within None: the exact phrase. Else proximity: all the window's words, in any order, within that many
    words (the shortest span around each place of the rarest term).
    """
    index = build_index(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), ("doc_id",))
    kind = "doc_id string, item string, first_word long, last_word long"
    out = None
    for group in passes(phrases, width):
        found = in_arrow(index, lambda it, g=group: _matches(it, g, within), kind)
        out = found if out is None else out.unionAll(found)
    return out
