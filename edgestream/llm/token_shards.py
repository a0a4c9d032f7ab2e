"""Operator 5, token-ID / binary output: training order materialised as fixed-stride shards.

1. Documents are encoded once into a written table (token ids as little-endian integers, each document
   ended by an end token). The table's parts, and the rows in a part, fix one long stream of tokens; a
   document's place in it is its part's first token (a running sum over one row a part) plus its own.
   The exchange carries tokens by their rank of frequency, counted over the whole table, as two byte planes
   and compressed: a token then costs little more than its information.
2. The stream is cut every `length` tokens into sequences, across documents, so only the last is padded.
3. A keyed Feistel network over the next even number of bits, walked until it lands below the number of
   sequences, is a permutation of them: it gives each sequence its slot in training order, without a sort
   and without a stored order.
4. Slots are dealt to shards by range (one partition a shard), sorted there, and written by Spark's text
   writer, whose commits survive lost executors on any file system: a record is the sequence's bytes and
   one "\\n", so record k of a shard begins at k * stride, and slot s is record s % per_shard of shard
   s // per_shard. A reader resumes at any slot with one seek.

Defined results: null and empty texts have no tokens and take no place in the stream; repeated rows are
encoded each; a null doc_id is listed as null; an empty table gives no sequence and no shard; extra
columns are not read. The order is fixed by the written token table: read again from other files, the same
documents may get other slots.
"""

from __future__ import annotations

import json
import uuid
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, in_arrow, materialise, mix, scratch_dir, steps

LENGTH = 2048
#: Records of a shard, at least; doubled until the shards are no more than MOST_SHARDS.
PER_SHARD = 4096
MOST_SHARDS = 8192
KEY = 0x5DEECE66D
ROUNDS = 6


class Layout(NamedTuple):
    """What a reader needs to know; kept beside the shards as layout.json."""

    length: int
    per_shard: int
    width: int  # bytes a token
    n_tokens: int
    n_sequences: int
    key: int
    end: int

    @property
    def stride(self) -> int:
        return self.length * self.width + 1


class Permutation:
    """A keyed bijection of [0, n): Feistel rounds over 2 * half bits, walked until the value is below n."""

    def __init__(self, n: int, key: int) -> None:
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [mix(np.array([(key + r * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0] for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & self.mask)
        return (right << np.uint64(self.half)) | left  # halves swapped, so that the reversed keys undo it

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], keys)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self.keys)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


class Ranks(NamedTuple):
    """Token ids by falling frequency (ties: the smaller id), and the rank of each id."""

    ids: np.ndarray
    of: np.ndarray

    @classmethod
    def by(cls, counts: np.ndarray, width: int) -> Ranks:
        ids = np.argsort(-counts, kind="stable").astype(np.dtype(f"<u{width}"))
        of = np.empty_like(ids)
        of[ids] = np.arange(len(ids), dtype=ids.dtype)
        return cls(ids, of)

    def pack(self, tokens: np.ndarray) -> bytes:
        """Token ids compressed for the exchange, in which a row is compressed alone: the low bytes of the ranks, then the higher ones."""
        planes = self.of[tokens].view(np.uint8).reshape(len(tokens), -1).T
        return zstandard.compress(planes.tobytes(), 3)

    def unpack(self, blob: bytes) -> bytes:
        width = self.ids.dtype.itemsize
        planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1)
        return self.ids[np.ascontiguousarray(planes.T).view(self.ids.dtype)[:, 0]].tobytes()


def _count_tokens(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        raw, _ = buffer_of(batch.column(0))
        total += np.bincount(raw.view(np.dtype(f"<u{width}")), minlength=size)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])


def frequencies(table: DataFrame, size: int, width: int) -> np.ndarray:
    """How often each token stands in the table: a row a token of the vocabulary reaches the driver."""
    seen = in_arrow(table.select("tokens"), lambda it: _count_tokens(it, size, width), "token long, n long")
    counts = np.zeros(size, np.int64)
    for r in seen.groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r.token] = r.n
    return counts


def records_of_shard(n_sequences: int, least: int = PER_SHARD, most_shards: int = MOST_SHARDS) -> int:
    """least, doubled until the shards are few enough."""
    while n_sequences > least * most_shards:
        least *= 2
    return least


# --- encoding ----------------------------------------------------------------------------------


def default_ranks() -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks={b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def _encode(batches: Iterator[pa.RecordBatch], ranks, end: int, width: int) -> Iterator[pa.RecordBatch]:
    coder = encoding(*ranks.value)
    part, place, kind = TaskContext.get().partitionId(), 0, np.dtype(f"<u{width}")
    for batch in batches:
        for piece in steps(batch):
            rows = [(i, t) for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) if t]
            ids = [coder.encode_ordinary(t) for _, t in rows]
            n = np.array([len(x) + 1 for x in ids], np.int64)
            at = place + np.concatenate([[0], np.cumsum(n)])
            place = int(at[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], piece.schema.field(0).type), pa.array(np.full(len(rows), part, np.int32)), pa.array(at[:-1]), pa.array(n), pa.array([np.array([*x, end], kind).tobytes() for x in ids], pa.binary())],
                ["doc_id", "part", "place", "n", "tokens"],
            )


def encoded(docs: DataFrame, ranks: tuple[bytes, str] | None = None) -> tuple[DataFrame, int, int]:
    """The written table doc_id, part, place, n, tokens; the end token; bytes a token."""
    ranks = ranks or default_ranks()
    end = max(encoding(*ranks)._mergeable_ranks.values()) + 1
    width = 2 if end < 1 << 16 else 4
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, place long, n long, tokens binary"
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return materialise(in_arrow(texts, lambda it: _encode(it, sent, end, width), kind), "tokens"), end, width


# --- sequences ---------------------------------------------------------------------------------


def _token_hash(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Values whose sum names a run of tokens and their places."""
    return mix((place.astype(np.uint64) << np.uint64(20)) + tokens.astype(np.uint64) + np.uint64(1))


def _pieces(batches: Iterator[pa.RecordBatch], bases, layout: Layout, ranks=None) -> Iterator[pa.RecordBatch]:
    """Rows part, place, doc_id, tokens to pieces of sequences: packed tokens if ranks are given, else names and
    documents. Documents that follow one another share pieces."""
    pack = ranks.value.pack if ranks is not None else None
    first, kind, order = bases.value, np.dtype(f"<u{layout.width}"), Permutation(max(layout.n_sequences, 1), layout.key)
    for batch in batches:
        start = np.array([first[p] for p in batch.column(0).to_pylist()], np.int64) + batch.column(1).to_numpy(zero_copy_only=False)
        ids, blobs = batch.column(2).to_pylist(), [np.frombuffer(b, kind) for b in batch.column(3).to_pylist()]
        size = np.array([len(b) for b in blobs], np.int64)
        breaks = np.flatnonzero(np.r_[True, start[1:] != start[:-1] + size[:-1]]) if len(start) else np.zeros(0, np.int64)
        out: list[tuple] = []
        for a, z in zip(breaks, np.r_[breaks[1:], len(start)], strict=True):
            tokens = np.concatenate(blobs[a:z])
            at = int(start[a])
            bounds = np.r_[at, np.arange(at // layout.length + 1, -(-(at + len(tokens)) // layout.length)) * layout.length, at + len(tokens)]
            sequence = bounds[:-1] // layout.length
            slots = order.slot(sequence)
            if pack:
                runs = zip(slots.tolist(), sequence.tolist(), (bounds[:-1] % layout.length).tolist(), np.diff(bounds).tolist(), (bounds - at).tolist(), (bounds[1:] - at).tolist(), strict=False)
                out += [(slot, s, begin, n, 0, (), pack(tokens[i:j])) for slot, s, begin, n, i, j in runs]
                continue
            names = _token_hash(tokens, (np.arange(len(tokens)) + at) % layout.length)
            sums = np.add.reduceat(names, bounds[:-1] - at).view(np.int64)
            # documents that overlap a piece
            low = np.searchsorted(start[a:z] + size[a:z], bounds[:-1], "right") + a
            high = np.searchsorted(start[a:z], bounds[1:], "left") + a
            for k in range(len(sequence)):
                out.append((int(slots[k]), int(sequence[k]), int(bounds[k] % layout.length), int(bounds[k + 1] - bounds[k]), int(sums[k]), ids[low[k] : high[k]], None))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(batch.schema.field(2).type), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], ["slot", "sequence", "begin", "n", "name", "doc_ids", "tokens"])


def _assemble(batches: Iterator[pa.RecordBatch], layout: Layout, ranks) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by slot and begin, joined to records of fixed size; the stream's end is padded with end tokens."""
    pad = np.full(layout.length, layout.end, np.dtype(f"<u{layout.width}")).tobytes()
    unpack = ranks.value.unpack
    now, held = None, []
    for batch in batches:
        out = []
        for slot, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if slot != now and held:
                out.append(b"".join(held))
                held = []
            now = slot
            held.append(unpack(tokens))
        yield pa.RecordBatch.from_arrays([pa.array([(x + pad)[: len(pad)] for x in out], pa.binary())], ["record"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([(b"".join(held) + pad)[: len(pad)]], pa.binary())], ["record"])


def write_shards(docs: DataFrame, path: str | None = None, length: int = LENGTH, per_shard: int | None = None, key: int = KEY, ranks: tuple[bytes, str] | None = None) -> tuple[DataFrame, str]:
    """Write the shards below path (a folder of the shared one if None).

    Returns a row for each sequence (slot, sequence, shard, record, byte_offset, n_tokens, doc_ids,
    token_hash) and the path.
    """
    spark = docs.sparkSession
    table, end, width = encoded(docs, ranks)
    sums = {r.part: r.n for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a part
    bases, total = {}, 0
    for p in sorted(sums):
        bases[p], total = total, total + sums[p]
    per_shard = per_shard or records_of_shard(-(-total // length))
    layout = Layout(length, per_shard, width, total, -(-total // length), key, end)
    sent = spark.sparkContext.broadcast(bases)
    rows = table.select("part", "place", "doc_id", "tokens")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"slot long, sequence long, begin int, n int, name long, doc_ids array<{id_type}>, tokens binary"

    path = path or f"{scratch_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    n_shards = -(-layout.n_sequences // per_shard)
    if n_shards:
        by_rank = spark.sparkContext.broadcast(Ranks.by(frequencies(table, end + 1, width), width))  # a vocabulary
        pieces = in_arrow(rows, lambda it: _pieces(it, sent, layout, by_rank), kind).select("slot", "begin", "tokens")
        dealt = pieces.repartitionById(n_shards, F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot", "begin")
        records = in_arrow(dealt.select("slot", "tokens"), lambda it: _assemble(it, layout, by_rank), "record binary")
        # the text writer writes a string's bytes as they are
        records.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(f"{path}/shards")
    spark.createDataFrame([(json.dumps(layout._asdict()),)], "value string").coalesce(1).write.text(f"{path}/layout.json")

    parts = in_arrow(rows, lambda it: _pieces(it, sent, layout), kind).drop("tokens")
    named = parts.groupBy("slot").agg(
        F.first("sequence").alias("sequence"),
        F.sum(F.col("n").cast("long")).alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("begin", "doc_ids"))).alias("p"),
        # a wrapping sum: ANSI arithmetic would raise
        F.sum(F.col("name").cast("decimal(38,0)")).alias("token_hash"),
    )
    wrapped = F.expr(f"string(pmod(token_hash, cast('{1 << 64}' AS decimal(38, 0))))")
    return named.select(
        "slot",
        "sequence",
        F.floor(F.col("slot") / per_shard).cast("int").alias("shard"),
        F.pmod("slot", F.lit(per_shard)).alias("record"),
        (F.pmod("slot", F.lit(per_shard)) * layout.stride).alias("byte_offset"),
        "n_tokens",
        F.array_distinct(F.flatten("p.doc_ids")).alias("doc_ids"),
        wrapped.alias("token_hash"),
    ), path


# --- reading -----------------------------------------------------------------------------------


def read_layout(spark: SparkSession, path: str) -> Layout:
    return Layout(**json.loads(spark.read.text(f"{path}/layout.json").first()[0]))


def read_slots(spark: SparkSession, path: str, start: int, count: int) -> Iterator[np.ndarray]:
    """The sequences of slots start .. start + count - 1, in order: one seek into each shard, then sequential reads."""
    layout = read_layout(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shards")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files: dict[int, Any] = {int(f.getPath().getName().split("-")[1]): f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")}
    slot, stop = start, min(start + count, layout.n_sequences)
    while slot < stop:
        shard = slot // layout.per_shard
        n = min(stop, (shard + 1) * layout.per_shard) - slot
        stream = fs.open(files[shard])
        try:
            stream.seek(slot % layout.per_shard * layout.stride)
            for _ in range(n):
                record = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, layout.stride))
                yield np.frombuffer(record[:-1], np.dtype(f"<u{layout.width}"))
        finally:
            stream.close()
        slot += n
