"""What the training-data operators share: shared-folder tables, byte-level words, hashes of word runs."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Text bytes that one numpy step holds; a longer document forms a step of its own.
STEP_BYTES = 1 << 19
#: Bytes of an Arrow batch between the JVM and a Python worker: both sides hold a batch or two.
BATCH_BYTES = 4 << 20

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes, whatever the rows' length (a setting of the session)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) != f"{BATCH_BYTES}b":
        conf.set(name, f"{BATCH_BYTES}b")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def release() -> None:
    """Give back what a worker's allocators keep: workers live on from task to task, beside each other."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local master without one (tests) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="edgestream-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors, and fixes row ids."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _scratch:
        atexit.register(_forget)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it follows the driver's garbage collection,
    which may not happen for long on its own. What has been materialised does not need them any more."""
    for _ in range(2):  # the first collection frees what held the references, the second queues them
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more: what was computed from them has been written."""
    paths = {getattr(t, "_written_path", None) for t in tables}
    gone = [x for x in _scratch if x[1] in paths]
    _scratch[:] = [x for x in _scratch if x[1] not in paths]
    _forget(gone)


def written() -> int:
    """How many tables materialise() has written and not dropped."""
    return len(_scratch)


def drop_since(start: int, but: Sequence[DataFrame] = ()) -> None:
    """Delete the tables written since written() said start, but those: the last reader's result of the others has been written."""
    keep = {t._written_path for t in but}
    gone = [x for x in _scratch[start:] if x[1] not in keep]
    _scratch[start:] = [x for x in _scratch[start:] if x[1] in keep]
    _forget(gone)


def _forget(tables: list[tuple[SparkSession, str]] | None = None) -> None:
    for spark, path in _scratch if tables is None else tables:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have ended first
            return


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


# --- bytes, words and hashes -------------------------------------------------------------------


def separators(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


#: The two word definitions, by the bytes that end a word.
SPACE = separators(b"\x20\x09\x0a\x0b\x0c\x0d")
NOT_ALNUM = separators(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and n + 1 offsets; null reads as empty."""
    if pc.any(pc.is_null(column)).as_py():
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[bounds[0] : bounds[-1]], bounds - bounds[0]) if len(bounds) else (raw[:0], np.zeros(1, np.int64))


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of a piece stays within most bytes; whole documents only."""
    if not batch.num_rows:
        return
    size = np.array(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False), np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def word_spans(raw: np.ndarray, bounds: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (n + 1 entries)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~ends_word[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True  # a document's end ends its last word
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Multipliers of the words of a window, by their place in it.
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), 1 << max(10, int(n).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """64-bit hash of the bytes of each span (A-Z folded unless fold is None), from one running polynomial sum."""
    n = len(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw if fold is None else fold[raw]] * powers(_P, n), out=run[1:])
    return mix((run[ends] - run[starts]) * powers(_P_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width consecutive words from each word on (the last width - 1 words have none)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _PLACE[0]
    for k in range(1, width):
        out += words[k : k + n] * _PLACE[k]
    return mix(out)


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


@cache
def crc32_remainder() -> str:
    return "pmod(crc32(cast(cast(doc_id as string) as binary)), 4)"
