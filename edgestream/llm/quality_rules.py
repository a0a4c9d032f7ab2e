"""Operator 8, quality rules: base counts of each text, and removal of lines that many documents of a host share.

Plan: one Arrow pass over whole texts gives each document's base counts and the 64-bit hashes of its
distinct normalised lines (A-Z folded, white space runs as one space), written as a small table with
a row id. Lines are counted per host over distinct texts (exact copies of a text are one document, so
a copied document is not mistaken for boilerplate) with map-side partial counts; only lines above the
limit are joined back, an equi-join that adaptive execution broadcasts or splits where it is skewed.
A document that keeps less than MIN_KEPT_PERCENT of its words, or fewer than MIN_WORDS, is depleted, and rejected; of the others
keep_good() returns the text without those lines. Texts are shuffled only where the frequent lines are
more than a task can hold.

Defined results: a null or empty text has no words, and counts of 0; a null host is a host of its own;
repeated rows are judged each, and count as one document of their host; other columns are not read
(keep_good() returns them all, unchanged); a text without a frequent line is returned as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, buffer_of, drop_since, in_arrow, materialise, mix, per_document, span_hashes, steps, window_hashes, word_spans, written

#: Fixed value: the contract's symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate in a host if more distinct texts of it hold the line than both this many and this share of all.
LEAST_LINE_DOCUMENTS = 5
LINE_PERCENT = 1
#: A document that keeps less than this share of its words is depleted.
MIN_KEPT_PERCENT = 40

#: Frequent lines (8 bytes each) that keep_good() sends to every task; beyond it they are joined to the texts by shuffle.
MOST_BROADCAST = 1 << 20

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[np.frombuffer(SYMBOLS, np.uint8)] = True

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _lines(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every \\n-split line; a document's first line starts with it."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, bounds[1:]]))
    return starts, ends


def repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document, its words that lie in a window found twice or more in it."""
    n, width = len(words), WINDOW
    if n < width:
        return np.zeros(len(first) - 1, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[: n - width + 1] == doc[width - 1 :]
    at = np.flatnonzero(whole)
    keys = window_hashes(words, width)[at] + mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + width, -1)
    return per_document(np.cumsum(cover[:-1]) > 0, first)


class Lines(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray
    name: np.ndarray  # hash of the folded words in order


def _normal_lines(raw: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Lines:
    """Every line, with the hash of its normalised form."""
    line_start, line_end = _lines(raw, bounds)
    doc = np.searchsorted(bounds, line_start, "right") - 1
    # an empty document shares its start with the next one's: its only line is empty, either way
    doc = np.clip(doc, 0, max(len(bounds) - 2, 0))
    first, last = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    n_words = last - first
    some = n_words > 0
    place = np.arange(len(starts)) - np.repeat(first[some], n_words[some])
    weight = mix(place.astype(np.uint64) + np.uint64(7)) | np.uint64(1)
    run = np.zeros(len(starts) + 1, np.uint64)
    np.cumsum(mix(span_hashes(raw, starts, ends) * weight), out=run[1:])
    return Lines(line_start, line_end, doc, n_words, mix(run[last] - run[first] + n_words.astype(np.uint64)))


def _measure(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    raw, bounds = buffer_of(batch.column(batch.schema.get_field_index("text")))
    n_docs = len(bounds) - 1
    starts, ends, first = word_spans(raw, bounds, SPACE)
    hashes = span_hashes(raw, starts, ends, None)
    in_word = ~SPACE[raw]
    chars = per_document(in_word & ((raw & 0xC0) != 0x80), bounds)

    lines = _normal_lines(raw, bounds, starts, ends)
    with_words, line_doc = lines.n_words > 0, lines.doc
    exact = span_hashes(raw, lines.start[with_words], lines.end[with_words], None) + mix(line_doc[with_words].astype(np.uint64) + np.uint64(1))
    order = np.argsort(exact, kind="stable")
    again = np.zeros(len(exact), np.int64)
    again[order[1:][exact[order][1:] == exact[order][:-1]]] = 1
    dup_lines = np.bincount(line_doc[with_words], again, n_docs).astype(np.int64) if n_docs else np.zeros(0, np.int64)
    normal = lines.name[with_words]
    docs, counts = line_doc[with_words], lines.n_words[with_words]
    order = np.lexsort((normal, docs))
    docs, normal, counts = docs[order], normal[order], counts[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (normal[1:] != normal[:-1])
    at = np.flatnonzero(new)
    counts = np.add.reduceat(counts, at) if len(at) else counts[:0]
    docs, normal = docs[at], normal[at]
    listed = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(docs, np.arange(n_docs + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(normal.view(np.int64)), pa.array(counts.astype(np.int64))], ["line", "words"]),
    )
    text_hash = span_hashes(raw, bounds[:-1], bounds[1:], None).view(np.int64)
    return {
        "n_words": pa.array(np.diff(first).astype(np.int64)),
        "word_chars": pa.array(chars),
        "n_symbols": pa.array(per_document(_IS_SYMBOL[raw], bounds)),
        "n_dup_lines": pa.array(dup_lines),
        "n_repeat_words": pa.array(repeated_words(hashes, first)),
        "text_hash": pa.array(text_hash),
        "text_bytes": pa.array(np.diff(bounds)),
        "lines": listed,
    }


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in steps(batch):
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column(0), "host": piece.column(1)} | _measure(piece))


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base counts and distinct normalised lines of each document, with a row id, as a written table."""
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, {BASE}, text_hash long, text_bytes long, lines array<struct<line:long,words:long>>"
    found = in_arrow(docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")), _measure_batches, kind)
    return materialise(found.withColumn("rid", F.monotonically_increasing_id()), "quality")


def frequent_lines(measured: DataFrame, least: int = LEAST_LINE_DOCUMENTS, percent: float = LINE_PERCENT) -> DataFrame:
    """host, line, n_documents of the normalised lines that more distinct texts of a host hold than least and percent of its texts."""
    texts = measured.groupBy("host", "text_hash", "text_bytes").agg(F.first("lines").alias("lines"))
    counted = texts.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_documents"))
    hosts = measured.select("host", "text_hash", "text_bytes").distinct().groupBy(F.col("host").alias("of")).agg(F.count("*").alias("n_texts"))
    counted = counted.where(F.col("n_documents") > least)
    return counted.join(hosts, counted.host.eqNullSafe(hosts.of)).where(100 * F.col("n_documents") > percent * F.col("n_texts")).select("host", "line", "n_documents")


def _found_in(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """rid, words, line of the frequent lines in each document."""
    named = frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    lines = measured.select("rid", "host", F.inline("lines"))
    return lines.join(named, lines.host.eqNullSafe(named.f_host) & (lines.line == named.f_line)).select("rid", "words", "line")


def judge(measured: DataFrame, least: int = LEAST_LINE_DOCUMENTS, percent: float = LINE_PERCENT, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """measured with n_removed (words in frequent lines), base_failed and kept; one row a document."""
    removed = _found_in(measured, frequent_lines(measured, least, percent)).groupBy("rid").agg(F.sum("words").alias("n_removed"))
    n, gone = F.col("n_words"), F.coalesce("n_removed", F.lit(0).cast("long"))
    out = measured.drop("lines").join(removed, "rid", "left").withColumn("n_removed", gone)
    out = out.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))
    left = n - F.col("n_removed")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (100 * left >= min_kept_percent * n))


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the base counts, n_removed, base_failed, kept."""
    return judge(measure(docs, host)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def keep_good(docs: DataFrame, host: str = "source", most_broadcast: int = MOST_BROADCAST, least: int = LEAST_LINE_DOCUMENTS, percent: float = LINE_PERCENT) -> DataFrame:
    """The documents that quality() keeps, all rows and columns, their texts without frequent lines.

    Rows are judged again while they stream by. The frequent lines go to every task if their counted number
    is within most_broadcast; else the frequent lines of each text are joined to it, by the text's name.
    """
    spark, start = docs.sparkSession, written()
    measured = measure(docs, host)
    frequent = materialise(frequent_lines(measured, least, percent), "frequent")
    small = frequent.count() <= most_broadcast
    known = line_keys([(r.host, r.line) for r in frequent.collect()]) if small else np.zeros(0, np.uint64)
    sent = spark.sparkContext.broadcast(known)
    if small:
        drop_since(start)
    text = F.col("text").cast("string")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).cast("string").alias("host"), text.alias("text"))
    if small:
        row = row.withColumn("gone", F.lit(None).cast("array<bigint>"))
    else:
        gone = _found_in(measured, frequent).groupBy("rid").agg(F.collect_set("line").alias("gone")).join(measured.select("rid", "host", "text_hash", "text_bytes"), "rid")
        gone = gone.groupBy("host", "text_hash", "text_bytes").agg(F.first("gone").alias("gone")).withColumnsRenamed({c: f"g_{c}" for c in ("host", "text_hash", "text_bytes")})
        kinds = T.StructType([*row.schema, T.StructField("text_hash", T.LongType()), T.StructField("text_bytes", T.LongType())])
        row = in_arrow(row, _named_batches, kinds)
        row = row.join(gone, row.host.eqNullSafe(gone.g_host) & (row.text_hash == gone.g_text_hash) & (row.text_bytes == gone.g_text_bytes), "left").select("row", "host", "text", "gone")
    return in_arrow(row, lambda it: _clean_batches(it, sent), T.StructType([row.schema["row"]])).select("row.*")


def _host_hashes(hosts: pa.Array) -> np.ndarray:
    raw, bounds = buffer_of(hosts)
    own = span_hashes(raw, bounds[:-1], bounds[1:], None)
    return np.where(hosts.is_null().to_numpy(zero_copy_only=False), np.uint64(1), own)


def line_keys(lines: list[tuple[str | None, int]]) -> np.ndarray:
    """A key for each host and line, ascending."""
    if not lines:
        return np.zeros(0, np.uint64)
    own = _host_hashes(pa.array([h for h, _ in lines], pa.string()))
    return np.unique(mix(own + np.array([n for _, n in lines], np.int64).view(np.uint64)))


def _named_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in steps(batch):
            raw, bounds = buffer_of(piece.column(2))
            names = [pa.array(span_hashes(raw, bounds[:-1], bounds[1:], None).view(np.int64)), pa.array(np.diff(bounds))]
            yield pa.RecordBatch.from_arrays([*piece.columns, *names], ["row", "host", "text", "text_hash", "text_bytes"])


def _clean_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Rows (row, host, text, gone) that pass, with row.text without its frequent lines."""
    known: np.ndarray = sent.value
    for batch in batches:
        for piece in steps(batch):
            row, texts = piece.column(0), piece.column(2)
            raw, bounds = buffer_of(texts)
            starts, ends, first = word_spans(raw, bounds, SPACE)
            n = np.diff(first).astype(np.int64)
            lines = _normal_lines(raw, bounds, starts, ends)
            out = (lines.n_words > 0) & np.isin(mix(_host_hashes(piece.column(1))[lines.doc] + lines.name), known) if len(n) else np.zeros(0, bool)
            for d, names in enumerate(piece.column(3).to_pylist()):
                if names:
                    own = lines.doc == d
                    out[own] |= (lines.n_words[own] > 0) & np.isin(lines.name[own].view(np.int64), np.array(names, np.int64))
            removed = np.bincount(lines.doc[out], lines.n_words[out], len(n)).astype(np.int64)
            repeats = repeated_words(span_hashes(raw, starts, ends, None), first)
            kept = (n >= MIN_WORDS) & (100 * repeats <= MAX_REPEAT_PERCENT * n) & (n - removed >= MIN_WORDS) & (100 * (n - removed) >= MIN_KEPT_PERCENT * n)
            if (removed > 0).any():
                row = _with_text(row, [_without(raw, lines, out, d) if removed[d] and kept[d] else texts[d].as_py() for d in range(len(n))])
            yield pa.RecordBatch.from_arrays([row], ["row"]).filter(pa.array(kept))


def _without(raw: np.ndarray, lines: Lines, out: np.ndarray, doc: int) -> str:
    left = np.flatnonzero((lines.doc == doc) & ~out)
    return b"\n".join(raw[lines.start[k] : lines.end[k]].tobytes() for k in left).decode()


def _with_text(row: pa.StructArray, texts: list[str | None]) -> pa.StructArray:
    fields = [row.type.field(k) for k in range(row.type.num_fields)]
    columns = [pa.array(texts, f.type) if f.name == "text" else c for f, c in zip(fields, row.flatten(), strict=True)]
    return pa.StructArray.from_arrays(columns, fields=fields)
