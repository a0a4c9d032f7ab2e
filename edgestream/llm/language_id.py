"""Operator 2, language ID: script ranges narrow the candidates, Viterbi labels the words of mixed text.

A word's score for a language is the sum of log ratios of its byte trigrams (with its ends marked),
learned from labelled rows. A word in a script that a language does not use cannot be of that language.
Over a document's words, the best path with a penalty for each switch labels spans; the language with
most labelled words is the prediction, and its share of them the score.

Most documents are one language throughout, and that is decided without the dynamic program, exactly:
if no stretch of words gains more than half a penalty by any other language, no switch can pay. Only the
other documents are run through it, all of a block position by position at once.

The model is fitted on at most SAMPLE_PER_LANGUAGE labelled documents of each language, chosen by a hash
of their key, with whole texts; its size is fixed (GRAMS scores a language).

Defined results: null text and text without a letter (any character of a Unicode letter category) is "und"
with score 0, as is all text if nothing was learned; text whose letters are all in scripts that no language
uses is the most frequent learned language, with that language's share of the sample as its score; repeated
rows are predicted each; equal scores go to the alphabetically first language; extra columns are not read.
A text of n words needs n x languages doubles and as many small back pointers, whatever lies beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, LOWER_BYTES, NOT_ALNUM, buffer_of, crc32_remainder, in_arrow, steps, word_spans

SAMPLE_PER_LANGUAGE = 2000
GRAMS = 1 << 16
SMOOTHING = 0.5
#: Text bytes of a step: the dynamic program goes through all of a step's mixed documents at once.
PREDICTED_BYTES = 2 << 20
#: Log ratio that a switch of language costs.
SWITCH = 18.0
#: A trigram's log ratio is held within this.
MOST_RATIO = 6.0
#: Languages use the scripts of this share of their words or more.
LEAST_SCRIPT_SHARE = 0.01
UNKNOWN = "und"

#: First code points of Unicode ranges, and the script each begins (0: none).
SCRIPTS = ((0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 1), (0xB6, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 10), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 14), (0x3100, 15), (0x3130, 12), (0x3190, 15), (0xAC00, 12), (0xD7B0, 0), (0xF900, 15), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0x20000, 15), (0x30000, 0))
_RANGE = np.array([a for a, _ in SCRIPTS], np.int64)
_SCRIPT = np.array([s for _, s in SCRIPTS], np.int64)
N_SCRIPTS = int(_SCRIPT.max()) + 1

_ENDS_WORD = NOT_ALNUM[np.frombuffer(LOWER_BYTES, np.uint8)]


class Model(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # GRAMS x languages, float32
    scripts: np.ndarray  # N_SCRIPTS x languages, bool
    prior: np.ndarray  # share of the learned words of each language


_LETTER = regex.compile(r"\p{L}")


def with_letter(text: pa.Array) -> np.ndarray:
    """Whether each text holds a letter: the search ends at the first one."""
    return np.array([t is not None and _LETTER.search(t) is not None for t in text.to_pylist()], bool)


class Words(NamedTuple):
    """The words of a block of texts: bounds a document, trigram codes with their bounds, and scripts."""

    first: np.ndarray
    grams: np.ndarray
    gram_bounds: np.ndarray
    script: np.ndarray


def code_points(raw: np.ndarray) -> np.ndarray:
    """The code point that begins at each byte (-1 within one)."""
    pad = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
    b, n = pad, len(raw)
    lead = b[:n]
    two = (lead & 0x1F) << 6 | b[1 : n + 1] & 0x3F
    three = (lead & 0x0F) << 12 | (b[1 : n + 1] & 0x3F) << 6 | b[2 : n + 2] & 0x3F
    four = (lead & 0x07) << 18 | (b[1 : n + 1] & 0x3F) << 12 | (b[2 : n + 2] & 0x3F) << 6 | b[3 : n + 3] & 0x3F
    return np.where(lead < 0x80, lead, np.where(lead < 0xC0, -1, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))))


def words_of(text: pa.Array) -> Words:
    raw, bounds = buffer_of(text)
    starts, ends, first = word_spans(raw, bounds, _ENDS_WORD)
    # a word's bytes between two marks, all words behind one another
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    spread = np.full(int(at[-1]), 0x20, np.int64)
    inner = np.ones(len(spread), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    take = np.zeros(len(raw) + 1, np.int64)
    np.add.at(take, starts, 1)
    np.add.at(take, ends, -1)
    spread[inner] = LOWER[raw[np.cumsum(take[:-1]) > 0]] if len(raw) else 0
    code = (spread[:-2] * 0x9E3779B1 + spread[1:-1] * 0x85EBCA77 + spread[2:] * 0xC2B2AE3D) >> 13 & GRAMS - 1 if len(spread) > 2 else np.zeros(0, np.int64)
    # the last two places of a word begin a trigram that runs into the next one
    whole = np.ones(len(code), bool)
    cut = np.concatenate([at[1:] - 1, at[1:] - 2])
    whole[cut[(cut >= 0) & (cut < len(code))]] = False
    points = _SCRIPT[np.searchsorted(_RANGE, code_points(raw), "right") - 1] if len(raw) else np.zeros(0, np.int64)
    points = np.where((raw & 0xC0) == 0x80, 0, points)
    letters = np.flatnonzero(points)
    near = np.searchsorted(letters, starts)
    found = np.append(letters, len(raw))[near]
    script = np.where(found < ends, points[np.minimum(found, max(len(raw) - 1, 0))] if len(raw) else 0, 0)
    return Words(first, code[whole], np.concatenate([[0], np.cumsum(size - 2)]), script)


def word_scores(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """words x languages scores, and whether a word can be of any language."""
    n, k = len(words.script), len(model.languages)
    run = np.zeros((len(words.grams) + 1, k), np.float64)
    np.cumsum(model.grams[words.grams], axis=0, out=run[1:])
    score = run[words.gram_bounds[1:]] - run[words.gram_bounds[:-1]]
    allowed = model.scripts[words.script] if n else np.zeros((0, k), bool)
    known = allowed.any(axis=1)
    score[known[:, None] & ~allowed] = -1e3
    score[~known] = 0.0
    return score, known


def plain(score: np.ndarray, first: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Each document's best single language, and whether no switch can improve on it.

    Sure if no stretch of words gains more than switch / 2 in another language: a path of m > 1 stretches
    gains at most m * switch / 2, which is no more than its (m - 1) * switch.
    """
    n_docs, k = len(first) - 1, score.shape[1]
    run = np.concatenate([np.zeros((1, k)), np.cumsum(score, axis=0)])
    best = np.argmax(run[first[1:]] - run[first[:-1]], axis=1) if n_docs else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    sure = np.ones(n_docs, bool)
    for other in range(k):
        gain = score[:, other] - score[np.arange(len(doc)), best[doc]]
        total = np.concatenate([[0.0], np.cumsum(gain)])
        # running least within a document: each document is moved below all before it
        low = float(np.abs(total).max(initial=0.0)) * 2 + 1
        after, before = total[1:] - doc * low, total[:-1] - doc * low
        rise = after - np.minimum.accumulate(before) if len(doc) else after
        np.logical_and.at(sure, doc[rise > switch / 2 - 1e-6], False)
    return best, sure


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best label path of each document (words x languages scores), all documents a position at a time.

    Documents lie behind one another, the longest first, so that those alive at a position are the first
    ones; nothing is padded.
    """
    order = sorted(range(len(scores)), key=lambda d: -len(scores[d]))
    length = np.array([len(scores[d]) for d in order], np.int64)
    if not len(length) or not length[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    k = scores[0].shape[1]
    flat = np.concatenate([scores[d] for d in order])
    first = np.concatenate([[0], np.cumsum(length)])[:-1]
    best = np.zeros((len(order), k))
    back = np.zeros((len(flat), k), np.uint8 if k < 256 else np.uint16)
    alive = len(order)
    for t in range(int(length[0])):
        while length[alive - 1] <= t:
            alive -= 1
        now, at = best[:alive], first[:alive] + t
        top = now.argmax(axis=1)
        value = now[np.arange(alive), top]
        move = value[:, None] - switch > now
        back[at] = np.where(move, top[:, None], np.arange(k))
        best[:alive] = np.where(move, value[:, None] - switch, now) + flat[at]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for row, d in enumerate(order):
        path = np.zeros(length[row], np.int64)
        state = int(best[row].argmax())
        for t in range(int(length[row]) - 1, -1, -1):
            path[t] = state
            state = int(back[first[row] + t, state])
        out[d] = path
    return out


# --- learning ----------------------------------------------------------------------------------


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts of each language of a task's rows (lang, text): only codes met, so that all tasks together send what the sample holds."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for piece in steps(batch):
            words = words_of(piece.column(1))
            lang = np.array(piece.column(0).to_pylist(), object)
            of_word = np.repeat(lang, np.diff(words.first))
            of_gram = np.repeat(of_word, np.diff(words.gram_bounds))
            for name in set(lang):
                grams[name] = grams.get(name, 0) + np.bincount(words.grams[of_gram == name], minlength=GRAMS)
                scripts[name] = scripts.get(name, 0) + np.bincount(words.script[of_word == name], minlength=N_SCRIPTS)
    names = sorted(grams)
    both = [np.concatenate([grams[x], scripts[x]]).astype(np.int64) for x in names]
    codes = [np.flatnonzero(x) for x in both]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c.astype(np.int32).tobytes() for c in codes], pa.binary()), pa.array([x[c].tobytes() for x, c in zip(both, codes, strict=True)], pa.binary())], ["lang", "codes", "counts"])


def _sum_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tally a language, from the rows of whole languages."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, codes, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = total.setdefault(name, np.zeros(GRAMS + N_SCRIPTS, np.int64))
            own[np.frombuffer(codes, np.int32)] += np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "tally"])


#: What is learned from no row at all.
NOTHING = Model([], np.zeros((GRAMS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), np.zeros(0))


def learn(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on at most about sample whole documents a language (rows doc_id, lang, text), chosen by hash."""
    held = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in held.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return NOTHING
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))]), F.col("lang"))
    chosen = held.where(draw < share * 1_000_000).select("lang", "text")
    tallies = in_arrow(chosen, _tally, "lang string, codes binary, counts binary")
    found = in_arrow(tallies.repartition("lang"), _sum_tallies, "lang string, tally binary").collect()  # a row a language, of fixed size
    if not found:
        return NOTHING
    found.sort(key=lambda r: r.lang)
    names, whole = [r.lang for r in found], np.stack([np.frombuffer(r.tally, np.int64) for r in found], axis=1)
    tally = whole[:GRAMS] + SMOOTHING
    chance = np.log(tally / tally.sum(axis=0))
    ratio = np.clip(chance - chance.mean(axis=1, keepdims=True), -MOST_RATIO, MOST_RATIO).astype(np.float32)
    used = whole[GRAMS:].astype(float)
    prior = used.sum(axis=0) / max(used.sum(), 1.0)
    used[0] = 0
    return Model(names, ratio, used >= np.maximum(1, LEAST_SCRIPT_SHARE * used.sum(axis=0)), prior)


# --- prediction --------------------------------------------------------------------------------


def label_spans(path: np.ndarray, known: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of one label (first_word, last_word, lang) over a document's words."""
    if not len(path) or not known.any():
        return []
    cut = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    return [{"first_word": int(a), "last_word": int(z) - 1, "lang": languages[path[a]]} for a, z in zip(cut, np.r_[cut[1:], len(path)], strict=True)]


def predict_piece(text: pa.Array, model: Model, switch: float, with_spans: bool) -> tuple[list[str], np.ndarray, list]:
    n_docs, k = len(text), len(model.languages)
    predicted, share, spans = [UNKNOWN] * n_docs, np.zeros(n_docs), [[] for _ in range(n_docs)]
    if not k:
        return predicted, share, spans
    words, letters = words_of(text), with_letter(text)
    score, known = word_scores(words, model)
    known &= np.repeat(letters, np.diff(words.first))
    usual = int(model.prior.argmax())
    best, sure = plain(score, words.first, switch)
    mixed = np.flatnonzero(~sure)
    paths = dict(zip(mixed.tolist(), viterbi([score[words.first[d] : words.first[d + 1]] for d in mixed], switch), strict=True))
    for d in range(n_docs):
        a, z = words.first[d], words.first[d + 1]
        n = int(known[a:z].sum())
        if not n:
            if letters[d]:
                predicted[d], share[d] = model.languages[usual], float(model.prior[usual])
            continue
        if d in paths:
            votes = np.bincount(paths[d][known[a:z]], minlength=k)
            label = int(votes.argmax())
            predicted[d], share[d] = model.languages[label], votes[label] / n
        else:
            predicted[d], share[d] = model.languages[best[d]], 1.0
        if with_spans:
            spans[d] = label_spans(paths.get(d, np.full(z - a, best[d])), known[a:z], model.languages)
    return predicted, share, spans


def _predict(batches: Iterator[pa.RecordBatch], model, switch: float, with_spans: bool) -> Iterator[pa.RecordBatch]:
    own: Model = model.value
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("lang", pa.string())]))
    for batch in batches:
        for piece in steps(batch, most=PREDICTED_BYTES):
            predicted, share, spans = predict_piece(piece.column(1), own, switch, with_spans)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(predicted, pa.string()), pa.array(share), pa.array(spans, kind)], ["row", "lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), switch: float = SWITCH, with_spans: bool = True) -> DataFrame:
    """row (a struct of the carried columns), lang_pred, score, spans of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<first_word:long,last_word:long,lang:string>>"
    return in_arrow(rows, lambda it: _predict(it, sent, switch, with_spans), kind)


def held_out_languages(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows whose crc32(doc_id) mod 4 is not 2 (a null id is not learned from)."""
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.expr(crc32_remainder()).alias("fold"))
    model = learn(keyed.where("fold <> 2").select("doc_id", "lang", "text"), sample)
    held = docs.select("doc_id", "text", F.coalesce(F.expr(crc32_remainder()) == 2, F.lit(False)).alias("held_out"))
    return identify(held, model, ("doc_id", "held_out"), with_spans=False).select("row.doc_id", "row.held_out", "lang_pred", "score")
