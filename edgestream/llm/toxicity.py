"""Operator 9, toxicity: a weighted finite-state grammar over clauses.

Words are read as classes: insult, threat, target, negation, report, article, other. Transducers rewrite a
clause's classes. Read from right to left, a threat that a negation closely follows is taken back. Read from
left to right, a threat whose subject is a thing ("the movie beat them all") is none; negation marks what follows it
closely, reported speech marks the rest of its clause, a near target before an insult or threat marks
it, and one after it is marked itself as aimed at; and a weighted acceptor prices the marked symbols. The machines
are composed once into one table, which then runs over those clauses only that hold an insult or a threat.
A text's score is a logistic value of what its clauses matched, added over at most MOST_CLAUSES of a kind: by
its own prices, one insult that is aimed at nobody stays below the threshold, a threat at somebody lies above
it; and however many words are aimed at nobody, and whatever was learned, they never outweigh one insult or threat
that is aimed at somebody. `verdicts_by_machine` counts the verdicts that each machine changes.

Learned from labelled rows: the insult lexicon (words, and beginnings of words, that more toxic texts
hold than chance allows, and more of them than clean ones; near copies count as one text; an entry weighs
its precision), and the prices, whose prior is the grammar's own; whatever they come to, one insult or
threat aimed at somebody decides. The fit uses at most about SAMPLE_TOXIC and SAMPLE_CLEAN labelled
documents, chosen by a hash of their key, with whole texts.

Defined results: null and empty texts match nothing and score the bias; without any labelled row the
hand-written lexicon and prices are used; a document labelled twice counts by its larger label; repeated
rows are scored each; labels, language, source and key are never inputs of a score; extra columns are
not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, NOT_ALNUM, buffer_of, crc32_remainder, drop, in_arrow, materialise, mix, separators, span_hashes, steps, window_hashes, word_spans

SAMPLE_TOXIC = 3000
SAMPLE_CLEAN = 9000
THRESHOLD = 0.3
#: Lengths in bytes of the beginnings of words that may enter the lexicon.
BEGINNINGS = (5, 6, 7, 8)
#: An entry is in this many toxic texts at least, and this precise.
LEAST_TEXTS = 3
LEAST_PRECISION = 0.5
#: Clauses of a kind that a text's score counts, and the most that one clause counts.
MOST_CLAUSES, MOST_OF_CLAUSE = 4.0, 2.0
#: Words between a target and what it marks, before and after.
REACH_BEFORE, REACH_AFTER = 4, 3
#: Log of the expected number of entries that chance alone would make.
MOST_CHANCE = -4.0
#: Orders in which texts are compared to find near copies within the sample.
COPY_HASHES = 6

#: The grammar's words in the four languages.
WORDS = {
    "threat": "kill hurt destroy punch strangle beat murder shoot stab töten umbringen schlagen verprügeln tuer tuerai frapper frapperai égorger matar mataré golpear golpearé",
    "target": "you your yours he she they him her them du dich dir sie ihr euch bist tu te toi vous il elle ils tú te usted ustedes él ella ellos eres hijo hija",
    "negation": "not never no nobody cannot nicht nie kein keine pas jamais aucun nunca jamás ningún",
    "article": "the a an this that these der die das ein eine dieser diese le la les un une ce cette el los las una este esta",
    "report": "said says say wrote quoted claimed called alleged sagte sagt behauptet dit déclare affirme dijo dice afirma",
    "insult": "idiot moron stupid worthless pathetic scum loser clown trash disgusting bitch bastard asshole imbecile dummkopf arschloch wichser abschaum versager trottel idiote stupide connard connasse salope imbécile crétin idiota estúpido estúpida imbécil puta puto cabrón pendejo gilipollas basura",
}
CLASSES = ("other", "insult", "threat", "target", "negation", "report", "article")
_CODE = {c: k for k, c in enumerate(CLASSES)}
_ENDS_CLAUSE = separators(b'.!?;:\n"')
_ENDS_WORD = NOT_ALNUM[np.frombuffer(LOWER_BYTES, np.uint8)]

#: Prices before any data: log odds that a clause's marked symbol adds, and the bias.
PRIOR = {"insult": 2.2, "insult+target": 5.5, "insult+aimed": 1.0, "insult+negated": 0.5, "insult+reported": 1.0, "threat": 0.5, "threat+target": 1.5, "threat+aimed": 6.0, "threat+negated": 0.1, "threat+reported": 0.5}
KINDS = tuple(PRIOR)
#: Kinds of which one clause decides, and the log odds it then leads to at least.
DECISIVE, DECIDES = ("insult+target", "threat+aimed"), 0.5
#: Kinds that are aimed at somebody; all others together stay this far below what one decisive clause comes to.
AIMED, BELOW = ("insult+target", "insult+aimed", "threat+target", "threat+aimed"), 0.1
BIAS = -3.5


# --- transducers -------------------------------------------------------------------------------


class Fst:
    """A deterministic transducer: arcs (state, input) -> (state, output, weight)."""

    def __init__(self, start: object) -> None:
        self.start = start
        self.arcs: dict[tuple[object, str], tuple[object, str, float]] = {}

    def arc(self, state: object, read: str, to: object, write: str, weight: float = 0.0) -> None:
        self.arcs[state, read] = (to, write, weight)

    def compose(self, other: Fst) -> Fst:
        """The machine that feeds this one's output to the other one; weights add."""
        out = Fst((self.start, other.start))
        inputs = sorted({read for _, read in self.arcs})
        left = [out.start]
        seen = {out.start}
        while left:
            a, b = state = left.pop()
            for read in inputs:
                if (first := self.arcs.get((a, read))) and (second := other.arcs.get((b, first[1]))):
                    to = (first[0], second[0])
                    out.arc(state, read, to, second[1], first[2] + second[2])
                    if to not in seen:
                        seen.add(to)
                        left.append(to)
        return out


def taken_back(reach: int = 2) -> Fst:
    """Read from right to left: a threat that a negation follows within reach words is none."""
    f = Fst(0)
    for left in range(reach + 1):
        for c in CLASSES:
            f.arc(left, c, reach if c == "negation" else max(left - 1, 0), "other" if left and c == "threat" else c)
    return f


def things(reach: int = 2) -> Fst:
    """A threat within reach words after an article has a thing, or whoever is told of, as its subject: it is none."""
    f = Fst(0)
    for left in range(reach + 1):
        for c in CLASSES:
            f.arc(left, c, reach if c == "article" else max(left - 1, 0), "other" if left and c == "threat" else c)
    return f


def negation(reach: int = 3) -> Fst:
    """Marks insults and threats within reach words after a negation."""
    f = Fst(0)
    for left in range(reach + 1):
        down = max(left - 1, 0)
        for c in CLASSES:
            marked = left and c in ("insult", "threat")
            f.arc(left, c, reach if c == "negation" else down, f"{c}+negated" if marked else c)
    return f


def _marked() -> list[str]:
    return [*CLASSES, "insult+negated", "threat+negated"]


def reported() -> Fst:
    """Marks insults and threats after a report word, to the end of the clause."""
    f = Fst(False)
    for said in (False, True):
        for c in _marked():
            kind = c.split("+")[0]
            f.arc(said, c, said or c == "report", f"{kind}+reported" if said and kind in ("insult", "threat") else c)
    return f


def _told() -> list[str]:
    return [*_marked(), "insult+reported", "threat+reported"]


def targeted(reach: int = REACH_BEFORE) -> Fst:
    """Marks plain insults and threats within reach words after a target."""
    f = Fst(0)
    for left in range(reach + 1):
        for c in _told():
            to = reach if c == "target" else max(left - 1, 0)
            f.arc(left, c, to, f"{c}+target" if left and c in ("insult", "threat") else c)
    return f


def aimed(reach: int = REACH_AFTER) -> Fst:
    """Marks a target within reach words after an insult or threat that is neither negated nor reported: that is whom it is aimed at."""
    f = Fst(("", 0))
    for kind, left in [("", 0), *((k, n) for k in ("insult", "threat") for n in range(1, reach + 1))]:
        for c in [*_told(), "insult+target", "threat+target"]:
            if c in ("insult", "threat", "insult+target", "threat+target"):
                f.arc((kind, left), c, (c.split("+")[0], reach), c)
            elif c == "target" and left:
                f.arc((kind, left), c, ("", 0), f"{kind}+aimed")
            else:
                f.arc((kind, left), c, (kind, left - 1) if left > 1 else ("", 0), c)
    return f


def prices(weights: dict[str, float]) -> Fst:
    """One state that weighs the marked symbols."""
    f = Fst(0)
    for c in [*_told(), "insult+target", "threat+target", "insult+aimed", "threat+aimed"]:
        f.arc(0, c, 0, c, weights.get(c, 0.0))
    return f


class Machine(NamedTuple):
    """The composed grammar as tables: next state, kind (-1: none) and weight by state and class."""

    to: list[list[int]]
    kind: list[list[int]]
    weight: list[list[float]]
    back: list[list[tuple[int, int]]]  # next state and class of the machine that reads from right to left


#: The machines in the order in which they read; the first one reads from right to left.
MACHINES = {"taken back": taken_back, "things": things, "negation": negation, "reported": reported, "targeted": targeted, "aimed": aimed}


def machine(weights: dict[str, float], without: str = "") -> Machine:
    """The grammar, or what is left of it without one of its machines."""
    used = [f() for name, f in MACHINES.items() if name not in (without, "taken back")]
    whole = used[0]
    for f in [*used[1:], prices(weights)]:
        whole = whole.compose(f)
    first = taken_back(0) if without == "taken back" else taken_back()
    rows = sorted({s for s, _ in first.arcs})
    back = [[(rows.index(first.arcs[s, c][0]), _CODE[first.arcs[s, c][1]]) for c in CLASSES] for s in rows]
    states = [whole.start, *sorted({s for s, _ in whole.arcs} - {whole.start}, key=repr)]
    number = {s: k for k, s in enumerate(states)}
    arcs = [[whole.arcs[s, c] for c in CLASSES] for s in states]
    return Machine([[number[a[0]] for a in row] for row in arcs], [[KINDS.index(a[1]) if a[1] in KINDS else -1 for a in row] for row in arcs], [[a[2] for a in row] for row in arcs], back)


# --- reading -----------------------------------------------------------------------------------


def _hash_of(words: list[str]) -> np.ndarray:
    encoded = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in encoded])
    return span_hashes(np.frombuffer(b"".join(encoded), np.uint8), ends - [len(w) for w in encoded], ends)


class Lexicon(NamedTuple):
    """Hashes (ascending) of whole words with their classes, and of insults among words and beginnings with their weights."""

    words: np.ndarray
    classes: np.ndarray
    insults: np.ndarray
    weights: np.ndarray


def lexicon(insults: dict[int, float]) -> Lexicon:
    words = {int(h): _CODE[c] for c in ("article", "report", "negation", "target", "threat") for h in _hash_of(WORDS[c].split())}
    keys, own = np.array(sorted(words), np.uint64), np.array(sorted(insults), np.uint64)
    return Lexicon(keys, np.array([words[int(k)] for k in keys], np.int64), own, np.array([insults[int(k)] for k in own]))


def _find(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in keys, or -1."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return np.where(keys[at] == hashes, at, -1)


class Read(NamedTuple):
    first: np.ndarray
    clause: np.ndarray
    hashes: list[np.ndarray]  # of whole words, then of their beginnings (words that are longer, else a copy of the word's)


def read(text: pa.Array) -> Read:
    raw, bounds = buffer_of(text)
    starts, ends, first = word_spans(raw, bounds, _ENDS_WORD)
    breaks = np.concatenate([[0], np.cumsum(_ENDS_CLAUSE[raw])])
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    clause = breaks[starts] + doc  # a document's end ends its clause
    whole = span_hashes(raw, starts, ends)
    # the marker keeps a beginning apart from the same letters as a word
    return Read(first, clause, [whole, *(np.where(ends - starts > n, span_hashes(raw, starts, np.minimum(ends, starts + n)) ^ np.uint64(0xB5E9), whole) for n in BEGINNINGS)])


def classify(r: Read, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Class and lexicon weight of each word."""
    at = _find(lex.words, r.hashes[0])
    classes = np.where(at >= 0, lex.classes[at] if len(lex.classes) else 0, 0)
    weight = np.zeros(len(classes))
    for h in r.hashes:
        at = _find(lex.insults, h)
        hit = at >= 0
        weight[hit] = np.maximum(weight[hit], lex.weights[at[hit]])
    classes[weight > 0] = _CODE["insult"]
    return classes, weight


def clause_features(r: Read, lex: Lexicon, m: Machine) -> np.ndarray:
    """documents x kinds: what the clauses matched of each kind (an insult counts its lexicon weight), at most
    MOST_OF_CLAUSE of one clause and MOST_CLAUSES of a document."""
    classes, weight = classify(r, lex)
    out = np.zeros((len(r.first) - 1, len(KINDS)))
    hot = np.flatnonzero((classes == _CODE["insult"]) | (classes == _CODE["threat"]))
    insult, threat = _CODE["insult"], _CODE["threat"]
    for c in np.unique(r.clause[hot]):
        a, z = np.searchsorted(r.clause, c), np.searchsorted(r.clause, c, "right")
        doc = int(np.searchsorted(r.first, a, "right") - 1)
        state, found = 0, [0.0] * len(KINDS)
        last = min(z, int(hot[np.searchsorted(hot, z) - 1]) + 1 + REACH_AFTER)  # what it is aimed at may follow
        codes, behind = classes[a:last].tolist(), 0
        if threat in codes:
            for k, code in zip(range(z - a - 1, -1, -1), classes[a:z][::-1].tolist(), strict=True):
                behind, code = m.back[behind][code]
                if k < len(codes):
                    codes[k] = code
        for k, code in enumerate(codes, a):
            kind = m.kind[state][code]
            if kind >= 0:
                found[kind] += weight[k] if code == insult else 1.0
            state = m.to[state][code]
        out[doc] += np.minimum(found, MOST_OF_CLAUSE)
    return np.minimum(out, MOST_CLAUSES)


# --- learning ----------------------------------------------------------------------------------


class Model(NamedTuple):
    insults: dict[int, float]
    weights: np.ndarray  # of KINDS
    bias: float


def log_odds(x: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Of documents x kinds: what is aimed at nobody adds up to less than one decisive clause does."""
    own = np.isin(KINDS, AIMED)
    unaimed = np.minimum(x[:, ~own] @ weights[~own] + bias, max(DECIDES - BELOW, bias))
    decided = (x[:, np.isin(KINDS, DECISIVE)] > 0).any(axis=1)
    total = unaimed + x[:, own] @ weights[own]
    return np.where(decided, np.maximum(total, DECIDES), total)


def hand_model() -> Model:
    return Model({int(h): 1.0 for h in _hash_of(WORDS["insult"].split())}, np.array([PRIOR[k] for k in KINDS]), BIAS)


def alike(r: Read) -> np.ndarray:
    """A label for each text that near copies share: a join of texts with an equal least hash of three words, in one of COPY_HASHES orders."""
    n = len(r.first) - 1
    windows = window_hashes(r.hashes[0], 3)
    doc = np.repeat(np.arange(n), np.diff(r.first))[: len(windows)]
    out = np.zeros((n, COPY_HASHES), np.uint64)
    full = np.flatnonzero(np.diff(r.first) > 0)
    at = r.first[full][r.first[full] < len(windows)]
    for k in range(COPY_HASHES):
        if len(at):
            out[doc[at], k] = np.minimum.reduceat(mix(windows + np.uint64(k)), at)
    return out


def clusters(least: np.ndarray) -> np.ndarray:
    """Union of rows that agree in any column (0 agrees with nothing)."""
    label = np.arange(len(least))
    changed = True
    while changed:
        before = label.copy()
        for column in least.T:
            _, code = np.unique(column, return_inverse=True)
            lowest = np.full(code.max() + 1 if len(code) else 0, len(least))
            np.minimum.at(lowest, code, label)
            label = np.where(column == 0, label, np.minimum(label, lowest[code]))
        changed = bool((label != before).any())
    return label


def distinct_features(r: Read, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a text's label and a word or beginning of a word in it."""
    own = np.repeat(docs, np.diff(r.first))
    return unique_pairs(np.tile(own, len(r.hashes)), np.concatenate(r.hashes))


def unique_pairs(docs: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((features, docs))
    docs, features = docs[by], features[by]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (features[1:] != features[:-1])
    return docs[new], features[new]


class Candidates(NamedTuple):
    """Features (ascending) that the toxic texts of LEAST_TEXTS clusters or more hold."""

    features: np.ndarray
    texts: np.ndarray  # clusters that hold each
    clusters: int


def candidates(pieces: list[pa.RecordBatch]) -> Candidates:
    """From the toxic texts of the sample (column 1), near copies as one."""
    reads = [read(p.column(1)) for p in pieces]
    if not reads:
        return Candidates(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    label = clusters(np.concatenate([alike(r) for r in reads]))
    docs, features, base = [], [], 0
    for r in reads:
        n = len(r.first) - 1
        d, f = distinct_features(r, label[base : base + n])
        docs.append(d)
        features.append(f)
        base += n
    names, texts = np.unique(unique_pairs(np.concatenate(docs), np.concatenate(features))[1], return_counts=True)
    often = texts >= LEAST_TEXTS
    return Candidates(names[often], texts[often], len(np.unique(label)))


def held_by(text: pa.Array, features: np.ndarray) -> np.ndarray:
    """How many of the texts hold each feature."""
    _, found = distinct_features(read(text), np.arange(len(text)))
    at = _find(features, found)
    return np.bincount(at[at >= 0], minlength=len(features))


def choose_insults(found: Candidates, clean: np.ndarray, n_clean: int) -> dict[int, float]:
    """Candidates that toxic texts hold more than clean ones do (clean: texts that hold each), beyond chance."""
    if not len(found.features):
        return {}
    chance = found.clusters / max(found.clusters + n_clean, 1)
    real = (found.texts * np.log(chance) + np.log(len(found.features)) < MOST_CHANCE) & (found.texts >= LEAST_PRECISION * (found.texts + clean))
    return {int(h): float((t + 1) / (t + c + 2)) for h, t, c in zip(found.features[real], found.texts[real], clean[real], strict=True)}


def fit_prices(x: np.ndarray, y: np.ndarray, steps_: int = 60, spread: float = 3.0) -> tuple[np.ndarray, float]:
    """Logistic fit by Newton steps, with the grammar's own prices as the prior's centre."""
    centre = np.array([*(PRIOR[k] for k in KINDS), BIAS])
    full = np.column_stack([x, np.ones(len(x))])
    w = centre.copy()
    for _ in range(steps_):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - y) + (w - centre) / spread**2
        bend = (full * (p * (1 - p))[:, None]).T @ full + np.eye(len(w)) / spread**2
        w = w - np.clip(np.linalg.solve(bend, slope), -1.0, 1.0)  # a full step may overshoot far from the optimum
    price, bias = np.maximum(w[:-1], 0.0), float(w[-1])
    for k in DECISIVE:  # whatever isolated words are worth here, one such clause is enough
        price[KINDS.index(k)] = max(price[KINDS.index(k)], DECIDES - bias)
    return price, bias


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = candidates([p for b in batches for p in steps(b)])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(found))], pa.binary())], ["found"])


def _clean_batches(batches: Iterator[pa.RecordBatch], features) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(features.value), np.int64)
    for b in batches:
        for p in steps(b):
            total += held_by(p.column(1), features.value)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["place", "n"])


def _matched_batches(batches: Iterator[pa.RecordBatch], insults) -> Iterator[pa.RecordBatch]:
    lex, m = lexicon(insults.value), machine(PRIOR)
    for b in batches:
        for p in steps(b):
            x = clause_features(read(p.column(1)), lex, m)
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])


def learn(labelled: DataFrame, most: tuple[int, int] = (SAMPLE_CLEAN, SAMPLE_TOXIC)) -> Model:
    """Fit on at most about most[toxic] documents a class (rows doc_id, text, toxic 0 or 1), chosen by hash.

    The sample is written once. One task finds the candidates in its toxic texts; the clean texts that hold them
    are counted, and all its clauses read, in as many tasks as it has; the driver fits the prices on the small
    table of what each document's clauses matched.
    """
    held = labelled.where("toxic in (0, 1)")
    counts = {r.toxic: r["count"] for r in held.groupBy("toxic").count().collect()}  # two rows
    if len(counts) < 2:
        return hand_model()
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, min(1.0, most[1] / counts[1])).otherwise(min(1.0, most[0] / counts[0]))
    chosen = held.where(draw < share * 1_000_000).select(F.col("toxic").cast("long").alias("toxic"), F.col("text").cast("string").alias("text"))
    spark = labelled.sparkSession
    sample = materialise(chosen.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))), "sample")
    row = in_arrow(sample.where("toxic = 1").repartition(1), _candidate_batches, "found binary").first()  # bounded by the sample
    found = Candidates(*pickle.loads(row.found)) if row else candidates([])
    sent = spark.sparkContext.broadcast(found.features)
    clean = np.zeros(len(found.features), np.int64)
    per = in_arrow(sample.where("toxic = 0"), lambda it: _clean_batches(it, sent), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    for r in per.collect():  # at most a row a candidate
        clean[r.place] = r.n
    insults = choose_insults(found, clean, sample.where("toxic = 0").count())
    for h, weight in hand_model().insults.items():
        insults.setdefault(h, weight)
    known = spark.sparkContext.broadcast(insults)
    rows = in_arrow(sample, lambda it: _matched_batches(it, known), "toxic long, x array<double>").orderBy("toxic", "x").collect()  # a row a sampled document
    drop(sample)
    toxic = np.array([r.toxic for r in rows], float)
    if not toxic.any() or toxic.all():
        return hand_model()
    weights, bias = fit_prices(np.array([r.x for r in rows]), toxic)
    return Model(insults, weights, bias)


# --- scoring -----------------------------------------------------------------------------------


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own: Model = model.value
    lex, m = lexicon(own.insults), machine(dict(zip(KINDS, own.weights, strict=True)))
    for batch in batches:
        for piece in steps(batch):
            x = clause_features(read(piece.column(1)), lex, m)
            score = 1 / (1 + np.exp(-np.clip(log_odds(x, own.weights, own.bias), -30, 30)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["row", "score", "predicted"])


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the carried columns), score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, lambda it: _score(it, sent), f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int")


def _compared(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own: Model = model.value
    lex, priced = lexicon(own.insults), dict(zip(KINDS, own.weights, strict=True))
    turns = {name: machine(priced, name) for name in ("", *MACHINES)}
    gate = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    for batch in batches:
        for piece in steps(batch):
            r = read(piece.column(1))
            flags = {name: log_odds(clause_features(r, lex, m), own.weights, own.bias) >= gate for name, m in turns.items()}
            words = clause_features(r, lex, turns[""])
            words[:, [k for k, kind in enumerate(KINDS) if kind != "insult"]] = 0.0
            flags["only isolated insults"] = log_odds(words, own.weights, own.bias) >= gate
            for name, flag in flags.items():
                yield pa.RecordBatch.from_pydict({"without": [name or "nothing"], "flagged": [int(flag.sum())], "freed": [int((flags[""] & ~flag).sum())], "added": [int((flag & ~flags[""]).sum())]})


def verdicts_by_machine(docs: DataFrame, model: Model) -> DataFrame:
    """without, flagged, freed, added: documents flagged without each machine, and how many of them that frees or adds."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.lit(0).alias("row"), F.col("text").cast("string").alias("text"))
    counts = in_arrow(rows, lambda it: _compared(it, sent), "without string, flagged long, freed long, added long")
    return counts.groupBy("without").agg(*(F.sum(c).alias(c) for c in ("flagged", "freed", "added")))


def learned(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (SAMPLE_CLEAN, SAMPLE_TOXIC)) -> Model:
    """The model of the rows whose crc32(doc_id) mod 4 is not 2."""
    marked = labels.where(F.expr(crc32_remainder()) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, min(1.0, most[1] / max(counts.get(1, 1), 1))).otherwise(min(1.0, most[0] / max(counts.get(0, 1), 1)))
    chosen = marked.where(draw < share * 1_000_000)  # its expected size is sum(most): a bounded side
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return learn(texts.join(F.broadcast(chosen), "doc_id"), most)


def held_out_toxicity(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (SAMPLE_CLEAN, SAMPLE_TOXIC)) -> DataFrame:
    """doc_id, held_out, score, predicted: labels learned only from rows whose crc32(doc_id) mod 4 is not 2."""
    model = learned(docs, labels, most)
    held = docs.select("doc_id", "text", F.coalesce(F.expr(crc32_remainder()) == 2, F.lit(False)).alias("held_out"))
    return score(held, model, ("doc_id", "held_out")).select("row.doc_id", "row.held_out", "score", "predicted")
