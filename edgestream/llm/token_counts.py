"""Operator 10, token counts: byte-pair merges of many pre-tokens at once, on ragged numpy arrays.

A batch's distinct new pre-tokens lie behind one another in one symbol array. In each round every
sequence finds its lowest-rank pair and merges all its places of that pair, left to right, at the
same time as all others; sequences without a pair drop out. What survives is counted. Counts of
chunks between spaces are remembered within a task, chunks of up to LONGEST_REMEMBERED characters and
MOST_REMEMBERED characters in all.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside a text are
one token each, as the library has it by default; repeated rows are counted each; a very long text
is cut at spaces (which never lie in a token) and its parts are added; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections import ChainMap
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, steps

LIMIT = 2048
MOST_REMEMBERED = 4 << 20
LONGEST_REMEMBERED = 64
#: Characters of a text that are split at a time.
PART = 1 << 20
NEVER = np.int32(2**31 - 1)
#: 2^18 slots a table.
SHIFT = np.uint64(46)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """Vocabulary and merge ranks of a lower-casing BPE with word ends, read from a tokenizers file."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.split_lines = regex.compile(rf"\n|{self.split.pattern}")
        shown = byte_characters()
        self.inner = np.array([vocab.get(c, -1) for c in shown], np.int64)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in shown], np.int64)
        self.size = max(vocab.values()) + 1
        self._index([(vocab[a], vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges)])
        self.known: dict[str, int] = {}
        self.remembered = 0
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def _index(self, pairs: list[tuple[int, int, int, int]]) -> None:
        """Hash tables of the pairs: the few that meet in one slot go on to the next table."""
        rest = np.array(pairs, np.int64).reshape(-1, 4)
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]] = []
        odd = 0x9E3779B97F4A7C15
        while len(rest):
            odd = (odd * 0xD1342543DE82EF95 + 2) | 1
            factor = np.uint64(odd % 2**64)
            keys = rest[:, 0] * self.size + rest[:, 1]
            slot, first = np.unique((keys.astype(np.uint64) * factor) >> SHIFT, return_index=True)
            key, rank, merged = np.full(1 << (64 - int(SHIFT)), -1, np.int64), np.zeros(1 << (64 - int(SHIFT)), np.int32), np.zeros(1 << (64 - int(SHIFT)), np.int32)
            key[slot], rank[slot], merged[slot] = keys[first], rest[first, 2], rest[first, 3]
            self.tables.append((factor, key, rank, merged))
            left = np.ones(len(rest), bool)
            left[first] = False
            rest = rest[left]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if no merge) and merged symbol of each pair."""
        keys = left * self.size + right
        rank, merged = np.full(len(keys), NEVER, np.int32), np.zeros(len(keys), np.int32)
        for factor, key, ranks, symbols in self.tables:
            slot = ((keys.astype(np.uint64) * factor) >> SHIFT).astype(np.int64)
            hit = np.flatnonzero(key[slot] == keys)
            rank[hit], merged[hit] = ranks[slot[hit]], symbols[slot[hit]]
        return rank, merged

    def symbols_left(self, words: Sequence[str]) -> np.ndarray:
        """How many symbols remain of each word after all merges."""
        encoded = [w.encode() for w in words]
        counts = np.array([len(w) for w in encoded], np.int64)
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        symbol = self.inner[raw]
        last = np.cumsum(counts) - 1
        symbol[last] = self.final[raw[last]]
        owner = np.repeat(np.arange(len(words)), counts)
        rank, merged = np.full(len(symbol), NEVER, np.int32), np.zeros(len(symbol), np.int32)  # of a symbol and the next one
        fresh = np.flatnonzero(owner[:-1] == owner[1:])  # pairs to look up
        while len(symbol):
            rank[fresh], merged[fresh] = self.look_up(symbol[fresh], symbol[fresh + 1])
            firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, firsts)
            lowest = np.repeat(lowest, np.diff(np.r_[firsts, len(symbol)]))
            active = lowest != NEVER
            merge = (rank == lowest) & active
            if (merge[1:] & merge[:-1]).any():  # places of a pair overlap only in a run of one symbol: every second one merges
                place = np.arange(len(merge))
                start = np.maximum.accumulate(np.where(merge & ~np.r_[False, merge[:-1]], place, 0))
                merge &= (place - start) % 2 == 0
            gone = np.r_[False, merge[:-1]]
            symbol = np.where(merge, merged, symbol)
            rank[merge] = NEVER  # the last symbol of a sequence has no pair; others are looked up
            counts -= np.bincount(owner[gone], minlength=len(words))
            keep = active & ~gone
            symbol, owner, rank, merged, made = symbol[keep], owner[keep], rank[keep], merged[keep], merge[keep]
            if not len(symbol):
                break
            touched = made | np.r_[made[1:], False]
            touched &= np.r_[owner[:-1] == owner[1:], False]
            fresh = np.flatnonzero(touched)
        return counts

    def parts(self, text: str) -> Iterator[str]:
        """Normalised parts of a text, without its special strings."""
        start = 0
        while start < len(text):
            end = start + PART
            if end < len(text):
                cut = max(text.rfind(" ", start, end), text.rfind("\n", start, end))
                end = cut + 1 if cut > start else next((m.start() for m in regex.finditer(r"[ \n]", text, pos=end)), len(text))
            part = text[start:end]
            start = end
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower() has a final sigma, single characters have not
            yield part.lower()

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """Tokens of each text. The words of some PART characters are merged in one pass."""
        out = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            known = self.learn({c for _, chunks in held for c in chunks})
            for k, chunks in held:
                out[k] += sum(map(known.__getitem__, chunks))
            held.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            pieces = [text]
            if self.at_special is not None and any(s in text for s in self.specials):
                out[k] += len(self.at_special.findall(text))
                pieces = self.at_special.split(text)
            for piece in pieces:
                for part in self.parts(piece):
                    held.append((k, part.replace("\n", " ").split(" ")))
                    size += len(part)
                    if size >= PART:
                        settle()
                        size = 0
        settle()
        return out

    def learn(self, chunks: set[str]) -> Mapping[str, int]:
        """Counts of the chunks (text between spaces): the pre-tokens of all that were not met yet in one merge."""
        new = list(chunks.difference(self.known))
        fresh: dict[str, int] = {}
        if new:
            words = np.array(self.split_lines.findall("\n".join(new)), object)
            ends = np.r_[np.flatnonzero(words == "\n"), len(words)]
            own = words != "\n"
            total = np.zeros(len(words) + 1, np.int64)
            total[1:][own] = self.symbols_left(words[own].tolist())
            total = np.cumsum(total)[np.r_[0, ends]]
            fresh = dict(zip(new, np.diff(total).tolist(), strict=True))
        short = {c: n for c, n in fresh.items() if len(c) <= LONGEST_REMEMBERED}
        size = sum(map(len, short))
        if self.remembered + size > MOST_REMEMBERED:  # all that these texts need is in the old and the new counts
            out = ChainMap(fresh, self.known)
            self.known, self.remembered = short, size
            return out
        self.known.update(short)
        self.remembered += size
        return self.known if len(short) == len(fresh) else ChainMap(self.known, fresh)


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies show for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


@lru_cache(maxsize=2)
def _loaded(definition: str) -> WordBpe:
    return WordBpe(definition)


def _count_batches(batches: Iterator[pa.RecordBatch], definition, limit: int) -> Iterator[pa.RecordBatch]:
    bpe = _loaded(definition.value)
    for batch in batches:
        for piece in steps(batch):
            texts = piece.column(1).to_pylist()
            n_bytes = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
            tokens = bpe.count(texts)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: a tokenizers file of a word-end BPE; the driver reads it and sends its text (some MB)."""
    with open(path or default_path(), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = f"doc_id {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return in_arrow(docs.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text")), lambda it: _count_batches(it, definition, limit), kind)
