"""Vector codes, hard negatives and repeated strings, held against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgestream.llm import hard_negatives, suffix_dedup, vector_codes

from . import helpers

INF, NAN = float("inf"), float("nan")


def vectors(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, key int, q string, uid int, turn int")


def drawn(n, width, seed=1, kinds=4):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.normal(size=width).round(2).tolist(), int(draw.integers(kinds))) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, [NAN] * width, 1), (n + 2, [INF] + [0.0] * (width - 1), 1), (n + 3, [None] + [0.5] * (width - 1), 1), (n + 4, [0.5] * (width + 1), 1), (n + 5, rows[3][1], None)]


def plain_codes(rows, width):
    kept = sorted((r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    part = -(-width // 4)
    x = np.array([[int(np.floor(1024 * v)) for v in r[1]] + [0] * (4 * part - width) for r in kept], dtype=np.int64).reshape(len(kept), 4, part)
    books = x[:256].transpose(1, 0, 2).copy()
    for turn in range(5):
        far = [((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        at, best = [f.argmin(axis=1) for f in far], sum(f.min(axis=1) for f in far)
        if turn < 4:
            for p in range(4):
                for e in range(books.shape[1]):
                    if (at[p] == e).any():
                        books[p, e] = x[at[p] == e, p].sum(axis=0) // (at[p] == e).sum()
    label = Counter()
    for r, e in zip(kept, best, strict=True):
        label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return Counter((r[0], "".join(f"{int(at[p][k]):02x}" for p in range(4)), int(best[k]), label[r[2]], digest) for k, r in enumerate(kept))


@pytest.mark.parametrize(("n", "width"), [(700, 8), (40, 10), (300, 4)])
def test_codes_match_brute_force(spark, n, width):
    rows = drawn(n, width)
    rows += rows[5:9] + [(None, rows[2][1], 2), (-1, [0.25] * width, 1)]  # repeated rows, a null key
    got = Counter(tuple(r) for r in vector_codes.compressed(vectors(spark, rows)).collect())
    assert got == plain_codes(rows, width)


def test_equal_entries_keep_the_lower_index():
    draw = np.random.default_rng(2)
    book = draw.integers(-2, 3, (256, 3))  # many equal entries and equal distances
    points = draw.integers(-3, 4, (500, 3))
    far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    for scale in (1, 2**24):  # both ways of adding up
        at, best = vector_codes.nearest(vector_codes.build_tree(book * scale), points * scale)
        assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1) * scale**2).all()


def test_codes_of_empty_and_huge(spark):
    assert vector_codes.compressed(vectors(spark, [])).collect() == []
    assert vector_codes.compressed(vectors(spark, [(1, None, 1)])).collect() == []
    r = vector_codes.compressed(vectors(spark, [(1, [], 1)])).first()
    assert (r.code, r.error) == ("00000000", 0)
    huge = vector_codes.compressed(vectors(spark, [(1, [1e300, -1e300, 0.0, 3e9], 1), (2, [0.0, 0.0, 0.0, 1e300], None)])).collect()
    assert {x.code for x in huge} == {"00000000", "01010000"}  # held at the limit, the last components are equal


def plain_negatives(rows, width):
    kept = [(r[0], [int(np.floor(256 * v)) for v in r[1]], (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2]) for r in rows if r[2] is not None and r[1] is not None and len(r[1]) == width and all(x is not None and np.isfinite(x) for x in r[1])]
    out = Counter()
    for i, (a, va, la) in enumerate(kept):
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), k is None, k, same == la) for j, (k, v, same) in enumerate(kept) if j != i), key=lambda x: (x[0], x[1], x[2] or 0))
        for s, _, p, _ in [x for x in scored if x[3]][:5]:
            good = [x for x in scored if not x[3] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            for rank, (t, _, n, _) in enumerate(good):
                out[a, p, rank + 1, n, -s, -t] += 1
    return out


@pytest.mark.parametrize("width", [1, 6])
def test_negatives_match_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", 300)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    rows = drawn(900, width, 3)
    rows += [rows[200], rows[200], rows[7], (None, rows[9][1], 2)]  # an anchor three times, a repeated row, a null key
    rows += [(1000 + k, rows[300][1], k % 2) for k in range(150)]  # ties
    got = hard_negatives.mine(vectors(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.collect()) == plain_negatives(rows, width)


def test_negatives_of_empty_and_zero(spark):
    assert hard_negatives.mine(vectors(spark, [])).collect() == []
    zero = [(100, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 3.0], 2), (3, [2.0, 1.0], None)]
    assert [tuple(r) for r in hard_negatives.mine(vectors(spark, zero)).collect()] == [(100, 1, 1, 2, 0, 0)]


def test_trees_prune_what_cannot_count():
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(16, 8)) * 2000
    rows = np.concatenate([c + draw.normal(size=(64, 8)) * 10 for c in centers]).astype(np.int64)
    tree = hard_negatives.build_tree(rows, np.repeat(np.arange(16), 64), np.arange(1024), np.arange(1024), np.zeros(1024, bool), leaf=64)
    reads = []
    q = rows[:1]
    far = 2**50
    seen = tree.vectors
    tree.vectors = type("Counted", (), {"__getitem__": lambda self, s: reads.append(s) or seen[s], "shape": seen.shape, "__array__": lambda self, *a, **k: seen})()
    score, place = hard_negatives.search(tree, q, np.array([0]), np.array([0]), True, np.array([-far]), np.array([far]), 5)
    assert len(reads) <= 3 and sorted(-(rows[1:64] @ rows[0]))[:5] == (-score[0]).tolist() and (place >= 0).all()


# --- repeated strings ----------------------------------------------------------------------------


def plain_dedup(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in raws for s in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def planted():
    draw = np.random.default_rng(6)
    word = lambda n: " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 5)) for _ in range(n))
    passage = word(80)  # 479 bytes
    near = passage[:200] + "#" + passage[201:]
    edge = passage[:400]
    texts = [word(60) + passage + word(30), passage, word(3) + passage, near, edge, edge[:399], word(200), "a" * 1500, "a" * 401, "ha " * 300, "x" + "ha " * 200, "é日😀" * 150, "日😀é" * 150]
    twin = word(300)
    texts += [twin, twin, twin, twin, twin[50:700] + word(100) + twin[:500], "\x00" * 450, "\x00" * 900, "b" * 399, None, "", passage[40:445] + word(50), word(20) + passage[60:470]]
    return texts + [word(5) + edge[k:] + word(40) for k in range(0, 12, 3)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeated_strings_match_brute_force(spark, hot):
    texts = planted()
    got = {r.doc_id: r for r in suffix_dedup.dedup(helpers.frame(spark, texts), hot=hot).collect()}
    want = plain_dedup(texts, 400)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    assert all(sum(x.end - x.start for x in r.spans) == r.n_removed and len(r.spans) == r.n_spans for r in got.values())


def test_repeated_strings_of_awkward_and_empty_tables(spark):
    docs = helpers.awkward(spark).withColumns({"g1": F.lit(1), "h": F.lit(2), "marks": F.lit("x"), "key": F.lit(1)})
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(docs).collect())
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    assert got == sorted((i, n, gone) for (i, _), (n, gone, _, _) in zip(rows, plain_dedup([t for _, t in rows], 400), strict=True))
    assert suffix_dedup.dedup(helpers.empty(spark)).collect() == []


def test_loser_tree_merges_and_knows_prefixes():
    draw = np.random.default_rng(8)
    for k in (1, 2, 3, 5, 8):
        runs = [np.sort(draw.integers(97, 99, (int(draw.integers(0, 40)), 1)).astype(np.uint8) if w == 1 else draw.integers(97, 99, (int(draw.integers(0, 40)), w)).astype(np.uint8).view(f"S{w}").ravel()).reshape(-1) for w in [6] * k]
        rows = [np.frombuffer(b"".join(x.ljust(6, b"\0") for x in r.tolist()), np.uint8).reshape(-1, 6) if len(r) else np.zeros((0, 6), np.uint8) for r in runs]
        lists = [[bytes(x) for x in r] for r in rows]
        merged = [(lists[a][b], p) for a, b, p in suffix_dedup.LoserTree(lists, [suffix_dedup.common_prefix(r).tolist() for r in rows])]
        want = sorted(x for r in lists for x in r)
        assert [x for x, _ in merged] == want
        assert all(p == next((i for i in range(6) if a[i] != b[i]), 6) for (a, _), (b, p) in zip(merged, merged[1:], strict=False))


def test_front_coding_round_trip():
    draw = np.random.default_rng(9)
    rows = draw.integers(0, 3, (50, suffix_dedup._WIDTH)).astype(np.uint8)
    rows[10] = rows[9]
    rows[20:23] = 0
    rows[30, 5:] = 0
    lcp, size, rest = suffix_dedup.front_coded(rows)
    assert suffix_dedup.decoded(lcp.tolist(), size.tolist(), rest.tobytes()) == [bytes(r) for r in rows]


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(10)
    core = draw.integers(97, 101, 450).astype(np.uint8)
    raw = np.concatenate([draw.integers(97, 101, 333).astype(np.uint8), core, draw.integers(97, 101, 100).astype(np.uint8), core])
    doc, at, least, most = suffix_dedup.find_anchors(raw, np.array([0, len(raw)]))
    of = {a - d: a for a, lo, hi in zip(at.tolist(), least.tolist(), most.tolist(), strict=True) for d in range(lo, hi + 1)}
    assert sorted(of) == list(range(len(raw) - 399)) and (doc == 0).all()
    assert all(of[333 + s] - 333 == of[333 + 450 + 100 + s] - 883 for s in range(51)) and all(0 <= a - s < 256 for s, a in of.items())
