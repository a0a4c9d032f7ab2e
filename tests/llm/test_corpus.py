"""Operators over the whole corpus, against plain Python."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from edgestream.llm import jaccard_join, mixing, token_shards
from edgestream.llm.stars import components

from .helpers import FOLD, awkward, empty, frame, words

# --- Jaccard join ------------------------------------------------------------------------------


def shingles(text):
    w = words((text or "").translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 10**9)
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], k)
    return Counter((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def near_copies(seed, groups, size, length, edits):
    draw = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(draw.choice(vocabulary, 60))
    texts = []
    for _ in range(groups):
        base = list(draw.choice(vocabulary, int(draw.integers(5, length))))
        if draw.random() < 0.4:
            base += passage
        for _ in range(int(draw.integers(1, size))):
            own = list(base)
            for _ in range(int(draw.integers(0, edits))):
                own[int(draw.integers(len(own)))] = str(draw.choice(vocabulary))
            texts.append(" ".join(own[int(draw.integers(0, 3)) :]))
    return texts


@pytest.mark.parametrize(("seed", "tile"), [(1, 4096), (2, 4)])
def test_jaccard_classes(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)  # small tiles: groups meet in blocks
    docs = frame(spark, near_copies(seed, 12, 30, 200, 14)).unionAll(awkward(spark).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "lines", "host", "row", "rid", "size"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(docs).collect())
    assert got == plain_classes(rows)


def test_sketches_part_only_sets_that_cannot_link():
    draw = np.random.default_rng(7)
    sets = []
    for size in (3, 40, 60, 70, 300, 900, 1100):
        base = draw.integers(0, 2**63, size).astype(np.uint64)
        for keep in (1, 0.95, 0.9, 0.85, 0.5):
            sets.append(np.unique(np.r_[base[draw.random(size) < keep], base[:2], draw.integers(0, 2**63, int(draw.integers(0, 4))).astype(np.uint64)]))
    bounds = np.cumsum([0, *map(len, sets)])
    sketched = [np.frombuffer(x, np.uint64) for x in jaccard_join.sketches(jaccard_join.Sets(np.concatenate(sets), bounds, np.arange(len(sets)).astype(np.uint64)))]
    size = np.diff(bounds)
    part = jaccard_join.kin(size, sketched)
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * n < 80 * (size[i] + size[j] - n) or part[i] == part[j]
    assert len(set(part)) > 10


def test_chance_meetings_send_no_sets(spark):
    draw = np.random.default_rng(9)
    passage, vocabulary = [f"p{i}" for i in range(80)], [f"w{i}" for i in range(5000)]
    texts = [" ".join([*draw.choice(vocabulary, 160), *passage]) for _ in range(12)]
    docs = frame(spark, [*texts, texts[0] + " tail"])
    described = jaccard_join.in_arrow(docs.select("doc_id", "text"), jaccard_join._describe, "doc_id long, n_shingles long, node long, sketch binary")
    apart = jaccard_join.groups_of(docs.select("text"), described, 4).collect()
    assert len(apart) == 1  # of 12 sets that share a passage and one near copy: the copy alone


@pytest.mark.parametrize("most", [2, 4096])
def test_large_groups_stay_whole(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "KIN", most)
    docs = frame(spark, near_copies(4, 6, 20, 120, 10))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(docs).collect())
    assert got == plain_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_derived_answers_equal_direct_ones():
    draw = np.random.default_rng(3)
    leader = np.unique(draw.integers(0, 2**60, 200).astype(np.uint64))
    sets = []
    for _ in range(60):
        keep = leader[draw.random(len(leader)) > draw.choice([0.02, 0.1, 0.2, 0.3])]
        sets.append(np.unique(np.r_[keep, draw.integers(0, 500, int(draw.integers(0, 40))).astype(np.uint64)]))
    apart = [np.setxor1d(leader, s) for s in sets]
    size = np.array([len(s) for s in sets])
    outlier = np.array([9 * len(d) > len(leader) + n for d, n in zip(apart, size, strict=True)])
    names = np.arange(60)
    edges = jaccard_join.derive(names, size, apart, outlier)
    assert outlier.any() and not outlier.all()

    def classes(pairs):
        label = list(range(60))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i in range(60) if label[i] == x) for x in label}

    core = [int(x) for x in names[~outlier]]
    chain = list(zip(core, core[1:], strict=False))
    direct = [(i, j) for i in range(60) for j in range(i) if (n := len(np.intersect1d(sets[i], sets[j]))) and 100 * n >= 80 * (size[i] + size[j] - n)]
    assert classes(chain + edges) == classes(chain + direct)


def test_chains_of_outliers_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 7)  # twelve outliers: two rows of tiles, several members of a chain in each
    draw, rows, chains = np.random.default_rng(5), [], []
    for leader in range(1, 41):
        own = [1000 * leader + int(x) for x in draw.permutation(900)[:12]]
        chains.append({*own})
        rows.append((leader, leader, 100, 100, bytearray()))
        for k, member in enumerate(own):  # 20 shingles from the next, 40 from the one after (limit 22); 30 or more from the leader
            apart = np.r_[np.arange(10**6, 10**6 + 30), np.arange(20 * k)].astype(np.uint64)
            rows.append((leader, member, 100, 100, bytearray(apart.tobytes())))
    rows = [rows[k] for k in draw.permutation(len(rows))]  # a member's first link is not always the one before it
    found = jaccard_join.group_links(spark.createDataFrame(rows, "leader long, member long, n_leader long, n long, difference binary"), 4).collect()
    for chain in chains:
        label = {x: x for x in chain}
        for a, b in found:
            if a in chain and b in chain:
                label = {x: label[a] if y == label[b] else y for x, y in label.items()}
        assert len(set(label.values())) == 1
    assert {(a, b) for a, b in found if a <= 40 or b <= 40} == {(k, k) for k in range(1, 41)}  # none with a leader


def test_jaccard_stage_keeps_one_of_each_class(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = frame(spark, [base, base + " tail", "other text", None, None, base, "one"])
    kept = jaccard_join.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 6]
    assert jaccard_join.classes(empty(spark)).count() == 0 and jaccard_join.drop_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in (100, 101, 102)) and len(got) == 44


# --- mixing ------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, fixed, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}
        free -= above
    return fixed


def test_mixing(spark):
    draw = np.random.default_rng(4)
    texts = [" ".join(["w"] * int(draw.integers(0, 40))) for _ in range(3000)] + [None, ""]
    sources = [str(draw.choice(["a", "b", "B", "ü", "tiny"], p=[0.6, 0.2, 0.1, 0.095, 0.005])) for _ in texts[:-2]] + [None, "void"]
    docs = frame(spark, texts, sources=sources)
    rows = mixing.mixture(docs).collect()
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(words(t))
    goal, taken = plain_targets(dict(sizes)), defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == sizes[r.source]
        assert abs(r.target - goal[r.source]) < 1e-6 and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 40 for s in goal)
    again = mixing.mixture(docs.repartition(5)).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_mixing_meets_targets_over_all_strata(spark):
    draw = np.random.default_rng(11)
    sizes = np.clip(np.exp(draw.normal(4.5, 1.6, 900)), 1, 2856).astype(int).tolist()
    sources = [str(s) for s in draw.choice(["a", "b", "c"], 900)]
    texts = [" ".join(["w"] * n) + f" {k}" for k, n in enumerate(sizes)]
    docs = frame(spark, texts, sources=sources)
    copies = docs.where("doc_id = 17").crossJoin(spark.range(400)).drop("id")  # equal rows, above a third of their source
    docs = docs.unionAll(copies)
    assert {k for n in sizes for k, low in enumerate(mixing.STRATA) if n + 1 >= low and (not k or n + 1 < mixing.STRATA[k - 1])} == set(range(len(mixing.STRATA)))
    rows = mixing.mixed(mixing.sized(docs), block=16).collect()
    taken, target, twins = defaultdict(int), {}, []
    for r in rows:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.taken
        target[r.source] = r.target
        if r.doc_id == 17:
            twins.append(r.copies)
    assert len(rows) == 1300 and len(twins) == 401 and max(twins) - min(twins) <= 1
    assert all(abs(taken[s] - target[s]) <= 8 for s in target)
    again = mixing.mixed(mixing.sized(docs.repartition(7)), block=16).collect()
    assert Counter((r.doc_id, r.copies) for r in rows) == Counter((r.doc_id, r.copies) for r in again)


def test_mixing_awkward(spark):
    docs = awkward(spark)
    rows = mixing.mixture(docs).collect()
    assert len(rows) == 12 and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mixture(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


# --- token shards ------------------------------------------------------------------------------


def test_permutation():
    for n in (1, 2, 3, 100, 1025):
        p = token_shards.Permutation(n, 9)
        slots = p.slot(np.arange(n))
        assert sorted(slots) == list(range(n)) and (p.sequence(slots) == np.arange(n)).all()


def test_shards_round_trip(spark):
    docs = frame(spark, [f"text number {i} " * (i % 37) for i in range(200)]).unionAll(awkward(spark)).repartition(3)
    rows, path = token_shards.write_shards(docs, length=64, per_shard=50)
    rows = {r.slot: r for r in rows.collect()}
    layout = token_shards.read_layout(spark, path)
    sequences = list(token_shards.read_slots(spark, path, 0, layout.n_sequences))
    assert len(sequences) == len(rows) == layout.n_sequences > 100
    order = token_shards.Permutation(layout.n_sequences, layout.key).slot(np.arange(layout.n_sequences))
    stream = np.concatenate([sequences[s] for s in order])[: layout.n_tokens]
    cut = [x.tobytes() for x in np.split(stream, np.flatnonzero(stream == layout.end) + 1)[:-1]]
    coder = token_shards.encoding(*token_shards.default_ranks())
    assert Counter(cut) == Counter(np.array([*coder.encode_ordinary(r.text), layout.end], "<u2").tobytes() for r in docs.collect() if r.text)
    for s, r in rows.items():
        assert r.shard == s // 50 and r.byte_offset == (s % 50) * layout.stride and order[r.sequence] == s
        assert int(r.token_hash) == int(token_shards._token_hash(sequences[s][: r.n_tokens], np.arange(r.n_tokens)).sum(dtype=np.uint64))
    resumed = list(token_shards.read_slots(spark, path, 95, 10))
    assert all((a == b).all() for a, b in zip(resumed, sequences[95:105], strict=True))
    assert token_shards.write_shards(empty(spark))[0].count() == 0


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark_leaks", "source_mix", "token_output"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, folder).cache()
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert kept.where("n_chars <> length(text)").count() == 0
    single = stages["near_duplicates"](spark, kept, folder).cache()
    left = jaccard_join.classes(single)
    assert left.where("n_shingles > 0").groupBy("component_id").count().where("count > 1").count() == 0
    clean = stages["benchmark_leaks"](spark, single, folder).cache()
    assert clean.columns == docs.columns
    mixed = stages["source_mix"](spark, clean, folder).cache()
    assert mixed.columns == docs.columns and 0 < mixed.select("doc_id").distinct().count() <= clean.count()
    shards = stages["token_output"](spark, mixed, folder).collect()
    assert sorted(r.slot for r in shards) == list(range(len(shards)))


def test_pipeline_stages_on_awkward_tables(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward(spark), empty(spark), awkward(spark).withColumn("doc_id", __import__("pyspark").sql.functions.expr("nullif(doc_id, 3)"))):
            out = stage(spark, docs, folder)
            rows = out.collect()
            if name == "token_output":
                assert bool(rows) == bool(docs.count())
                continue
            assert out.columns == docs.columns and len(rows) <= 3 * docs.count()
            if name == "near_duplicates" and rows:
                assert sum(r.text in (None, "", "   \n\t ") for r in rows) == 3 and len(rows) == 10
            if name == "benchmark_leaks":
                assert len(rows) == docs.count()
