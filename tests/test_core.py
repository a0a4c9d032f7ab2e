"""Operators of edge streams on small frames with results derived by hand or by a plain Python fold."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgestream.functions import paths as P
from edgestream.functions import vectors as V
from edgestream.operators import clique_model, evaluation, factorise, graphs, injection, linkstream, memory, memory_model, message_passing, microcluster, relational, sampling, sequence, temporal, walkscore
from edgestream.plans import catalog_graphs, catalog_relational, catalog_sequence, ordering
from edgestream.sources import readers, writers
from edgestream.streaming import sketch
from edgestream.streaming import walks as follow


def stream(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, t long, src string, dst string, label int").withColumns({"clock": F.col("t"), "weight": F.lit(1.0)})


def column(df, name, order="seq"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_ordering_is_the_same_for_any_chunk(spark, chunk):
    df = spark.createDataFrame([(i * 5, v) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6])], "seq long, v long")
    assert column(ordering.global_lag(df, {"p": "v"}, chunk=chunk), "p") == [None, 3, 1, 4, 1, 5, 9, 2]
    assert column(ordering.global_lead(df, {"p": "v"}, chunk=chunk), "p") == [1, 4, 1, 5, 9, 2, 6, None]
    assert column(ordering.global_sum(df, F.col("v"), "s", chunk=chunk), "s") == [3, 4, 8, 9, 14, 23, 25, 31]
    assert column(ordering.global_max(df, F.col("v"), "m", chunk=chunk), "m") == [3, 3, 4, 4, 5, 9, 9, 9]
    assert column(ordering.global_number(df, "n", chunk=chunk), "n") == list(range(1, 9))


def test_gaps(spark):
    log = spark.createDataFrame(list(enumerate([1, 302, 303, 603, 904])), "seq long, clock long")
    assert column(sequence.gap_rows(log, "before"), "seq") == [0, 3]
    assert column(sequence.gap_rows(log, "after"), "seq") == [1, 4]


def test_self_loops_count_twice(spark):
    e = stream(spark, [(1, "a", "a", 0), (2, "a", "a", 0)])
    assert column(sequence.running_degree(e), "degree") == [2, 4]


def test_padding_never_counts_down(spark):
    assert [r.bin for r in sequence.idle_padding(stream(spark, [(0, "a", "b", 0), (30, "b", "c", 0)]), 10).orderBy("bin").collect()] == [1, 2]
    assert sequence.idle_padding(stream(spark, [(0, "a", "b", 0), (10, "b", "c", 0)]), 10).count() == 0


def test_path_functions(spark):
    df = spark.createDataFrame([("/a/./b//c", "/a/b/d"), ("a\\b", "x"), ("", "/")], "p string, q string")
    assert [r[0] for r in df.select(P.path_depth(F.col("p"))).collect()] == [4, 1, 0]
    assert [r[0] for r in df.select(P.tree_distance(F.col("p"), F.col("q"))).collect()] == [2, 2, 1]
    import hashlib

    text = "C:\\Users\\x"
    row = spark.createDataFrame([(text, "10.1.2.3")], "s string, ip string").select(P.md5_mod(F.col("s")), P.bytes_mod(F.col("ip")), P.is_private_ip(F.col("ip"))).first()
    assert row[0] == int(hashlib.md5(text.encode()).hexdigest(), 16) % 10**8
    assert row[1] == int.from_bytes(b"10.1.2.3", "little") % 10**8 and row[2] is True


def test_haar_keeps_energy_and_inverts(spark):
    x = [1.0, -2.0, 3.5, 4.0, 0.0, 7.0]
    r = spark.createDataFrame([(x,)], "x array<double>").select(V.haar(F.col("x"), 8).alias("h")).select("h", V.inverse_haar(F.col("h"), 8).alias("y")).first()
    assert math.isclose(sum(v * v for v in r.h), sum(v * v for v in x)) and all(abs(a - b) < 1e-9 for a, b in zip(r.y, [*x, 0.0, 0.0], strict=True))
    assert all(abs(a - b) < 1e-9 for a, b in zip(r.h, linkstream.haar_matrix(__import__("numpy").array([x]))[0], strict=True))


def test_auc_ties_and_missing_class(spark):
    auc = lambda rows: evaluation.roc_auc(spark.createDataFrame(rows, "score double, label int")).first().auc
    assert auc([(1.0, 0), (1.0, 1), (1.0, 0)]) == 0.5
    assert auc([(1.0, 0), (2.0, 0)]) is None
    rows = [(float(i * 7 % 11), i % 3 == 0) for i in range(30)]
    forward, back = auc([(s, int(b)) for s, b in rows]), auc([(-s, int(b)) for s, b in rows])
    assert math.isclose(forward + back, 1.0)


def test_link_score_extremes(spark):
    e = stream(spark, [(t, "a", "b", 0) for t in range(1, 11)] + [(20, "a", "b", 0)])
    got = {r.t: r.score for r in linkstream.edge_scores(e, e.select("src", "dst").distinct(), 5, 8, True).collect()}
    assert got[20] == 100.0 and got[10] == 0.0


def test_filtering_matches_a_sequential_fold(spark):
    rows = [(t, f"u{(t * 7 + k) % 4}", f"v{(t + k * k) % 3}", 0) for t in (1, 2, 3, 5, 6, 9, 10) for k in range(5)]
    threshold, fade = 2.0, 0.5
    current, total, score = {}, {}, {}
    now, reciprocal, expected = 1, 0.0, []
    for t, u, v, _ in rows:
        if t > now:
            for key in current:
                total[key] = total.get(key, 0.0) + (current[key] if score.get(key, 0.0) < threshold else total.get(key, 0.0) * reciprocal)
                current[key] *= fade
            reciprocal, now = 1 / (t - 1), t
        best = 0.0
        for key in ((u, v), (u,), ("", v)):
            current[key] = current.get(key, 0.0) + 1
            a, s = current[key], total.get(key, 0.0)
            score[key] = 0.0 if s == 0 else (a + s - a * t) ** 2 / (s * (t - 1))
            best = max(best, score[key])
        expected.append(best)
    got = column(microcluster.filtering(stream(spark, rows), threshold, fade), "score")
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, expected, strict=True))


def test_memory_scores_match_a_fold(spark):
    rows = [(i, f"n{i * 3 % 5}", f"n{i * 2 % 4}", 0) for i in range(60)]
    e = stream(spark, rows).withColumn("f", F.array(F.col("t") / 10.0, F.sin("t"), F.lit(1.0)))
    mem, seen, expected = {}, {}, []
    for t, u, v, _ in rows:
        x, both = [t / 10.0, math.sin(t), 1.0], []
        for n in (u, v):
            a = seen.get(n, 0)
            d = 0.5 * (1 - 0.3 * (a / (a + 10)))
            mem[n] = x if n not in mem else [d * p + (1 - d) * q for p, q in zip(mem[n], x, strict=True)]
            seen[n] = a + 1
            both.append(mem[n])
        expected.append(math.dist(*both))
    got = column(memory.edge_scores(e), "score")
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, expected, strict=True))


def test_memories_keep_a_double_s_precision(spark):
    f = np.random.default_rng(4).random((1000, 3)).tolist()
    got = memory._remembered(spark.createDataFrame([("n", a, x) for a, x in enumerate(f)], "node string, a long, f array<double>"), 3)
    m = f[0]
    for a, r in enumerate(got.orderBy("a").collect()):
        if a:
            d = 0.5 * (1 - 0.3 * (a / (a + 10)))
            m = [d * p + (1 - d) * q for p, q in zip(m, f[a], strict=True)]
        assert all(math.isclose(p, q, rel_tol=1e-15) for p, q in zip(r.memory, m, strict=True))


def test_memories_keep_what_is_left_of_old_values(spark, monkeypatch):
    monkeypatch.setattr(memory, "CHUNK", 2048)
    f = [[0.1 if a % 700 == 0 else 0.0, 1.0, float(a % 997 == 3)] for a in range(5000)]
    got = memory._remembered(spark.createDataFrame([("n", a, x) for a, x in enumerate(f)], "node string, a long, f array<double>"), 3)
    m = f[0]
    rows = got.orderBy("a").collect()
    assert len(rows) == len(f)
    for a, r in enumerate(rows):
        if a:
            d = 0.5 * (1 - 0.3 * (a / (a + 10)))
            m = [d * p + (1 - d) * q for p, q in zip(m, f[a], strict=True)]
        assert r.memory == m


def test_decimal_weights_are_added_exactly(spark):
    weights = spark.range(1000).select(F.col("id").alias("node"), F.lit("0.1").cast("decimal(18, 6)").alias("weight"))
    draws = spark.range(1000).select("id", (F.col("id") / 1000).alias("x"))  # each at an end of a share
    upper = np.arange(1, 1001) / 10
    got = sampling.weighted_choice(weights, draws).select("id", "node").collect()
    assert len(got) == 1000 and all(r.node == np.searchsorted(upper, r.id / 1000 * upper[-1], "right") for r in got)


def test_injection_keeps_benign_rows(spark):
    log = spark.createDataFrame([(i, c, f"p{i}", 0) for i, c in enumerate([1, 2, 500, 501])], "seq long, clock long, path string, label int")
    bad = spark.createDataFrame([(0, 9000, "x", 1), (1, 9003, "y", 1)], log.schema)
    got = injection.into_gap(log, bad, 1).orderBy("seq").collect()
    assert [r.path for r in got] == ["p0", "p1", "x", "y", "p2", "p3"] and [r.clock for r in got] == [1, 2, 3, 6, 500, 501]
    series = spark.createDataFrame([("a", "b", t) for t in (0, 10, 30, 32)], "src string, dst string, t long")
    assert [r.t for r in injection.densify(series, 50).collect()] == [20, 5]
    assert [r.t for r in injection.sparsify(series, 25).collect()] == [32]


def test_injection_without_a_gap_keeps_all_rows(spark):
    log = spark.createDataFrame([(i, c, f"p{i}", 0) for i, c in enumerate([1, 2, 3])], "seq long, clock long, path string, label int")
    bad = spark.createDataFrame([(0, 9000, "x", 1), (1, 9003, "y", 1)], log.schema)
    got = injection.into_gap(log, bad, None).orderBy("seq").collect()
    assert [(r.path, r.clock) for r in got] == [("p0", 1), ("p1", 2), ("p2", 3), ("x", None), ("y", None)]
    got = injection.into_gap(log.where("seq <> 1"), bad, 1).orderBy("seq").collect()
    assert [(r.path, r.clock) for r in got] == [("p0", 1), ("x", None), ("y", None), ("p2", 3)]


def test_sketch_is_never_below_the_count(spark):
    e = spark.range(3000).selectExpr("id % 37 AS u", "id % 91 AS v")
    rows = microcluster.sketch_estimates(e, [(16807, 11), (48271, 7)], 97).collect()
    assert rows and all(r.estimate >= r.n for r in rows)


def test_sketch_estimates_group_the_pairs_once(spark):
    rows = [(k % 37, k % 91) for k in range(700)]
    held = microcluster.sketch_estimates(spark.createDataFrame(rows, "u long, v long"), [(16807, 11), (48271, 7)], 19)
    cells = [{}, {}]
    place = lambda u, v, r: ((u + 104729 * v) * (16807, 48271)[r] + (11, 7)[r] + 2**31) % 2**32 - 2**31
    column_of = lambda u, v, r: (abs(place(u, v, r)) % 19 * (1 if place(u, v, r) >= 0 else -1)) % 19
    for u, v in rows:
        for r in (0, 1):
            cells[r][column_of(u, v, r)] = cells[r].get(column_of(u, v, r), 0) + 1
    assert {(r.u, r.v, r.n, r.estimate) for r in held.collect()} == {(u, v, rows.count((u, v)), min(cells[r][column_of(u, v, r)] for r in (0, 1))) for u, v in rows}
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Generate" not in plan  # a pair's cells are not rows of their own


def test_nearest_without_points_has_no_rows(spark):
    log = spark.createDataFrame(list(enumerate([5, 6, 2000, 3, 4])), "seq long, clock long")
    assert column(sequence.gap_rows(log, "before", 900), "seq") == [1]  # the clock set back is no gap
    assert column(sequence.gap_rows(log, "after", 900), "seq") == [2]
    targets = spark.createDataFrame([(0,), (5,)], "target long")
    assert relational.nearest(log.where("clock > 5000").select(F.col("seq").alias("position")), targets).count() == 0


def test_relational_edge_cases(spark):
    near = relational.nearest(spark.createDataFrame([(2,), (8,)], "position long"), spark.createDataFrame([(0,), (5,), (9,)], "target long"))
    assert {r.target: r.position for r in near.collect()} == {0: 2, 5: 8, 9: 8}
    e = stream(spark, [(1, "a", "b", 0), (2, "a", "c", 0), (2, "c", "a", 0), (3, "a", "d", 0)])
    assert {r.seq: r.neighbours for r in relational.recent_neighbours(e, 2).collect()} == {0: [], 1: ["b"], 2: [], 3: ["c", "c"]}


def test_walks_follow_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a")], "u string, v string")
    known = {("a", "b"), ("b", "c"), ("b", "a")}
    for r in sampling.walks(e, spark.createDataFrame([("a",), ("c",)], "node string"), 5).collect():
        assert all(p in known for p in zip(r.path, r.path[1:], strict=False)) and (r.start != "c" or r.path == ["c"])


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "log.txt").write_text("1|d|t|10|2|/a/b\n2|d|t|20|2|/a/c\n")
    assert [(r.session_id, r.path, r.label) for r in readers.access_log(spark, str(tmp_path / "log.txt"), 1).collect()] == [(10, "/a/b", 1), (20, "/a/c", 1)]
    (tmp_path / "chain.txt").write_text("src_node,x\na\\b,c\\d,1.5,1\n\na\\b,c,zz,1\n\\,c,1,1\na,b,2,?\n")
    assert [(r.src, r.dst, r.src_depth, r.ts, r.label) for r in readers.path_chain_log(spark, str(tmp_path / "chain.txt")).collect()] == [("b", "d", 2, 1.5, 1), ("a", "b", 1, 2.0, 0)]
    (tmp_path / "w.csv").write_text("1,a,b,2.0,0\n2,a,b,1.0,-\n")
    assert [r.label for r in readers.weighted_edges(spark, str(tmp_path / "w.csv")).collect()] == [1, 0]
    e = stream(spark, [(5, "a", "b", 0), (5, "b", "a", 1), (9, "c", "b", 0)])
    writers.write_column_split(e, str(tmp_path / "m"))
    data = readers.column_split_stream(spark, str(tmp_path / "m/data"), str(tmp_path / "m/label"), str(tmp_path / "m/shape"))
    assert {(r.u, r.v, r.t, r.label) for r in data.collect()} == {(0, 1, 5, 0.0), (1, 0, 5, 1.0), (2, 1, 9, 0.0)}
    assert [(r.t, r.u, r.v) for r in writers.snapshot_rows(e).orderBy("seq").collect()] == [(1, 1, 2), (1, 2, 1), (5, 3, 2)]
    (tmp_path / "s.txt").write_text("[TOP50] precision: 0.5, recall: 0.25\n0.3 1\n[TOP100] precision: 0.4, recall: 0.5\n")
    assert [(r.k, r.precision, r.recall) for r in readers.score_or_topk(spark, str(tmp_path / "s.txt")).collect()] == [(50, 0.5, 0.25), (100, 0.4, 0.5)]


def test_streaming_equals_batch(spark, tmp_path):
    from edgestream.streaming import engine

    rows = [(t, f"u{t % 3}", f"v{t % 2}", 0) for t in (1, 1, 2, 2, 2, 4, 5, 5)]
    e = stream(spark, rows).select("seq", "t", "src", "dst", "label")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = engine.microcluster_scores(live).writeStream.format("memory").queryName("scores").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.seq: r.score for r in spark.table("scores").collect()}
    want = {r.seq: r.score for r in microcluster.normal(e).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_microcluster_stream_calls_no_function_for_a_pair(spark, tmp_path):
    from edgestream.plans import catalog_streams
    from edgestream.streaming import engine

    rows = [(i, t, f"u{i % 3}", None if i % 5 == 0 else f"v{i % 2}") for i, t in enumerate([1, 1, 2, 2, 2, 4, 3, 5, 5, 4, 4, 6, 6, 6, 1, 7, 7, 7, 7, 9])]
    e = spark.createDataFrame(rows, "seq long, t long, src string, dst string")
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    for a, b in ((0, 6), (6, 6), (6, 13), (13, 20)):  # cuts within a tick, an empty file, late ticks
        e.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(source)
        engine.microcluster_stream(spark.readStream.schema(e.schema).parquet(source), folder).awaitTermination()
    state, want = {}, {}
    for seq, t, *pair in rows:
        now, a, s = state.get(tuple(pair), (1, 0, 0))
        now, a, s = (t, 1, s + 1) if t > now else (now, a + 1, s + 1)
        state[tuple(pair)] = now, a, s
        want[seq] = 0.0 if t <= 1 else ((a - s / t) * t) ** 2 / (s * (t - 1))
    assert close({r.seq: r.score for r in spark.read.parquet(folder + "/out/*").collect()}, want)
    assert "microcluster_stream" in catalog_streams.QUERIES["stream_microcluster"].__code__.co_names


@pytest.mark.parametrize("fade", [None, 0.5])
def test_sketch_stream_equals_the_batch_form_with_a_state_of_fixed_size(spark, tmp_path, fade):
    rows = [(i, 1 + i // 9 * 2, i * i % 13, (i * 5 + i // 3) % 11) for i in range(300)]
    e = spark.createDataFrame(rows, "seq long, t long, u long, v long")
    source, folder, sizes = str(tmp_path / "in"), str(tmp_path / "run"), []
    for a, b in ((0, 95), (95, 95), (95, 200), (200, 300)):  # cuts within a tick, an empty file
        e.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(source)
        sketch.sketch_stream(spark.readStream.schema(e.schema).parquet(source), folder, 2, 8, fade).awaitTermination()
        held = sketch.cell_state(spark, folder + "/state")
        sizes.append(held.before()["cells"].count())
    want = {r.seq: r.score for r in microcluster.sketch_scores(e.withColumn("stream_id", F.lit(0)), 2, 8, fade).collect()}
    out = spark.read.parquet(folder + "/out/*").collect()
    assert len(out) == 300 and close({r.seq: r.score for r in out}, want)
    assert max(sizes) <= 2 * 8 * (3 if fade else 1) and len(held.done()) <= 2
    # a batch that runs again reads the version before its own; a late edge rewinds nothing
    state = held.before()["cells"]
    late = spark.createDataFrame([(300, 5, 1, 1), (301, 69, 1, 1)], "seq long, t long, u long, v long")
    scores, after = sketch.score_batch(late, state, 2, 8, fade, 7)
    assert after.agg(F.max("t")).first()[0] == 69 and scores.count() == 2


def test_walk_stream_equals_the_batch_forms_after_every_batch(spark, tmp_path):
    rows = [(i, f"n{i * i % 17}", f"n{(i * 5 + i // 3) % 13}") for i in range(160)]
    e = spark.createDataFrame(rows, "seq long, src string, dst string")
    source, folder, told = str(tmp_path / "in"), str(tmp_path / "run"), []
    as_set = lambda df: {(r.start, r.walk, tuple(r.path)) for r in df.collect()}
    before = set()
    for number, (a, b) in enumerate(((0, 40), (40, 43), (43, 43), (43, 160))):
        e.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(source)
        follow.walk_stream(spark.readStream.schema(e.schema).parquet(source), folder, 5, 3, 2).awaitTermination()
        now = follow.Versions(spark, folder + "/state", {"slots": follow.SLOTS, "walks": follow.WALKS}).before()
        slots = sampling.neighbour_reservoirs(e.where(F.col("seq") < b), 3)
        assert {tuple(r) for r in now["slots"].collect()} == {tuple(r) for r in slots.collect()}
        walks = as_set(now["walks"])
        assert walks == as_set(follow.reservoir_walks(slots, 5, 3, 2)) and all(len(p) == 6 for _, _, p in walks)
        out = as_set(spark.read.schema(follow.WALKS).parquet(f"{folder}/out/batch={number}")) if b > a else set()
        assert walks - before <= out <= walks
        told.append((len(out), len(walks)))
        before = walks
    assert told[1][0] < told[1][1] / 2  # three edges change few walks


def plain_bridge_scores(rows, priority, sample, rounds, restart=0.15):
    held, scores = [], []

    def visits(u, v, extra):
        out = {}
        for a, b, w in [e for _, _, a, b, w in held for e in ((a, b, w), (b, a, w))] + [(u, v, extra)]:
            if w:
                out.setdefault(a, []).append((b, w))
        mass, at = {u: 1.0}, 0.0
        for _ in range(rounds):
            at, moved = at + mass.get(v, 0.0), {}
            for x, m in mass.items():
                total = sum(w for _, w in out.get(x, []))
                for y, w in out.get(x, []):
                    moved[y] = moved.get(y, 0.0) + m * (1 - restart) * w / total
            mass = moved
        return at / sum((1 - restart) ** k for k in range(rounds))  # the walk's steps count, whether an edge leads on or not

    for seq, _, u, v, w in rows:
        full = len(held) == sample
        scores.append(sum(max(0.0, visits(a, b, w) - visits(a, b, 0.0)) for a, b in ((u, v), (v, u))) / 2 if full else 0.0)
        if not full or priority[seq] > min(held)[0]:
            held = [h for h in held if not full or h != min(held)] + [(priority[seq], seq, u, v, w)]
    return scores


@pytest.mark.parametrize("batch", [7, 4096])
def test_bridge_scores_match_a_plain_walk(spark, batch):
    rows = [(i, 1 + i // 7, f"n{i * i % 13}", f"n{(i * 5 + i // 3) % 11}", 1.0 + i % 3) for i in range(120)]
    e = spark.createDataFrame([(*r, 0) for r in rows], "seq long, t long, src string, dst string, weight double, stream_id int")
    placed = walkscore.with_priority(e).collect()
    priority = {r.seq: r.priority for r in placed}
    ticks = [r[1] for r in rows]
    assert all(r.place == r.seq and r.priority <= 0 for r in placed) and len(set(priority.values())) > 100
    assert math.isclose(10 ** (priority[119] / ticks.count(ticks[119])), int(__import__("hashlib").md5(b"1-119").hexdigest()[:7], 16) / 2**28, abs_tol=1e-6)
    want = plain_bridge_scores(rows, priority, 20, 12)
    got = column(walkscore.bridge_scores(e, 20, rounds=12, batch=batch), "score")
    assert any(r[2] == r[3] for r in rows) and sum(x > 0 for x in got) > 10
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, want, strict=True))
    # sampled walks: the same for every cut into batches, and within their error of the expectation
    sampled = column(walkscore.bridge_scores(e, 20, walks=900, batch=batch), "score")
    assert sampled == column(walkscore.bridge_scores(e, 20, walks=900, batch=31), "score")
    exact = column(walkscore.bridge_scores(e, 20, rounds=60, batch=batch), "score")
    assert max(abs(a - b) for a, b in zip(sampled, exact, strict=True)) < 2 / 30


def test_events_of_a_version_share_their_power_iteration(monkeypatch):
    draw, rounds, restart = np.random.default_rng(5), 9, 0.15
    held = walkscore.Sample()
    for a, b, w in [*zip(draw.integers(0, 25, 40), draw.integers(20, 40, 40), draw.integers(1, 4, 40), strict=True), (3, 3, 2)]:
        held.add(f"n{a}", f"n{b}", float(w))
    named = [(f"n{a}", f"n{b}") for a, b in draw.integers(0, 45, (300, 2))] + [("n3", "n3"), ("new", "new"), ("new", "n3"), ("n3", "other")]
    u, v = (np.array([held.node(x[k]) for x in named]) for k in (0, 1))
    weight = draw.integers(1, 4, len(u)).astype(float)
    n, plain = len(held.number), np.zeros((len(held.number),) * 2)
    for a, table in held.next.items():
        for b, parts in table.parts.items():
            plain[held.number[a], held.number[b]] = sum(parts)

    def visits(w, a, b):
        total = w.sum(axis=1, keepdims=True)
        step = np.divide((1 - restart) * w, total, out=np.zeros_like(w), where=total > 0)
        return sum(np.linalg.matrix_power(step, k)[a, b] for k in range(rounds)) / sum((1 - restart) ** k for k in range(rounds))

    def gain(a, b, extra):
        more = plain.copy()
        more[a, b] += extra
        return max(0.0, visits(more, a, b) - visits(plain, a, b))

    calls, real = [], np.add.reduceat
    monkeypatch.setattr(walkscore.np, "add", type("Counted", (), {"reduceat": staticmethod(lambda *a, **b: calls.append(1) or real(*a, **b))}))
    got = walkscore._expected(held, u, v, weight, restart, rounds)
    monkeypatch.undo()
    assert len(calls) == rounds - 1  # however many events there are
    for side, (a, b) in enumerate(((u, v), (v, u))):
        assert np.allclose(got[side], [gain(x, y, w) for x, y, w in zip(a, b, weight, strict=True)], rtol=0, atol=1e-12)
    assert n > 40 and (got[0] > 0).sum() > 100


def test_alias_tables_draw_by_weight_after_changes():
    table = walkscore.AliasTable()
    for key, by in (("c", 1.0), ("a", 2.0), ("b", 4.0), ("a", 1.0), ("d", 3.0)):
        table.increment(key, by)
    table.decrement("d", 3.0)
    keys, keep, other, total = table.table()
    assert table.table()[0] is keys  # built once
    share = dict(zip(keys, (keep / 3).tolist(), strict=True))
    for k, o in enumerate(other):
        share[keys[o]] += (1 - keep[k]) / 3 if o != k else 0.0
    assert total == 8.0 and share.keys() == {"a", "b", "c"} and all(math.isclose(share[k], w / 8) for k, w in (("c", 1), ("a", 3), ("b", 4)))


def test_bridge_query_scores_every_event(spark, monkeypatch):
    rows = [(i + 1700, 1 + i // 40, f"u{i * i % 61}", f"v{i * 7 % 53}", 1.0) for i in range(620)]
    e = spark.createDataFrame(rows, "seq long, t long, src string, dst string, weight double")
    monkeypatch.setattr(catalog_relational, "ev", lambda s, d: e)
    got = catalog_relational.QUERIES["bridge_score"](spark, "").orderBy("seq").collect()
    assert [r.seq for r in got] == [r[0] for r in rows]
    assert all(r.score == 0.0 for r in got[:500]) and any(r.score > 0.0 for r in got[500:])  # the operator's own sample of 500


def test_scores_of_every_tick_exchange_the_pairs_ticks_only(spark):
    rows = [(3, "a", "b"), (5, "a", "b"), (5, "a", "b"), (6, "a", "b"), (12, "a", "b"), (4, "c", "d"), (20, "e", "f")]
    e = spark.createDataFrame(rows, "t long, src string, dst string")
    scores = linkstream.edge_scores(e, e.where("src < 'e'").select("src", "dst").distinct(), 4, 6)
    got = {(r.src, r.t): r.score for r in scores.collect()}
    assert got.keys() == {(x, t) for x in "ac" for t in range(6, 13)}
    for (src, t), score in got.items():
        ticks = {r[0] for r in rows if r[1] == src}
        near = [k for k in ticks if t - 4 <= k < t]
        p = len(near) / (max(near) - min(near) + 1) if len(near) > 1 else 0.0
        assert math.isclose(score, ((t in ticks) - p) ** 2 / max(p * (1 - p), 0.01))
    above = scores._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Window" not in above and "hashpartitioning" not in above  # what is formed of the ticks stays in its task


def test_link_queries_take_every_malicious_pair_and_node(spark, monkeypatch):
    rows = [(t, f"{k}", f"k{(t + k) % 3}", int((t * k) % 4 == 1)) for t in (*range(1, 31), 101, 299, *range(301, 306)) for k in range(9, 16)]
    e = stream(spark, rows).withColumn("seq", F.col("seq") + 950)
    monkeypatch.setattr(catalog_relational, "ev", lambda s, d: e)
    pairs = {(u, v) for _, u, v, bad in rows if bad}
    ticks = {p: sorted({t for t, u, v, _ in rows if (u, v) == p}) for p in pairs}
    want = {}
    for (u, v), seen in ticks.items():
        for t in range(300, 306):
            near = [x for x in seen if t - 20 <= x < t]
            p = len(near) / (near[-1] - near[0] + 1) if near and near[-1] > near[0] else 0.0
            want[u, v, t] = ((t in seen) - p) ** 2 / max(p * (1 - p), 0.01)
    got = {(r.src, r.dst, r.t): r.score for r in catalog_relational.QUERIES["edge_link_score"](spark, "").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-5) for k in want)
    scored = {r.node for r in catalog_relational.QUERIES["node_link_score"](spark, "").collect()}
    assert scored == {u for u, _ in pairs} and len(scored) > 3


def plain_ranks(edges, nodes, weighted):
    w, fan = {}, {}
    for u, v in edges:
        w[u, v] = w.get((u, v), 0.0) + 1.0
    if not weighted:
        w = dict.fromkeys(w, 1.0)
    for (u, _), x in w.items():
        fan[u] = fan.get(u, 0.0) + x
    flow = {n: 0.5 * (fan.get(n, 0.0) / sum(fan.values()) if weighted else 1 / len(nodes)) for n in nodes}
    total = dict(flow)
    for _ in range(60):  # to the limit
        moved = dict.fromkeys(nodes, 0.0)
        for (u, v), x in w.items():
            moved[v] += 0.5 * flow[u] * x / fan[u]
        flow = moved
        total = {n: total[n] + flow[n] for n in nodes}
    return {n: x / sum(total.values()) for n, x in total.items()}


def test_pagerank_queries_reach_the_limit_on_the_whole_graph(spark, monkeypatch):
    pairs = [(k, k * k % 7) for k in range(15, 40)] + [(15, 1), (15, 1), (30, 5)]
    monkeypatch.setattr(catalog_relational, "li", lambda s, d: spark.createDataFrame(pairs, "u long, v long"))
    named = [(f"s{u}", f"p{v}") for u, v in pairs]
    nodes = {n for e in named for n in e}
    for name in ("pagerank_v1", "pagerank_v2"):
        got = {r.node: r.rank for r in catalog_relational.QUERIES[name](spark, "").collect()}
        want = plain_ranks(named + [(v, u) for u, v in named], nodes, name == "pagerank_v2")
        assert got.keys() == nodes and sum(abs(got[n] - want[n]) for n in nodes) < 1e-3  # the reference's residual
    assert {r.start for r in catalog_graphs.QUERIES["random_walks"](spark, "").collect()} == {u for u, _ in named}


def test_rounds_of_pagerank_exchange_the_mass_alone(spark):
    pairs = [(f"s{k}", f"p{k * k % 11}") for k in range(40)]
    rows = graphs.both_ways(spark.createDataFrame(pairs, "u string, v string")).select(F.lit(0).alias("tick"), F.col("u").alias("node"), F.col("v").alias("other"), F.lit(0.25).alias("share"))
    shares = graphs.laid_out(graphs.dealt_by(rows, "tick", "node").sortWithinPartitions("tick", "node"))
    mass = rows.select("tick", "node").distinct().withColumn("mass", F.lit(0.5))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        found = graphs._spread(mass, shares, ["tick"], 3)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange hashpartitioning") == 5  # what is handed on, and the mass but for the start; the shares were exchanged as well
    mine = [(t, "a", "b", 0) for t in (1, 2)] + [(2, "b", "c", 0)]
    both = {(r.t, r.node): (r.r1, r.r2) for r in graphs.both_snapshot_pageranks(stream(spark, mine)).collect()}
    for k, weighted in enumerate((False, True)):
        alone = {(r.t, r.node): r["rank"] for r in graphs.snapshot_pageranks(stream(spark, mine), weighted).collect()}
        assert all(math.isclose(both[key][k], alone.get(key, 0.0), abs_tol=1e-12) for key in both) and alone.keys() <= both.keys() and len(both) == 6


def test_derivative_query_uses_the_operators_rounds(spark, monkeypatch):
    rows = [(1 + 24 * (i // 4), f"n{i * i % 7}", f"n{(i * 3 + 1) % 5}", 0) for i in range(24)]
    e = stream(spark, rows)
    monkeypatch.setattr(catalog_relational, "ev", lambda s, d: e)
    daily = e.withColumn("t", F.expr("(t - 1) div 24"))
    full = graphs.snapshot_pageranks(daily).withColumnRenamed("rank", "r1").join(graphs.snapshot_pageranks(daily, True).withColumnRenamed("rank", "r2"), ["t", "node"], "left").na.fill(0.0, ["r2"])
    want = {r.t: round(r.score, 4) for r in graphs.derivative_scores(full).collect()}
    got = {r.t: r.score for r in catalog_relational.QUERIES["derivative_scores"](spark, "").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[t], want[t], abs_tol=2e-4) for t in want)


def test_queries_take_the_whole_table(spark, monkeypatch):
    rows = [(1 + i // 1500 * 2, f"{5 + i % 4}", "k", int(i == 1600)) for i in range(10600)]
    e = stream(spark, rows).withColumn("clock", F.col("seq") + F.when(F.col("seq") > 10400, 1000).otherwise(0))
    for module in (catalog_relational, catalog_sequence):
        monkeypatch.setattr(module, "ev", lambda s, d: e)
    ask = lambda name, module=catalog_relational: module.QUERIES[name](spark, "").collect()
    filled = {}
    for r in ask("fill_seconds", catalog_sequence):
        filled[r.seq] = filled.get(r.seq, 0) + 1
    assert filled == {i: 1001 if i == 10400 else 1 for i in range(10600)}
    assert {r.t for r in ask("empty_slices")} == set(range(174, 190))
    assert {r.t: r.label for r in ask("spine_labels")} == {t: int(t == 3) for t in range(1, 16)}
    assert {r.target: r.position for r in ask("nearest_gap")} == dict.fromkeys(range(0, 10600, 250), 10400)
    monkeypatch.setattr(catalog_relational, "li", lambda s, d: spark.createDataFrame([(10, 2), (60, 2), (60, 1)], "u long, v long"))
    assert {r.node: r.neighbours for r in ask("adjacency_lists")} == {1000010: [2], 1000060: [1, 2], 1: [1000060], 2: [1000010, 1000060]}
    x = np.arange(64.0) ** 1.5 % 7
    monkeypatch.setattr(catalog_relational, "vectors", lambda s, d: spark.createDataFrame([(0, x.tolist())], "node long, x array<double>"))
    got = {r.k: r.c for r in ask("haar")}
    assert got.keys() == set(range(64)) and all(math.isclose(got[k], c, abs_tol=1e-5) for k, c in enumerate(linkstream.haar_matrix(x[None])[0]))


def plain_link_score(history, present, by_walk):
    """The reference's score by explicit basis vectors (history: oldest tick first).

    by_walk: of equally probable edges, the one that reached its count earlier in the walk back stands first
    (an edge that counts once more changes places with the first of its old count); else they stand by number.
    """
    n = 1 << max(0, (len(present) - 1).bit_length())

    def basis():
        yield np.full(n, n**-0.5), slice(0, n)
        size = n
        while size > 1:
            for a in range(0, n, size):
                b = np.zeros(n)
                b[a : a + size // 2], b[a + size // 2 : a + size] = size**-0.5, -(size**-0.5)
                yield b, slice(a, a + size)
            size //= 2

    def leaves(x, order):
        return np.array([x[i] for i in order] + [0.0] * (n - len(order)))

    def ranked(window):
        if not by_walk:
            return sorted(range(len(present)), key=lambda i: (-sum(h[i] for h in window), i))
        order, count = list(range(len(present))), [0] * len(present)
        for now in reversed(window):
            for e in (i for i, x in enumerate(now) if x):
                first, at = next(k for k, i in enumerate(order) if count[i] == count[e]), order.index(e)
                order[first], order[at] = order[at], order[first]
                count[e] += 1
        return order

    best, p, order = math.inf, np.zeros(len(present)), list(range(len(present)))
    first = next((i for i, h in enumerate(history) if any(h)), len(history))
    for length in range(2, len(history) - first):
        window = history[-length:]
        if not any(map(any, window)):
            continue
        q, now = np.array([sum(h[i] for h in window) / length for i in range(len(present))]), ranked(window)
        gap = 0.0
        for b, part in basis():
            xs = [float(leaves(h, now) @ b) for h in window]
            gap += (leaves(q * (1 - q), now)[part].mean() - np.var(xs)) ** 2
        if math.sqrt(gap) <= best + 1e-9:
            best, p, order = min(best, math.sqrt(gap)), q, now
    x, m, v = (leaves(y, order) for y in (present, p, p * (1 - p)))
    return sum(float((x - m) @ b) ** 2 / max(v[part].mean(), 0.01) for b, part in basis())


LINK_ROWS = [(t, "a", o, 0) for t in range(1, 26) for k, o in enumerate("vwxyz") if t not in (13, 14, 22, 23, 24, 25) and np.random.default_rng(100 * t + k).random() < (0.9, 0.5, 0.3, 0.2, 0.1)[k]]


def close(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-6, abs_tol=1e-6) for k in b)


@pytest.mark.parametrize("span", [1, 8])
def test_node_link_scores_match_a_plain_fit_on_every_tick(spark, span):
    e = stream(spark, [*LINK_ROWS, (27, "b", "c", 0)])
    met = sorted({r[2] for r in LINK_ROWS})
    there = lambda t: [float((t, "a", o, 0) in LINK_ROWS) for o in met]
    got = {r.t: r.score for r in linkstream.node_scores(e, spark.createDataFrame([("a",)], "node string"), 8, 5, span=span).collect()}
    assert close(got, {t: plain_link_score([there(k) for k in range(t - 8, t)], there(t), True) for t in range(5, 28)})  # quiet ticks too, to the stream's last


def test_node_links_of_one_pattern_are_fitted_once(spark):
    draw = np.random.default_rng(3)
    seen = {}
    linkstream._quiet.cache_clear(), linkstream._known_window.cache_clear()
    for edges in range(1, 40):
        for _ in range(8):
            history = [sorted(draw.choice(edges, min(edges, n), replace=False).tolist()) if (n := draw.poisson(0.3)) else [] for _ in range(9)]
            oldest = max((k for k, now in enumerate(history) if now), default=0)
            names = {}
            events = tuple((m, names.setdefault(e, len(names))) for m in range(1, oldest + 1) for e in history[m - 1])
            whole = sorted(linkstream.spectrum(history, [], edges))
            height = (edges - 1).bit_length()
            assert seen.setdefault((height, oldest, events), whole) == whole  # whatever the edges are called
            assert sorted(linkstream._quiet(height, oldest, events)) == whole
    again = linkstream._quiet.cache_info()
    assert again.hits > 0 and again.hits + again.misses == 39 * 8
    rows = [(t, f"n{k}", f"m{(k + t) % 3}", 0) for k in range(30) for t in (1, 5, 6, 40)]
    e = stream(spark, rows)
    scored = linkstream.node_scores(e, e.select(F.col("src").alias("node")).distinct(), 8, 1)
    assert scored.rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes were put in one task


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_graph_link_scores_match_one_plain_tree_over_all_edges(spark, bits):
    draw = np.random.default_rng(7)
    more = [(t, f"n{k % 3}", f"m{k}", 0) for t in (*range(1, 12), *range(17, 26)) for k in range(6) if draw.random() < (0.8, 0.1, 0.3, 0.5, 0.05, 0.2)[k]]
    rows = LINK_ROWS + more
    edges = sorted({r[1:3] for r in rows})
    there = lambda t: [float((t, *x, 0) in rows) for x in edges]
    want = {t: plain_link_score([there(k) for k in range(t - 6, t)], there(t), False) for t in range(5, 28)}
    got = {r.t: r.score for r in linkstream.graph_scores(stream(spark, [*rows, (27, "a", "v", 0)]), 6, 5, bits).collect()}
    want[27] = plain_link_score([there(k) for k in range(21, 27)], [float(x == ("a", "v")) for x in edges], False)
    assert close(got, want)
    one = [(t, "a", "b", 0) for t in (1, 2, 4, 5, 9)]
    got = {r.t: r.score for r in linkstream.graph_scores(stream(spark, one), 4, 3, bits).collect()}
    assert close(got, {t: plain_link_score([[float((k, "a", "b", 0) in one)] for k in range(t - 4, t)], [float((t, "a", "b", 0) in one)], False) for t in range(3, 10)})
    assert linkstream.graph_scores(stream(spark, one).limit(0), 4, 3).count() == 0


def test_graph_link_scores_send_a_few_nodes_of_each_run_of_leaves(spark):
    draw = np.random.default_rng(5)
    there = (draw.random((3, 5000)) < 0.4).astype(float)
    parts, pieces = linkstream._fit_pieces(77, there, there.sum(axis=0) ** 2)
    assert len(pieces) <= 2 * 13 and sum(1 << p[0] for p in pieces) == 5000  # each leaf was a row before, for every window
    one, more = linkstream._fit_pieces(77, there[:, :1], there.sum(axis=0)[:1] ** 2)
    assert not one.any() and more == [(0, 77, there[:, 0].tolist(), there[:, 0].sum() ** 2)] and parts.all()
    score, pieces = linkstream._score_pieces(3, 1 << 20, np.array([3, 4, 70000]), np.array([1.0, -1.0, 0.5]), np.zeros(3))
    assert len(pieces) <= 3 and math.isclose(score + sum(g * g / 2.0**j / 0.01 for j, _, g, _ in pieces), 225.0)  # no coefficient is lost
    rows = [(t, "a", o, 0) for t in range(1, 9) for o in "wxyz"]  # one run is the whole tree
    got = {r.t: r.score for r in linkstream.graph_scores(stream(spark, rows), 4, 3).collect()}
    assert close(got, {t: plain_link_score([[float(k > 0)] * 4 for k in range(t - 4, t)], [1.0] * 4, False) for t in range(3, 9)})


def plain_factor_scores(rows, most, alpha, setup, every, by_tick, floor=0.001, width=8):
    """Without fitting steps: vectors are the draws of the nodes that are held when they are first needed."""
    q = factorise.mixing_matrix(width)
    held, nodes, out, low = {}, None, {}, floor
    first = min(r[1] for r in rows)
    vector = lambda x: (lambda h: h / np.linalg.norm(h))(np.array([factorise.drawn(1, x, k) + 1e-9 for k in range(width)]))

    def prune(t):
        nonlocal held, low
        ranked = sorted((-f * alpha ** (t - was), p) for p, (was, f) in held.items())
        if len(ranked) >= most:
            low = -ranked[most - 1][0]
        held = {p: held[p] for f, p in ranked[:most] if -f >= low}

    for t in range(first, max(r[1] for r in rows) + 1):
        now = [r for r in rows if r[1] == t]
        pairs = [r[2:] for r in now]
        rate = {p: math.exp(vector(p[0]) @ q @ vector(p[1])) if nodes and {*p} <= nodes else low for p in pairs}
        for k, (seq, _, s, d) in enumerate(now):
            n = pairs.count((s, d))
            f = n if (s, d) in pairs[:k] else low if (s, d) not in held else 1 / (t - held[s, d][0] - 1 + 1 / n)
            groups = [sum(pairs.count(p) for p in rate if p[c] == x) / sum(rate[p] for p in rate if p[c] == x) for c, x in ((0, s), (1, d))]
            out[seq] = 0.0 if nodes is None else max(f / rate[s, d], *groups)
        for p in set(pairs):
            was, f = held.get(p, (t, 0.0))
            held[p] = t, f * alpha ** (t - was) + (1 - alpha) * pairs.count(p)
        at_fit = t >= first + setup and (t - first - setup) % every == 0
        if by_tick and now or not by_tick and at_fit:
            prune(t)
        if at_fit:
            nodes = {x for p in held for x in p}
    return out


FACTOR_ROWS = [(t, f"s{t * t % 5}", f"d{k * t % 4}", 0) for t in range(1, 40) if t % 9 for k in range(1 + t % 4)] + [(40, "s0", f"d{k}", 0) for k in range(6) for _ in range(1 + k % 3)] + [(41, f"s{k}", "d0", 0) for k in range(1, 5)]


@pytest.mark.parametrize("by_tick", [True, False])
def test_factor_scores_take_the_largest_of_edge_and_groups(spark, by_tick):
    e = stream(spark, FACTOR_ROWS).withColumn("stream_id", F.lit(0))
    rows = [(i, *r[:3]) for i, r in enumerate(FACTOR_ROWS)]
    rows.sort(key=lambda r: (r[1], r[0]))
    want = plain_factor_scores(rows, 6, 0.9, 10, 12, by_tick)
    score = factorise.fold_factor_scores(e, 6, 0.9, setup=10, every=12, steps=0) if by_tick else factorise.factor_scores(e, 6, 0.9, setup=10, every=12, epochs=0)
    got = {r.seq: r.score for r in score.collect()}
    assert close(got, want) and sum(x > 0 for x in want.values()) > 40


def test_strata_lose_no_more_than_one_plain_fit(spark):
    draw = np.random.default_rng(5)
    pairs = {(f"n{a}", f"n{b}"): float(f) for a, b, f in zip(draw.integers(0, 30, 90), draw.integers(0, 30, 90), draw.random(90), strict=True) if a != b}
    state = spark.createDataFrame([(*p, 1, f) for p, f in pairs.items()], "src string, dst string, t long, f double")
    q = factorise.mixing_matrix(8)
    start = ordering.cut_lineage(factorise.first_vectors(state.select(F.explode(F.array("src", "dst")).alias("node")), 8))
    met = [sorted(p for r in factorise.rounds_of(6) for p in r), [{g for p in r for g in p} for r in factorise.rounds_of(6)]]
    assert met == [[(a, b) for a in range(6) for b in range(a + 1, 6)], [set(range(6))] * 5]
    names = {r.node: k for k, r in enumerate(start.orderBy("node").collect())}
    h = np.array([r.h for r in start.orderBy("node").collect()])
    freq = np.full((len(h), len(h)), 0.01)
    for (s, d), f in pairs.items():
        freq[names[s], names[d]] = f
    wanted = ~np.eye(len(h), dtype=bool)
    loss, g = factorise.block_loss(h, q, freq, wanted)
    bumped = h.copy()
    bumped[3, 2] += 1e-6
    assert math.isclose((factorise.block_loss(bumped, q, freq, wanted)[0] - loss) / 1e-6, g[3, 2], rel_tol=1e-3)
    plain = factorise.block_loss(factorise.fit_block(h, q, freq, wanted, 6, 0.1), q, freq, wanted)[0]
    got = factorise.whole_loss(factorise.fit(start, state, 0.01, q, groups=4, epochs=6), state, 0.01, q)  # as often over all pairs
    assert got <= plain < loss - 100


def test_published_scores_have_their_published_auc(spark):
    path = os.path.join(os.path.dirname(__file__), "data", "published_scores.csv")
    rows = spark.read.csv(path, header=True, schema="set string, score double, label int")
    for name, auc in (("a", 0.759615), ("b", 0.823172)):
        got = evaluation.roc_auc(rows.where(F.col("set") == name)).first()
        assert abs(got.auc - auc) < 5e-7


def test_orders_over_any_column(spark):
    draw = __import__("random").Random(1)
    values = [draw.randrange(40) / 8 for _ in range(300)]
    df = spark.createDataFrame([(i, v, None if i % 3 else v) for i, v in enumerate(values)], "i long, v double, w double").repartition(5)
    held = ordering.in_order(df, "v", "i")
    numbered = {r.i: r.k for r in ordering.global_number(held, "k", "_m", ordering.RANGE).collect()}
    by = sorted(range(300), key=lambda i: (values[i], i))
    assert [numbered[i] for i in by] == list(range(1, 301))
    for backwards in (False, True):
        got = {r.i: r.x for r in ordering.global_last(held, {"x": "w"}, "_m", ordering.RANGE, backwards).collect()}
        last = None
        for i in reversed(by) if backwards else by:
            last = last if i % 3 else values[i]
            assert got[i] == last


def test_draws_and_samples(spark):
    from edgestream.functions import draws

    row = spark.range(1).select(draws.draw(3, F.lit("a"), F.lit(7)).alias("x"), draws.draw_int(3, F.lit("a"), F.lit(7)).alias("n")).first()
    import hashlib

    assert row.n == int(hashlib.md5(b"3-a-7").hexdigest()[:7], 16) and row.x == row.n / (1 << 28)
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 1.0)], "u string, v string, w double")
    queries = spark.range(4000).select(F.col("id").cast("string").alias("query"), F.lit("a").alias("node"), F.lit("z").alias("extra_v"), F.lit(4.0).alias("extra_w"))
    share = {r.other: r.n / 4000 for r in sampling.weighted_neighbours(e, queries).groupBy("other").agg(F.count("*").alias("n")).collect()}
    assert abs(share["b"] - 0.125) < 0.03 and abs(share["c"] - 0.375) < 0.03 and abs(share["z"] - 0.5) < 0.03
    walks = sampling.walks(e, spark.createDataFrame([("a",), ("c",), ("q",)], "node string"), 6, restart=0.5)
    assert all(len(r.path) == 7 for r in walks.where("start = 'a'").collect()) and all(set(r.path) == {r.start} for r in walks.where("start <> 'a'").collect())
    empty = e.limit(0)
    assert sampling.walks(empty, empty.select(F.col("u").alias("node")), 2).count() == 0
    assert sampling.negative_samples(empty, 2).count() == 0


def test_reservoirs_hold_a_uniform_neighbour(spark):
    rows = [(i, "hub", f"n{i % 10}") for i in range(10)]
    e = spark.createDataFrame(rows, "seq long, src string, dst string")
    held = sampling.neighbour_reservoirs(e, 3000).where("node = 'hub'").groupBy("other").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in held) == 3000 and len(held) == 10 and all(abs(r.n - 300) < 80 for r in held)


def test_shadow_mean_is_the_running_fold(spark):
    from edgestream.operators import learning

    values = [float(i * 7 % 13) for i in range(9000)]
    got = column(learning.shadow_mean(spark.createDataFrame(list(enumerate(values)), "seq long, x double"), "x"), "shadow")
    m = values[0]
    for x, g in zip(values, got, strict=True):
        m -= 0.01 * (m - x)
        assert abs(m - g) < 1e-9


def test_classifiers_beat_the_most_frequent_class(spark):
    from edgestream.operators import embedding, learning

    rows = [(i, [float(i % 3 == 0) + (i % 7) / 50, float(i % 3 == 1), (i % 5) / 50], i % 3) for i in range(300)]
    v = spark.createDataFrame(rows, "node long, x array<double>, label int")
    told = learning.class_predictions(v).collect()
    assert sum(r.label == r.predicted for r in told) == len(told) > sum(r.label == r.dummy for r in told)
    found, centres = embedding.kmeans(v, 3)
    assert found.join(v, "node").groupBy("label").agg(F.count_distinct("centre").alias("n")).where("n > 1").count() == 0 and centres.count() == 3


def test_node_sums_of_blocks_of_a_model_graph(spark):
    nodes = spark.range(10).select(F.col("id").cast("string").alias("node"), F.expr("id div 5").alias("block"))
    got = injection.block_model(nodes, 200, 0.5, 0.1).withColumn("same", F.expr("int(src) div 5 = int(dst) div 5"))
    share = {r.same: r.n for r in got.groupBy("same").agg(F.count("*").alias("n")).collect()}
    assert abs(share[True] / (20 * 200) - 0.5) < 0.05 and abs(share[False] / (25 * 200) - 0.1) < 0.03


def test_block_model_draws_in_many_tasks(spark):
    import hashlib

    held = [(str(k), k % 3 or None) for k in range(600)] + [("7", 2), (None, 1)]
    nodes = spark.createDataFrame(held, "node string, block int")
    got = injection.block_model(nodes, 2, 0.3, 0.05)
    drawn = lambda a, b, t: int(hashlib.md5(f"1-{a}-{b}-{t}".encode()).hexdigest()[:7], 16) / (1 << 28)
    known = [x for x in held if x[0] is not None]
    want = sorted((a, b, t) for a, p in known for b, q in known if a < b for t in (1, 2) if drawn(a, b, t) < (0.3 if p == q else 0.05))
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.src, r.dst, r.t) for r in rows) == want
    assert len({r.task for r in rows}) > 1  # the draws were one task's
    assert injection.block_model(nodes, 1, 1.0, 0.0).count() == sum(a < b and p == q for a, p in known for b, q in known)
    assert injection.block_model(nodes.limit(0), 2, 0.3, 0.05).count() == 0


def test_draws_as_arrays_are_the_digest_s(spark):
    import hashlib

    from edgestream.functions import draws

    random = np.random.default_rng(2)
    for p, q in ((0, 1), (3, 5), (10, 45), (10, 46), (55, 1), (64, 64), (1, 120)):  # up to and beyond a block
        firsts, lasts = ([random.bytes(size) for _ in range(n)] for size, n in ((p, 3), (q, 4)))
        want = [[int(hashlib.md5(a + b).hexdigest()[:7], 16) for b in lasts] for a in firsts]
        assert draws.draws_of(firsts, lasts).tolist() == want
    assert [draws.least(x) for x in (-1.0, 0.0, 0.5, 1.0, 2.0)] == [0, 0, 1 << 27, 1 << 28, 1 << 28]
    nodes = spark.createDataFrame([("é" * k, k % 2) for k in range(1, 40)], "node string, block int")  # lengths differ
    known = [(r.node, r.block) for r in nodes.collect()]
    drawn = lambda a, b, t: int(hashlib.md5(f"1-{a}-{b}-{t}".encode()).hexdigest()[:7], 16) / (1 << 28)
    want = sorted((a, b, t) for a, x in known for b, y in known if a < b for t in range(1, 12) if drawn(a, b, t) < (0.3 if x == y else 0.05))
    assert sorted((r.src, r.dst, r.t) for r in injection.block_model(nodes, 11, 0.3, 0.05).collect()) == want


def test_walk_vectors_and_spectral_clusters(spark):
    from edgestream.operators import learning

    inside = [(a, b) for block in (range(5), range(5, 10)) for a in block for b in block if a < b]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in inside] + [(4, 5, 0.01)], "u long, v long, w double")
    found = {r.node: r.cluster for r in learning.spectral_clusters(e, 2, 30).collect()}
    assert len(found) == 10 and len({found[k] for k in range(5)}) == 1 and len({found[k] for k in range(5, 10)}) == 1
    walked = sampling.walks(graphs.both_ways(e), spark.range(10).select(F.col("id").alias("node")), 6, per_start=4)
    vectors = learning.walk_vectors(walked, 8)
    assert {r.node for r in vectors.collect()} == {str(k) for k in range(10)} and all(len(r.x) == 8 for r in vectors.collect())


def test_spectral_clusters_are_found_by_joins(spark, monkeypatch):
    from pyspark.ml.clustering import PowerIterationClustering

    from edgestream.operators import learning

    def whole(*_args, **_named):
        raise AssertionError("the library holds the graph in memory")

    monkeypatch.setattr(PowerIterationClustering, "assignClusters", whole)
    inside = [(20 * b + i, 20 * b + j, 1.0) for b in range(3) for i in range(20) for j in range(i)]
    e = spark.createDataFrame([*inside, (7, 7, 5.0), (90, 90, 1.0)], "u long, v long, w double")  # loops count for nothing
    found = {r.node: r.cluster for r in learning.spectral_clusters(e, 3).collect()}
    assert len(found) == 60 and all(len({found[20 * b + i] for i in range(20)}) == 1 for b in range(3)) and len(set(found.values())) == 3
    assert learning.spectral_clusters(e.limit(0), 3).count() == 0


def test_walk_vectors_stay_out_of_the_driver(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    from edgestream.operators import learning

    def whole(*_args, **_named):
        raise AssertionError("the library holds all names and vectors in the driver")

    monkeypatch.setattr(Word2Vec, "fit", whole)
    paths = [[10 * b + (i + k * s) % 10 for k in range(5)] for b in range(2) for i in range(10) for s in (1, 3, 7)]
    walked = spark.createDataFrame([(p[0], k, p) for k, p in enumerate([*paths, [99]])], "start long, walk int, path array<long>")
    x = {r.node: np.array(r.x) for r in learning.walk_vectors(walked, 4).collect()}
    assert x.keys() == {*map(str, range(20)), "99"} and not x["99"].any()  # alone
    near = lambda a, b: x[str(a)] @ x[str(b)] / np.linalg.norm(x[str(a)]) / np.linalg.norm(x[str(b)])
    assert min(near(a, b) for a in range(10) for b in range(10)) > max(near(a, b) for a in range(10) for b in range(10, 20))
    assert {r.node for r in learning.walk_vectors(walked, 4, least=2).collect()} == {*map(str, range(20))}
    assert learning.walk_vectors(walked.limit(0), 4).count() == 0


def test_graph_predictions_use_the_neighbours(spark):
    from edgestream.operators import learning

    rows = [(i, [float(i % 2) if i < 200 else 0.5, 1.0], i % 2) for i in range(400)]  # the last half knows nothing of itself
    v = spark.createDataFrame(rows, "node long, x array<double>, label int")
    e = spark.createDataFrame([(i, (i + 200) % 400) for i in range(400)], "u long, v long")
    told = learning.graph_predictions(e, v).collect()
    assert sum(r.label == r.predicted for r in told) == len(told)


def test_line_numbers_over_part_files(spark, tmp_path):
    spark.range(5000).select(F.concat_ws(",", F.col("id").cast("string"), F.lit("1"), F.lit("2")).alias("v")).repartitionByRange(7, "id").write.text(f"{tmp_path}/a")
    spark.range(5000).selectExpr("cast(id % 2 as string) v").coalesce(1).write.text(f"{tmp_path}/b")
    got = readers.column_split_stream(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()
    assert len(got) == 5000 and all(r.seq == r.u and r.label == r.u % 2 for r in got)


def test_memory_model_learns_in_time_order_and_scores_frozen(spark):
    draw = np.random.default_rng(12)
    rows = [(1 + i // 20, f"n{draw.integers(6)}", f"m{draw.integers(5)}", 0) for i in range(240)]
    e = stream(spark, rows)
    w = memory_model.first_weights(3, 2)
    x, m = draw.normal(size=(5, 4)), draw.normal(size=(5, 3))
    new, loss, g = memory_model.loss_and_gradient(w, x, m, m.mean(axis=0))
    flat = w.flat()
    for k in range(0, len(flat), 5):
        up, down = flat.copy(), flat.copy()
        up[k], down[k] = up[k] + 1e-6, down[k] - 1e-6
        slope = (memory_model.loss_and_gradient(w.like(up), x, m, m.mean(axis=0))[1] - memory_model.loss_and_gradient(w.like(down), x, m, m.mean(axis=0))[1]) / 2e-6
        assert math.isclose(slope, g[k], rel_tol=1e-4, abs_tol=1e-6)
    # the frozen model by DataFrame functions equals a plain fold in time order
    nodes = sorted({n for r in rows for n in r[1:3]})
    h = {n: np.array([factorise.drawn(1, n, k) + 1e-9 for k in range(3)]) for n in nodes}
    state, want = {n: v / np.linalg.norm(v) for n, v in h.items()}, {}
    for b in range(4):
        met = {}
        for t, u, v, _ in rows:
            if (t - 1) // 3 == b:
                met.setdefault(u, []).append(v)
                met.setdefault(v, []).append(u)
        moved = {}
        for n, others in met.items():
            msg = np.array([*np.mean([state[o] for o in others], axis=0), math.log1p(len(others))])
            moved[n] = memory_model.loss_and_gradient(w, msg[None], state[n][None], np.zeros(3))[0][0]
            c = lambda p, q: p @ q / np.linalg.norm(p) / np.linalg.norm(q)
            want[b, n] = (2 - c(moved[n], state[n]) - c(moved[n], w.back @ msg)) / 4
        state |= moved
    got = {(r.batch, r.node): r.score for r in memory_model.drift_scores(e, w, 3).collect()}
    assert close(got, want)
    trained, losses = memory_model.train(e, 3, width=3, epochs=3, seed=2)
    assert losses[2] < losses[1] < losses[0] and not np.allclose(trained.flat(), flat)
    assert memory_model.drift_scores(e.limit(0), w, 3).count() == 0


def test_memories_are_not_broadcast(spark):
    links = ordering.cut_lineage(spark.createDataFrame([(f"n{k % 5}", f"n{k % 3}") for k in range(20)], "node string, other string"))
    state = ordering.cut_lineage(spark.createDataFrame([(f"n{k}", [1.0 * k, 2.0]) for k in range(6)], "node string, m array<double>"))
    for frame, n in ((memory_model.messages(links, state, 2), 5), (memory_model._kept(state, state.where("node < 'n2'")), 6)):
        assert len(frame.collect()) == n
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_temporal_attention_equals_a_plain_forward_pass(spark):
    draw = np.random.default_rng(14)
    rows = [(1 + i // 3, f"n{draw.integers(5)}", f"m{draw.integers(4)}", 0) for i in range(60)] + [(40, "late", "n0", 0)]
    e = stream(spark, rows)
    nodes = sorted({x for r in rows for x in r[1:3]})
    x = {k: draw.normal(size=3) for k in nodes}
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "node string, x array<double>")
    links = temporal.link_histories(e, 4)
    frequencies = temporal.fitted_frequencies(links, 3)
    assert frequencies == sorted(frequencies, reverse=True) and frequencies[0] <= 1
    layers = [temporal.first_layer(3, frequencies, 4, 1), temporal.first_layer(4, frequencies, 4, 2)]
    events = {}
    for seq, (t, u, v, _) in enumerate(rows):
        events.setdefault(u, []).append((t, seq, 0, v))
        events.setdefault(v, []).append((t, seq, 1, u))

    def embed(node, t, depth):
        if not depth:
            return x[node]
        w = layers[depth - 1]
        past = [(o, a) for a, _, _, o in sorted(events[node]) if a < t][-4:]
        if not past:
            return np.zeros(4)
        rows_ = np.array([np.concatenate([embed(o, a, depth - 1), np.cos((t - a) * w.frequencies)]) for o, a in past])
        q, k, v = w.query @ np.ones(3), rows_ @ w.key.T, rows_ @ w.value.T
        out = []
        for h in (slice(0, 2), slice(2, 4)):
            s = np.exp(k[:, h] @ q[h] / np.sqrt(2))
            out.append(s @ v[:, h] / s.sum())
        return w.out @ np.concatenate(out)

    got = {(r.node, r.clock, k): c for r in temporal.temporal_attention(e, vectors, layers, 4).collect() for k, c in enumerate(r.x)}
    want = {(n, t, k): c for n in nodes for t in {a for a, *_ in events[n]} for k, c in enumerate(embed(n, t, 2))}
    assert close(got, want) and all(got["late", 40, k] == 0.0 for k in range(4))


def test_attention_exchanges_a_moments_links_once(spark):
    e = stream(spark, [(k, f"a{k % 3}", f"b{k % 2}", 0) for k in range(1, 20)])
    histories = temporal.link_histories(e, 3)
    known = spark.createDataFrame([(f"a{k}", [float(k), 1.0]) for k in range(3)], "other string, x array<double>")  # none of b
    found = temporal.attended(histories, known, temporal.first_layer(2, [1.0, 0.1], 4, 1))
    rows = {(r.node, r.clock): r.x for r in found.collect()}
    assert rows.keys() == {(r.node, r.clock) for r in histories.collect()} and all(len(x) == 4 for x in rows.values())
    assert rows["a1", 1] == rows["a1", 19] == [0.0] * 4 and any(rows["b1", 19])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # there were four, and the links were worked on twice


def test_clique_vectors_learn_and_bring_cliques_together(spark):
    draw = np.random.default_rng(15)
    terms, walk = clique_model.Terms(), np.array([3, 3, 3, 4, 7, 7])
    code, out, others = draw.normal(size=(6, 4)), draw.normal(size=(6, 5)), draw.normal(size=(6, 2, 5))
    mean = np.full(4, 0.4)
    _, g_code, g_out, g_far = clique_model.loss_and_gradient(terms, mean, walk, code, out, others)
    rho, h = terms.activity, lambda c: clique_model.sigmoid(c)

    def plain(c, o, f):  # the sparse term by its slope at the fixed mean
        x = np.concatenate([h(c), np.ones((6, 1))], axis=1)
        fit = sum(np.log1p(np.exp(-x[i] @ o[i])) + sum(np.log1p(np.exp(x[i] @ f[i, k])) for k in range(2)) for i in range(6))
        pairs = sum(((h(c)[i] - h(c)[j]) ** 2).sum() for i in range(6) for j in range(i) if walk[i] == walk[j])
        return fit + terms.clique * pairs + terms.sparsity * (h(c) * ((1 - rho) / (1 - mean) - rho / mean)).sum()

    for array, g, place in ((code, g_code, (1, 2)), (code, g_code, (4, 0)), (out, g_out, (2, 4)), (others, g_far, (5, 1, 3))):
        values = []
        for sign in (1, -1):
            was = array[place]
            array[place] = was + sign * 1e-6
            values.append(plain(code, out, others))
            array[place] = was
        assert math.isclose((values[0] - values[1]) / 2e-6, g[place], rel_tol=1e-4, abs_tol=1e-6)
    walks = [(f"{side}{k}", w, [f"{side}{int(draw.integers(5))}" for _ in range(5)]) for side in "ab" for k in range(5) for w in range(4)] + [("a0", 9, ["a0", "b0"])]
    df = spark.createDataFrame(walks, "start string, walk int, path array<string>")
    found, losses = clique_model.clique_vectors(df, 4, 12, parts=3)
    x = {r.node: np.array(r.x) for r in found.collect()}
    assert len(x) == 10 and losses[-1] < losses[0] and all(((v > 0) & (v < 1)).all() for v in x.values())
    gap = lambda same: np.mean([((x[p] - x[q]) ** 2).sum() for p in x for q in x if p < q and (p[0] == q[0]) == same])
    assert gap(True) < gap(False) / 2
    again, more = clique_model.clique_vectors(df, 4, 2, parts=5)
    assert np.allclose(more, losses[:2])
    assert clique_model.clique_vectors(df.limit(0), 4, 2)[0].count() == 0


def plain_message_loss(model, edges, x, label, train):
    h, hs = x, [x]
    for layer in model.layers:
        p = (1 + layer.eps[0]) * h
        for u, v in edges:
            p[u] += h[v]
        z = np.maximum(p @ layer.first.T, 0) @ layer.second.T
        h = np.maximum(layer.scale * (z - z.mean(axis=0)) / np.sqrt(z.var(axis=0) + message_passing.SMALL) + layer.shift, 0)
        hs.append(h)
    logits = sum(a @ u.T for a, u in zip(hs, model.read, strict=True))
    logs = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return -logs[np.arange(len(x)), label][train].mean(), logits.argmax(axis=1)


def test_message_passing_has_the_plain_gradient_and_learns_from_neighbours(spark):
    draw = np.random.default_rng(16)
    bits = draw.integers(0, 2, 240)
    label = np.concatenate([bits[:120] ^ bits[120:], bits])  # of a centre: whether its two leaves differ, which no mean tells
    x = np.concatenate([np.tile([0.5, 0.0], (120, 1)), np.stack([bits, np.ones(240)], axis=1)])
    train = np.arange(360) % 3 > 0
    edges = [(c, leaf) for c in range(120) for leaf in (120 + c, 240 + c)]
    e = spark.createDataFrame(edges, "u long, v long")
    nodes = spark.createDataFrame([(i, x[i].tolist(), int(label[i]), bool(train[i])) for i in range(360)], "node long, x array<double>, label int, train boolean")
    model = message_passing.first_model(2, 2, 6, 2, 3)
    model.layers[1].eps[0] = 0.3
    loss, g = message_passing.loss_and_gradient(e, nodes, model)
    assert math.isclose(loss, plain_message_loss(model, edges, x.copy(), label, train)[0], rel_tol=1e-9)
    flat = model.flat()
    for k in range(0, len(flat), 9):
        up, down = flat.copy(), flat.copy()
        up[k], down[k] = up[k] + 1e-6, down[k] - 1e-6
        slope = (plain_message_loss(model.like(up), edges, x.copy(), label, train)[0] - plain_message_loss(model.like(down), edges, x.copy(), label, train)[0]) / 2e-6
        assert math.isclose(slope, g[k], rel_tol=1e-3, abs_tol=1e-6), k
    model, losses = message_passing.train(e, nodes, 2, 8, 1, 14, 0.1)
    told = {r.node: r.predicted for r in message_passing.predictions(e, nodes, model).collect()}
    right = np.mean([told[i] == label[i] for i in range(120) if not train[i]])
    from edgestream.operators import learning

    head = {r.node: r.predicted for r in learning.graph_predictions(e, nodes.where("train").select("node", "x", "label"), layers=1).collect()}
    assert losses[-1] < losses[0] / 2 and right > 0.9
    assert np.mean([head[i] == label[i] for i in head if i < 120]) < right  # even on what it has learned from


def test_heaps_blocks_and_numbers_equal_their_plain_forms(spark, monkeypatch):
    draw = np.random.default_rng(17)
    rows = [(int(t), f"a{k}", "b", 0) for k in range(6) for t in np.sort(draw.integers(1, 40, 1 + 4 * k))]
    series = {k: sorted(t for t, u, _, _ in rows if u == f"a{k}") for k in range(6)}
    thick, thin = set(), set()
    for k, ticks in series.items():
        now, left = list(ticks), list(ticks)
        for n in range(int(len(ticks) * 0.6)):
            if len(now) > 1:
                gaps = [b - a for a, b in zip(now, now[1:], strict=False)]
                at = gaps.index(max(gaps))
                now.insert(at + 1, now[at] + gaps[at] // 2)
                thick.add((f"a{k}", n, now[at + 1]))
            if len(left) > 1:
                gaps = [b - a for a, b in zip(left, left[1:], strict=False)]
                thin.add((f"a{k}", n, left.pop(gaps.index(min(gaps)) + 1)))
    told = lambda s: sorted((k, t) for k, _, t in s)
    assert sorted((r.src, r.t) for r in injection.densify(stream(spark, rows), 60).collect()) == told(thick)
    assert sorted((r.src, r.t) for r in injection.sparsify(stream(spark, rows), 60).collect()) == told(thin)
    monkeypatch.setattr(relational, "BLOCK", 2)
    left = spark.createDataFrame([("a",), ("b",), ("x",)], "node string")
    right = spark.createDataFrame([(c,) for c in "uvwxyz"], "node string")
    edges = spark.createDataFrame([("a", "u"), ("a", "z"), ("b", "q")], "src string, dst string")
    got = {(r.src, r.dst) for r in relational.complement_pairs(left, right, edges).collect()}
    assert got == {(a, b) for a in "abx" for b in "uvwxyz" if a != b} - {("a", "u"), ("a", "z")}
    matrix = relational.dense_adjacency(spark.createDataFrame([(1, 3), (3, 4), (0, 2), (2, 2)], "u long, v long"), 5)
    assert {r.u: r.row for r in matrix.collect()} == {1: [0, 0, 1, 0, 0], 2: [0, 1, 0, 0, 0], 3: [1, 0, 0, 1, 0], 4: [0, 0, 1, 0, 0], 5: [0] * 5}
    from edgestream.operators import learning

    folds = learning.stratified_folds(spark.createDataFrame([(i, None if i % 3 else 1) for i in range(30)], "seq long, label int"), 5)
    assert all(r.n == (4 if r.label is None else 2) for r in folds.groupBy("label", "fold").agg(F.count("*").alias("n")).collect())


def test_node_link_graphs_are_written_in_pieces(spark, tmp_path):
    links = spark.createDataFrame([("a", i, (i * 7 + 1) % 60) for i in range(60)] + [("b", 1, 2)], "graph string, source long, target long")
    ids = links.select("graph", F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = ids.select("graph", "id", F.array(F.col("id").cast("double")).alias("features"), F.lit(1).alias("label"), (F.col("id") % 7 == 0).alias("test"), F.lit(False).alias("val"), F.lit("ip").alias("ip"), F.lit("f").alias("flow_id"))
    held = [(r.graph, __import__("json").loads(r.value)) for r in writers.node_link_rows(nodes, links, 10).collect()]
    assert all(x["graph"]["timestamp"] == g and len(x["nodes"]) < 30 and len(x["links"]) < 30 for g, x in held) and len(held) > 5
    assert sorted((g, e["source"], e["target"]) for g, x in held for e in x["links"]) == sorted(map(tuple, links.collect()))
    writers.write_node_links(nodes, links, f"{tmp_path}/g")
    assert len([*tmp_path.glob("g/**/part-*")]) == 2  # a document for each graph, not one for all
    got, linked = readers.node_link_graphs(spark, f"{tmp_path}/g")
    assert {(r.graph, r.id) for r in got.collect()} == {(r.graph, r.id) for r in ids.collect()} and got.count() == ids.count()
    assert {(r.graph, r.source, r.target): r.train_removed for r in linked.collect()} == {(g, a, b): a % 7 == 0 or b % 7 == 0 for g, a, b in map(tuple, links.collect())}


def test_graph_blocks_are_written_by_graph_and_read_in_parts(spark, tmp_path):
    rows = [(g, k, g + k, [(k + 1) % (g + 2), (k + 2) % (g + 2)]) for g in (5, 9, 30) for k in range(g + 2)]
    nodes = spark.createDataFrame(rows, "graph long, node int, tag int, neighbours array<int>")
    writers.write_graph_text(nodes, nodes.select("graph", (F.col("graph") % 2).alias("label")).distinct(), f"{tmp_path}/g")
    assert len([*tmp_path.glob("g/**/part-*")]) == 3
    for most in (5, 1 << 14):
        got = readers.graph_blocks(spark, f"{tmp_path}/g", most)
        assert sorted((r.graph, r.label, r.node, r.tag, r.neighbours) for r in got.collect()) == [((5, 9, 30).index(g), g % 2, *rest) for g, *rest in rows]
    (tmp_path / "one.txt").write_text("2\n1 0\n4 0\n2 1\n3 1 1 0.5\n3 1 0\n")
    assert [tuple(r) for r in readers.graph_blocks(spark, f"{tmp_path}/one.txt").orderBy("graph", "node").collect()] == [(0, 0, 0, 4, [], []), (1, 1, 0, 3, [1], [0.5]), (1, 1, 1, 3, [0], [])]


def test_adjacency_lines_are_cut_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# a comment\n1 2 3\n\n 7  1 5 9 \n8\n")
    held = readers.adjacency_lists(spark, f"{tmp_path}/a.txt")
    assert sorted(map(tuple, held.collect())) == [(1, 2), (1, 3), (7, 1), (7, 5), (7, 9)]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan.split("Generate")[0]  # not once more for each neighbour
