"""Queries that run the streaming forms over files until they have read all of them, and further operators with SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.draws import draw_int_sql
from ..operators import clique_model as O
from ..operators import evaluation as M
from ..operators import factorise as Q
from ..operators import injection as I
from ..operators import learning as A
from ..operators import memory as N
from ..operators import memory_model as B
from ..operators import message_passing as Z
from ..operators import microcluster as C
from ..operators import relational as R
from ..operators import sequence as S
from ..operators import temporal as Y
from ..operators import walkscore as K
from ..streaming import engine, sketch
from ..streaming import walks as follow
from ..streaming.versions import Versions
from . import frames as T
from .catalog_files import _folder
from .catalog_formats import _MEMORIES, _MEMORY, _ONCE
from .catalog_graphs import _RESERVOIRS, _walked, pairs, rounded, vectors, walked
from .catalog_relational import _NORMAL, _VEC, _sketch, featured, li, nodes
from .catalog_sequence import _LOGS, _SPLICE, ev, halves, with_sql


def _run(stream, spark, mode: str):
    """The result of a stream over all files there are, as a table: each micro-batch replaces (complete) or adds (append) its part."""
    path = _folder(spark)

    def put(frame, number) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")


def _streamed(spark, df):
    """df as a stream of files."""
    path = _folder(spark)
    df.write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{path}/in")


def stamped(s, d):
    return ev(s, d).withColumns({"ts": F.timestamp_seconds(F.col("clock")), "stream_id": F.col("src")})


def stream_edges(s, d):
    path = _folder(s)
    ev(s, d).select(F.concat_ws(" ", F.col("t").cast("string"), "src", "dst", F.when(F.col("seq") % 5 != 0, F.col("label").cast("string"))).alias("value")).write.text(f"{path}/in")
    return _run(engine.edge_file_stream(s, f"{path}/in"), s, "append")


def stream_batches(s, d):
    """Micro-batches handed over one by one, each kept under its number."""
    path = _folder(s)
    source = _streamed(s, ev(s, d).select("seq", "t", "label"))

    def keep(frame, number) -> None:
        frame.groupBy("t").agg(F.sum("label").alias("attacks")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = engine.in_batches(source, keep, f"{path}/state")
    query.processAllAvailable()
    query.stop()
    return s.read.parquet(f"{path}/out").groupBy("t").agg(F.sum("attacks").alias("attacks"))


def sketched(s, d):
    """The sketch scores of the events as a stream of two runs: the second one begins with what the first has left."""
    path = _folder(s)
    rows = ev(s, d).select("seq", "t", F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    middle = rows.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0] or 0
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        sketch.sketch_stream(s.readStream.schema(rows.schema).parquet(f"{path}/in"), path, fade=0.5).awaitTermination()
    return s.read.schema("seq long, score double").parquet(f"{path}/out/*").select("seq", F.round("score", 5).alias("score"))


def paired(s, d):
    """The microcluster scores of the events as a stream, with exact counts."""
    path = _folder(s)
    engine.microcluster_stream(_streamed(s, ev(s, d).select("seq", "t", "src", "dst")), path).awaitTermination()
    return s.read.schema("seq long, score double").parquet(f"{path}/out/*").select("seq", F.round("score", 6).alias("score"))


def followed(s, d):
    """The state of the walks and reservoirs after the events as a stream of two runs."""
    path = _folder(s)
    rows = ev(s, d).select("seq", "src", "dst")
    middle = rows.agg(F.expr("(min(seq) + max(seq)) div 2")).first()[0] or 0
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        rows.where(part).write.mode("append").parquet(f"{path}/in")
        follow.walk_stream(s.readStream.schema(rows.schema).parquet(f"{path}/in"), path).awaitTermination()
    return Versions(s, f"{path}/state", {"slots": follow.SLOTS, "walks": follow.WALKS}).before()


def trained_memory(s, d):
    """Drift of every node and batch of five days, by a model trained on the first 70 % of the ticks."""
    edges = ev(s, d)
    cut = edges.agg(F.expr("min(t) + (max(t) - min(t)) * 7 div 10")).first()[0] or 0
    weights, _ = B.train(edges.where(F.col("t") <= cut), 120)
    return B.drift_scores(edges, weights, 120).select("batch", "node", F.round("score", 6).alias("score"))


def attended(s, d):
    """Nodes at the times of their links through two hops of attention, by seeded vectors and weights and a time code fitted to the stream."""
    edges = ev(s, d)
    codes = Y.fitted_frequencies(Y.link_histories(edges, 5), 4)
    layers = [Y.first_layer(4, codes, 4, 1), Y.first_layer(4, codes, 4, 2)]
    known = Q.first_vectors(R.node_set(edges), 4).withColumnRenamed("h", "x")
    return Y.temporal_attention(edges, known, layers, 5).select("node", "clock", rounded("x"))


def passed(s, d):
    """Classes of the vectors by trained message passing over their pairs; a digest of the node says which ones train."""
    held = vectors(s, d).select("node", "x", "label", (F.pmod(F.xxhash64("node"), F.lit(10)) < 7).alias("train"))
    model, _ = Z.train(pairs(s, d), held, 10, layers=1, epochs=6)
    return Z.predictions(pairs(s, d), held, model).join(held, "node").select("node", "label", "train", "predicted")


def grid(s, d):
    """The AUC of the relational scores for a few decays."""
    out = None
    for fade in (0.25, 0.5):
        one = M.roc_auc(C.relational(ev(s, d), fade).withColumn("score", F.round("score", 6))).select(F.lit(fade).alias("fade"), F.round("auc", 5).alias("auc"))
        out = one if out is None else out.unionAll(one)
    return out


def at_percentile(s, d):
    """The attack log behind the gap nearest to a quarter of the benign log; at its end, without a clock, if there is no gap."""
    benign, bad = halves(s, d)
    target = benign.agg(F.floor(0.25 * F.count("*")).alias("target"))
    place = R.nearest(S.gap_rows(benign, "before", 900).select(F.col("seq").alias("position")), target).first()
    return I.into_gap(benign, bad, place and place.position).select("seq", "clock", "path", "label")


GATE = [[round(math.sin(7 * r + k), 3) for k in range(4)] for r in range(4)]
GATES = [([[g[k] + 0.1 * n for k in range(4)] for g in GATE], [[g[k] - 0.1 * n for k in range(4)] for g in GATE]) for n in range(3)]


def gated(s, d):
    """All values of the vectors, four at a time by the same gates."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.expr("size(x) div 4 - 1")), lambda k: F.slice(x, k * 4 + 1, F.lit(4)))
    held = vectors(s, d).select("node", F.posexplode(cut(F.col("x"))).alias("part", "p"))
    left, right = held.withColumnRenamed("node", "u"), held.select(F.col("node").alias("v"), "part", F.col("p").alias("q"))
    return pairs(s, d).join(left, "u").join(right, ["v", "part"]).select("u", "part", A.gru(F.col("p"), F.col("q"), *GATES).alias("x")).select("u", "part", rounded("x"))


def by_day(s, d):
    """A run of its own for each day: scorers with one state a stream run in parallel."""
    return ev(s, d).withColumn("stream_id", F.expr("(t - 1) div 24"))


def stamped_log(s, d):
    return ev(s, d).select("seq", "src", "dst", F.concat(F.lit("day "), F.expr("(t - 1) div 24").cast("string")).alias("stamp"), F.when(F.col("label") == 1, "attack").otherwise("-").alias("token"))


QUERIES = {
    "stream_edges": stream_edges,
    "stream_tumbling_counts": lambda s, d: _run(engine.tumbling_counts(_streamed(s, stamped(s, d).select("ts", "label")), "ts", "1 hour", "10 minutes"), s, "complete").select(F.unix_timestamp("start").alias("start"), "n", "attacks"),
    "stream_session_counts": lambda s, d: _run(engine.session_counts(_streamed(s, stamped(s, d).select("ts", "stream_id")), "ts", "10 minutes", "7200 seconds"), s, "complete").select("stream_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n"),
    "stream_microcluster": paired,
    "stream_sketch_scores": sketched,
    "stream_reservoirs": lambda s, d: followed(s, d)["slots"],
    "stream_walks": lambda s, d: followed(s, d)["walks"],
    "memory_model_scores": trained_memory,
    "temporal_attention": attended,
    "stream_batches": stream_batches,
    "microcluster_grid": grid,
    "percentile_injection": at_percentile,
    "even_ticks": lambda s, d: I.even_ticks(ev(s, d), 13, 10),
    "densify": lambda s, d: I.densify(ev(s, d), 60),
    "sparsify": lambda s, d: I.sparsify(ev(s, d), 60),
    "gated_update": gated,
    "coded_log": lambda s, d: S.coded_log(stamped_log(s, d)),
    "snapshot_schedule": lambda s, d: S.snapshot_schedule(ev(s, d).select("seq"), 0.3, 500),
    "pool_queries": lambda s, d: R.pool_queries(ev(s, d).select(F.col("dst").alias("node")), nodes(s, d).select(F.col("node").alias("query"))),
    "message_passing_classes": passed,
    "graph_predictions": lambda s, d: A.graph_predictions(pairs(s, d), vectors(s, d)),
    "clique_vectors": lambda s, d: O.clique_vectors(walked(s, d, per_start=3))[0].select("node", rounded("x")),
    "walk_vectors": lambda s, d: A.walk_vectors(walked(s, d, per_start=5)),
    "spectral_clusters": lambda s, d: A.spectral_clusters(li(s, d).groupBy("u", (F.col("v") + 1_000_000_000).alias("v")).agg(F.count("*").alias("w")), 4),
    "node_drift": lambda s, d: N.node_drift(featured(s, d), by_day(s, d).withColumn("t", F.col("stream_id"))).select("node", "t", F.round("score", 5).alias("score")),
    "first_rows": lambda s, d: R.first_rows(ev(s, d).select("src", "seq", "dst", "t"), "src"),
    "padded_groups": lambda s, d: S.padded_groups(ev(s, d), "src", 300),
    "bridge_score_by_day": lambda s, d: K.bridge_scores(by_day(s, d), sample=100),
    "frequency_factor_by_day": lambda s, d: Q.fold_factor_scores(by_day(s, d), setup=6, every=6),
    "walk_lengths": lambda s, d: walked(s, d, 8, stop=0.3, per_start=2).groupBy(F.size("path").alias("length")).agg(F.count("*").alias("n")),
}


def _relational_sql(fade: float) -> str:
    from .catalog_relational import _CHI, _relational_key

    keys = (("e", "(evj.src || ',' || evj.dst)"), ("u", "evj.src"), ("d", "evj.dst"))
    held = "".join(_relational_key(n, k).replace("pow(0.5,", f"pow({fade},") for n, k in keys)
    return f", tj AS (SELECT t, row_number() OVER (ORDER BY t) AS j FROM (SELECT DISTINCT t FROM ev)), evj AS (SELECT ev.*, j FROM ev JOIN tj USING (t)){held}, sc AS (SELECT ev.label, round(greatest({_CHI.format('es')}, {_CHI.format('us')}, {_CHI.format('ds')}), 6) AS score FROM ev JOIN es ON es.seq = ev.seq JOIN us ON us.seq = ev.seq JOIN ds ON ds.seq = ev.seq)"


_AUC = ", r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM sc) SELECT {fade}::DOUBLE AS fade, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 5) AS auc FROM r"
_GAP = "(SELECT position FROM (SELECT seq AS position FROM (SELECT seq, lead(clock) OVER (ORDER BY seq) - clock AS gap FROM benign) WHERE gap >= 900) ORDER BY abs(position - (SELECT count(*) // 4 FROM benign)), position DESC LIMIT 1)"
_TICKS = ", p AS (SELECT src, dst, list_sort(list(t)) AS ts, CAST(floor(count(*) * 60 / 100.0) AS INT) AS todo FROM ev GROUP BY src, dst)"
_GAPS = "list_transform(range(1, len(ts)), lambda i: ts[i + 1] - ts[i])"


def _gru_sql() -> str:
    (zx, zh), (rx, rh), (nx, nh) = GATES
    row = lambda c, w: "(" + " + ".join(f"{c}[{k + 1}] * ({w[k]})" for k in range(4)) + ")"
    sig = lambda v: f"(1 / (1 + exp(-({v}))))"
    cells = []
    for k in range(4):
        z, r = sig(f"{row('p', zx[k])} + {row('q', zh[k])}"), sig(f"{row('p', rx[k])} + {row('q', rh[k])}")
        cells.append(f"round((1 - {z}) * tanh({row('p', nx[k])} + {r} * {row('q', nh[k])}) + {z} * q[{k + 1}], 5) + 0.0")
    slices = "SELECT node, CAST(part AS INTEGER) AS part, x[4 * part + 1 : 4 * part + 4] AS {0} FROM (SELECT node, x, unnest(range(len(x) // 4)) AS part FROM v)"
    return f"WITH {_VEC} SELECT a.node AS u, a.part, [{', '.join(cells)}] AS x FROM ({slices.format('p')}) a JOIN ({slices.format('q')}) b ON b.node = a.node + 1 AND a.part = b.part"


SQL = {
    "stream_edges": with_sql("SELECT t, src, dst, CASE WHEN seq % 5 <> 0 THEN label ELSE 0 END AS label FROM ev"),
    "stream_tumbling_counts": with_sql("SELECT clock // 3600 * 3600 AS start, count(*) AS n, CAST(sum(label) AS BIGINT) AS attacks FROM ev GROUP BY 1"),
    "stream_session_counts": with_sql(", o AS (SELECT src, clock, CASE WHEN clock - lag(clock) OVER (PARTITION BY src ORDER BY clock) <= 7200 THEN 0 ELSE 1 END AS fresh FROM ev), g AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY clock ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT src AS stream_id, min(clock) AS start, max(clock) + 7200 AS \"end\", count(*) AS n FROM g GROUP BY src, k"),
    "stream_microcluster": with_sql(f"{_NORMAL} SELECT seq, score FROM sc"),
    "stream_sketch_scores": with_sql(_sketch()),
    "stream_reservoirs": with_sql(_RESERVOIRS + " SELECT * FROM rs"),
    "stream_walks": with_sql(_RESERVOIRS + ", w0 AS (SELECT DISTINCT node AS start, 0 AS walk, [node] AS path FROM rs)" + "".join(f", w{k + 1} AS (SELECT start, walk, list_append(path, other) AS path FROM w{k} JOIN rs ON node = path[-1] AND slot = {draw_int_sql(1, 'start', 'walk', str(k))} % 4)" for k in range(4)) + " SELECT * FROM w4"),
    "stream_batches": with_sql("SELECT t, CAST(sum(label) AS BIGINT) AS attacks FROM ev GROUP BY t"),
    "microcluster_grid": " UNION ALL ".join(f"(WITH {T.EV}{_relational_sql(f)}{_AUC.format(fade=f)})" for f in (0.25, 0.5)),
    "percentile_injection": with_sql(_LOGS + f", spot AS (SELECT {_GAP} AS s)" + _SPLICE.replace("100, 1, seq", "(SELECT s FROM spot), 1, seq").format(clock="clock - (SELECT min(clock) FROM bad) + (SELECT clock FROM benign WHERE seq = (SELECT s FROM spot)) + 1") + " SELECT * FROM ordered"),
    "even_ticks": with_sql("SELECT 10 + k * (z - 10) // 13 AS t FROM (SELECT max(t) AS z FROM ev), (SELECT unnest(range(13)) AS k)"),
    "densify": f"WITH RECURSIVE {T.EV}{_TICKS}, g AS (SELECT src, dst, ts, todo, CAST(NULL AS BIGINT) AS t FROM p UNION ALL SELECT src, dst, list_concat(ts[:k], [m], ts[k + 1:]), todo - 1, m FROM (SELECT *, ts[k] + ({_GAPS})[k] // 2 AS m FROM (SELECT src, dst, ts, todo, list_position({_GAPS}, list_max({_GAPS})) AS k FROM g WHERE todo > 0 AND len(ts) > 1))) SELECT src, dst, t FROM g WHERE t IS NOT NULL",
    "sparsify": f"WITH RECURSIVE {T.EV}{_TICKS}, g AS (SELECT src, dst, ts, todo, CAST(NULL AS BIGINT) AS t FROM p UNION ALL SELECT src, dst, list_concat(ts[:k], ts[k + 2:]), todo - 1, ts[k + 1] FROM (SELECT src, dst, ts, todo, list_position({_GAPS}, list_min({_GAPS})) AS k FROM g WHERE todo > 0 AND len(ts) > 1)) SELECT src, dst, t FROM g WHERE t IS NOT NULL",
    "gated_update": _gru_sql(),
    "coded_log": with_sql(", ends AS (SELECT src AS node, seq AS p FROM ev UNION ALL SELECT dst, seq + 1 + (SELECT max(seq) FROM ev) FROM ev), ids AS (SELECT node, row_number() OVER (ORDER BY min(p)) - 1 AS id FROM ends GROUP BY node), st AS (SELECT stamp, row_number() OVER (ORDER BY stamp) AS t FROM (SELECT DISTINCT 'day ' || ((t - 1) // 24) AS stamp FROM ev)) SELECT seq, a.id AS u, b.id AS v, st.t, label FROM ev JOIN ids a ON a.node = src JOIN ids b ON b.node = dst JOIN st ON stamp = 'day ' || ((ev.t - 1) // 24)"),
    "snapshot_schedule": with_sql(", k AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k, CAST(floor(count(*) OVER () * 0.3::DOUBLE) AS BIGINT) AS f FROM ev) SELECT seq, CASE WHEN k < f THEN 0 ELSE (k - f) // 500 + 1 END AS snapshot FROM k"),
    "walk_lengths": _walked(8, stop=0.3, per_start=2) + " SELECT len(path) AS length, count(*) AS n FROM w8 GROUP BY len(path)",
    "node_drift": f"""{_MEMORY}{_ONCE}{_MEMORIES}, dy AS (SELECT seq, (t - 1) // 24 AS t, src, dst FROM ev),
l AS (SELECT m.node, dy.t, m0, m1, m2 FROM m JOIN dy ON dy.seq = m.seq QUALIFY row_number() OVER (PARTITION BY m.node, dy.t ORDER BY m.seq DESC, m.e DESC) = 1),
h AS (SELECT node, t, [m0, m1, m2] AS m, lag([m0, m1, m2]) OVER (PARTITION BY node ORDER BY t) AS b FROM l),
mt AS (SELECT t, src AS node, dst AS other FROM dy UNION SELECT t, dst, src FROM dy),
r AS (SELECT mt.node, mt.t, [avg(m0), avg(m1), avg(m2)] AS r FROM mt JOIN l ON l.t = mt.t AND l.node = mt.other GROUP BY ALL)
SELECT h.node, h.t, round((2 - list_cosine_similarity(m, b) - list_cosine_similarity(m, r)) / 4, 5) AS score FROM h JOIN r ON r.node = h.node AND r.t = h.t WHERE b IS NOT NULL""",
    "first_rows": with_sql("SELECT src, min(seq) AS seq, min_by(dst, seq) AS dst, min_by(t, seq) AS t FROM ev GROUP BY src"),
    "padded_groups": with_sql(", k AS (SELECT src, seq, (row_number() OVER (ORDER BY seq) - 1) // 300 AS batch FROM ev), l AS (SELECT batch, list(src ORDER BY seq) AS m FROM k GROUP BY batch) SELECT batch, list_concat(m, list_transform(range(300 - len(m)), lambda i: CAST(NULL AS VARCHAR))) AS members FROM l"),
    "pool_queries": with_sql("SELECT query, node FROM (SELECT DISTINCT src AS query FROM ev WHERE label = 1), (SELECT DISTINCT dst AS node FROM ev)"),
}
