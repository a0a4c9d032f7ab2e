"""Queries of joins, sets, aggregates, measures and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import embedding as E
from ..operators import evaluation as M
from ..operators import factorise as Q
from ..operators import graphs as G
from ..operators import linkstream as L
from ..operators import memory as N
from ..operators import microcluster as C
from ..operators import relational as R
from ..operators import sequence as S
from ..operators import walkscore as W
from . import frames as T
from .catalog_sequence import _r, ev, with_sql

SKETCH = [(16807, 11), (48271, 7), (69621, 3)]
COLUMNS = 2719


def nodes(s, d):
    return ev(s, d).where("label = 1").select(F.col("src").alias("node")).distinct()


def few_nodes(s, d):
    return ev(s, d).where("t <= 24").select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def marks(s, d):
    length = ev(s, d).agg(F.count("*").alias("n")).where("n > 0")
    return length.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(250).cast("long"))).alias("target"))


def scored(s, d):
    return C.normal(ev(s, d)).withColumn("score", F.round("score", 6))


def li(s, d):
    return T.lineitem_edges(s, d)


def vectors(s, d):
    return T.table(s, d, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label")


def pairs(s, d):
    held = vectors(s, d)
    return held.select(F.col("node").alias("u"), (F.col("node") + 1).alias("v"))


def rounded(name, digits=5):
    """All of an array column's values."""
    return F.transform(name, lambda x: F.round(x, digits) + 0.0).alias(name)


def single(c):
    """A double in single precision: unlike decimal digits, its steps do not meet the decimal values of the inputs halfway."""
    return c.cast("float").cast("double") + 0.0


def encoded(kind):
    return lambda s, d: E.encoded_edges(pairs(s, d), vectors(s, d), kind).select("u", "v", rounded("code"))


def featured(s, d):
    held = S.features(ev(s, d), F.col("label"))
    return held.select("seq", "src", "dst", "f")


def supplier_parts(s, d):
    return li(s, d).select(F.concat(F.lit("s"), F.col("u").cast("string")).alias("u"), F.concat(F.lit("p"), F.col("v").cast("string")).alias("v"))


def ranked(weighted):
    def run(s, d):
        e = supplier_parts(s, d)
        e = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("w", F.lit(1.0))
        return G.pagerank(e, e.select(F.col("u").alias("node")), weighted).select("node", *_r("rank"))

    return run


def derivative(s, d):
    e = ev(s, d).withColumn("t", F.expr("(t - 1) div 24"))
    return G.derivative_scores(G.both_snapshot_pageranks(e)).select("t", F.round("score", 4).alias("score"))


QUERIES = {
    "edge_totals": lambda s, d: R.edge_totals(ev(s, d)),
    "activity_series": lambda s, d: R.activity(ev(s, d)),
    "stream_stats": lambda s, d: R.stream_stats(ev(s, d)),
    "empty_slices": lambda s, d: R.empty_slices(ev(s, d).withColumn("t", F.expr("clock div 60"))),
    "link_stream_set": lambda s, d: R.link_stream(ev(s, d).withColumn("weight", F.col("seq").cast("double"))),
    "edge_time_series": lambda s, d: R.time_series_view(ev(s, d)),
    "node_set": lambda s, d: R.node_set(ev(s, d)),
    "subset_nodes": lambda s, d: R.subset_nodes(ev(s, d), few_nodes(s, d)).select("seq"),
    "subset_bipartite": lambda s, d: R.subset_bipartite(ev(s, d), nodes(s, d), few_nodes(s, d)).select("seq"),
    "subset_edges": lambda s, d: R.restrict_to_pairs(ev(s, d), R.malicious_pairs(ev(s, d))).select("seq"),
    "subset_time": lambda s, d: R.subset_time(ev(s, d), 10, 50).select("seq"),
    "malicious_pairs": lambda s, d: R.malicious_pairs(ev(s, d)),
    "malicious_gt": lambda s, d: R.restrict_to_pairs(ev(s, d), R.malicious_pairs(ev(s, d))).select("src", "dst", "t", "label"),
    "fake_edges_anti": lambda s, d: R.absent_pairs(li(s, d).select(F.col("u"), (F.col("v") + 1).alias("v")).distinct(), li(s, d), ["u", "v"]),
    "past_neighbours_only": lambda s, d: R.past_minus_present(ev(s, d), 100),
    "spine_labels": lambda s, d: R.spine_labels(ev(s, d).where("label = 1"), ev(s, d)),
    "score_label_join": lambda s, d: R.join_scores(scored(s, d).select("seq", "score"), ev(s, d).select("seq", "label"), ["seq"]),
    "snapshot_fill_labels": lambda s, d: R.fill_missing_labels(R.activity(ev(s, d)), R.bin_attack_label(ev(s, d).where("label = 1"), 3).select("t", "label"), ["t"]),
    "recent_neighbours": lambda s, d: R.recent_neighbours(ev(s, d), 5).select("seq", "neighbours"),
    "nearest_gap": lambda s, d: R.nearest(S.gap_rows(ev(s, d), "before", 900).select(F.col("seq").alias("position")), marks(s, d)),
    "delta_counts": lambda s, d: R.delta_counts(ev(s, d)),
    "frequency_decay": lambda s, d: R.frequency_with_decay(R.delta_counts(ev(s, d)), 0.99).select("src", "dst", *_r("f")),
    "top_frequencies": lambda s, d: R.top_frequencies(R.frequency_with_decay(R.delta_counts(ev(s, d)), 0.99).withColumn("f", F.round("f", 9)), 100).select("src", "dst", *_r("f")),
    "degree_stats": lambda s, d: R.degree_stats(ev(s, d)).select(*_r("mean_degree", "std_degree")),
    "microcluster_normal": lambda s, d: scored(s, d),
    "microcluster_relational": lambda s, d: C.relational(ev(s, d)).select("seq", "t", "label", F.round("score", 5).alias("score")),
    "microcluster_filtering": lambda s, d: C.filtering(ev(s, d), 1e3).select("seq", "t", "label", F.round("score", 6).alias("score")),
    "snapshot_rollup_max": lambda s, d: R.snapshot_rollup(scored(s, d), "max"),
    "snapshot_rollup_mean": lambda s, d: R.snapshot_rollup(C.normal(ev(s, d)), "mean").select("t", "attack", F.round("score", 5).alias("score")),
    "snapshot_rollup_sum": lambda s, d: R.snapshot_rollup(scored(s, d), "sum").select("t", "attack", F.round("score", 6).alias("score")),
    "bin_attack_label": lambda s, d: R.bin_attack_label(ev(s, d), 5),
    "roc_auc": lambda s, d: M.roc_auc(scored(s, d)).select(*_r("auc", "best_auc")),
    "roc_points": lambda s, d: M.roc_points(scored(s, d)).select("score", *_r("fpr", "tpr")),
    "pr_curve": lambda s, d: M.pr_curve(scored(s, d)).select("score", *_r("precision", "recall")),
    "average_precision": lambda s, d: M.average_precision(scored(s, d)).select(*_r("ap", "pr_auc")),
    "best_f1": lambda s, d: M.best_f1(scored(s, d)).select("threshold", *_r("f1")),
    "topk_precision_recall": lambda s, d: M.top_k(scored(s, d), list(range(50, 801, 50))).select("k", *_r("precision", "recall", "f1", "fpr")),
    "classification_f1": lambda s, d: M.classification(ev(s, d).select("label", (F.col("dst") < "5").cast("int").alias("predicted"))).select(*_r("accuracy", "micro_f1", "macro_f1", "weighted_f1")),
    "mean_reciprocal_rank": lambda s, d: R.reciprocal_rank(scored(s, d).withColumn("positive", F.col("seq") % 97 == 3), "t").select(*_r("mrr")),
    "hourly_snapshots": lambda s, d: G.hourly_snapshots(ev(s, d), 3600),
    "adjacency_lists": lambda s, d: G.adjacency(li(s, d).select((F.col("u") + 1000000).alias("u"), "v")),
    "degree": lambda s, d: G.degrees(li(s, d)),
    "undirected_clean": lambda s, d: G.undirected(li(s, d)),
    "cumulative_adjacency": lambda s, d: G.cumulative_adjacency(ev(s, d)),
    "pagerank_v1": ranked(False),
    "pagerank_v2": ranked(True),
    "derivative_scores": derivative,
    "edge_link_score": lambda s, d: L.edge_scores(ev(s, d), R.malicious_pairs(ev(s, d)), 20, 300).select("src", "dst", "t", *_r("score")),
    "edge_link_score_active": lambda s, d: L.edge_scores(ev(s, d), R.malicious_pairs(ev(s, d)), 200, 30, True).select("src", "dst", "t", *_r("score")),
    "node_link_score": lambda s, d: L.node_scores(ev(s, d), nodes(s, d), 20, 100).select("node", "t", *_r("score")),
    "graph_link_score": lambda s, d: L.graph_scores(ev(s, d), 10, 100).select("t", *_r("score")),
    "edge_encoding_hadamard": encoded("hadamard"),
    "edge_encoding_average": encoded("average"),
    "edge_encoding_l1": encoded("l1"),
    "edge_encoding_l2": encoded("l2"),
    "cosine": lambda s, d: E.encoded_edges(pairs(s, d), vectors(s, d)).select("u", "v").join(vectors(s, d).select(F.col("node").alias("u"), F.col("x").alias("p")), "u").join(vectors(s, d).select(F.col("node").alias("v"), F.col("x").alias("q")), "v").select("u", "v", F.round(V.cosine(F.col("p"), F.col("q")), 5).alias("cosine")),
    "haar": lambda s, d: vectors(s, d).select("node", F.posexplode(V.haar(F.col("x"), 64)).alias("k", "c")).select("node", "k", (F.round("c", 5) + 0.0).alias("c")),
    "nearest_centroid": lambda s, d: E.nearest_centre(vectors(s, d), E.class_centres(vectors(s, d))).select("node", "centre", F.round("distance", 5).alias("distance")),
    "neighbour_mean": lambda s, d: E.aggregate_neighbours(pairs(s, d), vectors(s, d)).select("node", rounded("x")),
    "gin_aggregate": lambda s, d: E.gin_aggregate(pairs(s, d), vectors(s, d)).select("node", rounded("x")),
    "online_centroid_update": lambda s, d: moved(s, d),
    "node_memory_ema": lambda s, d: N.memories(featured(s, d)).select("node", "seq", "end", F.transform("memory", single).alias("memory")),
    "edge_memory_score": lambda s, d: N.edge_scores(featured(s, d)).select("seq", F.round(single(F.col("score")), 9).alias("score")),
    "window_memory_score": lambda s, d: N.window_scores(S.sliding_windows(featured(s, d), 800, 400)).select("window", F.round("score", 5).alias("score")),
    "zscore_online": lambda s, d: N.z_scores(transitions(s, d), 1.5),
    "cms_estimates": lambda s, d: C.sketch_estimates(li(s, d), SKETCH, COLUMNS),
    "sketch_scores": lambda s, d: C.sketch_scores(ev(s, d).select("seq", "t", F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"), F.lit(0).alias("stream_id")), fade=0.5).select("seq", F.round("score", 5).alias("score")),
    "reservoir_sample": lambda s, d: G.reservoir(ev(s, d), 200).select("seq", "src", "dst"),
    "fixed_fanout": lambda s, d: G.fixed_fanout(li(s, d), 8),
    "bridge_score": lambda s, d: W.bridge_scores(ev(s, d).withColumn("stream_id", F.lit(0))),
    "bridge_score_sampled": lambda s, d: W.bridge_scores(ev(s, d).withColumn("stream_id", F.lit(0)), walks=50),
    "frequency_factor": lambda s, d: Q.factor_scores(ev(s, d), most=1000, setup=168, every=168),
}


def transitions(s, d):
    log = S.transition_edges(T.events_paths(s, d), "row")
    from pyspark.sql import Window

    gap = F.col("clock") - F.lag("clock").over(Window.partitionBy("stream_id").orderBy("seq"))
    return log.select("stream_id", "seq", (F.col("src") == F.col("dst")).alias("idle"), F.length("dst").cast("double").alias("depth_delta"), F.coalesce(gap, F.lit(0)).cast("double").alias("time_delta"))


def moved(s, d):
    v = vectors(s, d)
    a, b = E.class_centres(v.where("node % 2 = 0")), E.class_centres(v.where("node % 2 = 1")).withColumnsRenamed({"centre": "c2", "n": "n2"})
    return a.join(b, "label").select("label", E.moved_centre(F.col("centre"), F.col("n"), F.col("c2"), F.col("n2"), 0.7).alias("x")).select("label", rounded("x"))


_NORMAL = ", n AS (SELECT seq, t, label, count(*) OVER (PARTITION BY src, dst ORDER BY seq) AS s, count(*) OVER (PARTITION BY src, dst, t ORDER BY seq) AS a FROM ev), sc AS (SELECT seq, t, label, round(CASE WHEN t <= 1 THEN 0.0 ELSE pow((a - s / t) * t, 2) / (s * (t - 1)) END, 6) AS score FROM n)"
_RAW = _NORMAL.replace("round(CASE", "(CASE").replace(", 6) AS score", ") AS score")
_CUM = _NORMAL + ", g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM sc GROUP BY score), c AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS ap, sum(q) OVER () AS an FROM g WINDOW w AS (ORDER BY score DESC)), pr AS (SELECT score, tp / (tp + fp) AS precision, tp / ap AS recall, fp / an AS fpr FROM c)"
_FEW = ", few AS (SELECT src AS node FROM ev WHERE t <= 24 UNION SELECT dst FROM ev WHERE t <= 24), badn AS (SELECT DISTINCT src AS node FROM ev WHERE label = 1), badp AS (SELECT DISTINCT src, dst FROM ev WHERE label = 1)"
_VEC = "v AS (SELECT vec_id AS node, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, label FROM embeddings)"
_PAIR = f"WITH {_VEC}, e AS (SELECT a.node AS u, b.node AS v, a.x AS p, b.x AS q FROM v a JOIN v b ON b.node = a.node + 1)"


def _encoding(f: str) -> str:
    return _PAIR + f", c AS (SELECT u, v, list_transform(range(1, len(p) + 1), lambda i: {f}) AS c FROM e) SELECT u, v, list_transform(c, lambda x: round(x, 5) + 0.0) AS code FROM c"


def _pagerank(weighted: bool, rounds: int = 10) -> str:
    share = "w / sum(w) OVER (PARTITION BY u)" if weighted else "1.0 / count(*) OVER (PARTITION BY u)"
    start = "SELECT u AS node, 0.5 * sum(w) / (SELECT sum(w) FROM m) AS mass FROM m GROUP BY u" if weighted else "SELECT u AS node, 0.5 / (SELECT count(DISTINCT u) FROM m) AS mass FROM m GROUP BY u"
    steps = "".join(f", f{k + 1} AS (SELECT v AS node, sum(0.5 * mass * share) AS mass FROM f{k} JOIN sh ON node = u GROUP BY v)" for k in range(rounds))
    every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(rounds + 1))
    return f"""WITH {T.LI}, sg AS (SELECT 's' || u AS u, 'p' || v AS v FROM li), b AS (SELECT u, v FROM sg UNION ALL SELECT v, u FROM sg),
m AS (SELECT u, v, CAST(count(*) AS DOUBLE) AS w FROM b GROUP BY ALL), sh AS (SELECT u, v, {share} AS share FROM m), f0 AS ({start}){steps},
r AS (SELECT node, sum(mass) AS raw FROM ({every}) GROUP BY node) SELECT node, round(raw / (SELECT sum(raw) FROM r), 6) AS rank FROM r"""


def _derivative(rounds: int = 10) -> str:
    """Both ranks of the cumulative graph of each day, their first and second differences, normalised as they come."""
    out = """, de AS (SELECT (t - 1) // 24 AS t, src, dst FROM ev), tk AS (SELECT DISTINCT t AS tick FROM de), nd AS (SELECT src AS node FROM de UNION SELECT dst FROM de),
gr AS (SELECT src, dst, t, sum(n) OVER (PARTITION BY src, dst ORDER BY t) AS w, lead(t) OVER (PARTITION BY src, dst ORDER BY t) AS u FROM (SELECT src, dst, t, count(*) AS n FROM de GROUP BY ALL)),
al AS (SELECT tick, src, dst, w FROM gr JOIN tk ON tick >= t AND (u IS NULL OR tick < u))"""
    for k, share, start in (
        (1, "1.0::DOUBLE / count(*) OVER (PARTITION BY tick, src)", "SELECT tick, node, 0.5::DOUBLE / (SELECT count(*) FROM nd) AS mass FROM nd, tk"),
        (2, "w / sum(w) OVER (PARTITION BY tick, src)", "SELECT tick, src AS node, 0.5::DOUBLE * sum(w) / sum(sum(w)) OVER (PARTITION BY tick) AS mass FROM al GROUP BY tick, src"),
    ):
        flows = "".join(f", f{k}_{i + 1} AS (SELECT tick, dst AS node, sum(0.5::DOUBLE * mass * share) AS mass FROM f{k}_{i} JOIN sh{k} USING (tick) WHERE node = src GROUP BY tick, dst)" for i in range(rounds))
        every = " UNION ALL ".join(f"SELECT * FROM f{k}_{i}" for i in range(rounds + 1))
        out += f", sh{k} AS (SELECT tick, src, dst, {share} AS share FROM al), f{k}_0 AS ({start}){flows}, r{k} AS (SELECT tick, node, sum(mass) / sum(sum(mass)) OVER (PARTITION BY tick) AS r FROM ({every}) GROUP BY tick, node)"
    names = ("d1", "e1", "d2", "e2")
    out += """, fu AS (SELECT r1.tick AS t, r1.node, r1.r AS r1, coalesce(r2.r, 0) AS r2, row_number() OVER (PARTITION BY r1.node ORDER BY r1.tick) - 1 AS k FROM r1 LEFT JOIN r2 USING (tick, node)),
df AS (SELECT *""" + "".join(f", CASE WHEN k > 0 THEN r{i} - lag(r{i}) OVER w ELSE 0.0 END AS d{i}, CASE WHEN k > 1 THEN r{i} - 2 * lag(r{i}) OVER w + lag(r{i}, 2) OVER w ELSE 0.0 END AS e{i}" for i in (1, 2)) + " FROM fu WINDOW w AS (PARTITION BY node ORDER BY t))"
    out += ", st AS (SELECT t, " + ", ".join(f"{d}, avg({d}) OVER w AS {d}_m, avg({d} * {d}) OVER w AS {d}_v" for d in names) + " FROM df WINDOW w AS (PARTITION BY node ORDER BY t))"
    sd = "sqrt(greatest(0.0, {0}_v - {0}_m * {0}_m))"
    out += ", nm AS (SELECT t, " + ", ".join(f"CASE WHEN {sd.format(d)} > 1e-15 THEN ({d} - {d}_m) / {sd.format(d)} ELSE {d} END AS {d}" for d in names) + " FROM st)"
    out += ", su AS (SELECT t, " + ", ".join(f"sum(abs({d})) AS {d}_s, max(abs({d})) AS {d}_x" for d in names) + " FROM nm GROUP BY t)"
    parts = ", ".join(f"{d}_s * " + " * ".join(f"{o}_x" for o in names if o != d) for d in names)
    return out + f" SELECT t, round(greatest({parts}), 4) AS score FROM su"


def _relational_key(name: str, key: str) -> str:
    return f""", {name}k AS (SELECT {key} AS k, t, j, count(*) AS n FROM evj GROUP BY ALL),
{name}h AS (SELECT a.k, a.t, coalesce(sum(b.n), 0) AS bs, coalesce(sum(b.n * pow(0.5, a.j - b.j)), 0) AS ba FROM {name}k a LEFT JOIN {name}k b ON a.k = b.k AND b.j < a.j GROUP BY ALL),
{name}s AS (SELECT seq, {name}h.ba + row_number() OVER (PARTITION BY {key}, evj.t ORDER BY seq) AS a, {name}h.bs + row_number() OVER (PARTITION BY {key}, evj.t ORDER BY seq) AS s FROM evj JOIN {name}h ON {name}h.k = {key} AND {name}h.t = evj.t)"""


_CHI = "CASE WHEN ev.t <= 1 THEN 0.0 ELSE pow(({0}.a - {0}.s / ev.t) * ev.t, 2) / ({0}.s * (ev.t - 1)) END"
#: A key's total and current count before each tick of the stream, from its first one on; "score" is that of its last tick with edges.
_FILTERING = """, tj AS (SELECT t, row_number() OVER (ORDER BY t) AS j, lag(t) OVER (ORDER BY t) AS p FROM (SELECT DISTINCT t FROM ev)),
ks AS (SELECT seq, t, 'e' || src || ',' || dst AS key FROM ev UNION ALL SELECT seq, t, 's' || src FROM ev UNION ALL SELECT seq, t, 'd' || dst FROM ev),
kc AS (SELECT key, t, count(*) AS n FROM ks GROUP BY ALL), kf AS (SELECT key, min(t) AS a, max(t) AS z FROM kc GROUP BY key),
fo AS (SELECT key, j, t, z, 0.0::DOUBLE AS ba, 0.0::DOUBLE AS total, n::DOUBLE AS cur, 0.0::DOUBLE AS score FROM kf JOIN kc USING (key) JOIN tj USING (t) WHERE t = a
  UNION ALL
  SELECT key, j, t, z, cur, total, cur + n, CASE WHEN n = 0 THEN score WHEN total = 0 THEN 0.0 ELSE pow(cur + n + total - (cur + n) * t, 2) / (total * (t - 1)) END
  FROM (SELECT fo.key, tj.j, tj.t, z, cur * 0.5 AS cur, score, coalesce(kc.n, 0) AS n,
      total + CASE WHEN score < 1000 THEN cur WHEN tj.p > 1 THEN total * (1.0::DOUBLE / (tj.p - 1)) ELSE 0.0 END AS total
    FROM fo JOIN tj ON tj.j = fo.j + 1 AND tj.t <= fo.z LEFT JOIN kc ON kc.key = fo.key AND kc.t = tj.t)),
sk AS (SELECT seq, ks.t, fo.ba + row_number() OVER (PARTITION BY ks.key, ks.t ORDER BY seq) AS a, total AS s FROM ks JOIN fo ON fo.key = ks.key AND fo.t = ks.t)
SELECT ev.seq, ev.t, ev.label, round(max(CASE WHEN s = 0 THEN 0.0 ELSE pow(a + s - a * sk.t, 2) / (s * (sk.t - 1)) END), 6) AS score FROM sk JOIN ev ON ev.seq = sk.seq GROUP BY ev.seq, ev.t, ev.label"""
_LINK = """, q AS (SELECT DISTINCT src, dst FROM ev WHERE label = 1 AND {where}), h AS (SELECT DISTINCT src, dst, t FROM ev JOIN q USING (src, dst)),
sp AS ({spine}), c AS (SELECT sp.src, sp.dst, sp.t, count(h.t) AS seen, min(h.t) AS a, max(h.t) AS z FROM sp LEFT JOIN h ON h.src = sp.src AND h.dst = sp.dst AND h.t >= sp.t - {w} AND h.t < sp.t GROUP BY ALL),
x AS (SELECT c.*, CASE WHEN h.t IS NULL THEN 0 ELSE 1 END AS x, CASE WHEN a IS NULL OR z = a THEN 0.0 ELSE seen / (z - a + 1) END AS p FROM c LEFT JOIN h USING (src, dst, t))
SELECT src, dst, t, round(pow(x - p, 2) / greatest(p * (1 - p), 0.01), 6) AS score FROM x"""

_FEATURED = """, ends AS (SELECT seq, src AS node, 0 AS e FROM ev UNION ALL SELECT seq, dst, 1 FROM ev),
deg AS (SELECT seq, e, count(*) OVER (PARTITION BY node ORDER BY seq RANGE UNBOUNDED PRECEDING) AS degree FROM ends),
dd AS (SELECT seq, degree FROM deg WHERE e = 1),
up AS (SELECT node, ends.seq, ends.e, (degree - (SELECT avg(degree) FROM dd)) / ((SELECT stddev_pop(degree) FROM dd) + 1e-9) AS x FROM ends JOIN dd ON ends.seq = dd.seq),
nu AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq, e) - 1 AS a FROM up)"""



def _sketch(rows: int = 2, columns: int = 1024, seed: int = 7) -> str:
    """Every edge in its cells; a cell's counts before a tick, plain and decayed, and its place within the tick."""
    cell = "(({0} % {p} + 104729 * ({1} % {p})) % {p} * {f} + {g}) % {p} % {c}"
    kinds = ("CAST(src AS BIGINT)", "CAST(dst AS BIGINT)"), ("CAST(src AS BIGINT)", "0"), ("CAST(dst AS BIGINT)", "0")
    cells = " UNION ALL ".join(f"SELECT seq, t, j, {k} AS kind, {r} AS row, {cell.format(a, b, p=C.PRIME, f=f, g=g, c=columns)} AS cell FROM evj" for k, (a, b) in enumerate(kinds) for r, (f, g) in enumerate(C.sketch_factors(rows, seed)))
    return f""", tj AS (SELECT t, row_number() OVER (ORDER BY t) AS j FROM (SELECT DISTINCT t FROM ev)), evj AS (SELECT ev.*, j FROM ev JOIN tj USING (t)), ce AS ({cells}),
pt AS (SELECT kind, row, cell, j, count(*) AS n FROM ce GROUP BY ALL),
bf AS (SELECT a.kind, a.row, a.cell, a.j, coalesce(sum(b.n), 0) AS s, coalesce(sum(b.n * pow(0.5, a.j - b.j)), 0) AS a FROM pt a LEFT JOIN pt b ON a.kind = b.kind AND a.row = b.row AND a.cell = b.cell AND b.j < a.j GROUP BY ALL),
up AS (SELECT seq, t, kind, bf.a + k AS a, bf.s + k AS s FROM (SELECT *, row_number() OVER (PARTITION BY kind, row, cell, j ORDER BY seq) AS k FROM ce) ce JOIN bf USING (kind, row, cell, j)),
le AS (SELECT seq, t, kind, min(a) AS a, min(s) AS s FROM up GROUP BY ALL)
SELECT seq, round(max(CASE WHEN t <= 1 THEN 0.0 ELSE pow((a - s / t) * t, 2) / (s * (t - 1)) END), 5) AS score FROM le GROUP BY seq"""


SQL = {
    "edge_totals": with_sql("SELECT src, dst, sum(weight) AS total FROM ev GROUP BY ALL"),
    "activity_series": with_sql("SELECT t, sum(weight) AS activity FROM ev GROUP BY ALL"),
    "stream_stats": with_sql(", z AS (SELECT DISTINCT src, dst, t FROM ev) SELECT count(*) AS size, count(DISTINCT t) AS n_times, min(t) AS first_t, max(t) AS last_t, (SELECT count(*) FROM (SELECT src FROM z UNION SELECT dst FROM z)) AS n_nodes FROM z"),
    "empty_slices": with_sql(", z AS (SELECT clock // 60 AS t FROM ev) SELECT unnest(range(0, (SELECT max(t) FROM z))) AS t EXCEPT SELECT t FROM z"),
    "link_stream_set": with_sql("SELECT src, dst, t, CAST(max(seq) AS DOUBLE) AS weight FROM ev GROUP BY ALL"),
    "edge_time_series": with_sql("SELECT src, dst, list_sort(list(t)) AS ticks FROM ev GROUP BY ALL"),
    "node_set": with_sql("SELECT src AS node FROM ev UNION SELECT dst FROM ev"),
    "subset_nodes": with_sql(f"{_FEW} SELECT seq FROM ev WHERE src IN (SELECT node FROM few) AND dst IN (SELECT node FROM few)"),
    "subset_bipartite": with_sql(f"{_FEW} SELECT seq FROM ev WHERE src IN (SELECT node FROM badn) AND dst IN (SELECT node FROM few)"),
    "subset_edges": with_sql(f"{_FEW} SELECT seq FROM ev JOIN badp USING (src, dst)"),
    "subset_time": with_sql("SELECT seq FROM ev WHERE t >= 10 AND t < 50"),
    "malicious_pairs": with_sql(f"{_FEW} SELECT src, dst FROM badp"),
    "malicious_gt": with_sql(f"{_FEW} SELECT src, dst, t, label FROM ev JOIN badp USING (src, dst)"),
    "fake_edges_anti": f"WITH {T.LI} SELECT DISTINCT u, v + 1 AS v FROM li EXCEPT SELECT u, v FROM li",
    "past_neighbours_only": with_sql(", b AS (SELECT src AS node, dst AS other, t FROM ev UNION ALL SELECT dst, src, t FROM ev) SELECT node, other FROM b WHERE t < 100 EXCEPT SELECT node, other FROM b WHERE t = 100"),
    "spine_labels": with_sql(", z AS (SELECT DISTINCT t FROM ev WHERE label = 1) SELECT t, CASE WHEN t IN (SELECT t FROM z) THEN 1 ELSE 0 END AS label FROM (SELECT unnest(range((SELECT min(t) FROM ev), (SELECT max(t) FROM ev) + 1)) AS t)"),
    "score_label_join": with_sql(f"{_NORMAL} SELECT seq, score, label FROM sc"),
    "snapshot_fill_labels": with_sql("SELECT t, sum(weight) AS activity, CASE WHEN sum(label) >= 3 THEN 1 ELSE 0 END AS label FROM ev GROUP BY t"),
    "recent_neighbours": with_sql(", b AS (SELECT src AS node, dst AS other, seq, 0 AS e, clock FROM ev UNION ALL SELECT dst, src, seq, 1, clock FROM ev), l AS (SELECT node, list(other ORDER BY seq, e) AS o, list(clock ORDER BY seq, e) AS c FROM b GROUP BY node) SELECT seq, list_slice(o, greatest(1, k - 4), k) AS neighbours FROM (SELECT seq, o, len(list_filter(c, lambda x: x < clock)) AS k FROM ev JOIN l ON l.node = ev.src)"),
    "nearest_gap": with_sql(", g AS (SELECT seq AS position FROM (SELECT seq, lead(clock) OVER (ORDER BY seq) - clock AS gap FROM ev) WHERE gap >= 900), q AS (SELECT unnest(range(0, (SELECT count(*) FROM ev), 250)) AS target) SELECT target, position FROM (SELECT target, position, row_number() OVER (PARTITION BY target ORDER BY abs(position - target), position DESC) AS r FROM q, g) WHERE r = 1"),
    "delta_counts": with_sql("SELECT t, src, dst, count(*) AS n FROM ev GROUP BY ALL"),
    "frequency_decay": with_sql("SELECT src, dst, round((1 - 0.99) * sum(pow(0.99, (SELECT max(t) FROM ev) - t)), 6) AS f FROM ev GROUP BY ALL"),
    "top_frequencies": with_sql(", z AS (SELECT src, dst, round((1 - 0.99) * sum(pow(0.99, (SELECT max(t) FROM ev) - t)), 9) AS f FROM ev GROUP BY ALL) SELECT src, dst, round(f, 6) AS f FROM (SELECT * FROM z ORDER BY f DESC, src, dst LIMIT 100)"),
    "degree_stats": with_sql(", z AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ev UNION ALL SELECT dst FROM ev) GROUP BY node) SELECT round(avg(degree), 6) AS mean_degree, round(stddev_pop(degree), 6) AS std_degree FROM z"),
    "microcluster_normal": with_sql(f"{_NORMAL} SELECT * FROM sc"),
    "microcluster_relational": with_sql(", tj AS (SELECT t, row_number() OVER (ORDER BY t) AS j FROM (SELECT DISTINCT t FROM ev)), evj AS (SELECT ev.*, j FROM ev JOIN tj USING (t))" + _relational_key("e", "(evj.src || ',' || evj.dst)") + _relational_key("u", "evj.src") + _relational_key("d", "evj.dst") + f" SELECT ev.seq, ev.t, ev.label, round(greatest({_CHI.format('es')}, {_CHI.format('us')}, {_CHI.format('ds')}), 5) AS score FROM ev JOIN es ON es.seq = ev.seq JOIN us ON us.seq = ev.seq JOIN ds ON ds.seq = ev.seq"),
    "snapshot_rollup_max": with_sql(f"{_NORMAL} SELECT t, max(score) AS score, max(label) AS attack FROM sc GROUP BY t"),
    "snapshot_rollup_mean": with_sql(f"{_RAW} SELECT t, round(avg(score), 5) AS score, max(label) AS attack FROM sc GROUP BY t"),
    "snapshot_rollup_sum": with_sql(f"{_NORMAL} SELECT t, round(sum(score), 6) AS score, max(label) AS attack FROM sc GROUP BY t"),
    "bin_attack_label": with_sql("SELECT t, CAST(sum(label) AS BIGINT) AS attacks, CASE WHEN sum(label) >= 5 THEN 1 ELSE 0 END AS label FROM ev GROUP BY t"),
    "roc_auc": with_sql(f"{_NORMAL}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM sc), a AS (SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r) SELECT round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS best_auc FROM a"),
    "roc_points": with_sql(f"{_CUM} SELECT score, round(fpr, 6) AS fpr, round(recall, 6) AS tpr FROM pr"),
    "pr_curve": with_sql(f"{_CUM} SELECT score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr"),
    "average_precision": with_sql(f"{_CUM}, l AS (SELECT precision, recall, coalesce(lag(recall) OVER w, 0) AS r0, coalesce(lag(precision) OVER w, 1) AS p0 FROM pr WINDOW w AS (ORDER BY score DESC)) SELECT round(sum((recall - r0) * precision), 6) AS ap, round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_auc FROM l"),
    "best_f1": with_sql(f"{_CUM}, f AS (SELECT score, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 12) ELSE 0 END AS f1 FROM pr) SELECT score AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, score DESC LIMIT 1"),
    "topk_precision_recall": with_sql(f"{_NORMAL}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, seq) AS r FROM sc), k AS (SELECT unnest(range(50, 801, 50)) AS k), h AS (SELECT k, sum(label) AS tp, count(*) AS n, (SELECT sum(label) FROM sc) AS ap, (SELECT count(*) FROM sc) AS al FROM k JOIN r ON r.r <= k GROUP BY k) SELECT k, round(tp / n, 6) AS precision, round(tp / ap, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / n) * (tp / ap) / (tp / n + tp / ap) ELSE 0 END, 6) AS f1, round((n - tp) / (al - ap), 6) AS fpr FROM h"),
    "classification_f1": with_sql(", p AS (SELECT label, CAST(dst < '5' AS INT) AS y FROM ev), c AS (SELECT c, count(*) FILTER (label = c AND y = c) AS tp, count(*) FILTER (label <> c AND y = c) AS fp, count(*) FILTER (label = c AND y <> c) AS fn FROM p, (SELECT unnest([0, 1]) AS c) GROUP BY c), f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c) SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(sum(tp) / sum(tp + fn), 6) AS micro_f1, round(avg(f1), 6) AS macro_f1, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1 FROM f"),
    "mean_reciprocal_rank": with_sql(f"{_NORMAL}, r AS (SELECT seq, rank() OVER (PARTITION BY t ORDER BY score DESC) AS r FROM sc) SELECT round(avg(1 / r), 6) AS mrr FROM r WHERE seq % 97 = 3"),
    "hourly_snapshots": with_sql(", b AS (SELECT min(clock) AS a, max(clock) AS z FROM ev), k AS (SELECT (clock - a) // 3600 AS snapshot, src, dst FROM ev, b WHERE a + (clock - a) // 3600 * 3600 < z), n AS (SELECT snapshot, count(DISTINCT node) AS n_nodes FROM (SELECT snapshot, src AS node FROM k UNION ALL SELECT snapshot, dst FROM k) GROUP BY ALL) SELECT snapshot, count(*) AS n_edges, any_value(n_nodes) AS n_nodes FROM k JOIN n USING (snapshot) GROUP BY snapshot"),
    "adjacency_lists": f"WITH {T.LI}, z AS (SELECT u + 1000000 AS u, v FROM li), b AS (SELECT u, v FROM z UNION SELECT v, u FROM z) SELECT u AS node, list_sort(list(v)) AS neighbours FROM b GROUP BY u",
    "degree": f"WITH {T.LI} SELECT node, count(*) AS degree FROM (SELECT u AS node FROM li UNION ALL SELECT v FROM li) GROUP BY node",
    "undirected_clean": f"WITH {T.LI} SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM li WHERE u <> v",
    "cumulative_adjacency": with_sql("SELECT src, dst, t, CAST(sum(count(*)) OVER (PARTITION BY src, dst ORDER BY t) AS BIGINT) AS weight FROM ev GROUP BY src, dst, t"),
    "pagerank_v1": _pagerank(False),
    "pagerank_v2": _pagerank(True),
    "edge_link_score": with_sql(_LINK.format(where="true", w=20, spine="SELECT DISTINCT q.src, q.dst, unnest(range(300, (SELECT max(t) FROM h) + 1)) AS t FROM q")),
    "edge_link_score_active": with_sql(_LINK.format(where="true", w=200, spine="SELECT src, dst, t FROM h WHERE t >= 30")),
    "edge_encoding_hadamard": _encoding("p[i] * q[i]"),
    "edge_encoding_average": _encoding("(p[i] + q[i]) / 2"),
    "edge_encoding_l1": _encoding("abs(p[i] - q[i])"),
    "edge_encoding_l2": _encoding("(p[i] - q[i]) * (p[i] - q[i])"),
    "cosine": _PAIR + " SELECT u, v, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * q[i])) / (sqrt(list_sum(list_transform(p, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 5) AS cosine FROM e",
    "haar": f"WITH {_VEC} SELECT node, 0 AS k, round(list_sum(x) / 8, 5) + 0.0 AS c FROM v" + "".join(f" UNION ALL SELECT node, {64 // w} + b, round((list_sum(x[b * {w} + 1:b * {w} + {w // 2}]) - list_sum(x[b * {w} + {w // 2} + 1:(b + 1) * {w}])) / sqrt({w}), 5) + 0.0 FROM (SELECT node, x, unnest(range({64 // w})) AS b FROM v)" for w in (64, 32, 16, 8, 4, 2)),
    "nearest_centroid": f"WITH {_VEC}, f AS (SELECT label, i, avg(x[i]) AS m FROM (SELECT label, x, unnest(range(1, 65)) AS i FROM v) GROUP BY ALL), d AS (SELECT node, f.label AS centre, sqrt(sum(pow(x[i] - m, 2))) AS distance FROM v, f GROUP BY node, f.label) SELECT node, centre, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, centre) AS r FROM d) WHERE r = 1",
    "neighbour_mean": _PAIR + ", a AS (SELECT u AS node, i, avg(q[i]) AS m FROM (SELECT u, q, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL) SELECT node, list(round(m, 5) + 0.0 ORDER BY i) AS x FROM a GROUP BY node",
    "gin_aggregate": f"WITH {_VEC} SELECT a.node, list_transform(range(1, 65), lambda i: round(a.x[i] + coalesce(b.x[i], 0), 5) + 0.0) AS x FROM v a LEFT JOIN v b ON b.node = a.node + 1",
    "online_centroid_update": f"WITH {_VEC}, c AS (SELECT label, i, avg(y) FILTER (node % 2 = 0) AS c0, count(*) FILTER (node % 2 = 0) AS n0, avg(y) FILTER (node % 2 = 1) AS c1, count(*) FILTER (node % 2 = 1) AS n1 FROM (SELECT label, node, unnest(range(1, 65)) AS i, unnest(x) AS y FROM v) GROUP BY ALL) SELECT label, list(round((0.7 * c0 * n0 + 0.3 * c1 * n1) / (0.7 * n0 + 0.3 * n1), 5) + 0.0 ORDER BY i) AS x FROM c GROUP BY label",
    "cms_estimates": f"WITH {T.LI}, h AS (SELECT u, v, r, ((CASE WHEN w < 0 THEN w + {COLUMNS} ELSE w END)) AS c FROM (SELECT u, v, r, (((((u + 104729 * v + 2147483648) % 4294967296 - 2147483648) * p + q + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) % {COLUMNS} AS w FROM li, (VALUES (0, 16807, 11), (1, 48271, 7), (2, 69621, 3)) f(r, p, q))), cell AS (SELECT r, c, count(*) AS value FROM h GROUP BY ALL) SELECT u, v, n, min(value) AS estimate FROM (SELECT u, v, r, c, count(*) AS n FROM h GROUP BY ALL) JOIN cell USING (r, c) GROUP BY ALL",
    "sketch_scores": with_sql(_sketch()),
    "microcluster_filtering": f"WITH RECURSIVE {T.EV}{_FILTERING}",
    "derivative_scores": with_sql(_derivative()),
}
