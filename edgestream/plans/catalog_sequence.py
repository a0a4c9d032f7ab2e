"""Queries of the sequential operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import injection as I
from ..operators import sequence as S
from . import frames as T
from .ordering import global_lag

WIDTH = 600
ROUND = "round({}, 6)"


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def ev(s, d):
    return T.events_edges(s, d)


def paths(s, d):
    return T.events_paths(s, d)


def urls(s, d):
    return T.page_paths(s, d)


def with_sql(body: str) -> str:
    return f"WITH {T.EV}{body if body.startswith(',') else ' ' + body}"


QUERIES = {
    "transition_edges_src_label": lambda s, d: S.transition_edges(paths(s, d), "source"),
    "transition_edges_row_label": lambda s, d: S.transition_edges(paths(s, d), "row"),
    "transition_edges_global": lambda s, d: S.transition_edges(paths(s, d), "source", None),
    "dense_ids_first_seen": lambda s, d: S.first_seen_ids(ev(s, d), "dst"),
    "dense_ids_interleaved": lambda s, d: S.interleaved_ids(ev(s, d)),
    "dense_ids_factorize": lambda s, d: S.factorize_ends(ev(s, d)),
    "dense_ids_sorted": lambda s, d: S.sorted_ids(ev(s, d)),
    "dense_ids_bipartite": lambda s, d: S.bipartite_ids(ev(s, d)),
    "time_normalise": lambda s, d: S.normalised_time(ev(s, d)).select("seq", "norm_t"),
    "time_bins": lambda s, d: S.time_bin(ev(s, d), WIDTH).select("seq", "bin"),
    "sequential_time": lambda s, d: S.sequential_time(ev(s, d), "t").select("seq", "dense_t"),
    "time_since_last_dst": lambda s, d: S.since_last(ev(s, d)).select("seq", "since_last"),
    "running_degree_dst": lambda s, d: S.running_degree(ev(s, d)).select("seq", "degree"),
    "running_edge_weight": lambda s, d: S.running_weight(ev(s, d)).select("seq", "occurrence"),
    "feature_vector": lambda s, d: S.features(ev(s, d), F.col("label")).select("seq", F.round(F.col("f")[0], 6).alias("f0"), F.round(F.col("f")[1], 6).alias("f1"), F.round(F.col("f")[2], 6).alias("f2")),
    "gap_rows_before": lambda s, d: S.gap_rows(ev(s, d), "before").select("seq", "gap"),
    "gap_rows_after": lambda s, d: S.gap_rows(ev(s, d), "after").select("seq", "gap"),
    "session_islands": lambda s, d: S.sessions(paths(s, d), 7200).select("seq", "stream_id", "session"),
    "gap_quartiles_by_count": lambda s, d: S.gap_quartiles_by_count(S.gap_rows(ev(s, d), "before")).select("seq", "quartile"),
    "gap_quartiles_by_position": lambda s, d: S.gap_quartiles_by_position(ev(s, d)).select("seq", "quartile"),
    "batch_summary": lambda s, d: S.batch_summary(ev(s, d), 64).select("batch", "n", *_r("mean_gap", "mean_label")),
    "batch_depths": lambda s, d: S.batches(urls(s, d), 40).select("seq", "batch", P.path_depth(F.col("path")).alias("depth")),
    "path_depth": lambda s, d: urls(s, d).select("seq", P.path_depth(F.col("path")).alias("depth")),
    "path_tree_distance": lambda s, d: global_lag(urls(s, d), {"before": "path"}).where("before is not null").select("seq", P.tree_distance(F.col("before"), F.col("path")).alias("distance")),
    "path_edges": lambda s, d: urls(s, d).select("seq", F.inline(P.path_edges(F.col("path")))),
    "depth_delta": lambda s, d: S.depth_delta(urls(s, d)),
    "idle_padding": lambda s, d: S.idle_padding(ev(s, d), 300),
    "fill_pair_gaps": lambda s, d: S.fill_pair_gaps(ev(s, d), 20000),
    "tail_padding": lambda s, d: S.tail_padding(ev(s, d), 10, 5),
    "fill_seconds": lambda s, d: S.fill_seconds(ev(s, d)).select("seq", "clock"),
    "sliding_windows": lambda s, d: S.labelled_windows(ev(s, d), 800, 200).select("window", "seq", "attack"),
    "attack_spans": lambda s, d: S.attack_spans(ev(s, d)),
    "temporal_split": lambda s, d: S.temporal_split(ev(s, d), 0.7, 0.85).select("seq", "part"),
    "strictly_increasing_clock": lambda s, d: S.strictly_increasing(ev(s, d).withColumn("clock", F.expr("clock div 900"))).select("seq", "fixed"),
    "second_difference_hybrid": lambda s, d: second_difference(s, d),
    "minute_flow_graph": lambda s, d: S.chained_rows(ev(s, d).withColumn("minute", F.expr("clock div 3600"))),
    "organised_injection": lambda s, d: I.organised(*halves(s, d)).select("seq", "clock", "path", "label"),
    "gap_injection": lambda s, d: I.into_gap(*halves(s, d), 100).select("seq", "clock", "path", "label"),
    "continuous_injection": lambda s, d: I.continuous(*halves(s, d), 100).select("seq", "clock", "path", "label"),
}


def halves(s, d):
    log = T.events_paths(s, d).select("seq", "clock", "path", "label")
    return log.where("label = 0"), log.where("label = 1")


def second_difference(s, d):
    from ..operators.relational import activity

    held = activity(ev(s, d)).select(F.col("t").alias("seq"), F.col("activity").cast("double").alias("score"))
    return S.second_difference(held).select("seq", *_r("diff2", "hybrid"))


_PARTS = "list_concat(CASE WHEN starts_with({0}, '/') THEN ['/'] ELSE [] END, list_filter(string_split({0}, '/'), lambda x: x <> '' AND x <> '.'))"
_URL = f"WITH {T.URL}, parts AS (SELECT seq, {_PARTS.format('path')} AS p FROM urls)"
_LOGS = ", benign AS (SELECT seq, clock, path, label FROM paths WHERE label = 0), bad AS (SELECT seq, clock, path, label FROM paths WHERE label = 1)"
_SPLICE = """, spliced AS (SELECT clock, path, label, seq AS p, 0 AS side, seq FROM benign
  UNION ALL SELECT {clock}, path, label, 100, 1, seq FROM (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM bad)),
ordered AS (SELECT row_number() OVER (ORDER BY p, side, seq) AS seq, clock, path, label FROM spliced)"""


def _ids(position: str, base: int) -> str:
    return f"SELECT node, row_number() OVER (ORDER BY min(p)) - 1 + {base} AS id FROM ({position}) GROUP BY node"


SQL = {
    "transition_edges_src_label": with_sql("SELECT * FROM (SELECT seq, stream_id, clock, lag(path) OVER w AS src, path AS dst, lag(label) OVER w AS label FROM paths WINDOW w AS (PARTITION BY stream_id ORDER BY seq)) WHERE src IS NOT NULL"),
    "transition_edges_row_label": with_sql("SELECT * FROM (SELECT seq, stream_id, clock, lag(path) OVER w AS src, path AS dst, label FROM paths WINDOW w AS (PARTITION BY stream_id ORDER BY seq)) WHERE src IS NOT NULL"),
    "transition_edges_global": with_sql("SELECT * FROM (SELECT seq, clock, lag(path) OVER w AS src, path AS dst, lag(label) OVER w AS label FROM paths WINDOW w AS (ORDER BY seq)) WHERE src IS NOT NULL"),
    "dense_ids_first_seen": with_sql("SELECT dst, row_number() OVER (ORDER BY min(seq)) AS id FROM ev GROUP BY dst"),
    "dense_ids_interleaved": with_sql(_ids("SELECT src AS node, 2 * seq AS p FROM ev UNION ALL SELECT dst, 2 * seq + 1 FROM ev", 1)),
    "dense_ids_factorize": with_sql(_ids("SELECT src AS node, seq AS p FROM ev UNION ALL SELECT dst, seq + 1 + (SELECT max(seq) FROM ev) FROM ev", 0)),
    "dense_ids_sorted": with_sql("SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev)"),
    "dense_ids_bipartite": with_sql(", a AS (SELECT src, row_number() OVER (ORDER BY min(seq)) AS u FROM ev GROUP BY src), b AS (SELECT dst, row_number() OVER (ORDER BY min(seq)) + (SELECT count(*) FROM a) AS i FROM ev GROUP BY dst) SELECT seq, u, i FROM ev JOIN a USING (src) JOIN b USING (dst)"),
    "time_normalise": with_sql("SELECT seq, clock - (SELECT min(clock) FROM ev) + 1 AS norm_t FROM ev"),
    "time_bins": with_sql(f"SELECT seq, (clock - (SELECT min(clock) FROM ev)) // {WIDTH} AS bin FROM ev"),
    "sequential_time": with_sql("SELECT seq, dense_rank() OVER (ORDER BY t) AS dense_t FROM ev"),
    "time_since_last_dst": with_sql("SELECT seq, clock - coalesce(lag(clock) OVER (PARTITION BY dst ORDER BY seq), clock) AS since_last FROM ev"),
    "running_degree_dst": with_sql(", ends AS (SELECT seq, src AS node, 0 AS e FROM ev UNION ALL SELECT seq, dst, 1 FROM ev) SELECT seq, degree FROM (SELECT seq, e, count(*) OVER (PARTITION BY node ORDER BY seq RANGE UNBOUNDED PRECEDING) AS degree FROM ends) WHERE e = 1"),
    "running_edge_weight": with_sql("SELECT seq, row_number() OVER (PARTITION BY src, dst ORDER BY seq) AS occurrence FROM ev"),
    "feature_vector": with_sql(""", ends AS (SELECT seq, src AS node, 0 AS e FROM ev UNION ALL SELECT seq, dst, 1 FROM ev),
deg AS (SELECT seq, e, count(*) OVER (PARTITION BY node ORDER BY seq RANGE UNBOUNDED PRECEDING) AS degree FROM ends),
f AS (SELECT ev.seq, label, clock - coalesce(lag(clock) OVER (PARTITION BY dst ORDER BY ev.seq), clock) AS gap, degree FROM ev JOIN deg ON ev.seq = deg.seq AND e = 1)
SELECT seq, round(label / 10.0, 6) AS f0, round(gap / 10000.0, 6) AS f1, round((degree - (SELECT avg(degree) FROM f)) / ((SELECT stddev_pop(degree) FROM f) + 1e-9), 6) AS f2 FROM f"""),
    "gap_rows_before": with_sql("SELECT * FROM (SELECT seq, lead(clock) OVER (ORDER BY seq) - clock AS gap FROM ev) WHERE gap >= 301"),
    "gap_rows_after": with_sql("SELECT * FROM (SELECT seq, clock - lag(clock) OVER (ORDER BY seq) AS gap FROM ev) WHERE gap >= 301"),
    "session_islands": with_sql("SELECT seq, stream_id, CAST(sum(new) OVER (PARTITION BY stream_id ORDER BY seq) AS BIGINT) AS session FROM (SELECT *, CASE WHEN clock - lag(clock) OVER (PARTITION BY stream_id ORDER BY seq) >= 7200 THEN 1 ELSE 0 END AS new FROM paths)"),
    "gap_quartiles_by_count": with_sql(", g AS (SELECT seq FROM (SELECT seq, lead(clock) OVER (ORDER BY seq) - clock AS gap FROM ev) WHERE gap >= 301), k AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k, count(*) OVER () AS n FROM g) SELECT seq, CAST(k >= n // 4 AS INT) + CAST(k >= n // 2 AS INT) + CAST(k >= 3 * n // 4 AS INT) AS quartile FROM k"),
    "gap_quartiles_by_position": with_sql(", k AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k, count(*) OVER () AS n, lead(clock) OVER (ORDER BY seq) - clock AS gap FROM ev) SELECT seq, CASE WHEN k * 100.0 / n < 25 THEN 0 WHEN k * 100.0 / n < 50 THEN 1 WHEN k * 100.0 / n < 75 THEN 2 ELSE 3 END AS quartile FROM k WHERE gap >= 301"),
    "batch_summary": with_sql(", b AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 64 AS batch FROM ev), g AS (SELECT *, clock - lag(clock) OVER (PARTITION BY batch ORDER BY seq) AS gap FROM b) SELECT batch, count(*) AS n, round(avg(gap), 6) AS mean_gap, round(avg(label), 6) AS mean_label FROM g GROUP BY batch HAVING count(*) = 64"),
    "batch_depths": _URL + ", b AS (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 40 AS batch, len(p) AS depth FROM parts), f AS (SELECT *, count(*) OVER (PARTITION BY batch) AS size FROM b) SELECT seq, batch, depth FROM f WHERE size = 40",
    "path_depth": _URL + " SELECT seq, len(p) AS depth FROM parts",
    "path_tree_distance": _URL + ", l AS (SELECT seq, p, lag(p) OVER (ORDER BY seq) AS q FROM parts), c AS (SELECT seq, p, q, (SELECT coalesce(min(i) - 1, least(len(p), len(q))) FROM (SELECT unnest(range(1, least(len(p), len(q)) + 1)) AS i) WHERE p[i] <> q[i]) AS common FROM l WHERE q IS NOT NULL) SELECT seq, len(p) + len(q) - 2 * common AS distance FROM c",
    "path_edges": _URL + " SELECT seq, p[i] AS parent, p[i + 1] AS child FROM (SELECT seq, p, unnest(range(1, len(p))) AS i FROM parts)",
    "depth_delta": _URL + " SELECT * FROM (SELECT seq, abs(len(p) - lag(len(p)) OVER (ORDER BY seq)) AS delta FROM parts) WHERE delta IS NOT NULL",
    "idle_padding": with_sql(", b AS (SELECT (clock - (SELECT min(clock) FROM ev)) // 300 AS bin, src, seq FROM ev), l AS (SELECT bin, max_by(src, seq) AS node FROM b GROUP BY bin), n AS (SELECT bin, node, lead(bin) OVER (ORDER BY bin) AS nxt FROM l) SELECT unnest(range(bin + 1, nxt)) AS bin, node AS src, node AS dst FROM n WHERE nxt > bin + 1"),
    "fill_pair_gaps": with_sql(", n AS (SELECT src, dst, clock, lead(clock) OVER (PARTITION BY src, dst ORDER BY clock, seq) AS nxt FROM ev), f AS (SELECT src, dst, unnest(range(clock + 20000, nxt, 20000)) AS clock FROM n WHERE nxt - clock > 20000) SELECT src, dst, clock FROM f"),
    "tail_padding": with_sql("SELECT max_by(dst, seq) AS src, max_by(dst, seq) AS dst, max_by(clock, seq) + 5 * k AS clock FROM ev, (SELECT unnest(range(1, 11)) AS k) GROUP BY k"),
    "fill_seconds": with_sql("SELECT seq, unnest(range(clock, greatest(clock, coalesce(nxt - 1, clock)) + 1)) AS clock FROM (SELECT seq, clock, lead(clock) OVER (ORDER BY seq) AS nxt FROM ev)"),
    "sliding_windows": with_sql(", k AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS k FROM ev), w AS (SELECT unnest(range(0, ((SELECT count(*) FROM ev) - 800) // 200 + 1)) AS win) SELECT win AS \"window\", seq, 2 * sum(label) OVER (PARTITION BY win) > 800 AS attack FROM w JOIN k ON k >= win * 200 AND k < win * 200 + 800"),
    "attack_spans": with_sql(", k AS (SELECT label, row_number() OVER (ORDER BY seq) - 1 AS k FROM ev), i AS (SELECT k, k - row_number() OVER (ORDER BY k) AS island FROM k WHERE label = 1) SELECT min(k) AS first, max(k) AS last FROM i GROUP BY island"),
    "temporal_split": with_sql("SELECT seq, CASE WHEN clock <= (SELECT quantile_cont(clock, 0.7) FROM ev) THEN 'train' WHEN clock <= (SELECT quantile_cont(clock, 0.85) FROM ev) THEN 'valid' ELSE 'test' END AS part FROM ev"),
    "strictly_increasing_clock": with_sql(", k AS (SELECT seq, clock // 900 AS s, row_number() OVER (ORDER BY seq) AS k FROM ev) SELECT seq, max(s - k) OVER (ORDER BY seq) + k AS fixed FROM k"),
    "second_difference_hybrid": with_sql(", a AS (SELECT t, sum(weight) AS s FROM ev GROUP BY t), d AS (SELECT t, s, coalesce(abs(s - 2 * lag(s) OVER w + lag(s, 2) OVER w), 0) AS r FROM a WINDOW w AS (ORDER BY t)), n AS (SELECT t, s, CASE WHEN (SELECT max(r) FROM d) > 0 THEN r / ((SELECT max(r) FROM d) + 1e-9) ELSE r END AS x FROM d) SELECT t AS seq, round(x, 6) AS diff2, round(0.85 * s + 0.15 * x, 6) AS hybrid FROM n"),
    "minute_flow_graph": with_sql(", k AS (SELECT clock // 3600 AS g, row_number() OVER (PARTITION BY clock // 3600 ORDER BY seq) AS k FROM ev) SELECT g AS graph, 2 * (k - 1) AS source, 2 * k - 1 AS target FROM k UNION ALL SELECT g, 2 * k - 3, 2 * k - 2 FROM k WHERE k > 1"),
    "organised_injection": with_sql(f"{_LOGS} SELECT row_number() OVER (ORDER BY clock, side, seq) AS seq, clock, path, label FROM (SELECT *, 0 AS side FROM benign UNION ALL SELECT *, 1 FROM bad)"),
    "gap_injection": with_sql(_LOGS + _SPLICE.format(clock="clock - (SELECT min(clock) FROM bad) + (SELECT clock FROM benign WHERE seq = 100) + 1") + " SELECT * FROM ordered"),
    "continuous_injection": with_sql(_LOGS + _SPLICE.format(clock="k - 1 + (SELECT clock FROM benign WHERE seq = 100) + 1") + " SELECT seq, max(clock - seq) OVER (ORDER BY seq) + seq AS clock, path, label FROM ordered"),
}
