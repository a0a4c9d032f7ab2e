"""Queries of export formats, scalar functions, splits and scaling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import vectors as V
from ..operators import learning as A
from ..operators import relational as R
from ..operators import sequence as S
from ..sources import writers as K
from . import frames as T
from .catalog_relational import _FEATURED, _VEC, vectors
from .catalog_sequence import ev, with_sql


QUERIES = {
    "snapshot_format_rows": lambda s, d: K.snapshot_rows(ev(s, d)),
    "padded_format_rows": lambda s, d: K.padded_rows(ev(s, d), 1800).select("bin", "u", "v", "label"),
    "column_split_rows": lambda s, d: K.column_split_rows(ev(s, d)),
    "interaction_rows": lambda s, d: K.interaction_rows(ev(s, d)),
    "query_truth_rows": lambda s, d: K.query_files(ev(s, d))[1],
    "md5_ids": lambda s, d: T.page_paths(s, d).select("seq", P.md5_mod(F.col("path")).alias("id")),
    "attack_label": lambda s, d: T.events_clock(s, d).select("seq", P.is_attack_label(F.col("event_type"), ("view", "click")).alias("label")),
    "time_encoding": lambda s, d: ev(s, d).select("seq", F.transform(V.time_encoding(F.col("clock") % 1000, 4), lambda x: F.round(x, 5) + 0.0).alias("code")),
    "one_hot": lambda s, d: vectors(s, d).select("node", V.one_hot(F.col("label"), 10).alias("code")),
    "stratified_folds": lambda s, d: A.stratified_folds(ev(s, d).select("seq", "label"), 5),
    "random_split": lambda s, d: A.random_split(ev(s, d).select("seq", "t")).select("seq", "part"),
    "scaled_by_train": lambda s, d: S.scaled(S.temporal_split(T.events_clock(s, d).select("seq", "clock", "value"), 0.7, 0.85), "value", F.col("part") == "train").select("seq", "part", F.round("standard", 5).alias("standard"), F.round("min_max", 6).alias("min_max")),
    "scaled_values": lambda s, d: S.scaled(T.events_clock(s, d).select("seq", "value"), "value").select("seq", F.round("standard", 5).alias("standard"), F.round("min_max", 6).alias("min_max"), F.round("log", 6).alias("log")),
    "layer_lists": lambda s, d: R.members(T.events_clock(s, d).select(F.expr(f"us div {T.HOUR_US}").alias("graph"), "event_type", "seq"), ["graph", "event_type"], "seq"),
    "both_directions": lambda s, d: S.both_directions(T.events_clock(s, d), "value"),
    "group_sizes": lambda s, d: R.group_sizes(ev(s, d), "t"),
    "endpoint_filter": lambda s, d: R.subset_nodes(ev(s, d), ev(s, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n > 60")).select("seq"),
}

_IDS = """, ends AS (SELECT src AS node, 2 * seq AS p FROM ev UNION ALL SELECT dst, 2 * seq + 1 FROM ev),
ids AS (SELECT node, row_number() OVER (ORDER BY min(p)) AS id FROM ends GROUP BY node),
named AS (SELECT ev.*, a.id AS u, b.id AS v FROM ev JOIN ids a ON a.node = src JOIN ids b ON b.node = dst)"""

SQL = {
    "snapshot_format_rows": with_sql(_IDS + " SELECT seq, clock - (SELECT min(clock) FROM ev) + 1 AS t, u, v, label FROM named"),
    "padded_format_rows": with_sql(_IDS + ", b AS (SELECT (clock - (SELECT min(clock) FROM ev)) // 1800 AS bin, u, v, label, seq FROM named), l AS (SELECT bin, max_by(u, seq) AS u FROM b GROUP BY bin), n AS (SELECT bin, u, lead(bin) OVER (ORDER BY bin) AS nxt FROM l), a AS (SELECT bin, u, v, label FROM b UNION ALL SELECT unnest(range(bin + 1, nxt)), u, u, 0 FROM n WHERE nxt > bin + 1) SELECT bin, u, v, label FROM a"),
    "column_split_rows": with_sql(", ends AS (SELECT src AS node, seq AS p FROM ev UNION ALL SELECT dst, seq + 1 + (SELECT max(seq) FROM ev) FROM ev), ids AS (SELECT node, row_number() OVER (ORDER BY min(p)) - 1 AS id FROM ends GROUP BY node) SELECT seq, a.id AS u, b.id AS v, clock AS t, label FROM ev JOIN ids a ON a.node = src JOIN ids b ON b.node = dst"),
    "interaction_rows": with_sql(_IDS + " SELECT u, v AS i, clock - (SELECT min(clock) FROM ev) + 1 AS ts, label, row_number() OVER (ORDER BY seq) - 1 AS idx FROM named"),
    "query_truth_rows": with_sql("SELECT src, dst, t, label FROM ev WHERE (src, dst) IN (SELECT (src, dst) FROM ev WHERE label = 1)"),
    "md5_ids": f"WITH {T.URL} SELECT seq, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(8), lambda k: CAST('0x' || substr(md5(path), k * 4 + 1, 4) AS BIGINT))), lambda a, b: (a * 65536 + b) % 100000000) AS id FROM urls",
    "attack_label": with_sql("SELECT seq, CASE WHEN lower(event_type) IN ('view', 'click') THEN 0 ELSE 1 END AS label FROM clocked"),
    "time_encoding": with_sql("SELECT seq, list_transform(range(4), lambda k: round(cos(clock % 1000 * pow(10.0, -3.0 * k)), 5) + 0.0) AS code FROM ev"),
    "one_hot": f"WITH {_VEC} SELECT node, list_transform(range(10), lambda k: CAST(k = label AS INTEGER)) AS code FROM v",
    "stratified_folds": with_sql("SELECT seq, label, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(seq AS VARCHAR))) - 1) % 5 AS fold FROM ev"),
    "random_split": with_sql(", p AS (SELECT seq, percent_rank() OVER (PARTITION BY t ORDER BY md5('7-' || seq)) AS p FROM ev) SELECT seq, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'valid' ELSE 'test' END AS part FROM p"),
    "scaled_by_train": with_sql(", c AS (SELECT quantile_cont(clock, 0.7) AS a, quantile_cont(clock, 0.85) AS b FROM ev), p AS (SELECT seq, value, CASE WHEN clock <= a THEN 'train' WHEN clock <= b THEN 'valid' ELSE 'test' END AS part FROM ev JOIN clocked USING (seq), c), f AS (SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM p WHERE part = 'train') SELECT seq, part, round((value - m) / s, 5) AS standard, round((value - lo) / (hi - lo), 6) AS min_max FROM p, f"),
    "scaled_values": with_sql("SELECT seq, round((value - (SELECT avg(value) FROM clocked)) / (SELECT stddev_pop(value) FROM clocked), 5) AS standard, round((value - (SELECT min(value) FROM clocked)) / ((SELECT max(value) FROM clocked) - (SELECT min(value) FROM clocked)), 6) AS min_max, round(ln(1 + value), 6) AS log FROM clocked"),
    "layer_lists": with_sql(f"SELECT us // {T.HOUR_US} AS graph, event_type, list_sort(list(seq)) AS members FROM clocked GROUP BY ALL"),
    "both_directions": with_sql("SELECT seq, 1 AS direction, value AS v FROM clocked UNION ALL SELECT seq, -1, -value FROM clocked"),
    "group_sizes": with_sql("SELECT t, count(*) AS n FROM ev GROUP BY t"),
    "endpoint_filter": with_sql(", n AS (SELECT src AS node FROM ev GROUP BY src HAVING count(*) > 60) SELECT seq FROM ev WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)"),
}

_STEP = "0.5 * (1 - 0.3 * (nu.a / (nu.a + 10)))"
_ROUTE = ", ".join(f"{_STEP} * m.m{k} + (1 - {_STEP}) * nu.x{k} AS m{k}" for k in range(3))
_MEMORY = f"""WITH RECURSIVE {T.EV}{_FEATURED.split(', nu AS')[0].rsplit('up AS', 1)[0].rstrip().rstrip(',')},
ft AS (SELECT ev.seq, label / 10.0 AS x0, (clock - coalesce(lag(clock) OVER (PARTITION BY dst ORDER BY ev.seq), clock)) / 10000.0 AS x1,
  (degree - (SELECT avg(degree) FROM dd)) / ((SELECT stddev_pop(degree) FROM dd) + 1e-9) AS x2 FROM ev JOIN dd ON dd.seq = ev.seq),"""
_MEMORIES = f"""
m AS (SELECT nu.*, x0 AS m0, x1 AS m1, x2 AS m2 FROM nu WHERE a = 0 UNION ALL SELECT nu.*, {_ROUTE} FROM m JOIN nu ON nu.node = m.node AND nu.a = m.a + 1)"""
_ONCE = "nu AS (SELECT node, ends.seq, e, x0, x1, x2, row_number() OVER (PARTITION BY node ORDER BY ends.seq, e) - 1 AS a FROM ends JOIN ft ON ft.seq = ends.seq),"
_APART = "sqrt(pow(p.m0 - q.m0, 2) + pow(p.m1 - q.m1, 2) + pow(p.m2 - q.m2, 2))"
_SINGLE = "CAST(CAST({} AS FLOAT) AS DOUBLE) + 0.0"
SQL["edge_memory_score"] = f"{_MEMORY}{_ONCE}{_MEMORIES} SELECT p.seq, round({_SINGLE.format(_APART)}, 9) AS score FROM m p JOIN m q ON p.seq = q.seq AND p.e = 0 AND q.e = 1"
SQL["node_memory_ema"] = f'{_MEMORY}{_ONCE}{_MEMORIES} SELECT node, seq, e AS "end", [{", ".join(_SINGLE.format(f"m{k}") for k in range(3))}] AS memory FROM m'
SQL["window_memory_score"] = f"""{_MEMORY}
wi AS (SELECT unnest(range(0, ((SELECT count(*) FROM ev) - 800) // 400 + 1)) AS win), kk AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k FROM ev),
wk AS (SELECT win, seq FROM wi JOIN kk ON k >= win * 400 AND k < win * 400 + 800),
nu AS (SELECT node, win, ends.seq, e, x0, x1, x2, row_number() OVER (PARTITION BY node ORDER BY win, ends.seq, e) - 1 AS a FROM wk JOIN ends ON ends.seq = wk.seq JOIN ft ON ft.seq = wk.seq),{_MEMORIES},
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY node, win ORDER BY seq DESC, e DESC) = 1),
g AS (SELECT p.win, {_APART} AS d FROM l p JOIN l q ON q.node = p.node AND p.win = q.win + 2),
z AS (SELECT win, 0.5 * quantile_cont(d, 0.75) + 0.3 * median(d) + 0.2 * avg(d) AS score FROM g GROUP BY win)
SELECT wi.win AS "window", round(coalesce(score, 0.0), 5) AS score FROM wi LEFT JOIN z ON z.win = wi.win"""
_Z = "CASE WHEN size + 1 >= 3 AND {0} = 0 THEN 0.001 ELSE {0} END"
SQL["zscore_online"] = f"""WITH RECURSIVE {T.EV},
tr AS (SELECT * FROM (SELECT seq, stream_id, clock, lag(path) OVER w AS src, path AS dst FROM paths WINDOW w AS (PARTITION BY stream_id ORDER BY seq)) WHERE src IS NOT NULL),
r AS (SELECT stream_id, seq, src = dst AS idle, CAST(length(dst) AS DOUBLE) AS x, CAST(coalesce(clock - lag(clock) OVER (PARTITION BY stream_id ORDER BY seq), 0) AS DOUBLE) AS y, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS k FROM tr),
z AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, 0 AS predicted, 0 AS size, 0.0::DOUBLE AS m, 0.0::DOUBLE AS n, 0.0::DOUBLE AS v, 0.0::DOUBLE AS w FROM r WHERE k = 1
  UNION ALL
  SELECT stream_id, k, seq, CASE WHEN idle THEN 0 ELSE bad END, CASE WHEN idle THEN size ELSE size + 1 END,
    CASE WHEN idle OR bad = 1 THEN m ELSE nm END, CASE WHEN idle OR bad = 1 THEN n ELSE nn END,
    CASE WHEN idle THEN v WHEN bad = 1 THEN v1 ELSE greatest(0.0, (size * v1 + (x - m) * (x - nm)) / (size + 1)) END,
    CASE WHEN idle THEN w WHEN bad = 1 THEN w1 ELSE greatest(0.0, (size * w1 + (y - n) * (y - nn)) / (size + 1)) END
  FROM (SELECT *, CASE WHEN size + 1 >= 3 AND (abs(x - m) / sqrt(v1) + abs(y - n) / sqrt(w1)) / 2 > 1.5 THEN 1 ELSE 0 END AS bad, m + (x - m) / (size + 2) AS nm, n + (y - n) / (size + 2) AS nn
    FROM (SELECT z.stream_id, r.k, r.seq, idle, x, y, size, m, n, v, w, {_Z.format('v')} AS v1, {_Z.format('w')} AS w1 FROM z JOIN r ON r.stream_id = z.stream_id AND r.k = z.k + 1)))
SELECT seq, predicted FROM z WHERE k > 0"""
