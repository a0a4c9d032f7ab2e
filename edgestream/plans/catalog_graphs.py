"""Queries of walks, samples, splits, layers and graph injections, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import vectors as V
from ..functions.draws import draw_int_sql, draw_sql
from ..operators import embedding as E
from ..operators import graphs as G
from ..operators import injection as I
from ..operators import learning as A
from ..operators import linkstream as L
from ..operators import microcluster as C
from ..operators import relational as R
from ..operators import sampling as W
from . import frames as T
from .catalog_relational import _NORMAL, _PAIR, _VEC, li, nodes, pairs, rounded, supplier_parts, vectors
from .catalog_sequence import _LOGS, _r, ev, halves, with_sql

#: Weights of the layers in the queries below, by a formula.
LAYER = [[round(math.sin(64 * r + k), 3) for k in range(64)] for r in range(4)]
MERGE = [[round(math.cos(128 * r + k), 3) for k in range(128)] for r in range(4)]
OUT = [[0.5, -0.25, 0.125, 1.0], [1.0, 1.0, -1.0, 0.5]]


def graph(s, d):
    """Suppliers and parts, both ways."""
    return G.both_ways(supplier_parts(s, d))


def suppliers(s, d):
    return supplier_parts(s, d).select(F.col("u").alias("node")).distinct()


def walked(s, d, length=4, **how):
    return W.walks(graph(s, d), suppliers(s, d), length, **how)


def upto(s, d, tick):
    return ev(s, d).where(F.col("t") <= tick).select(F.col("src").alias("u"), F.col("dst").alias("v"))


def updated_walks(s, d):
    """The walks of the whole stream, from those before its last tick."""
    last = ev(s, d).agg(F.max("t")).first()[0] or 0
    before = upto(s, d, last - 1)
    old = W.walks(before, before.select(F.col("u").alias("node")), 3)
    touched = ev(s, d).where(F.col("t") == last).select(F.col("src").alias("node"))
    return W.regenerated_walks(old, upto(s, d, last), touched, 3, seed=2)


def asked(s, d):
    number = F.regexp_extract("node", r"(\d+)", 1).cast("long")
    extra = number % 2 == 0
    return suppliers(s, d).select(F.col("node").alias("query"), "node", F.when(extra, F.lit("new")).alias("extra_v"), F.when(extra, F.lit(5.0)).alias("extra_w"))


def weighted(s, d):
    return graph(s, d).groupBy("u", "v").agg(F.count("*").cast("double").alias("w"))


def clustered(s, d):
    return vectors(s, d).select("node", F.col("label").alias("cluster"))


def parts(s, d):
    held = R.node_set(ev(s, d)).withColumn("t", F.lit(0))
    return A.random_split(held, key="node").select("node", "part")


def own_edges(s, d):
    return ev(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v"))


def measured(s, d):
    return ev(s, d).select((F.col("clock") % 7 / 7.0).alias("loss"), (F.col("dst") < "5").cast("int").alias("right"), (F.col("seq") % 3 == 0).cast("int").alias("mask"))


def days(s, d):
    return ev(s, d).withColumn("graph", F.expr("(t - 1) div 24"))


def messages(s, d):
    x = F.array((F.col("clock") % 97).cast("double"), F.col("label").cast("double"))
    return ev(s, d).select(F.explode(F.array("src", "dst")).alias("node"), "clock", x.alias("x"))


def numbered_nodes(s, d):
    return ev(s, d).select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))


def matrix(s, d):
    e = numbered_nodes(s, d)
    return R.dense_adjacency(e, e.agg(F.max(F.greatest("u", "v"))).first()[0] or 0)


def rewired(s, d):
    return I.rewire(ev(s, d), 300, 0.5)


def coded(s, d):
    """Codes of neighbouring vectors, the first half for training; t is the pair's class."""
    e = E.encoded_edges(pairs(s, d), vectors(s, d), "average")
    return e.select("u", "v", F.pmod("u", F.lit(10)).alias("t"), F.when(F.col("u") % 2 == 0, "train").otherwise("test").alias("part"), "code")


def outliers(s, d):
    return E.edge_outliers(coded(s, d), E.class_centres(vectors(s, d)))


def chains(s, d):
    return T.page_paths(s, d).select("seq", F.translate("path", "/", "\\").alias("chain"))


def addresses(s, d):
    octet = lambda k: F.pmod(F.col("seq") * k + F.col("clock"), F.lit(256)).cast("string")
    first = F.element_at(F.array(*map(F.lit, ("10", "172", "192", "8"))), (F.pmod("seq", F.lit(4)) + 1).cast("int"))
    second = F.when(F.pmod("seq", F.lit(8)) == 2, "168").otherwise(octet(3))
    return ev(s, d).select("seq", F.concat_ws(".", first, second, octet(5), octet(7)).alias("ip"))


QUERIES = {
    "random_walks": walked,
    "restart_walks": lambda s, d: walked(s, d, 6, restart=0.2),
    "geometric_walks": lambda s, d: walked(s, d, 8, stop=0.3, per_start=2),
    "walk_words": lambda s, d: W.walk_words(walked(s, d, per_start=3)),
    "walk_lines": lambda s, d: W.walk_lines(walked(s, d, per_start=3)),
    "context_pairs": lambda s, d: W.context_pairs(walked(s, d, per_start=3)),
    "neighbour_reservoirs": lambda s, d: W.neighbour_reservoirs(ev(s, d), 4),
    "regenerated_walks": updated_walks,
    "multi_hop_fanout": lambda s, d: W.hops(graph(s, d), suppliers(s, d), [3, 2]),
    "weighted_neighbours": lambda s, d: W.weighted_neighbours(weighted(s, d), asked(s, d)),
    "negative_samples": lambda s, d: W.negative_samples(supplier_parts(s, d), 2),
    "shuffled_batches": lambda s, d: W.shuffled_batches(ev(s, d).select("seq"), "seq", 64, epoch=3),
    "cross_cluster_pairs": lambda s, d: W.cross_cluster_pairs(clustered(s, d), pairs(s, d), 50),
    "sample_rows": lambda s, d: W.sample_rows(ev(s, d).select("seq", "src"), "seq", 200),
    "noisy_vectors": lambda s, d: W.noisy(vectors(s, d).select("node", "x"), "node").select("node", rounded("x")),
    "train_edges": lambda s, d: A.train_edges(own_edges(s, d), parts(s, d)),
    "usable_nodes": lambda s, d: A.usable_nodes(parts(s, d), own_edges(s, d)),
    "pruned_valid_edges": lambda s, d: A.pruned_valid_edges(own_edges(s, d), parts(s, d)),
    "dense_layer": lambda s, d: vectors(s, d).select("node", A.dense(F.col("x"), LAYER, [0.1] * 4, A.RELU).alias("x")).select("node", rounded("x")),
    "merge_mlp": lambda s, d: E.encoded_edges(pairs(s, d), vectors(s, d)).select("u", "v").join(vectors(s, d).select(F.col("node").alias("u"), F.col("x").alias("p")), "u").join(vectors(s, d).select(F.col("node").alias("v"), F.col("x").alias("q")), "v").select("u", "v", A.merge_mlp(F.col("p"), F.col("q"), MERGE, OUT).alias("x")).select("u", "v", rounded("x")),
    "pooled_neighbours_max": lambda s, d: A.pooled_neighbours(pairs(s, d), vectors(s, d), LAYER).select("node", rounded("x")),
    "masked_measures": lambda s, d: A.masked_measures(measured(s, d)).select(*_r("loss", "accuracy")),
    "shadow_mean": lambda s, d: A.shadow_mean(ev(s, d).select("seq", (F.col("clock") % 100).cast("double").alias("x")), "x").select("seq", *_r("shadow")),
    "gradient": lambda s, d: A.gradient(R.activity(ev(s, d)), "activity", "t").select("t", "gradient"),
    "class_predictions": lambda s, d: A.class_predictions(vectors(s, d)),
    "kmeans": lambda s, d: E.kmeans(vectors(s, d), 8)[0],
    "largest_graphs": lambda s, d: R.largest_graphs(days(s, d), 5),
    "merged_graph": lambda s, d: R.merged_graph(days(s, d), R.largest_graphs(days(s, d), 5)),
    "merged_nodes": lambda s, d: R.merged_nodes(days(s, d).select("graph", F.col("dst").alias("id"), "seq", F.col("src").alias("value")), R.largest_graphs(days(s, d), 1)),
    "first_minutes": lambda s, d: R.first_values(ev(s, d).select("seq", F.expr("clock div 60").alias("minute")), "minute", 5),
    "message_mean": lambda s, d: R.last_message(messages(s, d), "clock").select("node", rounded("x"), "last"),
    "positions_in": lambda s, d: R.positions_in(ev(s, d).select("seq", "src"), ev(s, d).where("label = 1").select("seq", F.col("dst").alias("src")), "src", "seq").select("seq", "src", "position"),
    "dense_adjacency": matrix,
    "complement_pairs": lambda s, d: R.complement_pairs(ev(s, d).select(F.col("src").alias("node")), ev(s, d).select(F.col("dst").alias("node")), ev(s, d)),
    "rewire": rewired,
    "injected_stream": lambda s, d: R.injected_stream(ev(s, d), rewired(s, d)),
    "random_injection": lambda s, d: I.at_random(*halves(s, d)).select("seq", "clock", "path", "label"),
    "block_model": lambda s, d: I.block_model(T.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("node"), F.col("s_nationkey").alias("block")), 10, 0.3, 0.05),
    "star_spread": lambda s, d: I.spread_over_out_edges(weighted(s, d).select(F.col("u").alias("src"), F.col("v").alias("dst")), "s1", 1000),
    "clique_edges": lambda s, d: I.clique(ev(s, d).where("label = 1").select(F.col("dst").alias("node")).distinct()),
    "attention": lambda s, d: E.attention(pairs(s, d).unionAll(pairs(s, d).select(F.col("v").alias("u"), F.col("u").alias("v"))), vectors(s, d)).select("node", rounded("x")),
    "gcn_aggregate": lambda s, d: E.gcn_aggregate(pairs(s, d), vectors(s, d)).select("node", rounded("x")),
    "graph_readout": lambda s, d: E.graph_readout(vectors(s, d).withColumnRenamed("label", "graph"), how="max").select("graph", rounded("x")),
    "drift_score": lambda s, d: E.encoded_edges(pairs(s, d), vectors(s, d)).select("u", "v").join(vectors(s, d).select(F.col("node").alias("u"), F.col("x").alias("p")), "u").join(vectors(s, d).select(F.col("node").alias("v"), F.col("x").alias("q")), "v").select("u", F.round(E.drift_score(F.col("p"), F.col("q"), F.zip_with("p", "q", lambda a, b: a + 2 * b)), 5).alias("score")),
    "edge_outliers": lambda s, d: outliers(s, d).select("u", "v", "t", "part", F.round("score", 5).alias("score"), "outlier"),
    "snapshot_distance": lambda s, d: E.snapshot_distance(outliers(s, d)).select("t", F.round("score", 5).alias("score")),
    "cosine_basis": lambda s, d: ev(s, d).select("seq", F.transform(V.cosine_basis(F.col("clock") % 1000, F.array(F.lit(0.5), F.lit(0.01)), F.array(F.lit(0.0), F.lit(1.0))), lambda x: F.round(x, 5) + 0.0).alias("code")),
    "signed_min_max": lambda s, d: vectors(s, d).select("node", F.transform(V.min_max(F.col("x"), F.array_repeat(F.lit(0.0), 64), F.array_repeat(F.lit(4.0), 64)), lambda x: F.round(x, 6) + 0.0).alias("x")),
    "carried_forward": lambda s, d: G.carried_forward(R.activity(ev(s, d).where("label = 1")), "activity"),
    "chain_depth": lambda s, d: chains(s, d).select("seq", F.size(P.chain_parts(F.col("chain"))).alias("depth"), F.element_at(P.chain_parts(F.col("chain")), -1).alias("last")),
    "private_addresses": lambda s, d: addresses(s, d).select("seq", "ip", P.is_private_ip(F.col("ip")).alias("private")),
    "address_ids": lambda s, d: ev(s, d).select("seq", P.bytes_mod(F.col("src")).alias("id")),
    "graph_spectrum": lambda s, d: L.node_scores(ev(s, d), nodes(s, d), 10, 100, with_spectrum=True).select("node", "t", "level", "place", *_r("value")),
    "top_bins": lambda s, d: R.top_frequencies(R.snapshot_rollup(C.normal(ev(s, d)), "max").select(F.col("t").cast("string").alias("src"), F.lit("").alias("dst"), F.round("score", 6).alias("f")), 10).select(F.col("src").alias("t"), "f"),
    "undirected_closure": lambda s, d: G.both_ways(li(s, d)).distinct(),
}

# --- SQL ---------------------------------------------------------------------------------------

_GRAPH = f"{T.LI}, sg AS (SELECT 's' || u AS u, 'p' || v AS v FROM li), b AS (SELECT u, v FROM sg UNION ALL SELECT v, u FROM sg), st AS (SELECT DISTINCT u AS node FROM sg)"


_RESERVOIRS = f", b AS (SELECT seq, 0 AS e, src AS node, dst AS other FROM ev UNION ALL SELECT seq, 1, dst, src FROM ev), a AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq, e) AS d FROM b), k AS (SELECT *, unnest(range(4)) AS slot FROM a), rs AS (SELECT node, slot, max_by(other, d) AS other FROM k WHERE {draw_sql(1, 'node', 'slot', 'd')} * d < 1 GROUP BY node, slot)"


def _neighbours(name: str, edges: str) -> str:
    return f", {name} AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY u) AS fan FROM (SELECT DISTINCT u, v FROM {edges}))"


def _walks(name: str, starts: str, table: str, length: int, seed: int = 1, restart: float = 0.0, stop: float = 0.0, per_start: int = 1) -> str:
    out = f", {name}0 AS (SELECT node AS start, walk, [node] AS path, node AS here FROM (SELECT DISTINCT node FROM {starts}), (SELECT unnest(range({per_start})) AS walk))"
    for k in range(length):
        keys = ("start", "walk", str(k))
        at = f"CASE WHEN {draw_sql(f'{seed}s', *keys)} < {stop} THEN NULL ELSE here END" if stop else "here"
        back = f"{draw_sql(f'{seed}r', *keys)} < {restart}" if restart else "false"
        out += f""", {name}{k + 1} AS (SELECT start, walk, CASE WHEN nx IS NULL THEN path ELSE list_append(path, nx) END AS path, nx AS here FROM (
  SELECT a.start, a.walk, a.path, CASE WHEN a.now IS NOT NULL AND a.back THEN a.start ELSE n.v END AS nx
  FROM (SELECT *, {at} AS now, {back} AS back, {draw_int_sql(seed, *keys)} AS x FROM {name}{k}) a LEFT JOIN (SELECT DISTINCT u, fan FROM {table}) f ON f.u = a.now LEFT JOIN {table} n ON n.u = a.now AND n.k = a.x % f.fan))"""
    return out


def _walked(length: int = 4, **how) -> str:
    return f"WITH {_GRAPH}{_neighbours('nt', 'b')}{_walks('w', 'st', 'nt', length, **how)}"


def _layer(x: str, weights: list[list[float]], bias: float = 0.0, relu: bool = False) -> str:
    row = lambda w: f"list_sum(list_transform(range(1, {len(w) + 1}), lambda i: {x}[i] * ({w})[i])) + {bias}"
    return "[" + ", ".join(f"greatest({row(w)}, 0.0)" if relu else row(w) for w in weights) + "]"


_ROUNDED = "list_transform({}, lambda y: round(y, 5) + 0.0)"
_SPLIT = """, ns AS (SELECT src AS node FROM ev UNION SELECT dst FROM ev), pp AS (SELECT node, percent_rank() OVER (ORDER BY md5('7-' || node)) AS p FROM ns),
pa AS (SELECT node, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'valid' ELSE 'test' END AS part FROM pp), e AS (SELECT src AS u, dst AS v FROM ev),
tn AS (SELECT node FROM pa WHERE part = 'train'), te AS (SELECT u, v FROM e WHERE u IN (FROM tn) AND v IN (FROM tn))"""
_DAYS = """, dy AS (SELECT *, (t - 1) // 24 AS graph FROM ev), gn AS (SELECT graph, count(DISTINCT node) AS n_nodes FROM (SELECT graph, src AS node FROM dy UNION ALL SELECT graph, dst FROM dy) GROUP BY graph),
lg AS (SELECT graph, n_nodes, n_edges FROM gn JOIN (SELECT graph, count(*) AS n_edges FROM dy GROUP BY graph) USING (graph) ORDER BY n_nodes DESC, graph LIMIT 5)"""
_REWIRE = f""", nw AS (SELECT DISTINCT src, dst FROM ev WHERE t = 300), gone AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {draw_int_sql(2, 'dst')}, dst) AS k FROM nw WHERE {draw_sql(1, 'src', 'dst')} < 0.5),
past AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {draw_int_sql(1, 'dst')}, dst) AS k FROM (SELECT src, dst FROM ev WHERE t < 300 EXCEPT SELECT src, dst FROM nw)),
rw AS (SELECT src, dst, 300 AS t, 'removed' AS change FROM gone UNION ALL SELECT src, dst, 300, 'added' FROM past WHERE (src, k) IN (SELECT (src, k) FROM gone))"""
_CENTRES = ", f AS (SELECT label, i, avg(x[i]) AS m FROM (SELECT label, x, unnest(range(1, 65)) AS i FROM v) GROUP BY ALL)"
_OUTLIERS = _PAIR + _CENTRES + """, cd AS (SELECT u, v, u % 10 AS t, CASE WHEN u % 2 = 0 THEN 'train' ELSE 'test' END AS part, i, (p[i] + q[i]) / 2 AS y FROM (SELECT *, unnest(range(1, 65)) AS i FROM e)),
ds AS (SELECT u, v, t, part, label, sqrt(sum(pow(y - m, 2))) AS d FROM cd JOIN f USING (i) GROUP BY ALL), sc AS (SELECT u, v, t, part, min(d) AS score FROM ds GROUP BY ALL)"""
_CHAIN = f"WITH {T.URL}, c AS (SELECT seq, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM urls)"

SQL = {
    "random_walks": _walked() + " SELECT start, walk, path FROM w4",
    "restart_walks": _walked(6, restart=0.2) + " SELECT start, walk, path FROM w6",
    "geometric_walks": _walked(8, stop=0.3, per_start=2) + " SELECT start, walk, path FROM w8",
    "walk_words": _walked(per_start=3) + " SELECT node, count(*) AS n FROM (SELECT unnest(path) AS node FROM w4) GROUP BY node",
    "walk_lines": _walked(per_start=3) + " SELECT array_to_string(path, ' ') AS line FROM w4",
    "context_pairs": _walked(per_start=3) + " SELECT start AS node, context FROM (SELECT start, unnest(path[2:]) AS context FROM w4) WHERE start <> context",
    "neighbour_reservoirs": with_sql(_RESERVOIRS + " SELECT * FROM rs"),
    "regenerated_walks": with_sql(", o AS (SELECT src AS u, dst AS v FROM ev WHERE t < (SELECT max(t) FROM ev)), g AS (SELECT src AS u, dst AS v FROM ev), os AS (SELECT u AS node FROM o), ts AS (SELECT DISTINCT src AS node FROM ev WHERE t = (SELECT max(t) FROM ev))" + _neighbours("nt", "o") + _neighbours("mt", "g") + _walks("w", "os", "nt", 3) + _walks("y", "ts", "mt", 3, seed=2) + " SELECT start, walk, path FROM w3 WHERE start NOT IN (FROM ts) UNION ALL SELECT start, walk, path FROM y3"),
    "multi_hop_fanout": f"WITH {_GRAPH}{_neighbours('nt', 'b')}, fa AS (SELECT DISTINCT u, fan FROM nt), h0 AS (SELECT node AS root, 0 AS hop, CAST(0 AS BIGINT) AS place, node FROM st)"
    + "".join(f", p{h} AS (SELECT root, place * {n} + i AS place, node, fan FROM h{h - 1} JOIN fa ON u = node, (SELECT unnest(range({n})) AS i)), h{h} AS (SELECT root, {h} AS hop, place, v AS node FROM p{h} JOIN nt ON nt.u = p{h}.node AND nt.k = {draw_int_sql(1, 'root', str(h), 'place')} % p{h}.fan)" for h, n in ((1, 3), (2, 2)))
    + " SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2",
    "weighted_neighbours": f"WITH {_GRAPH}, m AS (SELECT u, v, count(*) AS w FROM b GROUP BY ALL), o AS (SELECT node AS query, u, v, w FROM st JOIN m ON u = node UNION ALL SELECT node, node, 'new', 5 FROM st WHERE CAST(substr(node, 2) AS BIGINT) % 2 = 0), s AS (SELECT query, u, v, sum(w) OVER (PARTITION BY query ORDER BY v) AS upto, sum(w) OVER (PARTITION BY query) AS total FROM o) SELECT query, u AS node, min_by(v, upto) AS other FROM s WHERE upto > {draw_sql(1, 'query')} * total GROUP BY ALL",
    "negative_samples": f"WITH {_GRAPH}, wt AS (SELECT u AS node, round(pow(count(*), 0.75), 6) AS w FROM b GROUP BY u), c AS (SELECT node, sum(w) OVER (ORDER BY node) AS upto FROM wt), d AS (SELECT u, v, i, {draw_sql(1, 'u', 'v', 'i')} * (SELECT max(upto) FROM c) AS x FROM (SELECT DISTINCT u, v FROM sg), (SELECT unnest(range(2)) AS i)) SELECT u, v, i, node AS negative FROM d ASOF JOIN c ON d.x < c.upto",
    "shuffled_batches": with_sql(f", o AS (SELECT seq, row_number() OVER (ORDER BY {draw_int_sql(1, '3', 'seq')}, seq) - 1 AS n FROM ev) SELECT seq, n // 64 AS batch, n % 64 AS place FROM o"),
    "cross_cluster_pairs": f"WITH {_VEC}, pl AS (SELECT node, label, row_number() OVER (ORDER BY node) - 1 AS k FROM v), d AS (SELECT id, {draw_int_sql('1a', 'id')} % (SELECT count(*) FROM v) AS a, {draw_int_sql('1b', 'id')} % (SELECT count(*) FROM v) AS b FROM (SELECT unnest(range(200)) AS id)), p AS (SELECT id, least(x.node, y.node) AS u, greatest(x.node, y.node) AS v FROM d JOIN pl x ON x.k = a JOIN pl y ON y.k = b WHERE x.label <> y.label), g AS (SELECT u, v, min(id) AS id FROM p WHERE v <> u + 1 GROUP BY ALL) SELECT u, v FROM g ORDER BY id LIMIT 50",
    "sample_rows": with_sql(f"SELECT seq, src FROM ev ORDER BY {draw_int_sql(1, 'seq')}, seq LIMIT 200"),
    "noisy_vectors": f"WITH {_VEC} SELECT node, list_transform(range(64), lambda i: round(x[i + 1] + 0.1 * {draw_sql(1, 'node', 'i')}, 5) + 0.0) AS x FROM v",
    "reservoir_sample": with_sql(f"SELECT seq, src, dst FROM ev ORDER BY log10(({draw_int_sql(1, 'seq')} + 1) / {float((1 << 28) + 1)}) / weight DESC, seq LIMIT 200"),
    "fixed_fanout": f"WITH {T.LI}, o AS (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY {draw_int_sql(1, 'u', 'v')}, v) AS k FROM (SELECT DISTINCT u, v FROM li)), l AS (SELECT u, list(v ORDER BY k) AS s FROM o WHERE k <= 8 GROUP BY u) SELECT u AS node, list_transform(range(8), lambda i: s[i % len(s) + 1]) AS sample FROM l",
    "train_edges": with_sql(_SPLIT + " SELECT u, v FROM te"),
    "usable_nodes": with_sql(_SPLIT + ", dt AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM te UNION ALL SELECT v FROM te) GROUP BY node), da AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node) SELECT node, part, degree FROM pa JOIN dt USING (node) WHERE part = 'train' UNION ALL SELECT node, part, degree FROM pa JOIN da USING (node) WHERE part <> 'train'"),
    "pruned_valid_edges": with_sql(_SPLIT + ", sn AS (SELECT u AS node FROM te UNION SELECT v FROM te), lost AS (SELECT node FROM tn EXCEPT SELECT node FROM sn) SELECT u, v FROM e WHERE (u, v) NOT IN (SELECT (u, v) FROM te) AND u NOT IN (FROM lost) AND v NOT IN (FROM lost)"),
    "dense_layer": f"WITH {_VEC} SELECT node, {_ROUNDED.format(_layer('x', LAYER, 0.1, True))} AS x FROM v",
    "merge_mlp": f"{_PAIR}, h AS (SELECT u, v, {_layer('z', MERGE, relu=True)} AS h FROM (SELECT u, v, list_concat(p, q) AS z FROM e)) SELECT u, v, {_ROUNDED.format(_layer('h', OUT))} AS x FROM h",
    "pooled_neighbours_max": f"{_PAIR}, h AS (SELECT u, {_layer('q', LAYER, relu=True)} AS h FROM e) SELECT u AS node, [{', '.join(f'round(max(h[{k}]), 5) + 0.0' for k in range(1, 5))}] AS x FROM h GROUP BY u",
    "masked_measures": with_sql("SELECT round(avg(clock % 7 / 7.0), 6) AS loss, round(avg(CAST(dst < '5' AS INT)), 6) AS accuracy FROM ev WHERE seq % 3 = 0"),
    "shadow_mean": with_sql(", k AS (SELECT seq, clock % 100 AS x, row_number() OVER (ORDER BY seq) - 1 AS k FROM ev) SELECT seq, round(pow(0.99, k) * sum(x * CASE WHEN k = 0 THEN 1 ELSE 0.01::DOUBLE END * pow(0.99, -k)) OVER (ORDER BY seq), 6) AS shadow FROM k"),
    "gradient": with_sql(", a AS (SELECT t, sum(weight) AS x FROM ev GROUP BY t), l AS (SELECT t, x, lag(x) OVER (ORDER BY t) AS p, lead(x) OVER (ORDER BY t) AS n FROM a) SELECT t, CASE WHEN p IS NULL THEN n - x WHEN n IS NULL THEN x - p ELSE (n - p) / 2 END AS gradient FROM l"),
    "largest_graphs": with_sql(_DAYS + " SELECT * FROM lg"),
    "merged_graph": with_sql(_DAYS + " SELECT src, dst, count(*) AS n FROM dy WHERE graph IN (SELECT graph FROM lg) GROUP BY ALL"),
    "merged_nodes": with_sql(_DAYS + " SELECT dst AS id, max_by(src, seq) AS value FROM dy WHERE graph = (SELECT graph FROM lg ORDER BY n_nodes DESC, graph LIMIT 1) GROUP BY dst"),
    "first_minutes": with_sql(", m AS (SELECT seq, clock // 60 AS minute FROM ev) SELECT seq, minute FROM m WHERE minute IN (SELECT DISTINCT minute FROM m ORDER BY minute LIMIT 5)"),
    "message_mean": with_sql(", m AS (SELECT src AS node, clock, label FROM ev UNION ALL SELECT dst, clock, label FROM ev) SELECT node, [round(avg(clock % 97), 5), round(avg(label), 5)] AS x, max(clock) AS last FROM m GROUP BY node"),
    "positions_in": with_sql(", f AS (SELECT dst, row_number() OVER (ORDER BY min(seq)) AS k FROM ev WHERE label = 1 GROUP BY dst) SELECT seq, src, coalesce(k, 0) AS position FROM ev LEFT JOIN f ON f.dst = src"),
    "dense_adjacency": with_sql(", z AS (SELECT CAST(src AS BIGINT) AS u, CAST(dst AS BIGINT) AS v FROM ev), y AS (SELECT u, v FROM z UNION SELECT v, u FROM z), n AS (SELECT max(u) AS n FROM y), r AS (SELECT unnest(range(1, (FROM n) + 1)) AS u), l AS (SELECT u, list(v) AS s FROM y GROUP BY u) SELECT r.u, list_transform(range(1, (FROM n) + 1), lambda k: CAST(coalesce(list_contains(s, k), false) AS INTEGER)) AS row FROM r LEFT JOIN l ON l.u = r.u"),
    "complement_pairs": with_sql("SELECT a.src, b.dst FROM (SELECT DISTINCT src FROM ev) a, (SELECT DISTINCT dst FROM ev) b WHERE a.src <> b.dst EXCEPT SELECT src, dst FROM ev"),
    "rewire": with_sql(_REWIRE + " SELECT * FROM rw"),
    "injected_stream": with_sql(_REWIRE + " SELECT src, dst, t, CAST(t IN (SELECT t FROM rw) AS INTEGER) AS label FROM (SELECT src, dst, t FROM ev EXCEPT SELECT src, dst, t FROM rw WHERE change = 'removed' UNION SELECT src, dst, t FROM rw WHERE change = 'added')"),
    "random_injection": with_sql(f"{_LOGS}, al AS (SELECT seq AS p, 0 AS side, seq, clock, path, label FROM benign UNION ALL SELECT {draw_int_sql(1, 'seq')} % ((SELECT max(seq) FROM benign) + 1), 1, seq, clock, path, label FROM bad) SELECT row_number() OVER (ORDER BY p, side, seq) AS seq, clock, path, label FROM al"),
    "block_model": f"WITH n AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_nationkey AS b FROM supplier), t AS (SELECT unnest(range(1, 11)) AS t) SELECT a.k AS src, c.k AS dst, t FROM n a, n c, t WHERE a.k < c.k AND {draw_sql(1, 'a.k', 'c.k', 't')} < CASE WHEN a.b IS NOT DISTINCT FROM c.b THEN 0.3 ELSE 0.05 END",
    "star_spread": f"WITH {_GRAPH}, o AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT v FROM b WHERE u = 's1')) SELECT 's1' AS src, v AS dst, 1000 // n + CASE WHEN k = 1 THEN 1000 - 1000 // n * n ELSE 0 END AS extra FROM o WHERE 1000 // n + CASE WHEN k = 1 THEN 1000 - 1000 // n * n ELSE 0 END > 0",
    "clique_edges": with_sql(", k AS (SELECT DISTINCT dst AS node FROM ev WHERE label = 1) SELECT a.node AS src, b.node AS dst FROM k a JOIN k b ON a.node < b.node"),
    "attention": _PAIR + ", y AS (SELECT u, v, p, q FROM e UNION ALL SELECT v, u, q, p FROM e), s AS (SELECT u, q, list_sum(list_transform(range(1, 65), lambda i: p[i] * q[i])) / 8 AS s FROM y), w AS (SELECT u, q, exp(s - max(s) OVER (PARTITION BY u)) AS w FROM s), z AS (SELECT u, i, sum(w * q[i]) / sum(w) AS y FROM (SELECT *, unnest(range(1, 65)) AS i FROM w) GROUP BY ALL) SELECT u AS node, list(round(y, 5) + 0.0 ORDER BY i) AS x FROM z GROUP BY u",
    "gcn_aggregate": f"WITH {_VEC} SELECT a.node, list_transform(range(1, 65), lambda i: round(CASE WHEN b.x IS NULL THEN a.x[i] ELSE (a.x[i] + b.x[i]) / 2 END, 5) + 0.0) AS x FROM v a LEFT JOIN v b ON b.node = a.node + 1",
    "graph_readout": f"WITH {_VEC}, y AS (SELECT label AS graph, i, max(x[i]) AS m FROM (SELECT *, unnest(range(1, 65)) AS i FROM v) GROUP BY ALL) SELECT graph, list(round(m, 5) + 0.0 ORDER BY i) AS x FROM y GROUP BY graph",
    "drift_score": _PAIR + ", z AS (SELECT u, p, q, list_transform(range(1, 65), lambda i: p[i] + 2 * q[i]) AS r FROM e) SELECT u, round((2 - list_cosine_similarity(p, q) - list_cosine_similarity(p, r)) / 4, 5) AS score FROM z",
    "edge_outliers": _OUTLIERS + " SELECT u, v, t, part, round(score, 5) AS score, score > (SELECT max(score) FROM sc WHERE part = 'train') AS outlier FROM sc",
    "snapshot_distance": _OUTLIERS + " SELECT t, round(avg(score), 5) AS score FROM sc GROUP BY t",
    "cosine_basis": with_sql("SELECT seq, [round(cos(clock % 1000 * 0.5::DOUBLE), 5) + 0.0, round(cos(clock % 1000 * 0.01::DOUBLE + 1), 5) + 0.0] AS code FROM ev"),
    "signed_min_max": f"WITH {_VEC} SELECT node, list_transform(x, lambda y: round(y / 4, 6) + 0.0) AS x FROM v",
    "carried_forward": with_sql(", a AS (SELECT t, sum(weight) AS x FROM ev WHERE label = 1 GROUP BY t), s AS (SELECT unnest(range((SELECT min(t) FROM a), (SELECT max(t) FROM a) + 1)) AS t) SELECT s.t, last_value(x IGNORE NULLS) OVER (ORDER BY s.t) AS activity FROM s LEFT JOIN a ON a.t = s.t"),
    "chain_depth": _CHAIN + " SELECT seq, len(p) AS depth, p[-1] AS last FROM c",
    "private_addresses": with_sql(", o AS (SELECT seq, ['10', '172', '192', '8'][seq % 4 + 1] AS a, CASE WHEN seq % 8 = 2 THEN 168 ELSE (seq * 3 + clock) % 256 END AS b, (seq * 5 + clock) % 256 AS c, (seq * 7 + clock) % 256 AS d FROM ev) SELECT seq, concat_ws('.', a, b, c, d) AS ip, a = '10' OR (a = '172' AND b BETWEEN 16 AND 31) OR (a = '192' AND b = 168) AS private FROM o"),
    "address_ids": with_sql("SELECT seq, CAST(list_sum(list_transform(range(1, len(src) + 1), lambda i: CAST(ascii(src[i]) AS HUGEINT) * CAST(pow(256, i - 1) AS HUGEINT))) % 100000000 AS BIGINT) AS id FROM ev"),
    "top_bins": with_sql(f"{_NORMAL}, m AS (SELECT t, max(score) AS f FROM sc GROUP BY t) SELECT CAST(t AS VARCHAR) AS t, f FROM m ORDER BY f DESC, CAST(t AS VARCHAR) LIMIT 10"),
    "undirected_closure": f"WITH {T.LI} SELECT u, v FROM li UNION SELECT v, u FROM li",
}
