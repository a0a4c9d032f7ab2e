"""Queries that write a format and read it again: readers and writers of every file format, with their SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as M
from ..operators import graphs as G
from ..operators import relational as R
from ..sources import readers as S
from ..sources import writers as K
from . import frames as T
from .catalog_formats import _IDS
from .catalog_relational import _CUM, _NORMAL, li, scored
from .catalog_sequence import ev, with_sql


def _folder(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder (a temporary one in local tests), deleted when the session ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="edgestream-")
    path = f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"

    def forget() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have ended first
            return

    atexit.register(forget)
    return path


def through(write, read):
    """A query that writes below a new path and reads what it wrote."""

    def run(spark, sf_dir):
        path = _folder(spark)
        write(spark, sf_dir, path)
        return read(spark, path)

    return run


def log_rows(s, d):
    p = T.events_paths(s, d)
    return p.select(F.col("seq").alias("id"), F.lit("2024-01-02").alias("date"), F.concat(F.lit("03:04:"), F.lpad((F.col("clock") % 60).cast("string"), 2, "0")).alias("time"), F.col("clock").alias("session_id"), F.lit(1).alias("depth"), "path", "seq")


def chain_lines(s, d):
    chain = F.translate(F.translate("path", ",", "_"), "/", "\\")
    return T.page_paths(s, d).select(F.concat_ws(",", chain, F.concat(chain, F.lit("\\x")), F.concat(F.col("seq").cast("string"), F.lit(".5")), F.lit("1")).alias("value"))


def json_lines(s, d):
    ip = lambda c: F.concat(F.lit("10.0.0."), c)
    ts = F.date_format(F.timestamp_seconds("clock"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return ev(s, d).select(F.to_json(F.struct(F.when(F.col("seq") % 10 == 0, "no time").otherwise(ts).alias("timestamp"), F.struct(ip("src").alias("src_ip"), ip("dst").alias("dest_ip")).alias("properties"))).alias("value"))


def flows(s, d):
    return ev(s, d).select(F.col("seq").cast("string").alias("Flow ID"), F.col("src").alias("Src IP"), F.col("dst").alias("Dst IP"), F.date_format(F.timestamp_seconds("clock"), "dd/MM/yyyy hh:mm:ss a").alias("Timestamp"), F.col("label").alias("Label"))


def day_graphs(s, d):
    """Nodes and links of day graphs; every seventh node is for tests, every fifth of them has no such mark."""
    held = ev(s, d).where("src <> dst").select(F.expr("1000 + (t - 1) div 24").cast("string").alias("graph"), F.col("src").cast("long").alias("source"), F.col("dst").cast("long").alias("target")).distinct()
    ids = held.select("graph", F.explode(F.array("source", "target")).alias("id")).distinct()
    mark = F.when(F.col("id") % 35 != 0, F.col("id") % 7 == 0)
    nodes = ids.select("graph", "id", F.array(F.col("id").cast("double")).alias("features"), F.lit(1).alias("label"), mark.alias("test"), F.when(mark.isNotNull(), F.lit(False)).alias("val"), F.lit("ip").alias("ip"), F.lit("f").alias("flow_id"))
    return nodes, held


def numbered_graphs(s, d):
    """Day graphs with nodes from 0 and their neighbours; the day's parity is the label."""
    days = ev(s, d).where("src <> dst").select(F.expr("(t - 1) div 24").alias("graph"), F.col("src").alias("u"), F.col("dst").alias("v"))
    both = days.unionAll(days.select("graph", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    ids = both.select("graph", "u").distinct().withColumn("node", F.row_number().over(Window.partitionBy("graph").orderBy("u")) - 1)
    named = both.join(ids, ["graph", "u"]).join(ids.withColumnsRenamed({"u": "v", "node": "other"}), ["graph", "v"])
    nodes = named.groupBy("graph", "node", "u").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))
    return nodes.select("graph", "node", F.length("u").alias("tag"), "neighbours"), days.select("graph", (F.col("graph") % 2).alias("label")).distinct()


def small_graph(s, d):
    return G.undirected(li(s, d))


QUERIES = {
    "file_snapshot": through(lambda s, d, p: K.write_snapshot(ev(s, d), p), lambda s, p: S.snapshot_edges(s, p).drop("seq")),
    "file_padded": through(lambda s, d, p: K.write_padded(ev(s, d), p, 1800), lambda s, p: S.snapshot_edges(s, p).drop("seq")),
    "file_weighted": through(lambda s, d, p: K.write_weighted(ev(s, d), p), lambda s, p: S.weighted_edges(s, p).drop("seq")),
    "file_column_split": through(lambda s, d, p: K.write_column_split(ev(s, d), p), lambda s, p: S.column_split_stream(s, f"{p}/data", f"{p}/label", f"{p}/shape").drop("seq")),
    "file_link_stream": through(lambda s, d, p: K.write_query_files(ev(s, d), p), lambda s, p: S.link_stream(s, f"{p}/data")),
    "file_query_pairs": through(lambda s, d, p: K.write_query_files(ev(s, d), p), lambda s, p: s.read.csv(f"{p}/queries", schema="src string, dst string")),
    "file_keyed_values": through(lambda s, d, p: ev(s, d).select("src", "dst", "seq", "clock").write.csv(p), lambda s, p: S.keyed_values(s, p, "src string, dst string, t long", "score double")),
    "file_interactions": through(lambda s, d, p: K.write_interactions(ev(s, d), p), S.interactions),
    "file_strict_edges": through(lambda s, d, p: K.write_columns(ev(s, d), p, ["clock", "src", "dst", "label"]), lambda s, p: S.strict_edges(s, p).drop("seq")),
    "file_memory_edges": through(lambda s, d, p: K.write_columns(ev(s, d), p, ["src", "dst", "clock", "label"]), lambda s, p: S.memory_edges(s, p).drop("seq")),
    "file_spaced_edges": through(lambda s, d, p: K.write_columns(ev(s, d), p, ["clock", "src", "dst", "label"], " "), lambda s, p: S.spaced_edges(s, p).drop("seq")),
    "file_log": through(lambda s, d, p: K.write_log(log_rows(s, d).withColumn("seq", F.col("id")), p), lambda s, p: S.access_log(s, p, S.role_label("malicious")).drop("seq")),
    "file_path_chains": through(lambda s, d, p: chain_lines(s, d).write.text(p), lambda s, p: S.path_chain_log(s, p).drop("seq")),
    "file_scores": through(lambda s, d, p: K.write_scores(scored(s, d).withColumn("score", F.col("score").cast("decimal(30,6)")), p), lambda s, p: S.score_or_topk(s, p)),
    "file_result": through(lambda s, d, p: K.write_result(scored(s, d).withColumn("score", F.col("score").cast("decimal(30,6)")), p, ["seq"]), lambda s, p: s.read.csv(p, schema="seq long, score double")),
    "file_roc": through(lambda s, d, p: K.write_roc(M.roc_points(scored(s, d)).withColumns({k: F.round(k, 6) for k in ("fpr", "tpr")}), p), lambda s, p: s.read.csv(p, header=True, schema="fpr double, tpr double")),
    "file_topk": through(lambda s, d, p: K.write_topk(M.top_k(scored(s, d), list(range(50, 801, 50))), p), lambda s, p: S.score_or_topk(s, p)),
    "file_spreadsheet": through(lambda s, d, p: K.write_spreadsheet(ev(s, d).select("seq", "label", F.concat(F.lit("<&"), "src").alias("src")), p, ["seq", "label", "src"], "seq"), lambda s, p: s.read.text(p).where("value like '<Row>%'")),
    "file_by_minute": through(lambda s, d, p: K.write_by_minute(ev(s, d).select("seq", "src", F.expr("clock div 36000").alias("minute")), p), lambda s, p: s.read.schema("seq long, src string, minute long").csv(p)),
    "file_json_events": through(lambda s, d, p: json_lines(s, d).write.option("compression", "gzip").text(f"{p}/a/b"), lambda s, p: S.json_events(s, p).select(F.unix_timestamp("ts").alias("clock"), "src", "dst")),
    "file_flows": through(lambda s, d, p: flows(s, d).write.csv(p, header=True), lambda s, p: S.coerced(S.flow_table(s, p).select(F.col("Flow ID").alias("flow"), F.unix_timestamp("ts").alias("ts"), F.unix_timestamp("minute").alias("minute"), F.col("Label").alias("label")), flow="long", label="int")),
    "file_node_links": through(lambda s, d, p: K.write_node_links(*day_graphs(s, d), p), lambda s, p: S.node_link_graphs(s, p)[1]),
    "file_graph_nodes": through(lambda s, d, p: K.write_node_links(*day_graphs(s, d), p), lambda s, p: S.node_link_graphs(s, p)[0].select("graph", "id", "features", "label", "test", "val")),
    "file_adjacency": through(lambda s, d, p: K.adjacency_lines(small_graph(s, d)).select("value").write.text(p), S.adjacency_lists),
    "file_edge_list": through(lambda s, d, p: small_graph(s, d).select(F.concat_ws(" ", F.col("u").cast("string"), F.col("v").cast("string")).alias("value")).write.text(p), lambda s, p: S.edge_list(s, p).drop("seq")),
    "file_graph_text": through(lambda s, d, p: K.write_graph_text(*numbered_graphs(s, d), p), lambda s, p: S.graph_blocks(s, p).select("graph", "label", "node", "tag", "neighbours")),
    "file_classes": through(lambda s, d, p: ev(s, d).select(F.concat_ws("\t", F.col("seq").cast("string"), "src").alias("value"), (F.col("t") % 3).alias("kind")).write.partitionBy("kind").text(p), S.class_lookup),
    "file_id_map": through(lambda s, d, p: K.write_map(R.node_set(ev(s, d)).select("node", F.length("node").alias("n")), p, "node", "n"), lambda s, p: s.read.text(p, wholetext=False).where("value like '%: %'").select(F.regexp_extract("value", '^"(.*)": ', 1).alias("node"), F.regexp_extract("value", r": (\d+),?$", 1).cast("int").alias("n"))),
}

_BOTH = ", dg AS (SELECT DISTINCT (t - 1) // 24 AS graph, src AS u, dst AS v FROM ev WHERE src <> dst), bw AS (SELECT graph, u, v FROM dg UNION SELECT graph, v, u FROM dg), id AS (SELECT graph, u, row_number() OVER (PARTITION BY graph ORDER BY u) - 1 AS node FROM (SELECT DISTINCT graph, u FROM bw))"
_LINKS = ", ln AS (SELECT DISTINCT CAST(1000 + (t - 1) // 24 AS VARCHAR) AS graph, CAST(src AS BIGINT) AS source, CAST(dst AS BIGINT) AS target FROM ev WHERE src <> dst)"

SQL = {
    "file_snapshot": with_sql(_IDS + " SELECT clock - (SELECT min(clock) FROM ev) + 1 AS t, u AS src, v AS dst, label FROM named"),
    "file_padded": with_sql(_IDS + ", b AS (SELECT (clock - (SELECT min(clock) FROM ev)) // 1800 AS bin, u, v, label, seq FROM named), l AS (SELECT bin, max_by(u, seq) AS u FROM b GROUP BY bin), n AS (SELECT bin, u, lead(bin) OVER (ORDER BY bin) AS nxt FROM l) SELECT bin AS t, u AS src, v AS dst, label FROM b UNION ALL SELECT unnest(range(bin + 1, nxt)), u, u, 0 FROM n WHERE nxt > bin + 1"),
    "file_weighted": with_sql("SELECT clock AS time, src, dst, weight::DOUBLE AS weight, 1 AS label FROM ev"),
    "file_column_split": with_sql(", ends AS (SELECT src AS node, seq AS p FROM ev UNION ALL SELECT dst, seq + 1 + (SELECT max(seq) FROM ev) FROM ev), ids AS (SELECT node, row_number() OVER (ORDER BY min(p)) - 1 AS id FROM ends GROUP BY node) SELECT a.id AS u, b.id AS v, clock AS t, label::DOUBLE AS label FROM ev JOIN ids a ON a.node = src JOIN ids b ON b.node = dst"),
    "file_link_stream": with_sql("SELECT DISTINCT src, dst, t FROM ev"),
    "file_query_pairs": with_sql("SELECT DISTINCT src, dst FROM ev WHERE label = 1"),
    "file_keyed_values": with_sql("SELECT src, dst, seq AS t, clock::DOUBLE AS score FROM ev"),
    "file_interactions": with_sql(_IDS + " SELECT u, v AS i, (clock - (SELECT min(clock) FROM ev) + 1)::DOUBLE AS ts, label, row_number() OVER (ORDER BY seq) - 1 AS idx FROM named"),
    "file_strict_edges": with_sql("SELECT clock AS ts, src, dst, label FROM ev"),
    "file_memory_edges": with_sql("SELECT src, dst, clock AS ts, label FROM ev"),
    "file_spaced_edges": with_sql("SELECT clock::DOUBLE AS t, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, label FROM ev"),
    "file_log": with_sql("SELECT seq AS id, '2024-01-02' AS date, '03:04:' || lpad(CAST(clock % 60 AS VARCHAR), 2, '0') AS time, clock AS session_id, 1 AS depth, path, 1 AS label FROM paths"),
    "file_path_chains": f"WITH {T.URL}, c AS (SELECT seq, list_filter(string_split(replace(path, ',', '_'), '/'), lambda x: x <> '') AS p FROM urls) SELECT p[-1] AS src, 'x' AS dst, len(p) AS src_depth, len(p) + 1 AS dst_depth, seq + 0.5::DOUBLE AS ts, 1 AS label FROM c WHERE len(p) > 0",
    "file_scores": with_sql(f"{_NORMAL} SELECT 'score' AS kind, NULL::INT AS k, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, score, label FROM sc"),
    "file_result": with_sql(f"{_NORMAL} SELECT seq, score FROM sc"),
    "file_roc": with_sql(f"{_CUM} SELECT round(fpr, 6) AS fpr, round(recall, 6) AS tpr FROM pr"),
    "file_topk": with_sql(f"{_NORMAL}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, seq) AS r FROM sc), k AS (SELECT unnest(range(50, 801, 50)) AS k), h AS (SELECT k, sum(label) AS tp, count(*) AS n, (SELECT sum(label) FROM sc) AS ap FROM k JOIN r ON r.r <= k GROUP BY k) SELECT 'topk' AS kind, CAST(k AS INT) AS k, round(tp / n, 6) AS precision, round(tp / ap, 6) AS recall, NULL::DOUBLE AS score, NULL::INT AS label FROM h"),
    "file_spreadsheet": with_sql("""SELECT '<Row><Cell><Data ss:Type="Number">' || seq || '</Data></Cell><Cell><Data ss:Type="Number">' || label || '</Data></Cell><Cell><Data ss:Type="String">&lt;&amp;' || src || '</Data></Cell></Row>' AS value FROM ev"""),
    "file_by_minute": with_sql("SELECT seq, src, clock // 36000 AS minute FROM ev"),
    "file_json_events": with_sql("SELECT clock, '10.0.0.' || src AS src, '10.0.0.' || dst AS dst FROM ev WHERE seq % 10 <> 0"),
    "file_flows": with_sql("SELECT seq AS flow, clock AS ts, clock // 60 * 60 AS minute, label FROM ev"),
    "file_node_links": with_sql(_LINKS + " SELECT graph, source, target, source % 7 = 0 OR target % 7 = 0 AS train_removed FROM ln WHERE source % 35 <> 0 AND target % 35 <> 0"),
    "file_graph_nodes": with_sql(_LINKS + ", i AS (SELECT graph, source AS id FROM ln UNION SELECT graph, target FROM ln) SELECT graph, id, [id::DOUBLE] AS features, 1 AS label, id % 7 = 0 AS test, false AS val FROM i WHERE id % 35 <> 0"),
    "file_adjacency": f"WITH {T.LI} SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM li WHERE u <> v",
    "file_edge_list": f"WITH {T.LI} SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM li WHERE u <> v",
    "file_graph_text": with_sql(_BOTH + ", nm AS (SELECT a.graph, a.node, a.u, list_sort(list(b.node)) AS neighbours FROM bw JOIN id a ON a.graph = bw.graph AND a.u = bw.u JOIN id b ON b.graph = bw.graph AND b.u = bw.v GROUP BY ALL) SELECT dense_rank() OVER (ORDER BY graph) - 1 AS graph, graph % 2 AS label, node, length(u) AS tag, neighbours FROM nm"),
    "file_classes": with_sql("SELECT CAST(seq AS VARCHAR) AS item, t % 3 AS class FROM ev"),
    "file_id_map": with_sql("SELECT node, length(node) AS n FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev)"),
}
