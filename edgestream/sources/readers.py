"""Readers of logs and edge lists. Each gives fixed columns; where order is data, seq is the position in the files.

Position: the text source numbers no lines, so seq is made of the file's name order and the line's place
in its file as the reader sees it (numbered()); within one file it ascends with the lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import chain_parts
from ..plans.ordering import RANGE, global_number, in_order

LOG = "id long, date string, time string, session_id long, depth int, path string"


def numbered(df: DataFrame) -> DataFrame:
    """seq first: ascends with the lines of a file, and over files as they are split; unique, with gaps."""
    return df.select(F.monotonically_increasing_id().alias("seq"), "*")


def access_log(spark: SparkSession, path: str, label: int | None = None) -> DataFrame:
    """Pipe-separated log without a header; label: that of all rows (None: a seventh column, null if it is missing)."""
    if label is None:
        return numbered(spark.read.csv(path, sep="|", schema=f"{LOG}, label int", mode="PERMISSIVE"))
    return numbered(spark.read.csv(path, sep="|", schema=LOG)).withColumn("label", F.lit(label))


def role_label(role: str) -> int:
    return 0 if role == "benign" else 1


def path_chain_log(spark: SparkSession, path: str) -> DataFrame:
    """src, dst (last parts), src_depth, dst_depth, ts, label of comma lines of backslash chains.

    Headers, blanks, short lines, empty chains and unreadable times are dropped; an unreadable label is 0.
    """
    parts = F.split("value", ",")
    held = numbered(spark.read.text(path)).where(~F.trim("value").startswith("src_node") & (F.trim("value") != "") & (F.size(parts) >= 4))
    get = lambda k: F.trim(parts[k])
    s, d = chain_parts(get(0)), chain_parts(get(1))
    rows = held.select("seq", s.alias("s"), d.alias("d"), get(2).try_cast("double").alias("ts"), F.coalesce(get(3).try_cast("int"), F.lit(0)).alias("label"))
    rows = rows.where("ts is not null and size(s) > 0 and size(d) > 0")
    return rows.select("seq", F.element_at("s", -1).alias("src"), F.element_at("d", -1).alias("dst"), F.size("s").alias("src_depth"), F.size("d").alias("dst_depth"), "ts", "label")


def _fields(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return numbered(spark.read.text(path)).withColumn("f", F.split(F.trim("value"), separator))


def memory_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, ts, label; lines without exactly four fields are skipped."""
    f = F.col("f")
    return _fields(spark, path, ",").where(F.size(f) == 4).select("seq", f[0].alias("src"), f[1].alias("dst"), f[2].cast("long").alias("ts"), f[3].cast("int").alias("label"))


def strict_edges(spark: SparkSession, path: str) -> DataFrame:
    """ts, src, dst, label; any malformed line fails the read."""
    return numbered(spark.read.csv(path, schema="ts long, src string, dst string, label int", mode="FAILFAST", enforceSchema=True))


def snapshot_edges(spark: SparkSession, path: str, separator: str = r"\s+") -> DataFrame:
    """t, src, dst, label of lines with three fields or more; a missing or unreadable label is 0."""
    f = F.col("f")
    rows = _fields(spark, path, separator).where(F.size(f) >= 3)
    read = rows.select("seq", f[0].try_cast("long").alias("t"), f[1].try_cast("long").alias("src"), f[2].try_cast("long").alias("dst"), F.coalesce(F.get(f, F.lit(3)).try_cast("int"), F.lit(0)).alias("label"))
    return read.dropna(subset=["t", "src", "dst"])


def weighted_edges(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """time, src, dst, weight, label; any token but "-" is an attack (the literal 0 too)."""
    rows = numbered(spark.read.csv(path, sep=separator, schema="time int, src string, dst string, weight double, token string"))
    return rows.withColumn("label", (F.col("token") != "-").cast("int")).drop("token")


def column_split_stream(spark: SparkSession, features: str, labels: str, size: str | None = None) -> DataFrame:
    """seq, u, v, t, label of two files aligned by line; the size file, if given, must agree."""
    left = _lines(spark, features, "u long, v long, t long")
    right = _lines(spark, labels, "label double")
    held = left.join(right, "seq")
    if size is not None:
        n = int(spark.read.text(size).first()[0])
        if (found := held.count()) != n:
            raise ValueError(f"{found} rows, {n} expected")
    return held


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file, or of part files in the order of their names, with their line number from 0: lines are
    ordered by file, block and place in the block, and counted over the ranges."""
    held = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"))
    placed = global_number(in_order(held, "_f", "_s", "_i"), "_k", "_m", RANGE)
    return placed.select((F.col("_k") - 1).alias("seq"), F.from_csv("line", schema).alias("r")).select("seq", "r.*")


def spaced_edges(spark: SparkSession, path: str) -> DataFrame:
    """t, src, dst, label of space-separated lines."""
    return numbered(spark.read.csv(path, sep=" ", schema="t double, src long, dst long, label int"))


def link_stream(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """src, dst, t (weight): a set of triplets; of a repeated one the last weight stays."""
    rows = numbered(spark.read.csv(path, schema="src string, dst string, t long" + (", weight double" if weighted else "")))
    if not weighted:
        return rows.select("src", "dst", "t").distinct()
    return rows.groupBy("src", "dst", "t").agg(F.max_by("weight", "seq").alias("weight"))


def keyed_values(spark: SparkSession, path: str, keys: str = "src string, dst string, t long", value: str = "score double") -> DataFrame:
    """Scores or labels by key; of a repeated key the last line stays."""
    rows = numbered(spark.read.csv(path, schema=f"{keys}, {value}"))
    names, last = [c for c in rows.columns[1:-1]], rows.columns[-1]
    return rows.groupBy(*names).agg(F.max_by(last, "seq").alias(last))


def json_events(spark: SparkSession, path: str) -> DataFrame:
    """ts, src, dst of (gzip) JSON lines in a folder tree; unreadable lines and times are dropped."""
    kind = "timestamp string, properties struct<src_ip string, dest_ip string>"
    rows = spark.read.schema(kind).option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(path)
    ts = F.col("timestamp").try_cast("timestamp")
    return rows.select(ts.alias("ts"), F.col("properties.src_ip").alias("src"), F.col("properties.dest_ip").alias("dst")).where("ts is not null and src is not null and dst is not null")


def flow_table(spark: SparkSession, path: str) -> DataFrame:
    """A flow CSV with header, with ts and minute of its Timestamp."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    ts = F.try_to_timestamp("Timestamp", F.lit("dd/MM/yyyy hh:mm:ss a"))
    return numbered(rows).withColumn("ts", ts).withColumn("minute", F.date_trunc("minute", "ts"))


def node_link_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, id, features, label, val, test) and links (graph, source, target, train_removed) of node-link JSON.

    Nodes without val or test are dropped with their links; a link at a val or test node is marked.
    """
    node = "struct<id long, features array<double>, label int, test boolean, val boolean, ip string, flow_id string>"
    kind = f"graphs array<struct<nodes array<{node}>, links array<struct<source long, target long>>, graph struct<timestamp string>>>"
    graphs = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("graphs").alias("g"))
    nodes = graphs.select(F.col("g.graph.timestamp").alias("graph"), F.explode("g.nodes").alias("n")).select("graph", "n.*").where("val is not null and test is not null")
    links = graphs.select(F.col("g.graph.timestamp").alias("graph"), F.explode("g.links").alias("l")).select("graph", "l.*")
    held = nodes.select("graph", "id", (F.col("val") | F.col("test")).alias("out"))
    a, b = held.withColumnsRenamed({"id": "source", "out": "_a"}), held.withColumnsRenamed({"id": "target", "out": "_b"})
    joined = links.join(a, ["graph", "source"]).join(b, ["graph", "target"])
    return nodes, joined.select("graph", "source", "target", (F.col("_a") | F.col("_b")).alias("train_removed"))


def adjacency_lists(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """u, v of lines "node neighbour neighbour ..."; comment lines are skipped."""
    real = ~F.trim("value").startswith(comment) & (F.trim("value") != "")
    # a line is cut once, below the explode; named beside it, its first word would be cut out anew for every neighbour
    cut = spark.read.text(path).select(F.when(real, F.split(F.trim("value"), r"\s+")).alias("f"))
    lines = cut.select(F.col("f")[0].cast("long").alias("u"), F.transform(F.slice("f", F.lit(2), F.size("f")), lambda x: x.cast("long")).alias("n"))
    return lines.select("u", F.explode("n").alias("v"))


def edge_list(spark: SparkSession, path: str, comment: str = "%") -> DataFrame:
    f = F.split(F.trim("value"), r"[\s,]+")
    rows = numbered(spark.read.text(path)).where(~F.trim("value").startswith(comment) & (F.trim("value") != ""))
    return rows.select("seq", f[0].cast("long").alias("u"), f[1].cast("long").alias("v"))


def graph_blocks(spark: SparkSession, path: str, most: int = 1 << 14) -> DataFrame:
    """graph, label, node, tag, neighbours, features of graph-classification text; each file is parsed in its task.

    A file's graphs are numbered from 0, or from k if it stands in a folder first=k. Rows are handed on after every
    most neighbours and features, so that a task holds its text but not the rows of it.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["graph", "label", "node", "tag", "neighbours", "features"]
        for frame in frames:
            for text, first in zip(frame["value"], frame["first"], strict=True):
                lines = (x.group() for x in re.finditer(r"[^\n]+", text))
                rows, held = [], 0
                for g in range(int(next(lines))):
                    n, label = map(int, next(lines).split()[:2])
                    for node in range(n):
                        tokens = next(lines).split()
                        fan = int(tokens[1])
                        rows.append((int(first) + g, label, node, int(tokens[0]), list(map(int, tokens[2 : 2 + fan])), list(map(float, tokens[2 + fan :]))))
                        held += len(tokens)
                        if held >= most:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    texts = spark.read.text(path, wholetext=True)
    texts = texts.select("value", (F.col("first") if "first" in texts.columns else F.lit(0)).cast("long").alias("first"))
    return texts.mapInPandas(parse, "graph int, label int, node int, tag int, neighbours array<int>, features array<double>")


def interactions(spark: SparkSession, path: str) -> DataFrame:
    """u, i, ts, label, idx of a CSV with header."""
    return spark.read.csv(path, header=True, schema="u long, i long, ts double, label int, idx long")


def score_or_topk(spark: SparkSession, path: str) -> DataFrame:
    """kind, k, precision, recall, score, label: lines of the format that most lines of the file have."""
    top, pair = r"\[TOP(\d+)\]\s*precision:\s*([\d.]+),\s*recall:\s*([\d.]+)", r"^\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s+([01])\s*$"
    lines = spark.read.text(path).select("value", F.col("value").rlike(top).alias("is_top"), F.col("value").rlike(pair).alias("is_pair"))
    vote = lines.agg((F.count_if("is_top") > F.count_if("is_pair")).alias("tops"))
    held = lines.crossJoin(F.broadcast(vote)).where((F.col("tops") & F.col("is_top")) | (~F.col("tops") & F.col("is_pair")))
    pick = lambda p, k, kind: F.when(F.col("value").rlike(p), F.regexp_extract("value", p, k)).try_cast(kind)
    return held.select(F.when(F.col("tops"), "topk").otherwise("score").alias("kind"), pick(top, 1, "int").alias("k"), pick(top, 2, "double").alias("precision"), pick(top, 3, "double").alias("recall"), pick(pair, 1, "double").alias("score"), pick(pair, 2, "int").alias("label"))


def coerced(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns as numbers; rows in which one of them is none are dropped."""
    made: dict[str, Column] = {c: F.col(c).try_cast(k) for c, k in kinds.items()}
    return df.withColumns(made).dropna(subset=list(kinds))


def class_lookup(spark: SparkSession, path: str) -> DataFrame:
    """item, class of tab-separated files, a folder a class below path: the class is the folder's place by name, from 0."""
    f = F.split("value", "\t")
    held = spark.read.option("recursiveFileLookup", "true").text(path).select(f[0].alias("item"), F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("folder"))
    placed = global_number(in_order(held.select("folder").distinct(), "folder"), "k", "_m", RANGE).select("folder", (F.col("k") - 1).alias("class"))
    return held.join(placed, "folder").select("item", "class")
