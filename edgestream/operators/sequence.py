"""Windowed and sequential features over ordered streams (seq is a unique total order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import path_depth
from ..plans.ordering import RANGE, global_lag, global_lead, global_max, global_number, global_sum, in_order, with_scalars

GAP = 301


def transition_edges(log: DataFrame, label_from: str = "source", stream: str | None = "stream_id") -> DataFrame:
    """Edges between a log's consecutive places. label_from: "source" (the row before) or "row" (this row).

    With stream, each stream is a log of its own; without, the whole log is one sequence (chunked, not gathered).
    """
    if stream:
        w = Window.partitionBy(stream).orderBy("seq")
        held = log.withColumns({"src": F.lag("path").over(w), "_label": F.lag("label").over(w)})
    else:
        held = global_lag(log, {"src": "path", "_label": "label"})
    label = F.col("_label") if label_from == "source" else F.col("label")
    return held.where("src is not null").select("seq", *([stream] if stream else []), "clock", "src", F.col("path").alias("dst"), label.alias("label"))


def since_last(edges: DataFrame, node: str = "dst", clock: str = "clock") -> DataFrame:
    """since_last: time since the node was last in that role; 0 at first."""
    w = Window.partitionBy(node).orderBy("seq")
    return edges.withColumn("since_last", F.col(clock) - F.coalesce(F.lag(clock).over(w), F.col(clock)))


def running_degree(edges: DataFrame) -> DataFrame:
    """degree: how often dst has been an end of an edge up to this one; a self-loop counts twice."""
    ends = edges.select("seq", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("end")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("end")))).alias("e")).select("seq", "e.*")
    w = Window.partitionBy("node").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    counted = ends.withColumn("degree", F.count("*").over(w)).where("end = 1").select("seq", "degree")
    return edges.join(counted, "seq")


def running_weight(edges: DataFrame) -> DataFrame:
    return edges.withColumn("occurrence", F.row_number().over(Window.partitionBy("src", "dst").orderBy("seq")))


def first_seen_ids(pairs: DataFrame, value: str, position: str = "seq", base: int = 1) -> DataFrame:
    """value, id: dense ids in the order of first occurrence. One row a value is numbered, by chunks."""
    firsts = pairs.groupBy(value).agg(F.min(position).alias("first"))
    return global_number(firsts, "n", "first").select(value, (F.col("n") + (base - 1)).alias("id"))


def factorize_ends(edges: DataFrame) -> DataFrame:
    """node, id from 0: all sources by first occurrence, then all new targets."""
    bounds = with_scalars(edges.select("seq", "src", "dst"), top=F.max("seq"))
    ends = bounds.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("seq").alias("p")), F.struct(F.col("dst").alias("node"), (F.col("seq") + F.col("top") + 1).alias("p")))).alias("e")).select("e.*")
    return first_seen_ids(ends, "node", "p", 0)


def interleaved_ids(edges: DataFrame, base: int = 1) -> DataFrame:
    """node, id: first occurrence row by row, src before dst."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (2 * F.col("seq")).alias("p")), F.struct(F.col("dst").alias("node"), (2 * F.col("seq") + 1).alias("p")))).alias("e")).select("e.*")
    return first_seen_ids(ends, "node", "p", base)


def sorted_ids(edges: DataFrame, base: int = 0) -> DataFrame:
    """node, id: dense ids by value, over both ends."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return global_number(in_order(nodes, "node"), "_k", "_m", RANGE).select("node", (F.col("_k") - 1 + base).alias("id"))


def bipartite_ids(edges: DataFrame) -> DataFrame:
    """seq, u, i: sources from 1 by first occurrence, targets after the last of them."""
    left = first_seen_ids(edges, "src").withColumnRenamed("id", "u")
    most = left.agg(F.max("u").alias("most"))
    right = first_seen_ids(edges, "dst").crossJoin(F.broadcast(most)).withColumn("i", F.col("id") + F.col("most"))
    return edges.join(left, "src").join(right.select("dst", "i"), "dst").select("seq", "u", "i")


def normalised_time(edges: DataFrame, clock: str = "clock") -> DataFrame:
    return with_scalars(edges, _low=F.min(clock)).withColumn("norm_t", F.col(clock) - F.col("_low") + 1).drop("_low")


def time_bin(edges: DataFrame, width: int, clock: str = "clock") -> DataFrame:
    """bin: whole widths since the first tick; a tick before it is in bin 0."""
    return with_scalars(edges, _low=F.min(clock)).withColumn("bin", F.greatest(F.lit(0).cast("long"), F.floor((F.col(clock) - F.col("_low")) / width))).drop("_low")


def sequential_time(edges: DataFrame, clock: str = "clock") -> DataFrame:
    """dense_t: 1, 2, ... for each new value of the clock. Distinct values are numbered, then joined back."""
    numbered = global_number(edges.select(F.col(clock).alias("_tick")).distinct(), "dense_t", "_tick")
    return edges.join(numbered, edges[clock] == numbered["_tick"]).drop("_tick")


def gap_rows(log: DataFrame, side: str = "before", gap: int = GAP, clock: str = "clock") -> DataFrame:
    """The rows at a gap of at least gap: those before it, or those after it, with the gap's size."""
    other = global_lead(log, {"_other": clock}) if side == "before" else global_lag(log, {"_other": clock})
    size = F.col("_other") - F.col(clock) if side == "before" else F.col(clock) - F.col("_other")  # a clock set back is no gap
    return other.withColumn("gap", size).where(F.col("gap") >= gap).drop("_other")


def sessions(log: DataFrame, gap: int = GAP, clock: str = "clock", stream: str = "stream_id") -> DataFrame:
    """session: a new one after each gap, by stream."""
    w = Window.partitionBy(stream).orderBy("seq")
    new = F.coalesce((F.col(clock) - F.lag(clock).over(w) >= gap).cast("int"), F.lit(0))
    return log.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_quartiles_by_count(gaps: DataFrame) -> DataFrame:
    """quartile 0..3 of gap rows: splits at n div 4, n div 2 and 3 n div 4."""
    counted = with_scalars(global_number(gaps, "k"), n=F.count("*"))
    k = F.col("k") - 1
    return counted.withColumn("quartile", (k >= F.expr("n div 4")).cast("int") + (k >= F.expr("n div 2")).cast("int") + (k >= F.expr("3 * n div 4")).cast("int")).drop("k", "n")


def gap_quartiles_by_position(log: DataFrame, gap: int = GAP) -> DataFrame:
    """quartile 0..3 of gap rows by their place in the whole log, in percent."""
    placed = with_scalars(global_number(log, "k"), n=F.count("*"))
    percent = (F.col("k") - 1) * 100.0 / F.col("n")
    quartile = F.when(percent < 25, 0).when(percent < 50, 1).when(percent < 75, 2).otherwise(3)
    return gap_rows(placed.withColumn("quartile", quartile), "before", gap).drop("k", "n")


def batches(stream: DataFrame, size: int, keep_partial: bool = False) -> DataFrame:
    """batch: consecutive blocks of size rows; a last, shorter one is dropped unless kept."""
    held = global_number(stream, "_k").withColumn("batch", F.floor((F.col("_k") - 1) / size)).drop("_k")
    if keep_partial:
        return held
    return held.withColumn("_n", F.count("*").over(Window.partitionBy("batch"))).where(F.col("_n") == size).drop("_n")


def sliding_windows(stream: DataFrame, size: int, stride: int) -> DataFrame:
    """A row for each full window (window from 0) that holds it."""
    held = with_scalars(global_number(stream, "_k"), _n=F.count("*"))
    k = F.col("_k") - 1
    last = F.least(F.floor(k / stride), F.floor((F.col("_n") - size) / stride))
    first = F.greatest(F.lit(0).cast("long"), F.floor((k - size) / stride) + 1)
    held = held.where(F.col("_n") >= size).withColumns({"_first": first, "_last": last}).where("_first <= _last")
    return held.withColumn("window", F.explode(F.sequence("_first", "_last"))).drop("_k", "_n", "_first", "_last")


def labelled_windows(stream: DataFrame, size: int, stride: int) -> DataFrame:
    """sliding_windows() with attack: whether more than half of the window's rows are labelled."""
    held = sliding_windows(stream, size, stride)
    marks = held.groupBy("window").agg((2 * F.sum("label") > size).alias("attack"))
    return held.join(marks, "window")


def features(edges: DataFrame, depth: Column) -> DataFrame:
    """f: (depth / 10, since_last / 10000, (degree - mean) / std), with statistics of the whole stream."""
    held = running_degree(since_last(edges))
    scaled = with_scalars(held, _mean=F.avg("degree"), _std=F.stddev_pop("degree") + 1e-9)
    return scaled.withColumn("f", F.array(depth / 10.0, F.col("since_last") / 10000.0, (F.col("degree") - F.col("_mean")) / F.col("_std"))).drop("_mean", "_std")


def second_difference(scores: DataFrame, score: str = "score") -> DataFrame:
    """diff2: |s - 2 s1 + s2| over its maximum (the first two are 0); hybrid: .85 score + .15 diff2."""
    lagged = global_lag(global_lag(scores, {"_s1": score}), {"_s2": "_s1"})
    raw = lagged.withColumn("_raw", F.coalesce(F.abs(F.col(score) - 2 * F.col("_s1") + F.col("_s2")), F.lit(0.0)))
    top = with_scalars(raw, _top=F.max("_raw"))
    diff = F.when(F.col("_top") > 0, F.col("_raw") / (F.col("_top") + 1e-9)).otherwise(F.col("_raw"))
    return top.withColumn("diff2", diff).withColumn("hybrid", 0.85 * F.col(score) + 0.15 * F.col("diff2")).drop("_s1", "_s2", "_raw", "_top")


def idle_padding(edges: DataFrame, width: int, clock: str = "clock") -> DataFrame:
    """bin, src, dst: for each bin without an edge, a self-loop of the source of the last edge before it."""
    binned = time_bin(edges, width, clock)
    last = binned.groupBy("bin").agg(F.max_by("src", "seq").alias("node"))
    following = global_lead(last, {"_next": "bin"}, "bin")
    gaps = following.where(F.col("_next") > F.col("bin") + 1)
    return gaps.select(F.explode(F.sequence(F.col("bin") + 1, F.col("_next") - 1)).alias("bin"), F.col("node").alias("src"), F.col("node").alias("dst"))


def fill_pair_gaps(edges: DataFrame, step: int, clock: str = "clock") -> DataFrame:
    """src, dst, clock of the ticks strictly between a pair's consecutive ticks, step apart."""
    w = Window.partitionBy("src", "dst").orderBy(clock, "seq")
    held = edges.withColumn("_next", F.lead(clock).over(w)).where(F.col("_next") - F.col(clock) > step)
    return held.select("src", "dst", F.explode(F.sequence(F.col(clock) + step, F.col("_next") - 1, F.lit(step).cast("long"))).alias("clock"))


def tail_padding(edges: DataFrame, ticks: int, step: int = 1, clock: str = "clock") -> DataFrame:
    """src, dst, clock: ticks self-loops of the last target after the last edge."""
    last = edges.agg(F.max_by("dst", "seq").alias("node"), F.max_by(clock, "seq").alias("_t")).where("node is not null")
    return last.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.explode(F.sequence(F.lit(1), F.lit(ticks))).alias("_k"), "_t").select("src", "dst", (F.col("_t") + step * F.col("_k")).alias("clock"))


def fill_seconds(log: DataFrame, clock: str = "clock") -> DataFrame:
    """The log with each row repeated for the ticks without a row until the next one."""
    held = global_lead(log, {"_next": clock})
    until = F.greatest(F.col(clock), F.coalesce(F.col("_next") - 1, F.col(clock)))
    return held.withColumn(clock, F.explode(F.sequence(F.col(clock), until))).drop("_next")


def attack_spans(stream: DataFrame) -> DataFrame:
    """first, last (0-based rows): runs of consecutive rows with label 1."""
    placed = global_number(stream, "_k")
    ones = global_number(placed.where("label = 1"), "_m")
    return ones.groupBy((F.col("_k") - F.col("_m")).alias("island")).agg((F.min("_k") - 1).alias("first"), (F.max("_k") - 1).alias("last")).drop("island")


def temporal_split(edges: DataFrame, train: float = 0.85, valid: float | None = None, clock: str = "clock") -> DataFrame:
    """part: train (up to the quantile, with it), valid (up to the next), test.

    The quantiles are exact: rows are counted by tick, and the ticks' counts added up in order.
    """
    shares = {"_a": train} | ({"_b": valid} if valid else {})
    ticks = in_order(edges.groupBy(F.col(clock).alias("c")).agg(F.count("*").alias("n")), "c")
    upto = with_scalars(global_sum(ticks, F.col("n"), "upto", "_m", RANGE), all=F.sum("n"))

    def quantile(q: float) -> Column:
        place = (F.col("all") - 1) * F.lit(q)
        low, high = (F.min(F.when(F.col("upto") > k, F.col("c"))) for k in (F.floor(place), F.ceil(place)))
        return low + (high - low) * F.max(place - F.floor(place))

    held = edges.crossJoin(F.broadcast(upto.agg(*(quantile(q).alias(k) for k, q in shares.items()))))
    part = F.when(F.col(clock) <= F.col("_a"), "train")
    if valid:
        part = part.when(F.col(clock) <= F.col("_b"), "valid")
    return held.withColumn("part", part.otherwise("test")).drop(*shares)


def strictly_increasing(log: DataFrame, clock: str = "clock") -> DataFrame:
    """fixed: the clock raised where needed, so that each row is after the one before: max(s - k) so far, plus k."""
    held = global_number(log, "_k")
    return global_max(held, F.col(clock) - F.col("_k"), "_m").withColumn("fixed", F.col("_m") + F.col("_k")).drop("_k", "_m")


def chained_rows(flows: DataFrame, minute: str = "minute") -> DataFrame:
    """graph, source, target: a flow's forward node to its backward one, and the backward one to the next flow's forward one, within a minute."""
    w = Window.partitionBy(minute).orderBy("seq")
    k = F.row_number().over(w)
    held = flows.withColumn("_k", k)
    own = held.select(F.col(minute).alias("graph"), (2 * (F.col("_k") - 1)).alias("source"), (2 * F.col("_k") - 1).alias("target"))
    before = held.where("_k > 1").select(F.col(minute).alias("graph"), (2 * F.col("_k") - 3).alias("source"), (2 * F.col("_k") - 2).alias("target"))
    return own.unionAll(before)


def scaled(rows: DataFrame, value: str, fit: Column | None = None) -> DataFrame:
    """rows with standard, min_max and log of value, with statistics of all rows, or of those that fit holds for (a training part)."""
    x = F.col(value)
    seen = F.when(fit, x) if fit is not None else x
    held = with_scalars(rows, _m=F.avg(seen), _s=F.stddev_pop(seen), _a=F.min(seen), _z=F.max(seen))
    return held.withColumns({"standard": F.try_divide(x - F.col("_m"), F.col("_s")), "min_max": F.try_divide(x - F.col("_a"), F.col("_z") - F.col("_a")), "log": F.log1p(x)}).drop("_m", "_s", "_a", "_z")


def both_directions(rows: DataFrame, value: str, seq: str = "seq") -> DataFrame:
    """seq, direction, v: each row forward and backward; the sign of a value carries the direction."""
    ways = F.array(F.struct(F.lit(1).alias("direction"), F.col(value).alias("v")), F.struct(F.lit(-1).alias("direction"), (-F.col(value)).alias("v")))
    return rows.select(seq, F.inline(ways))


def batch_summary(stream: DataFrame, size: int, clock: str = "clock") -> DataFrame:
    """batch, n, mean_gap, mean_label of whole batches; a gap lies within a batch."""
    held = batches(stream, size)
    gap = F.col(clock) - F.lag(clock).over(Window.partitionBy("batch").orderBy("seq"))
    return held.withColumn("gap", gap).groupBy("batch").agg(F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), F.avg("label").alias("mean_label"))


def depth_delta(paths: DataFrame) -> DataFrame:
    """seq, delta: how the depth of consecutive paths differs."""
    held = global_lag(paths, {"before": "path"}).where("before is not null")
    return held.select("seq", F.abs(path_depth(F.col("path")) - path_depth(F.col("before"))).alias("delta"))


def coded_log(log: DataFrame, stamp: str = "stamp", token: str = "token") -> DataFrame:
    """seq, u, v, t, label of a log (seq, src, dst, stamp, token): t numbers the distinct time texts in their lexical
    order from 1, u and v number all sources by first occurrence and then the new targets, and any token but "-" is an attack."""
    stamps = global_number(in_order(log.select(F.col(stamp).alias("_s")).distinct(), "_s"), "t", "_m", RANGE).select("_s", "t")
    ids = factorize_ends(log)
    a, b = ids.withColumnsRenamed({"node": "src", "id": "u"}), ids.withColumnsRenamed({"node": "dst", "id": "v"})
    named = log.join(a, "src").join(b, "dst").join(stamps, log[stamp] == stamps["_s"])
    return named.select("seq", "u", "v", "t", (F.col(token) != "-").cast("int").alias("label"))


def snapshot_schedule(edges: DataFrame, initial: float, size: int) -> DataFrame:
    """edges with snapshot: 0 for the first share of them, then 1, 2, ... by size; the last one may be shorter."""
    held = with_scalars(global_number(edges, "_k"), _n=F.count("*"))
    first = F.floor(F.col("_n") * F.lit(initial))
    place = F.col("_k") - 1 - first
    return held.withColumn("snapshot", F.when(place < 0, F.lit(0).cast("long")).otherwise(F.floor(place / size) + 1)).drop("_k", "_n")


def padded_groups(stream: DataFrame, value: str, size: int) -> DataFrame:
    """batch, members: consecutive groups of size values; the last one is filled up with nulls."""
    held = batches(stream, size, keep_partial=True).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("seq", F.col(value).alias("v")))).alias("m"))
    members = F.transform("m", lambda x: x["v"])
    return held.select("batch", F.concat(members, F.array_repeat(F.lit(None).cast(stream.schema[value].dataType), size - F.size("m"))).alias("members"))
