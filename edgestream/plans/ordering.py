"""Sequential operators over a whole stream, without a window that gathers all rows in one task.

A stream carries a unique, ascending `seq`. Rows are cut into chunks of seq; windows run within a chunk,
and one row a chunk (its last values or its sum) is carried over by a window over the chunks, which are
CHUNK times fewer than the rows.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20
#: Numbers of in_order() differ by this from one partition to the next.
RANGE = 1 << 33


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the cluster's shared folder; only a local master without one (tests) gets a temporary folder.

    Spark's cleaner deletes its files once nothing refers to it any more.
    """
    sc = df.sparkSession.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="edgestream-"))
    return df.checkpoint()


def in_order(df: DataFrame, *order: str | Column, name: str = "_m") -> DataFrame:
    """df with an ascending number in the given order, RANGE apart from one range partition to the next: with it
    as seq and RANGE as chunk, the functions below run over any order. Checkpointed, so that the ranges, which are
    sampled, stay as they are."""
    return cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def _chunked(df: DataFrame, seq: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(seq) / chunk))


def global_lag(df: DataFrame, columns: dict[str, str], seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """df with, for each new name, the old column's value in the row before by seq (null in the first)."""
    held = _chunked(df, seq, chunk)
    order = Window.partitionBy("_chunk").orderBy(seq)
    own = F.lag(F.struct(*columns.values())).over(order)
    last = held.groupBy("_chunk").agg(F.max_by(F.struct(*columns.values()), F.col(seq)).alias("_last"))
    carried = last.select("_chunk", F.lag("_last").over(Window.orderBy("_chunk")).alias("_before"))
    joined = held.withColumn("_own", own).withColumn("_first", F.row_number().over(order) == 1).join(carried, "_chunk", "left")
    value = F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_own"))
    return joined.withColumn("_v", value).select(*df.columns, *(F.col("_v")[old].alias(new) for new, old in columns.items()))


def global_lead(df: DataFrame, columns: dict[str, str], seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """As global_lag, of the row after (null in the last)."""
    turned = df.withColumn("_turned", -F.col(seq))
    return global_lag(turned, columns, "_turned", chunk).drop("_turned")


def global_sum(df: DataFrame, value: Column, name: str, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """df with the running sum of value up to and with each row."""
    held = _chunked(df, seq, chunk).withColumn("_value", value)
    own = F.sum("_value").over(Window.partitionBy("_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    sums = held.groupBy("_chunk").agg(F.sum("_value").alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_chunk", F.coalesce(before, F.lit(0)).alias("_offset"))
    return held.withColumn("_own", own).join(offsets, "_chunk").withColumn(name, F.col("_own") + F.col("_offset")).select(*df.columns, name)


def global_max(df: DataFrame, value: Column, name: str, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """df with the running maximum of value up to and with each row."""
    held = _chunked(df, seq, chunk).withColumn("_value", value)
    own = F.max("_value").over(Window.partitionBy("_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    tops = held.groupBy("_chunk").agg(F.max("_value").alias("_s"))
    before = F.max("_s").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tops.select("_chunk", before.alias("_offset"))
    return held.withColumn("_own", own).join(offsets, "_chunk").withColumn(name, F.greatest("_own", "_offset")).select(*df.columns, name)


def global_last(df: DataFrame, columns: dict[str, str], seq: str = "seq", chunk: int = CHUNK, backwards: bool = False) -> DataFrame:
    """df with, for each new name, the old column's last non-null value up to and with each row (backwards: the first one from it on)."""
    held = _chunked(df, seq, chunk)
    if backwards:
        held = held.withColumn("_chunk", -F.col("_chunk"))
    by = F.col(seq).desc() if backwards else F.col(seq)
    order = Window.partitionBy("_chunk").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    key = -F.col(seq) if backwards else F.col(seq)
    ends = held.groupBy("_chunk").agg(*(F.max_by(old, F.when(F.col(old).isNotNull(), key)).alias(f"_e_{new}") for new, old in columns.items()))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_chunk", *(F.last(f"_e_{new}", ignorenulls=True).over(before).alias(f"_b_{new}") for new in columns))
    own = held.withColumns({f"_o_{new}": F.last(old, ignorenulls=True).over(order) for new, old in columns.items()})
    return own.join(carried, "_chunk").select(*df.columns, *(F.coalesce(f"_o_{new}", f"_b_{new}").alias(new) for new in columns))


def global_number(df: DataFrame, name: str, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """df with the 1-based position of each row by seq."""
    return global_sum(df, F.lit(1).cast("long"), name, seq, chunk)


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str = "number", size: str = "edges") -> DataFrame:
    """df with each row's place in its group, from 0, and the group's rows. A group may span any number of tasks."""
    placed = global_number(in_order(df, *group, *order, name="_numbered_m"), "_numbered_n", "_numbered_m", RANGE)
    sizes = placed.groupBy(*group).agg(F.min("_numbered_n").alias("_numbered_first"), F.count("*").alias(size))
    if group:
        sizes = sizes.withColumnsRenamed({g: f"_numbered_{k}" for k, g in enumerate(group)})
        same = F.lit(True)
        for k, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_numbered_{k}"))
        joined = placed.join(sizes, same)
    else:
        joined = placed.crossJoin(F.broadcast(sizes))  # one row
    return joined.select(*df.columns, (F.col("_numbered_n") - F.col("_numbered_first")).alias(name), size)


def with_scalars(df: DataFrame, **values: Column) -> DataFrame:
    """df with aggregates over all its rows as columns: one row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in values.items()))))
