"""Measures of scores against labels. Rows are counted by distinct score, and the scores run through in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import RANGE, global_lag, global_sum, in_order, with_scalars


def by_score(scored: DataFrame) -> DataFrame:
    """score, p, n: positives and negatives of each distinct finite score."""
    finite = scored.where("score is not null and not isnan(score) and label is not null")
    return finite.groupBy("score").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") != 1).cast("long")).alias("n"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """auc, best_auc (of the score and its negative); null if a class is missing."""
    held = global_sum(in_order(by_score(scored), "score"), F.col("n"), "upto", "_m", RANGE)
    won = held.withColumn("won", F.col("p") * (F.col("upto") - F.col("n") / 2.0))
    auc = F.try_divide(F.sum("won"), F.sum("p") * F.sum("n"))
    return won.agg(auc.alias("auc")).withColumn("best_auc", F.greatest("auc", 1 - F.col("auc")))


def cumulative(scored: DataFrame) -> DataFrame:
    """score, tp, fp, all_p, all_n from the highest score down."""
    held = in_order(by_score(scored), F.desc("score"))
    held = global_sum(global_sum(held, F.col("p"), "tp", "_m", RANGE), F.col("n"), "fp", "_m", RANGE)
    return with_scalars(held, all_p=F.sum("p"), all_n=F.sum("n"))


def pr_curve(scored: DataFrame) -> DataFrame:
    return _precision_recall(cumulative(scored)).drop("_m")


def _precision_recall(c: DataFrame) -> DataFrame:
    return c.select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "all_p").alias("recall"), "_m")


def roc_points(scored: DataFrame) -> DataFrame:
    c = cumulative(scored)
    return c.select("score", F.try_divide("fp", "all_n").alias("fpr"), F.try_divide("tp", "all_p").alias("tpr"))


def average_precision(scored: DataFrame) -> DataFrame:
    """ap (steps) and pr_auc (trapezoids from recall 0 at precision 1)."""
    held = global_lag(_precision_recall(cumulative(scored)), {"r0": "recall", "p0": "precision"}, "_m", RANGE).na.fill({"r0": 0.0, "p0": 1.0})
    step = F.col("recall") - F.col("r0")
    return held.agg(F.sum(step * F.col("precision")).alias("ap"), F.sum(step * (F.col("precision") + F.col("p0")) / 2).alias("pr_auc"))


def best_f1(scored: DataFrame) -> DataFrame:
    """threshold, f1: the highest F1, the higher threshold at a tie."""
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    held = pr_curve(scored).withColumn("f1", F.round(f1, 12))
    return held.agg(F.max_by("score", F.struct("f1", "score")).alias("threshold"), F.max("f1").alias("f1"))


def top_k(scored: DataFrame, ks: list[int]) -> DataFrame:
    """k, precision, recall, f1, fpr of the k highest scores (ties by seq); k is clamped to the number of rows."""
    most = max(ks)
    ranked = scored.orderBy(F.desc("score"), "seq").limit(most).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "seq")))
    totals = scored.agg(F.sum("label").alias("all_p"), F.count("*").alias("all"))
    grid = scored.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    hits = ranked.join(F.broadcast(grid), F.col("r") <= F.col("k")).groupBy("k").agg(F.sum("label").alias("tp"), F.count("*").alias("taken"))
    held = hits.crossJoin(F.broadcast(totals))
    precision, recall = F.col("tp") / F.col("taken"), F.try_divide("tp", "all_p")
    return held.select("k", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"), F.try_divide(F.col("taken") - F.col("tp"), F.col("all") - F.col("all_p")).alias("fpr"))


def classification(predicted: DataFrame) -> DataFrame:
    """accuracy, micro_f1, macro_f1, weighted_f1 of rows (label, predicted)."""
    classes = predicted.select(F.explode(F.array("label", "predicted")).alias("c")).distinct()
    own = predicted.select(F.explode(F.array_distinct(F.array("label", "predicted"))).alias("c"), "label", "predicted")
    per = own.groupBy("c").agg(F.count_if(F.expr("label = c and predicted = c")).alias("tp"), F.count_if(F.expr("label <> c")).alias("fp"), F.count_if(F.expr("predicted <> c")).alias("fn"))
    f1 = per.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("n", F.col("tp") + F.col("fn")).join(classes, "c")
    accuracy = F.sum("tp") / F.sum("n")
    return f1.agg(accuracy.alias("accuracy"), accuracy.alias("micro_f1"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("n")) / F.sum("n")).alias("weighted_f1"))
