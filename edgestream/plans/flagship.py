"""The engine end to end: a log's transitions, their scores, the hourly roll-up, and how well it finds attacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, microcluster, relational, sequence
from . import frames


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """auc, best_auc of the hourly maxima of edge scores against hours with an attack on many edges."""
    log = frames.events_paths(spark, sf_dir)
    edges = sequence.transition_edges(log).withColumn("t", F.expr("clock div 3600 + 1"))
    hourly = relational.snapshot_rollup(microcluster.normal(edges), "max")
    labels = relational.bin_attack_label(edges, 2).select("t", "label")
    return evaluation.roc_auc(hourly.join(labels, "t"))
