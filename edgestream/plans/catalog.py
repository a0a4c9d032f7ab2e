"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_files, catalog_formats, catalog_graphs, catalog_relational, catalog_sequence, catalog_streams

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**catalog_sequence.QUERIES, **catalog_relational.QUERIES, **catalog_formats.QUERIES, **catalog_graphs.QUERIES, **catalog_files.QUERIES, **catalog_streams.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**catalog_sequence.SQL, **catalog_relational.SQL, **catalog_formats.SQL, **catalog_graphs.SQL, **catalog_files.SQL, **catalog_streams.SQL}
