"""Queries of problem 4 over cluster_files and cluster_file_lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lobule.operators import drift
from lobule.shared import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of fields between consecutive exports of a series."""
    return drift.changes(table(spark, d, "cluster_files"), table(spark, d, "cluster_file_lines"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All exports as one table, each field under its latest name."""
    return drift.consistent_table(table(spark, d, "cluster_files"), table(spark, d, "cluster_file_lines"))


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """Type and numbers of lines and values of each field of each file."""
    return drift.profile(drift.fields(table(spark, d, "cluster_file_lines")))


QUERIES = {"p4_found": p4_found, "p4_table": p4_table, "p4_profile": p4_profile}
