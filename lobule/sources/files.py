"""Scans and sinks: CSV matrices, modality matrices, JSON summaries, model arrays, text."""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lobule.functions.cleaning import col, finite


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, repeated ones numbered as name.1, name.2."""
    first = spark.read.text(path).limit(1).first()
    seen: dict[str, int] = {}
    names = []
    for n in (first[0] if first else "").lstrip("﻿").split(","):
        n = n.strip().strip('"')
        names.append(n if n not in seen else f"{n}.{seen[n]}")
        seen[n] = seen.get(n, 0) + 1
    return names


def scan_csv(spark: SparkSession, path: str, texts: list[str] = (), null: str = "-", schema: StructType | None = None) -> DataFrame:
    """A CSV matrix: `texts` are strings, all else double, by the file's header; no inference pass. `null` and what doesn't parse are null."""
    if schema is None:
        schema = StructType([StructField(n, StringType() if n in set(texts) else DoubleType()) for n in header(spark, path)])
    return spark.read.csv(path, header=True, schema=schema, nullValue=null, nanValue="NaN", mode="PERMISSIVE", enforceSchema=True)


def scan_first(spark: SparkSession, paths: list[str], texts: list[str] = ()) -> DataFrame:
    """The first of the files that exists; none raises."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return scan_csv(spark, p, texts)
    raise FileNotFoundError(f"none of {paths} exists")


def modality_matrix(df: DataFrame, id_column: str | None = None, meta: str | None = None) -> DataFrame:
    """(cell_id, position, x): id and metadata column (default: the first and the last), all others as an array of doubles, unknown ones 0."""
    id_column, meta = id_column or df.columns[0], meta or df.columns[-1]
    features = [c for c in df.columns if c not in (id_column, meta)]
    values = [F.coalesce(finite(col(c).cast("string").try_cast("double")), F.lit(0.0)) for c in features]
    return df.select(col(id_column).alias("cell_id"), col(meta).alias("position"), F.array(*values).alias("x"))


def json_safe(value: Any) -> Any:
    """Plain JSON values: NaN and infinite become null, numpy numbers and arrays become Python ones."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if hasattr(value, "tolist"):
        return json_safe(value.tolist())
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """One JSON object as a text file in any file system Spark knows."""
    spark.createDataFrame([(json.dumps(json_safe(summary), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.json(paths)


def write_table(df: DataFrame, path: str, by: list[str] = (), form: str = "parquet") -> None:
    """Parquet (default) or CSV, optionally in a folder for each value of `by`."""
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    writer.csv(path, header=True) if form == "csv" else writer.parquet(path)


def write_model(spark: SparkSession, path: str, model: dict) -> None:
    """Arrays of a fitted model as a one-row JSON table; read back with read_model()."""
    write_summary(spark, path, model)


def read_model(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))


def null_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Group sizes and numbers of unusable values of each column; what to look at when a result is empty."""
    others = [c for c, t in df.dtypes if c not in keys]
    bad = [F.count_if(finite(col(c)).isNull() if t in ("double", "float") else col(c).isNull()).alias(f"null_{c}") for c, t in df.dtypes if c in others]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *bad)


def precomputed_components(df: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """(key, component_1, component_2, ...): components that an earlier run stored, by default all of them in the order of their numbers;
    rows that lack one stay out. A table without components raises."""
    names = names or sorted((c for c in df.columns if c.startswith("component_") and c[10:].isdigit()), key=lambda c: int(c[10:]))
    if not names:
        raise ValueError("no component_ columns")
    return df.select(col(key), *[finite(col(c).cast("double")).alias(c) for c in names]).na.drop(subset=names)


def write_assignments(df: DataFrame, path: str, key: str, position: str, components: list[str], cluster: str) -> None:
    """Cluster assignments as CSV: key, position, components, cluster."""
    write_table(df.select(col(key), col(position), *[col(c) for c in components], col(cluster).alias("cluster")), path, form="csv")


def write_lines(df: DataFrame, path: str) -> None:
    """The only column of df as lines of text."""
    df.write.mode("overwrite").text(path)


def resolve(spark: SparkSession, path: str, folders: list[str]) -> str:
    """The path itself if it exists, else the first of folder/path that does; none raises."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tried = [path, *(f"{f.rstrip('/')}/{path.lstrip('/')}" for f in folders)]
    for p in tried:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(f"none of {tried} exists")
