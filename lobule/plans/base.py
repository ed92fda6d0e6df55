"""The cleaned tables that the queries share, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lobule.functions import labels
from lobule.functions.cleaning import finite
from lobule.shared import table

# The general features of the cell table.
MEASURES = ["density", "avg_area", "aspect_ratio", "perimeter", "percent_total_area", "solidity", "circularity", "distance_from_edge"]
FEATURES = [f"{o}_{m}" for o in ("mito", "peroxisome", "ld") for m in MEASURES if (o, m) != ("ld", "aspect_ratio")]
SUBTYPES = [f"percent_type_{i}_{o}" for o, n in (("mito", 3), ("peroxisome", 3), ("ld", 4)) for i in range(1, n + 1)]
POSTERIORS = ["0", "1", "2", "3", "4"]
NUMBERS = ["centroid-0", "centroid-1", "area", "ascini_position", *FEATURES, *SUBTYPES, *POSTERIORS, "Probability", "component_1", "component_2", "component_3"]
MORPH = ["perimeter", "solidity", "aspect_ratio", "circularity", "boundry_dist", "area"]


def cells(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """Cells with NaN and infinite numbers as null, parsed labels (acinus, liver, condition), cat = Prediction and position."""
    raw = table(spark, d, "full_concat_clusters")
    wanted = NUMBERS if columns is None else columns
    return raw.select(
        "row_id", "labels", "cell_id_linked", F.col("group"), F.col("Prediction").alias("cat"), F.col("Prediction_original").alias("cat0"), labels.acinus(F.col("labels")).alias("acinus"),
        labels.condition(F.col("labels"), F.col("group")).alias("condition"), finite(F.col("ascini_position")).alias("position"), *[finite(F.col(f"`{c}`")).alias(c) for c in wanted],
    )


def mito(spark: SparkSession, d: str) -> DataFrame:
    """Mitochondria with their parsed labels, zone (PV, CV or null) and finite numbers."""
    raw = table(spark, d, "fig5_ivm_control_group_mitochondria_properties")
    zone = F.upper(F.regexp_replace("PV_CV", r"\s", ""))
    return raw.select("row_id", F.upper(F.trim("cell_label")).alias("cell"), *[c.alias(n) for n, c in labels.ivm_parts(F.col("cell_label")).items()], F.when(zone.isin("PV", "CV"), zone).alias("zone"), *[finite(F.col(c)).alias(c) for c in ["ratio_01_00", "area_cell", *MORPH]])


def droplets(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "fig5_ivm_control_group_lipid_droplets_properties")
    return raw.select("row_id", F.upper(F.trim("cell_label")).alias("cell"), *[finite(F.col(c)).alias(c) for c in MORPH if c != "aspect_ratio"])


def r(c: Column | str, digits: int = 8) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _fin(c: str, name: str | None = None) -> str:
    return f'CASE WHEN isfinite("{c}") THEN "{c}" END AS "{name or c}"'


CELLS = f"""cells AS (SELECT row_id, labels, cell_id_linked, "group", Prediction AS cat, Prediction_original AS cat0,
  nullif(regexp_replace(regexp_extract(upper(labels), '(L\\d+L\\d+A\\d+)', 1), 'A', 'a'), '') AS acinus,
  CASE WHEN upper(trim("group")) IN ('CNT','1') THEN 'CNT' WHEN upper(trim("group")) IN ('STV','2') THEN 'STV' WHEN upper(trim("group")) IN ('WD','3') THEN 'WD'
    WHEN regexp_matches(upper(labels), 'CNT[_\\d]') THEN 'CNT' WHEN regexp_matches(upper(labels), 'STV[_\\d]') THEN 'STV' WHEN regexp_matches(upper(labels), 'WD[_\\d]') THEN 'WD'
    WHEN contains(labels, '_') AND split_part(trim(labels, ' '), '_', 1) <> '' THEN split_part(trim(labels, ' '), '_', 1) ELSE 'Unknown' END AS condition,
  {_fin('ascini_position', 'position')}, {', '.join(_fin(c) for c in NUMBERS)} FROM full_concat_clusters)"""
_IVM = r"^\s*([^T\s]+)(TS\d+)(R\d+)"
MITO = f"""mito AS (SELECT row_id, upper(trim(cell_label, ' ')) AS cell, {', '.join(f"nullif(regexp_extract(upper(cell_label), '{_IVM}', {i}), '') AS {n}" for i, n in enumerate(('liver_id', 'tile_section', 'region_id'), 1))},
  CASE WHEN upper(regexp_replace(PV_CV, '\\s', '', 'g')) IN ('PV','CV') THEN upper(regexp_replace(PV_CV, '\\s', '', 'g')) END AS zone, {', '.join(_fin(c) for c in ['ratio_01_00', 'area_cell', *MORPH])} FROM fig5_ivm_control_group_mitochondria_properties)"""
DROPLETS = f"""droplets AS (SELECT row_id, upper(trim(cell_label, ' ')) AS cell, {', '.join(_fin(c) for c in MORPH if c != 'aspect_ratio')} FROM fig5_ivm_control_group_lipid_droplets_properties)"""


def bin_sql(x: str, low: float, high: float, n: int) -> str:
    return f"CASE WHEN {x} BETWEEN {low} AND {high} THEN CAST(least({n - 1}, greatest(0, ceil(({x} - ({low})) / ((({high}) - ({low})) / {n})) - 1)) AS INTEGER) END"
