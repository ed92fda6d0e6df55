"""Null policies, quality filters, projections and derived columns. All functions return new DataFrames or Columns; nothing is collected
but schema-sized facts."""

from __future__ import annotations

import re
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NullPolicy(Enum):
    """How null, NaN and infinite numbers are treated after a scan."""

    EPS_FILL = "null, NaN and infinite become 1e-8"
    ZERO_FILL_ALL = "null, NaN and infinite become 0"
    ZERO_FILL_DROP_INF = "null and NaN become 0, rows with an infinite value go"
    ZERO_FILL_NUMERIC = "as ZERO_FILL_ALL, on numeric columns only"
    MEDIAN_FILL = "null, NaN and infinite become the column's exact median, or 0 where it has none"
    COERCE_ZERO = "cast to double, what does not parse becomes 0"
    COERCE_DROP = "cast to double, rows with what does not parse go"
    REQUIRE_NO_NULL = "null, NaN or infinite values raise"


def col(name: str) -> Column:
    """A column by its exact name, whatever signs it holds."""
    return F.col(f"`{name}`")


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]


def apply_nulls(df: DataFrame, policy: NullPolicy, columns: list[str] | None = None) -> DataFrame:
    """df under the policy, on `columns` (default: all numeric ones, and for COERCE_* they must be given)."""
    columns = numeric_columns(df) if columns is None else columns
    real = {c: finite(col(c).cast("double")) for c in columns}
    if policy is NullPolicy.EPS_FILL:
        return df.withColumns({c: F.coalesce(v, F.lit(1e-8)) for c, v in real.items()})
    if policy in (NullPolicy.ZERO_FILL_ALL, NullPolicy.ZERO_FILL_NUMERIC):
        return df.withColumns({c: F.coalesce(v, F.lit(0.0)) for c, v in real.items()})
    if policy is NullPolicy.ZERO_FILL_DROP_INF:
        filled = df.withColumns({c: F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns})
        return filled.where(reduce(lambda a, b: a & b, [F.abs(col(c)) != float("inf") for c in columns], F.lit(True)))
    if policy is NullPolicy.MEDIAN_FILL:
        medians = df.agg(*[F.percentile(v, 0.5).alias(f"m{i}") for i, v in enumerate(real.values())]).first()
        return df.withColumns({c: F.coalesce(v, F.lit(float(m if m is not None else 0.0))) for (c, v), m in zip(real.items(), medians)})
    parsed = {c: finite(col(c).cast("string").try_cast("double")) for c in columns}
    if policy is NullPolicy.COERCE_ZERO:
        return df.withColumns({c: F.coalesce(v, F.lit(0.0)) for c, v in parsed.items()})
    if policy is NullPolicy.COERCE_DROP:
        return df.withColumns(parsed).na.drop(subset=columns)
    bad = df.agg(*[F.count_if(v.isNull()).alias(f"b{i}") for i, v in enumerate(real.values())]).first()
    wrong = {c: n for c, n in zip(columns, bad) if n}
    if wrong:
        raise ValueError(f"null, NaN or infinite values: {wrong}")
    return df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that lists the missing columns."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def first_present(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidates that is a column; none raises."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} is a column")


def organelle_qc(df: DataFrame, aspect: str, density: str, area: str, least_count: float = 20, least_density: float | None = None, strict: bool = False) -> DataFrame:
    """Rows whose aspect ratio is positive and whose density times area is at least `least_count`, and optionally dense enough.

    Null and NaN values fail the tests.
    """
    a, d, s = finite(col(aspect)), finite(col(density)), finite(col(area))
    keep = (a > 0) & (d * s >= least_count)
    if least_density is not None:
        keep = keep & ((d > least_density) if strict else (d >= least_density))
    return df.where(F.coalesce(keep, F.lit(False)))


def linked_only(df: DataFrame, link: str = "cell_id_linked", keep_null: bool = True) -> DataFrame:
    """Rows whose link did not fail (is not 0); null links stay unless keep_null is off."""
    return df.where(F.coalesce(col(link) != 0, F.lit(keep_null)))


def feature_columns(df: DataFrame, excluded: list[str] = (), drop_digit_names: bool = True) -> list[str]:
    """Numeric columns minus the excluded ones, component_* and all-digit names."""
    skip = set(excluded)
    return [c for c in numeric_columns(df) if c not in skip and not c.startswith("component_") and not (drop_digit_names and c.isdigit())]


def drop_constant(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that hold at least two different finite values, found in one pass (minimum and maximum)."""
    if not columns:
        return []
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.min(finite(col(c).cast("double"))).alias(f"a{i}"), F.max(finite(col(c).cast("double"))).alias(f"b{i}"))]).first()
    return [c for i, c in enumerate(columns) if row[f"a{i}"] is not None and row[f"a{i}"] != row[f"b{i}"]]


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a finite value in every column."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(finite(col(c).cast("double")).isNotNull(), F.lit(False)) for c in columns], F.lit(True)))


def feature_report(df: DataFrame, wanted: list[str], extras: bool = False) -> DataFrame:
    """(feature, status): each wanted feature is present or missing; with `extras` other columns are listed too."""
    have = set(df.columns)
    rows = [(w, "present" if w in have else "missing") for w in wanted]
    rows += [(c, "extra") for c in df.columns if extras and c not in set(wanted)]
    return df.sparkSession.createDataFrame(rows, "feature string, status string")


def any_at_least(columns: list[str], threshold: float) -> Column:
    """True where any of the columns reaches the threshold; nulls and NaN do not."""
    return reduce(lambda a, b: a | b, [F.coalesce(finite(col(c)) >= threshold, F.lit(False)) for c in columns])


def row_max(columns: list[str]) -> Column:
    return F.greatest(*[finite(col(c)) for c in columns]) if len(columns) > 1 else finite(col(columns[0]))


def map_values(c: Column, mapping: dict, strict: bool = False) -> Column:
    """The mapped value; without an entry null, or an error if strict."""
    out = F.element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]), c)
    return F.when(out.isNull() & c.isNotNull(), F.raise_error(F.concat(F.lit("unmapped value: "), c.cast("string")))).otherwise(out) if strict else out


def first_match(cases: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first case that holds."""
    out = None
    for test, value in cases:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def side_of_axis(position: Column) -> Column:
    """PV_side from 0 up, else CV_side; an unknown position counts as CV_side."""
    return F.when(F.coalesce(finite(position) >= 0, F.lit(False)), "PV_side").otherwise("CV_side")


def percent_change(value: Column, control: Column) -> Column:
    """(value - control) / control in percent, null for a control of 0."""
    return F.try_divide(value - control, control) * 100


def percent_difference(a: Column, b: Column, least: float = 0.0) -> Column:
    """Difference over the mean of both in percent, null where that mean is no further than `least` from 0."""
    mean = (a + b) / 2
    return F.when(F.abs(mean) > least, (a - b) / mean * 100)


def minus_log10(p: Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def significance(p: Column) -> Column:
    """*** up to 1e-4, ** up to 0.05, else N.S.; NA where p is unknown."""
    return F.when(p.isNull() | F.isnan(p), "NA").when(p <= 1e-4, "***").when(p <= 0.05, "**").otherwise("N.S.")


def file_token(c: Column, longest: int = 120) -> Column:
    """A text as a file name: other signs than letters, digits, dot, underscore and hyphen become one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, longest)


def one_hot(c: Column, classes: int, drop_first: bool = False) -> Column:
    """Array with 1.0 at the class; a class out of range gives only zeros."""
    return F.transform(F.sequence(F.lit(1 if drop_first else 0), F.lit(classes - 1)), lambda i: F.coalesce((i == c).cast("double"), F.lit(0.0)))


def feature_names(organelles: list[str], measures: list[str], types: dict[str, int] | None = None) -> list[str]:
    """Names by the grammar [type_N_]<organelle>_<measure>, untyped ones first."""
    names = [f"{o}_{m}" for o in organelles for m in measures]
    return names + [f"type_{i}_{o}_{m}" for o in organelles for i in range(1, (types or {}).get(o, 0) + 1) for m in measures]


def organelle_of(feature: Column) -> Column:
    """mito, peroxisome, ld or other, by the feature's name."""
    low = F.lower(feature)
    return F.when(low.contains("mito"), "mito").when(low.contains("perox"), "peroxisome").when(low.rlike(r"(^|_)ld(_|$)"), "ld").otherwise("other")


def measure_class_of(feature: Column) -> Column:
    """shape, size, position, abundance or other; words for shape are looked for before those for size."""
    low = F.lower(feature)
    return (
        F.when(low.rlike("aspect_ratio|solidity|circularity"), "shape").when(low.contains("distance"), "position")
        .when(low.rlike("density|percent"), "abundance").when(low.rlike("area|perimeter"), "size").otherwise("other")
    )


def parse_spec(text: str) -> dict[str, str]:
    """'a:b,c:d' as a dict; blanks around names go, parts without a colon raise."""
    pairs = [p.split(":", 1) for p in re.split(r"\s*,\s*", text.strip()) if p]
    if any(len(p) != 2 for p in pairs):
        raise ValueError(f"not a list of name:value pairs: {text!r}")
    return {a.strip(): b.strip() for a, b in pairs}
