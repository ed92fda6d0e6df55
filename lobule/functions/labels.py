"""Label grammars as Column functions: acinus, liver, tile, condition, time point, organ hierarchy, category names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the pattern's first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def members(label: Column) -> Column:
    """The labels of a stringified list, or the label itself as the only one; null stays null."""
    listed = F.from_json(F.translate(F.trim(label), "'", '"'), "array<string>")
    return F.when(label.isNotNull(), F.coalesce(listed, F.array(F.trim(label))))


def first_member(label: Column) -> Column:
    return F.get(members(label), F.lit(0))


def acinus(label: Column) -> Column:
    """`CNT_L1L1a0s0_1` gives `L1L1a0`, without regard to case."""
    return F.regexp_replace(found(F.upper(label), r"(L\d+L\d+A\d+)"), "A", "a")


def liver_of_acinus(name: Column) -> Column:
    """`L1L1a0` gives `L1`; NA where there is none."""
    return F.coalesce(found(name, r"^(L\d+)"), F.lit("NA"))


def ivm_parts(label: Column) -> dict[str, Column]:
    """Liver, tile and region of an intravital label such as `CL1TS1R2Z0_1`."""
    pattern = r"^\s*([^T\s]+)(TS\d+)(R\d+)"
    upper = F.upper(label)
    return {"liver_id": found(upper, pattern, 1), "tile_section": found(upper, pattern, 2), "region_id": found(upper, pattern, 3)}


def condition(label: Column, group: Column | None = None) -> Column:
    """CNT, STV or WD by the group's name or code, else by any member of the label; else the text before its first `_`, or Unknown."""
    upper = F.upper(label)
    by_label = F.when(upper.rlike(r"CNT[_\d]"), "CNT").when(upper.rlike(r"STV[_\d]"), "STV").when(upper.rlike(r"WD[_\d]"), "WD")
    rest = F.coalesce(F.when(label.contains("_"), F.nullif(F.substring_index(F.trim(label), "_", 1), F.lit(""))), F.lit("Unknown"))
    if group is None:
        return F.coalesce(by_label, rest)
    name = F.upper(F.trim(group))
    by_group = F.when(name.isin("CNT", "1"), "CNT").when(name.isin("STV", "2"), "STV").when(name.isin("WD", "3"), "WD")
    return F.coalesce(by_group, by_label, rest)


def time_point(label: Column) -> Column:
    """Ordinal of the first of the known time tokens that the label holds, else 0."""
    tokens = ["C_", "7days_", "18days_", "31days_", "42days_", "50days_"]  # fixed values, tried in this order
    out = F.when(label.contains(tokens[0]), 1)
    for i, t in enumerate(tokens[1:], 2):
        out = out.when(label.contains(t), i)
    return out.otherwise(0)


def organ_hierarchy(label: Column) -> dict[str, Column]:
    """The five numbers of `P1S1R1S0_001`; null where the label has another form."""
    pattern = r"^[A-Z](\d+)S(\d+)R(\d+)S(\d+)_(\d+)$"
    return {n: found(label, pattern, i).cast("int") for i, n in enumerate(["animal", "section", "region", "slice", "cell"], 1)}


def category_name(code: Column) -> Column:
    """H1 to H5 for 0 to 4, FH1 to FH4 for 5 to 8, WH1 and WH2 for 9 and 10; else null."""
    return F.when(code.between(0, 4), F.concat(F.lit("H"), (code + 1).cast("string"))).when(code.between(5, 8), F.concat(F.lit("FH"), (code - 4).cast("string"))).when(code.between(9, 10), F.concat(F.lit("WH"), (code - 8).cast("string")))


def route_name(route: Column) -> Column:
    """`3>5>6` as category names joined by arrows."""
    return F.array_join(F.transform(F.split(route, ">"), lambda c: F.coalesce(category_name(c.try_cast("int")), c)), "→")


def title(name: Column) -> Column:
    """`mito_avg_area` as `Mito Avg Area`."""
    return F.initcap(F.regexp_replace(name, "_", " "))


def ordered_labels(df: DataFrame, column: str, name: str, prefix: str = "H") -> DataFrame:
    """df with a label H1, H2, ... for the category's place in ascending order; null categories get none. Only categories are sorted."""
    places = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_n", F.row_number().over(Window.orderBy(column)))
    return df.join(places, column, "left").withColumn(name, F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")
