"""Schemas that drift between files: profiles, renames by bipartite matching, a list of changes and one consistent table.

Fields are read from JSON lines as variants, so no schema is declared. Each field of each file is profiled: its type, and a sketch of
its values at the cells with the smallest hashes, the same cells in every file. Fields gone from and new in consecutive files of a series
are the two sides of a bipartite graph; sketches rule out edges whose common cells disagree, a join over all cells confirms the others, and
a maximum-weight matching (agreeing cells, then type, then likeness of names) decides which field was renamed to which.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobule.shared import stage

SKETCH = 64  # cells of a field's sketch
LEAST_CELLS = 3  # cells that must agree for a rename
EMPTY = ["-", "NaN"]  # texts that stand for no value, besides JSON null


def fields(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, cell_key, field, type, value) of every key of every line (file_id, line_no, cell_key, payload).

    type is integer, real, list or text, null for an empty value; value is the text of the value, with numbers in their shortest form, so
    that a number and its text are equal. Null and malformed payloads have no fields.
    """
    parsed = lines.select("file_id", "line_no", "cell_key", F.try_parse_json("payload").alias("v")).where("v is not null")
    parts = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    text = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    number = r"^-?(0|[1-9]\d*)(\.\d+)?$"
    short = F.when(text.rlike(number) & text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")).otherwise(text)
    short = F.when(short == "-0", F.lit("0")).otherwise(short)
    empty = text.isNull() | ((kind == "STRING") & text.isin(EMPTY))
    typed = F.when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "real").when(kind.startswith("ARRAY"), "list").otherwise("text")
    return parts.where("key is not null").select("file_id", "line_no", "cell_key", F.col("key").alias("field"), F.when(~empty, typed).alias("type"), F.when(~empty, short).alias("value"))


def profile(values: DataFrame) -> DataFrame:
    """(file_id, field, type, n_lines, n_values): the type holds over all non-empty values, integers among reals being reals."""
    kinds = F.collect_set("type")  # four at most
    typed = F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(F.size(kinds) == 0, F.lit(None)).when(F.size(F.array_except(kinds, F.array(F.lit("integer"), F.lit("real")))) == 0, "real").otherwise("text")
    return values.groupBy("file_id", "field").agg(typed.alias("type"), F.count("*").alias("n_lines"), F.count("value").alias("n_values"))


def sketch(values: DataFrame) -> DataFrame:
    """(file_id, field, cell, value): the hashes of up to SKETCH non-empty cells of each field, those with the smallest hashes."""
    cells = values.where("value is not null and cell_key is not null").groupBy("file_id", "field", F.xxhash64("cell_key").alias("cell")).agg(F.min(F.xxhash64("value")).alias("value"))
    order = Window.partitionBy("file_id", "field").orderBy("cell")
    return cells.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SKETCH).drop("n")


def consecutive(files: DataFrame) -> DataFrame:
    """(series_id, place, file_id, before): each file and the one before it in its series by (exported_at, file_id), null for the first."""
    order = Window.partitionBy("series_id").orderBy(F.asc_nulls_first("exported_at"), "file_id")
    return files.select("series_id", F.row_number().over(order).alias("place"), "file_id", F.lag("file_id").over(order).alias("before"))


def matching(weights: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight matching of a bipartite graph (rows to columns; weights of 0 or less are no edges), by shortest augmenting paths."""
    n, m = weights.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = -np.maximum(weights, 0)
    u, v, owner = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for row in range(1, size + 1):
        owner[0], column = row, 0
        least, came, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while True:
            used[column] = True
            reduced = cost[owner[column]] - u[owner[column]] - v
            better = ~used & (reduced < least)
            least[better], came[better] = reduced[better], column
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            nxt = int(free.argmin())
            step = free[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            column = nxt
            if owner[column] == 0:
                break
        while column:
            owner[column] = owner[came[column]]
            column = came[column]
    return [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if 0 < owner[j] <= n and weights[owner[j] - 1, j - 1] > 0]


def match_pair(edges: pd.DataFrame) -> pd.DataFrame:
    """The renames of one file among its confirmed edges (field, new_field, weight)."""
    old, new = sorted(edges["field"].unique()), sorted(edges["new_field"].unique())
    weights = np.zeros((len(old), len(new)))
    for f, g, w in zip(edges["field"], edges["new_field"], edges["weight"]):
        weights[old.index(f), new.index(g)] = w
    return pd.DataFrame([(edges["file_id"].iloc[0], old[i], new[j]) for i, j in matching(weights)], columns=["file_id", "field", "new_field"])


def changes(files: DataFrame, lines: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(file_id, change, field, new_field): every difference between a file and the one before it in its series.

    renamed: `field` is gone, `new_field` is new, and at least LEAST_CELLS cells have a value in both, equal in all of them. removed and
    added: gone or new otherwise. retyped: the field, under this name or its earlier one, changed its type; fields without any value have
    no type. A file without lines has no fields. Repeated lines and repeated files change nothing. Lines of unknown files are ignored.
    new_field is '' unless renamed.
    """
    values = stage(fields(lines), "fields") if values is None else values
    profiles = stage(profile(values), "profiles")
    pairs = stage(consecutive(files).where("before is not null").select("file_id", "before"), "pairs")
    now = pairs.join(profiles, "file_id").select("file_id", "field", F.col("type").alias("new_type"), F.lit(True).alias("now"))
    then = pairs.join(profiles.withColumnRenamed("file_id", "before"), "before").select("file_id", "field", F.col("type").alias("old_type"), F.lit(True).alias("then"))
    both = stage(now.join(then, ["file_id", "field"], "full"), "both")
    gone = both.where("now is null").select("file_id", "field", "old_type")
    new = both.where("then is null").select("file_id", F.col("field").alias("new_field"), "new_type")
    with_pair = pairs.join(gone.select("file_id").intersect(new.select("file_id")), "file_id")
    sketched = stage(sketch(values), "sketches")
    sizes = stage(sketched.groupBy("file_id", "field").agg(F.count("*").alias("n")), "sizes")
    old_fields = gone.join(with_pair, "file_id").join(sizes.withColumnRenamed("file_id", "before"), ["before", "field"])
    new_fields = new.join(sizes.select("file_id", F.col("field").alias("new_field"), F.col("n").alias("m")), ["file_id", "new_field"])
    old_side = old_fields.select("file_id", "before", "field").join(sketched.select(F.col("file_id").alias("before"), "field", "cell", F.col("value").alias("old")), ["before", "field"])
    new_side = new_fields.select("file_id", "new_field").join(sketched.select("file_id", F.col("field").alias("new_field"), "cell", F.col("value").alias("new")), ["file_id", "new_field"])
    met = old_side.join(new_side, ["file_id", "cell"]).groupBy("file_id", "field", "new_field").agg(F.min(F.col("old") == F.col("new")).alias("equal"), F.count("*").alias("common"))
    possible = F.coalesce("equal", F.lit(True)) & ((F.greatest("n", "m") >= SKETCH) | (F.coalesce("common", F.lit(0)) >= LEAST_CELLS))  # sketches under SKETCH hold all cells
    likely = old_fields.join(new_fields, "file_id").join(met, ["file_id", "field", "new_field"], "left").where(possible & (F.least("n", "m") >= LEAST_CELLS))
    likely = stage(likely.select("file_id", "before", "field", "new_field", "old_type", "new_type"), "likely")
    some = values.where("value is not null and cell_key is not null").select("file_id", "cell_key", "field", "value").distinct()
    old_cells = likely.join(some.withColumnsRenamed({"file_id": "before", "value": "old"}), ["before", "field"]).drop("before")
    new_cells = likely.select("file_id", "field", "new_field").join(some.select("file_id", "cell_key", F.col("field").alias("new_field"), F.col("value").alias("new")), ["file_id", "new_field"])
    compared = old_cells.join(new_cells, ["file_id", "field", "new_field", "cell_key"]).groupBy("file_id", "field", "new_field", "old_type", "new_type")
    sure = compared.agg(F.count_distinct("cell_key").alias("cells"), F.min(F.col("old") == F.col("new")).alias("equal")).where(F.col("equal") & (F.col("cells") >= LEAST_CELLS))
    alike = 1 - F.levenshtein("field", "new_field") / F.greatest(F.length("field"), F.length("new_field"), F.lit(1))
    weighted = sure.select("file_id", "field", "new_field", (F.col("cells") + F.when(F.col("old_type") == F.col("new_type"), 0.5).otherwise(0.0) + 0.4 * alike).alias("weight"))
    kind = dict(likely.dtypes)["file_id"]
    renamed = stage(weighted.groupBy("file_id").applyInPandas(match_pair, f"file_id {kind}, field string, new_field string"), "renamed")
    retyped_same = both.where("now and then and old_type <> new_type").select("file_id", F.lit("retyped").alias("change"), "field", F.lit("").alias("new_field"))
    retyped_new = renamed.join(gone, ["file_id", "field"]).join(new, ["file_id", "new_field"]).where("old_type <> new_type").select("file_id", F.lit("retyped").alias("change"), F.col("new_field").alias("field"), F.lit("").alias("new_field"))
    removed = gone.join(renamed, ["file_id", "field"], "left_anti").select("file_id", F.lit("removed").alias("change"), "field", F.lit("").alias("new_field"))
    added = new.join(renamed, ["file_id", "new_field"], "left_anti").select("file_id", F.lit("added").alias("change"), F.col("new_field").alias("field"), F.lit("").alias("new_field"))
    return renamed.select("file_id", F.lit("renamed").alias("change"), "field", "new_field").unionByName(removed).unionByName(added).unionByName(retyped_same).unionByName(retyped_new)


def consistent_table(files: DataFrame, lines: DataFrame) -> DataFrame:
    """All lines of all files in one table: (file_id, line_no, cell_key) and one column for each field under its latest name.

    A column is long if all its values are integers, double if they are numbers, else string (lists as JSON). Empty values are null.
    Exactly repeated lines of a file count once. Names that differ only in case get their number in the schema appended.
    """
    values = stage(fields(lines), "fields")
    order = consecutive(files).select("file_id", "series_id", "place")
    steps = changes(files, lines, values).where("change = 'renamed'").join(order, "file_id").select("series_id", F.col("place").alias("at"), "field", "new_field")
    known = stage(values.select("file_id", "field").distinct().join(order, "file_id").withColumn("name", F.col("field")), "names")
    steps = stage(steps, "steps")
    while True:  # follow each name through the later renames of its series; as many rounds as the longest chain has steps
        next_step = known.alias("k").join(steps.alias("s"), (F.col("k.series_id") == F.col("s.series_id")) & (F.col("k.name") == F.col("s.field")) & (F.col("s.at") > F.col("k.place")))
        moved = next_step.groupBy("k.file_id", "k.field").agg(F.min(F.struct("s.at", "s.new_field")).alias("step"))
        if moved.isEmpty():
            break
        joined = known.join(moved, ["file_id", "field"], "left")
        known = stage(joined.select("file_id", "field", "series_id", F.coalesce("step.at", "place").alias("place"), F.coalesce("step.new_field", "name").alias("name")), "names")
    named = values.join(known.select("file_id", "field", "name"), ["file_id", "field"])
    types = named.where("type is not null").groupBy("name").agg(F.sort_array(F.collect_set("type")).alias("types")).collect()  # one row per field of the schema
    kinds = {r["name"]: r["types"] for r in types}
    names = sorted({r["name"] for r in known.select("name").distinct().collect()})
    columns, seen = [], {"file_id", "line_no", "cell_key"}
    for i, n in enumerate(names):
        value = F.max(F.when(F.col("name") == n, F.col("value")))
        kind = kinds.get(n, [])
        if kind and set(kind) <= {"integer"}:
            value = value.cast("long")
        elif kind and set(kind) <= {"integer", "real"}:
            value = value.cast("double")
        label = n if n.lower() not in seen else f"{n}_{i}"
        seen.add(label.lower())
        columns.append(value.alias(label))
    whole = named.groupBy("file_id", "line_no", "cell_key")
    if not columns:
        return named.select("file_id", "line_no", "cell_key").distinct()
    wide = whole.agg(*columns)
    content = [c for c in wide.columns if c != "line_no"]
    return wide.groupBy(*[F.col(f"`{c}`") for c in content]).agg(F.min("line_no").alias("line_no"))
