"""Changes between files, against hand-made cases."""

import json

import numpy as np
import pytest

from lobule.operators import drift

FILES = "file_id long, series_id long, exported_at timestamp_ntz, extra string"
LINES = "file_id long, line_no int, cell_key long, payload string"


def tables(spark, contents):
    """contents: list of (file_id, series, day, [(cell, dict)])."""
    import datetime

    files = [(f, s, datetime.datetime(2024, 1, day), "x") for f, s, day, _ in contents]
    lines = [(f, i, c, p if isinstance(p, (str, type(None))) else json.dumps(p)) for f, _, _, rows in contents for i, (c, p) in enumerate(rows, 1)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(lines, LINES)


def found(spark, contents):
    return {tuple(r)[1:] if False else (r["file_id"], r["change"], r["field"], r["new_field"]) for r in drift.changes(*tables(spark, contents)).collect()}


def test_rename_retype_add_remove(spark):
    first = [(c, {"a": c, "b": f"t{c}", "gone": 1, "same": 1.5}) for c in range(5)]
    second = [(c, {"A2": str(c), "b": f"t{c}", "new": "x", "same": c}) for c in range(5)]
    got = found(spark, [(1, 1, 1, first), (2, 1, 2, second)])
    assert got == {(2, "renamed", "a", "A2"), (2, "retyped", "A2", ""), (2, "removed", "gone", ""), (2, "added", "new", ""), (2, "retyped", "same", "")}


def test_too_few_cells_and_one_difference_are_no_rename(spark):
    assert found(spark, [(1, 1, 1, [(1, {"a": 1}), (2, {"a": 2})]), (2, 1, 2, [(1, {"b": 1}), (2, {"b": 2})])]) == {(2, "removed", "a", ""), (2, "added", "b", "")}
    rows = [(c, {"a": c}) for c in range(200)]
    other = [(c, {"b": c if c != 150 else -1}) for c in range(200)]
    assert found(spark, [(1, 1, 1, rows), (2, 1, 2, other)]) == {(2, "removed", "a", ""), (2, "added", "b", "")}


def test_renames_of_fields_with_few_common_cells(spark):
    first = [(c, {"a": f"v{c}", "left": c} if c < 3000 else {"left": c}) for c in range(6000)]
    second = [(c, {"A2": f"v{c}"} if c >= 2990 else {"other": c if c % 2 else -c, "same": "x"}) for c in range(6000)]
    thin = [(c, {"thin": f"v{c}"}) for c in (5, 1500, 2500)]
    assert found(spark, [(1, 1, 1, first), (2, 1, 2, second)]) == {(2, "renamed", "a", "A2"), (2, "removed", "left", ""), (2, "added", "other", ""), (2, "added", "same", "")}
    assert found(spark, [(1, 1, 1, first), (2, 1, 2, thin)]) == {(2, "renamed", "a", "thin"), (2, "removed", "left", "")}


def test_empty_values_repeated_lines_nulls_and_bad_json(spark):
    rows = [(c, {"a": c, "e": None}) for c in range(4)] + [(0, {"a": 0, "e": None}), (9, "{bad"), (9, None)]
    other = [(c, {"b": c, "e": "-"}) for c in range(4)] + [(None, {"b": 7})]
    assert found(spark, [(1, 1, 1, rows), (2, 1, 2, other)]) == {(2, "renamed", "a", "b")}


def test_order_by_time_then_id_and_file_without_lines(spark):
    got = found(spark, [(9, 1, 1, [(c, {"a": c}) for c in range(3)]), (3, 1, 2, []), (4, 2, 1, [(1, {"z": 1})])])
    assert got == {(3, "removed", "a", "")}


def test_empty_tables(spark):
    assert found(spark, []) == set()
    assert drift.consistent_table(*tables(spark, [])).count() == 0


def test_consistent_table_follows_renames(spark):
    contents = [(1, 1, 1, [(c, {"a": c, "x": 1}) for c in range(3)]), (2, 1, 2, [(c, {"b": c, "x": 2.5}) for c in range(3)]), (3, 1, 3, [(c, {"c": c, "x": 1}) for c in range(3)])]
    df = drift.consistent_table(*tables(spark, contents))
    assert set(df.columns) == {"file_id", "line_no", "cell_key", "c", "x"}
    assert dict(df.dtypes)["c"] == "bigint" and dict(df.dtypes)["x"] == "double"
    assert {(r["file_id"], r["cell_key"], r["c"]) for r in df.collect()} == {(f, c, c) for f in (1, 2, 3) for c in range(3)}


@pytest.mark.parametrize("seed", range(5))
def test_matching_is_best(seed):
    from itertools import permutations

    w = np.random.default_rng(seed).integers(0, 9, (4, 5)).astype(float)
    best = max(sum(w[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
    assert sum(w[i, j] for i, j in drift.matching(w)) == best
