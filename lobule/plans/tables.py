"""Queries over projections, joins, aggregates, bins, ranks and sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobule.functions import cleaning as C
from lobule.functions import labels as L
from lobule.operators import bins as B
from lobule.operators import grouping as G
from lobule.operators import ranking as W
from lobule.plans.base import CELLS, DROPLETS, FEATURES, MITO, MORPH, POSTERIORS, SUBTYPES, bin_sql, cells, droplets, mito, r
from lobule.shared import table

QUERIES, ORACLE = {}, {}
CONDITIONS, CATS = ["CNT", "STV", "WD"], [1, 2, 3, 4, 5]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(f"WITH {CELLS} SELECT row_id, round(mito_density, 8) AS mito_density FROM cells WHERE mito_aspect_ratio > 0 AND mito_density * area >= 20 AND mito_density >= 0.28")
def qc_filter(spark: SparkSession, d: str) -> DataFrame:
    """Organelle quality filter."""
    return C.organelle_qc(cells(spark, d), "mito_aspect_ratio", "mito_density", "area", 20, 0.28).select("row_id", r("mito_density").alias("mito_density"))


@query("SELECT row_id FROM full_concat_clusters WHERE cell_id_linked IS NULL OR cell_id_linked <> 0")
def linked_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose link did not fail; unknown links stay."""
    return C.linked_only(table(spark, d, "full_concat_clusters")).select("row_id")


def policy_query(name: str, policy: C.NullPolicy, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        raw = table(spark, d, "full_concat_clusters").select("row_id", "mito_density", "ld_density")
        return C.apply_nulls(raw, policy, ["mito_density", "ld_density"]).select("row_id", r("mito_density", 8).alias("mito_density"), r("ld_density", 8).alias("ld_density"))

    run.__doc__ = f"P29: {policy.value}."
    QUERIES[name], ORACLE[name] = run, sql


def _both(form: str) -> str:
    return ", ".join(f"round({form.format(c)}, 8) AS {c}" for c in ("mito_density", "ld_density"))


policy_query("null_eps", C.NullPolicy.EPS_FILL, f"SELECT row_id, {_both('CASE WHEN isfinite({0}) THEN {0} ELSE 1e-8 END')} FROM full_concat_clusters")
policy_query("null_zero", C.NullPolicy.ZERO_FILL_ALL, f"SELECT row_id, {_both('CASE WHEN isfinite({0}) THEN {0} ELSE 0.0 END')} FROM full_concat_clusters")
policy_query("null_zero_drop_inf", C.NullPolicy.ZERO_FILL_DROP_INF, f"SELECT row_id, {_both('CASE WHEN {0} IS NULL OR isnan({0}) THEN 0.0 ELSE {0} END')} FROM full_concat_clusters WHERE NOT coalesce(isinf(mito_density), false) AND NOT coalesce(isinf(ld_density), false)")
policy_query("null_median", C.NullPolicy.MEDIAN_FILL, f"WITH m AS (SELECT median(mito_density) FILTER (isfinite(mito_density)) AS mito_density_m, median(ld_density) FILTER (isfinite(ld_density)) AS ld_density_m FROM full_concat_clusters) SELECT row_id, {_both('CASE WHEN isfinite({0}) THEN {0} ELSE {0}_m END')} FROM full_concat_clusters, m")
policy_query("null_coerce_drop", C.NullPolicy.COERCE_DROP, f"SELECT row_id, {_both('{0}')} FROM full_concat_clusters WHERE isfinite(mito_density) AND isfinite(ld_density)")


@query(f"WITH {CELLS} SELECT row_id, acinus, coalesce(nullif(regexp_extract(acinus, '^(L\\d+)', 1), ''), 'NA') AS liver, condition FROM cells")
def label_parse(spark: SparkSession, d: str) -> DataFrame:
    """Acinus, liver and condition of the labels."""
    return cells(spark, d).select("row_id", "acinus", L.liver_of_acinus(F.col("acinus")).alias("liver"), "condition")


@query(f"WITH {MITO} SELECT row_id, liver_id, tile_section, region_id, zone FROM mito")
def label_parse_ivm(spark: SparkSession, d: str) -> DataFrame:
    """Parts of intravital labels."""
    return mito(spark, d).select("row_id", "liver_id", "tile_section", "region_id", "zone")


@query(f"""WITH {CELLS} SELECT row_id, (coalesce("0" >= 0.8, false) OR coalesce("1" >= 0.8, false) OR coalesce("2" >= 0.8, false) OR coalesce("3" >= 0.8, false) OR coalesce("4" >= 0.8, false)) AS confident, round(greatest("0", "1", "2", "3", "4"), 8) AS top FROM cells""")
def any_prob_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Rows with any posterior of 0.8 or more, and the row's largest."""
    return cells(spark, d).select("row_id", C.any_at_least(POSTERIORS, 0.8).alias("confident"), r(C.row_max(POSTERIORS)).alias("top"))


@query(f"WITH {CELLS} SELECT row_id, CASE cat0 WHEN 0 THEN 'H1' WHEN 1 THEN 'H2' WHEN 2 THEN 'H3' WHEN 3 THEN 'H4' WHEN 4 THEN 'H5' END AS category, CASE WHEN position >= 0 THEN 'PV_side' ELSE 'CV_side' END AS side, list_transform([0, 1, 2, 3, 4], lambda i: CASE WHEN i = cat0 THEN 1.0 ELSE 0.0 END)::DOUBLE[] AS hot FROM cells")
def category_side_onehot(spark: SparkSession, d: str) -> DataFrame:
    """Category names, side of the axis, one-hot classes."""
    return cells(spark, d).select("row_id", L.category_name(F.col("cat0")).alias("category"), C.side_of_axis(F.col("position")).alias("side"), C.one_hot(F.col("cat0"), 5).alias("hot"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(trim(source, ' '), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ' ') AS token, CASE WHEN contains(source, 'notebook') THEN 'notebook' WHEN starts_with(lower(source), 'deposit') THEN 'deposit' ELSE 'other' END AS kind FROM documents")
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    """File tokens and first-match classes of texts."""
    source = F.col("source")
    kind = C.first_match([(source.contains("notebook"), "notebook"), (F.lower(source).startswith("deposit"), "deposit")], "other")
    return table(spark, d, "documents").select("doc_id", C.file_token(source).alias("token"), kind.alias("kind"))


@query(f"SELECT feature, CASE WHEN contains(feature, 'mito') THEN 'mito' WHEN contains(feature, 'perox') THEN 'peroxisome' WHEN regexp_matches(feature, '(^|_)ld(_|$)') THEN 'ld' ELSE 'other' END AS organelle, CASE WHEN regexp_matches(feature, 'aspect_ratio|solidity|circularity') THEN 'shape' WHEN contains(feature, 'distance') THEN 'position' WHEN regexp_matches(feature, 'density|percent') THEN 'abundance' WHEN regexp_matches(feature, 'area|perimeter') THEN 'size' ELSE 'other' END AS measure, feature IN ({', '.join(repr(f) for f in FEATURES)}) AS present FROM feature_scale")
def feature_classes(spark: SparkSession, d: str) -> DataFrame:
    """Organelle and class of feature names, and whether the cell table has them."""
    have = set(cells(spark, d, FEATURES).columns) & set(C.feature_names(["mito", "peroxisome", "ld"], [f.split("_", 1)[1] for f in FEATURES[:8]]))
    f = F.col("feature")
    return table(spark, d, "feature_scale").select("feature", C.organelle_of(f).alias("organelle"), C.measure_class_of(f).alias("measure"), f.isin(*have).alias("present"))


@query(f"WITH {CELLS} SELECT count(*) AS n, count(*) FILTER (cell_id_linked = 0) AS failed, round(count(*) FILTER (condition = 'CNT') / 5.0, 8) AS estimated FROM cells")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts under conditions; cells estimated from masks at five depths."""
    return cells(spark, d, []).agg(F.count("*").alias("n"), F.count_if(F.col("cell_id_linked") == 0).alias("failed"), r(F.count_if(F.col("condition") == "CNT") / 5).alias("estimated"))


_ROLL = f"""WITH {MITO}, {DROPLETS}, m AS (SELECT cell, avg(ratio_01_00) AS tmrm, count(*) AS n_mito, min(zone) AS zone, avg(area_cell) AS area_cell, avg(aspect_ratio) AS mito_aspect FROM mito WHERE liver_id IS NOT NULL GROUP BY cell),
  l AS (SELECT cell, count(*) AS n_ld, avg(area) AS ld_area FROM droplets GROUP BY cell)
  SELECT cell, zone, n_mito, n_ld, round(tmrm, 8) AS tmrm, round(ld_area, 8) AS ld_area, round(n_mito / area_cell, 8) AS mito_density, round(mito_aspect, 8) AS mito_aspect FROM m JOIN l USING (cell)"""


def ivm_cells(spark: SparkSession, d: str) -> DataFrame:
    m = mito(spark, d).where("liver_id is not null").groupBy("cell").agg(F.avg("ratio_01_00").alias("tmrm"), F.count("*").alias("n_mito"), F.min("zone").alias("zone"), F.avg("area_cell").alias("area_cell"), F.avg("aspect_ratio").alias("mito_aspect"), F.min("liver_id").alias("liver_id"), F.min("tile_section").alias("tile_section"))
    l = droplets(spark, d).groupBy("cell").agg(F.count("*").alias("n_ld"), F.avg("area").alias("ld_area"))
    return m.join(l, "cell")


@query(_ROLL)
def ivm_cell_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Organelles rolled up to cells, both tables joined, densities."""
    return ivm_cells(spark, d).select("cell", "zone", "n_mito", "n_ld", r("tmrm").alias("tmrm"), r("ld_area").alias("ld_area"), r(F.col("n_mito") / F.col("area_cell")).alias("mito_density"), r("mito_aspect").alias("mito_aspect"))


_LONG = " UNION ALL ".join(f"SELECT condition, cat, acinus, '{c}' AS feature, \"{c}\" AS x FROM cells" for c in FEATURES)


@query(f"WITH {CELLS}, long AS ({_LONG}) SELECT cat, feature, count(x) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS std, round(CASE WHEN avg(x) <> 0 THEN stddev_samp(x) / avg(x) END, 8) AS cv FROM long WHERE cat IS NOT NULL GROUP BY cat, feature")
def group_moments(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2: number, mean, deviation and coefficient of variation of every feature in every category."""
    return G.group_moments(cells(spark, d).where("cat is not null"), ["cat"], FEATURES).select("cat", "feature", "n", r("mean").alias("mean"), r("std").alias("std"), r("cv").alias("cv"))


_MITO3 = [c for c in SUBTYPES if c.endswith("mito")]


@query(f"WITH {CELLS}, s AS (SELECT cat, {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in _MITO3)} FROM cells WHERE cat IS NOT NULL GROUP BY cat) " + " UNION ALL ".join(f"SELECT cat, '{c}' AS feature, round({c} / ({' + '.join(_MITO3)}), 8) AS share FROM s" for c in _MITO3))
def subtype_composition(spark: SparkSession, d: str) -> DataFrame:
    """A5: shares of the subtypes in every category."""
    return G.composition(cells(spark, d).where("cat is not null"), ["cat"], _MITO3).select("cat", "feature", r("share").alias("share"))


@query(f"WITH {CELLS} SELECT condition, cat, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY condition), 8) AS share FROM cells WHERE cat IS NOT NULL GROUP BY condition, cat")
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    """Counts of categories and their shares within a condition."""
    return B.shares(cells(spark, d, []).where("cat is not null"), ["condition"], "cat").select("condition", "cat", "n", r("share").alias("share"))


@query(f"WITH {CELLS} SELECT condition, " + ", ".join(f"round(coalesce(avg(mito_density) FILTER (cat = {c}), 0), 8) AS c{c}" for c in CATS) + " FROM cells GROUP BY condition")
def pivot_means(spark: SparkSession, d: str) -> DataFrame:
    """Wide table of means, missing ones 0."""
    each = cells(spark, d, ["mito_density"]).where("cat is not null").groupBy("condition", "cat").agg(F.avg("mito_density").alias("m"))
    wide = G.pivot_wide(each, ["condition"], "cat", CATS, "m")
    return cells(spark, d, []).select("condition").distinct().join(wide, "condition", "left").select("condition", *[r(F.coalesce(F.col(str(c)), F.lit(0.0))).alias(f"c{c}") for c in CATS])


@query(f"WITH {CELLS} SELECT condition, count(mito_density) AS n, count(DISTINCT acinus) AS acini, round(min(mito_density), 8) AS low, round(quantile_cont(mito_density, 0.025), 8) AS q025, round(median(mito_density), 8) AS middle, round(quantile_cont(mito_density, 0.975), 8) AS q975, round(max(mito_density), 8) AS high FROM cells GROUP BY condition")
def quantile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles, distinct counts, summary row."""
    x = F.col("mito_density")
    p = lambda q: r(F.percentile(x, q))
    return cells(spark, d, ["mito_density"]).groupBy("condition").agg(F.count(x).alias("n"), F.count_distinct("acinus").alias("acini"), r(F.min(x)).alias("low"), p(0.025).alias("q025"), p(0.5).alias("middle"), p(0.975).alias("q975"), r(F.max(x)).alias("high"))


@query(f"WITH {CELLS}, m AS (SELECT condition, acinus, avg(mito_density) AS m FROM cells WHERE acinus IS NOT NULL GROUP BY condition, acinus HAVING avg(mito_density) IS NOT NULL) SELECT condition, round(avg(m), 8) AS mean, round(stddev_pop(m) / sqrt(count(m)), 8) AS sem, count(m) AS n FROM m GROUP BY condition")
def replicate_sem(spark: SparkSession, d: str) -> DataFrame:
    """Mean over acini and its standard error."""
    return B.pooled_curve(cells(spark, d, ["mito_density"]).where("acinus is not null"), "acinus", ["condition"], "mito_density").select("condition", r("mean").alias("mean"), r("sem").alias("sem"), "n")


@query(f"WITH {MITO} SELECT liver_id, array_to_string(list_sort(list(DISTINCT tile_section)), ';') AS tiles, list_sort(list(DISTINCT region_id)) AS regions FROM mito WHERE liver_id IS NOT NULL GROUP BY liver_id")
def joined_texts(spark: SparkSession, d: str) -> DataFrame:
    """A group's texts, sorted, joined and as an array."""
    few = mito(spark, d).where("liver_id is not null").select("liver_id", "tile_section", "region_id").distinct()
    return few.groupBy("liver_id").agg(F.array_join(F.array_sort(F.collect_set("tile_section")), ";").alias("tiles"), F.array_sort(F.collect_set("region_id")).alias("regions"))


@query(f"WITH {CELLS}, first AS (SELECT cell, min_by(liver_id, row_id) AS liver FROM (SELECT upper(trim(cell_label, ' ')) AS cell, liver_id, row_id FROM fig5_ivm_control_group_mitochondria_properties WHERE liver_id IS NOT NULL) GROUP BY cell) SELECT l.row_id, first.liver FROM (SELECT row_id, upper(trim(cell_label, ' ')) AS cell FROM fig5_ivm_control_group_lipid_droplets_properties) l LEFT JOIN first USING (cell)")
def lookup_validated(spark: SparkSession, d: str) -> DataFrame:
    """Left lookup of the first row of each key."""
    side = table(spark, d, "fig5_ivm_control_group_mitochondria_properties").where("liver_id is not null").select(F.upper(F.trim("cell_label")).alias("cell"), F.col("liver_id").alias("liver"), F.col("row_id").alias("at"))
    return G.lookup(droplets(spark, d).select("row_id", "cell"), side, "cell", ["liver"], [F.col("at")]).select("row_id", "liver")


@query(f"WITH {CELLS} SELECT row_id, round(mito_density - avg(mito_density) OVER (PARTITION BY condition) + avg(mito_density) OVER (), 8) AS corrected, round(avg(mito_density) OVER (PARTITION BY acinus), 8) AS acinus_mean FROM cells")
def location_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Batch location correction and means brought back to rows."""
    c = cells(spark, d, ["mito_density"])
    means = {k: c.groupBy(k).agg(F.avg("mito_density").alias(f"{k}_mean")) for k in ("condition", "acinus")}
    whole = c.agg(F.avg("mito_density").alias("whole")).first()[0]
    joined = c.join(means["condition"], "condition").join(means["acinus"], c["acinus"].eqNullSafe(means["acinus"]["acinus"]), "left")
    return joined.select("row_id", r(F.col("mito_density") - F.col("condition_mean") + F.lit(whole)).alias("corrected"), r("acinus_mean").alias("acinus_mean"))


@query(f"WITH {CELLS} SELECT c.row_id FROM cells c WHERE EXISTS (SELECT 1 FROM probe_cells p WHERE p.row_id = c.row_id)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Membership by semi join."""
    return cells(spark, d, []).select("row_id").join(table(spark, d, "probe_cells"), "row_id", "left_semi")


@query(f"WITH {CELLS}, g AS (SELECT a.condition, b.cat FROM (SELECT DISTINCT condition FROM cells) a, (SELECT unnest([1, 2, 3, 4, 5]) AS cat) b) SELECT g.condition, CAST(g.cat AS INTEGER) AS cat, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT condition, cat, count(*) AS n FROM cells GROUP BY condition, cat) x ON g.condition = x.condition AND g.cat = x.cat")
def filled_grid(spark: SparkSession, d: str) -> DataFrame:
    """Counts for every pair of condition and category, missing ones 0."""
    c = cells(spark, d, [])
    counted = c.groupBy("condition", "cat").agg(F.count("*").alias("n"))
    grid = c.select("condition").distinct().withColumn("cat", F.explode(F.array(*[F.lit(v) for v in CATS])))
    return grid.join(counted, ["condition", "cat"], "left").na.fill(0, ["n"])


@query("SELECT 'mito' AS tab, row_id, perimeter, aspect_ratio FROM fig5_ivm_control_group_mitochondria_properties UNION ALL SELECT 'ld', row_id, perimeter, NULL FROM fig5_ivm_control_group_lipid_droplets_properties")
def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Union by name with the table's tag, missing columns null."""
    parts = {"mito": table(spark, d, "fig5_ivm_control_group_mitochondria_properties").select("row_id", "perimeter", "aspect_ratio"), "ld": table(spark, d, "fig5_ivm_control_group_lipid_droplets_properties").select("row_id", "perimeter")}
    return W.union_tagged(parts, "tab").select("tab", "row_id", "perimeter", "aspect_ratio")


@query("SELECT cell FROM (SELECT upper(trim(cell_label, ' ')) AS cell FROM fig5_ivm_control_group_mitochondria_properties WHERE cell_label IS NOT NULL EXCEPT SELECT upper(trim(cell_label, ' ')) FROM fig5_ivm_control_group_lipid_droplets_properties WHERE cell_label IS NOT NULL)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Cells with mitochondria but no droplets."""
    a, b = mito(spark, d).where("cell is not null").select("cell").distinct(), droplets(spark, d).where("cell is not null").select("cell")
    return a.join(b, "cell", "left_anti")


LOW, HIGH, BINS = -0.95, 0.95, 60
_BIN = bin_sql("position", LOW, HIGH, BINS)


@query(f"WITH {CELLS} SELECT row_id, coalesce({_BIN}, -1) AS closed_right, coalesce(CASE WHEN position >= -1 AND position < 1 THEN CAST(least(19, floor((position + 1) / 0.1)) AS INTEGER) END, -1) AS closed_left FROM cells")
def bins_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Bins closed right over a fixed range, and closed left."""
    x = F.col("position")
    return cells(spark, d, []).select("row_id", F.coalesce(B.right_closed(x, LOW, HIGH, BINS), F.lit(-1)).alias("closed_right"), F.coalesce(B.left_closed(x, -1.0, 1.0, 20), F.lit(-1)).alias("closed_left"))


_Q8 = ", ".join(f"quantile_cont(position, {i / 8})" for i in range(9))


@query(f"WITH {CELLS}, k AS (SELECT * FROM cells WHERE position IS NOT NULL AND mito_density IS NOT NULL), e AS (SELECT condition, list_sort(list_distinct([{_Q8}])) AS edges FROM k GROUP BY condition), b AS (SELECT k.condition, greatest(0, len(list_filter(edges, lambda x: x < position)) - 1) AS bin, mito_density FROM k JOIN e USING (condition)) SELECT condition, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(mito_density), 8) AS mean FROM b GROUP BY ALL")
def bins_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantile bins in each condition, and their means."""
    known = cells(spark, d, ["mito_density"]).where("position is not null and mito_density is not null")
    return B.quantile_bins(known, "position", 8, ["condition"]).groupBy("condition", "bin").agg(F.count("*").alias("n"), r(F.avg("mito_density")).alias("mean"))


@query(f"WITH {CELLS}, h AS (SELECT cat, CAST(least(39, floor((position + 1) / 0.05)) AS INTEGER) AS bin, count(*) AS n FROM cells WHERE position BETWEEN -1 AND 1 AND cat IS NOT NULL GROUP BY ALL), g AS (SELECT DISTINCT cat, CAST(b.bin AS INTEGER) AS bin FROM cells, (SELECT unnest(range(40)) AS bin) b WHERE cat IS NOT NULL) SELECT g.cat, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (cat, bin)")
def histogram_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Histogram with empty bins."""
    return B.histogram(cells(spark, d, []).where("cat is not null"), F.col("position"), -1.0, 1.0, 40, ["cat"])


_P = f"p AS (SELECT condition, {_BIN} AS bin, cat FROM cells WHERE cat IS NOT NULL AND condition IN ('CNT', 'STV', 'WD')), c AS (SELECT condition, bin, cat, count(*) AS n FROM p WHERE bin IS NOT NULL GROUP BY ALL), s AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY condition, bin) AS share FROM c)"


def known_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d, []).where(F.col("cat").isNotNull() & F.col("condition").isin(*CONDITIONS))


@query(f"WITH {CELLS}, {_P} SELECT condition, bin, cat, n, round(share, 8) AS share FROM s")
def bin_category_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of categories in every bin."""
    binned = known_cells(spark, d).withColumn("bin", B.right_closed(F.col("position"), LOW, HIGH, BINS)).where("bin is not null")
    return B.shares(binned, ["condition", "bin"], "cat").select("condition", "bin", "cat", "n", r("share").alias("share"))


def curves(spark: SparkSession, d: str) -> DataFrame:
    return B.diversity_curve(known_cells(spark, d), ["condition"], F.col("position"), "cat", LOW, HIGH, BINS, 5)


_CURVE = f"{_P}, i AS (SELECT condition, bin, CAST(sum(n) AS BIGINT) AS n_cells, sum(-share * log2(share)) AS h, sum(share * share) AS dd FROM s GROUP BY ALL), g AS (SELECT x.condition, CAST(b.bin AS INTEGER) AS bin FROM (SELECT DISTINCT condition FROM p) x, (SELECT unnest(range({BINS})) AS bin) b), w AS (SELECT g.condition, g.bin, coalesce(n_cells, 0) AS n_cells, h, dd, h / log2(5) AS e FROM g LEFT JOIN i ON g.condition = i.condition AND g.bin = i.bin)"


@query(f"WITH {CELLS}, {_CURVE} SELECT condition, bin, n_cells, round(h, 8) + 0.0 AS H, round(dd, 8) AS D, round(e, 8) + 0.0 AS E FROM w")
def diversity_curves(spark: SparkSession, d: str) -> DataFrame:
    """Shannon, Simpson and evenness in every bin of every condition."""
    return curves(spark, d).select("condition", "bin", "n_cells", r("H").alias("H"), r("D").alias("D"), r("E").alias("E"))


@query(f"WITH {CELLS}, {_CURVE}, wide AS (SELECT bin, " + ", ".join(f"max({v}) FILTER (condition = '{c}') AS {c}_{n}" for c in CONDITIONS for v, n in (("h", "H"), ("dd", "D"), ("n_cells", "n"))) + f" FROM w GROUP BY bin) SELECT bin, round({LOW} + bin * {(HIGH - LOW) / BINS}, 8) + 0.0 AS bin_left, " + ", ".join(f"round({c}_H, 8) + 0.0 AS {c}_H, round({c}_D, 8) AS {c}_D, {c}_n" for c in CONDITIONS) + ", " + ", ".join(f"round(CASE WHEN CNT_{n} <> 0 THEN ({c}_{n} - CNT_{n}) / CNT_{n} * 100 END, 8) + 0.0 AS {c}_{n}_change" for c in ("STV", "WD") for n in "HD") + " FROM wide")
def diversity_wide_change(spark: SparkSession, d: str) -> DataFrame:
    """B12, P20 (flagship): the curves side by side, and their change against control in percent."""
    long = curves(spark, d)
    when = lambda c, v: F.max(F.when(F.col("condition") == c, F.col(v)))
    wide = long.groupBy("bin").agg(F.first("bin_left").alias("bin_left"), *[when(c, v).alias(f"{c}_{n}") for c in CONDITIONS for v, n in (("H", "H"), ("D", "D"), ("n_cells", "n"))])
    change = [r(C.percent_change(F.col(f"{c}_{n}"), F.col(f"CNT_{n}"))).alias(f"{c}_{n}_change") for c in ("STV", "WD") for n in "HD"]
    return wide.select("bin", r("bin_left").alias("bin_left"), *[x for c in CONDITIONS for x in (r(f"{c}_H").alias(f"{c}_H"), r(f"{c}_D").alias(f"{c}_D"), F.col(f"{c}_n"))], *change)


_B10 = "CASE WHEN position >= -1 AND position < 1 THEN floor((position + 1) / 0.2) END"


@query(f"WITH {CELLS}, p AS (SELECT acinus, cat, {_B10} AS bin FROM cells WHERE acinus IS NOT NULL AND cat IS NOT NULL), a AS (SELECT acinus, cat, count(*) AS n FROM p GROUP BY ALL), h AS (SELECT acinus, sum(-q * log2(q)) AS h FROM (SELECT acinus, n * 1.0 / sum(n) OVER (PARTITION BY acinus) AS q FROM a) GROUP BY acinus), b AS (SELECT acinus, bin, cat, count(*) AS n FROM p WHERE bin IS NOT NULL GROUP BY ALL), s AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY acinus, bin) AS q FROM b), x AS (SELECT acinus, bin, sum(n) AS m, sum(-q * log2(q)) AS hb, max(q) AS top FROM s GROUP BY ALL), y AS (SELECT acinus, sum(m * hb) / sum(m) AS hg, sum(m * top) / sum(m) AS acc FROM x GROUP BY acinus) SELECT acinus, round(h, 8) + 0.0 AS h, round(hg, 8) + 0.0 AS h_given, round(CASE WHEN h <> 0 THEN 1 - hg / h END, 8) + 0.0 AS fraction_explained, round(acc, 8) AS accuracy FROM h LEFT JOIN y USING (acinus)")
def entropy_explained(spark: SparkSession, d: str) -> DataFrame:
    """How far the position explains the category in every acinus."""
    known = cells(spark, d, []).where("acinus is not null and cat is not null").withColumn("bin", B.left_closed(F.col("position"), -1.0, 1.0, 10))
    return B.conditional_entropy(known, ["acinus"], "cat").select("acinus", r("h").alias("h"), r("h_given").alias("h_given"), r("fraction_explained").alias("fraction_explained"), r("accuracy").alias("accuracy"))


@query(f"WITH {CELLS}, m AS (SELECT condition, {_BIN} AS bin, acinus, avg(mito_density) AS m FROM cells WHERE acinus IS NOT NULL GROUP BY ALL) SELECT condition, bin, round(avg(m), 8) AS mean, round(stddev_pop(m) / sqrt(count(m)), 8) AS sem, count(m) AS n FROM m WHERE m IS NOT NULL AND bin IS NOT NULL GROUP BY ALL")
def pooled_curve(spark: SparkSession, d: str) -> DataFrame:
    """Mean curve over acini with its standard error."""
    binned = cells(spark, d, ["mito_density"]).withColumn("bin", B.right_closed(F.col("position"), LOW, HIGH, BINS)).where("bin is not null and acinus is not null")
    return B.pooled_curve(binned, "acinus", ["condition", "bin"], "mito_density").select("condition", "bin", r("mean").alias("mean"), r("sem").alias("sem"), "n")


_ENT = " + ".join(f'(-"{p}" * ln("{p}" + 1e-12))' for p in POSTERIORS)


@query(f"WITH {CELLS} SELECT condition, round(avg(({_ENT}) / ln(5)), 8) AS entropy FROM cells GROUP BY condition")
def membership_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Normalised entropy of soft memberships."""
    from lobule.operators.clustering import membership_entropy as entropy

    return cells(spark, d, POSTERIORS).groupBy("condition").agg(r(F.avg(entropy(POSTERIORS))).alias("entropy"))


@query(f"WITH {CELLS} SELECT row_id, rank() OVER (PARTITION BY condition ORDER BY area) + (count(*) OVER (PARTITION BY condition, area) - 1) / 2.0 AS rank FROM cells WHERE area IS NOT NULL")
def average_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks with ties averaged."""
    return cells(spark, d, ["area"]).where("area is not null").select("row_id", W.average_rank(F.col("area"), ["condition"]).alias("rank"))


@query(f"WITH {CELLS} SELECT condition, row_id, CAST(row_number() OVER (PARTITION BY condition ORDER BY area DESC, row_id) AS INTEGER) AS place FROM cells WHERE area IS NOT NULL QUALIFY place <= 10")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest cells of every condition."""
    known = cells(spark, d, ["area"]).where("area is not null")
    return W.top_per_group(known, ["condition"], [F.desc("area"), F.asc("row_id")], 10).select("condition", "row_id", "place")


@query(f"WITH {CELLS}, k AS (SELECT condition, row_id, cat, CAST(row_number() OVER (PARTITION BY condition ORDER BY area DESC, row_id) AS INTEGER) AS place FROM cells WHERE area IS NOT NULL), f AS (SELECT condition, min(place) AS first FROM k WHERE cat = 5 GROUP BY condition) SELECT k.condition, row_id, place FROM k LEFT JOIN f ON k.condition = f.condition WHERE place <= 5 OR place = first")
def top_with_forced(spark: SparkSession, d: str) -> DataFrame:
    """The five largest cells and the largest of category 5."""
    known = cells(spark, d, ["area"]).where("area is not null")
    return W.top_with_forced(known, ["condition"], [F.desc("area"), F.asc("row_id")], 5, F.coalesce(F.col("cat") == 5, F.lit(False))).select("condition", "row_id", "place")


@query(f"WITH {CELLS} SELECT condition, arg_max(row_id, (area, -row_id)) AS row_id, round(max(area), 8) AS area FROM cells WHERE area IS NOT NULL GROUP BY condition")
def best_row(spark: SparkSession, d: str) -> DataFrame:
    """The row with the largest value, ties by id."""
    return W.best_row(cells(spark, d, ["area"]), ["condition"], "area", "row_id", ["row_id", "area"]).select("condition", "row_id", r("area").alias("area"))


@query(f"WITH {CELLS}, k AS (SELECT row_id, position, row_number() OVER (ORDER BY position DESC, row_id) AS t, row_number() OVER (ORDER BY position, row_id) AS b, count(*) OVER () AS n FROM cells WHERE position IS NOT NULL) SELECT row_id, 'top' AS side FROM k WHERE t <= greatest(1, round_even(0.1 * n, 0)) UNION ALL SELECT row_id, 'bottom' FROM k WHERE b <= greatest(1, round_even(0.1 * n, 0))")
def extreme_share(spark: SparkSession, d: str) -> DataFrame:
    """The tenth with the largest, and with the smallest positions."""
    return W.extreme_share(cells(spark, d, []), "position", "row_id").select("row_id", "side")


@query(f"WITH {CELLS} SELECT row_id, round(CASE WHEN area IS NOT NULL THEN coalesce((area - min(area) OVER w) / nullif(max(area) OVER w - min(area) OVER w, 0), 0.5) END, 8) AS by_group, round((mito_density - (SELECT avg(mito_density) FROM cells)) / (SELECT stddev_pop(mito_density) FROM cells), 8) + 0.0 AS z, round((ld_density - (SELECT min(ld_density) FROM cells)) / (SELECT max(ld_density) - min(ld_density) FROM cells), 8) AS unit FROM cells WINDOW w AS (PARTITION BY acinus)")
def normalised(spark: SparkSession, d: str) -> DataFrame:
    """Min-max by group, z-scores and min-max over all rows."""
    c = cells(spark, d, ["area", "mito_density", "ld_density"])
    c = W.scaled(W.scaled(c, ["mito_density"]), ["ld_density"], "minmax")
    return c.select("row_id", r(W.minmax(F.col("area"), ["acinus"])).alias("by_group"), r("mito_density").alias("z"), r("ld_density").alias("unit"))


@query(f"WITH {CELLS}, c AS (SELECT condition, cat, count(*) AS n FROM cells WHERE cat IS NOT NULL GROUP BY ALL) SELECT condition, cat, round(n * 1.0 / sum(n) OVER (PARTITION BY condition), 8) AS p, CAST(sum(n) OVER (PARTITION BY condition ORDER BY cat) AS BIGINT) AS upto FROM c")
def row_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Row-normalised counts and running sums."""
    counted = cells(spark, d, []).where("cat is not null").groupBy("condition", "cat").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("condition").orderBy("cat"))
    return W.row_normalise(counted.withColumn("upto", running), ["condition"], "n").select("condition", "cat", r("p").alias("p"), "upto")


_H = "((row_id % 2147483648 * 1103515245 + 12345) % 2147483648 * 69069 + 1) % 2147483648"


@query(f"SELECT row_id, {_H} < CAST(floor(0.8 * 2147483648) AS BIGINT) AS is_train, ({_H} // 64) % 5 AS fold FROM full_concat_clusters")
def hash_folds(spark: SparkSession, d: str) -> DataFrame:
    """Train rows and folds by a scattered key."""
    key = F.col("row_id")
    return table(spark, d, "full_concat_clusters").select("row_id", W.is_train(key).alias("is_train"), W.folds(key, 5).alias("fold"))


@query(f"SELECT row_id FROM full_concat_clusters ORDER BY {_H}, row_id LIMIT 390")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of exactly 390 rows (the sampling operator's own limit)."""
    return W.hash_sample(table(spark, d, "full_concat_clusters"), "row_id", 390).select("row_id")


@query(f"WITH {CELLS}, k AS (SELECT row_id, condition, cat FROM cells WHERE cat IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY row_id) AS at FROM k), b AS (SELECT condition, cat AS shuffled, row_number() OVER (PARTITION BY condition ORDER BY {_H}, row_id) AS at FROM k) SELECT a.row_id, shuffled FROM a JOIN b ON a.condition = b.condition AND a.at = b.at")
def permuted(spark: SparkSession, d: str) -> DataFrame:
    """Categories shuffled within each condition."""
    return W.permute_within(cells(spark, d, []).where("cat is not null").select("row_id", "condition", "cat"), ["condition"], "cat", "row_id").select("row_id", "shuffled")


@query()
def bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of the mean, Poisson resamples."""
    runs = W.bootstrap(cells(spark, d, ["mito_density"]).where("mito_density is not null").select("row_id", "condition", "mito_density"), "row_id", 200)
    means = runs.groupBy("condition", "run").agg((F.sum(F.col("mito_density") * F.col("copies")) / F.sum("copies")).alias("m"))
    return means.groupBy("condition").agg(r(F.avg("m")).alias("mean"), r(F.stddev_samp("m")).alias("sem"), r(F.percentile("m", 0.025)).alias("low"), r(F.percentile("m", 0.975)).alias("high"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(rank() OVER (ORDER BY CAST(json_extract(props, '$.k') AS BIGINT) DESC, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 20")
def json_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Ranking of values read from JSON."""
    k = F.get_json_object("props", "$.k").cast("long")
    top = table(spark, d, "events").select("event_id", k.alias("k")).orderBy(F.desc("k"), "event_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("k"), "event_id")))


@query(f"WITH {CELLS} SELECT condition, count(*) AS n, count(*) FILTER (mito_density IS NULL) AS null_mito_density, count(*) FILTER (ld_density IS NULL) AS null_ld_density FROM cells GROUP BY condition")
def null_report(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of groups and numbers of unusable values."""
    from lobule.sources.files import null_report as report

    return report(cells(spark, d, ["mito_density", "ld_density"]).select("condition", "mito_density", "ld_density"), ["condition"])


@query(f"WITH {CELLS} SELECT count(*) AS n FROM cells WHERE " + " AND ".join(f'"{f}" IS NOT NULL' for f in FEATURES))
def complete_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that have every feature that varies."""
    c = cells(spark, d, FEATURES)
    return C.complete_rows(c, C.drop_constant(c, C.feature_columns(c, ["row_id", "cell_id_linked", "cat", "cat0", "position"]))).agg(F.count("*").alias("n"))


@query(f"WITH {CELLS} SELECT row_id, list_transform([{', '.join(chr(34) + f + chr(34) for f in FEATURES[:4])}], lambda v: coalesce(v, 0.0)) AS x FROM cells")
def modality_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A table as a matrix of arrays, unknown values 0."""
    from lobule.sources.files import modality_matrix as matrix

    raw = table(spark, d, "full_concat_clusters").select("row_id", *FEATURES[:4], "ascini_position")
    return matrix(raw).select(F.col("cell_id").alias("row_id"), "x")


