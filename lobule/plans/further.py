"""Queries over the sources and sinks, derived columns, result tables, bins, regression and group distances that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobule.functions import cleaning as C
from lobule.functions import labels
from lobule.operators import alignment as A
from lobule.operators import bins as B
from lobule.operators import clustering as K
from lobule.operators import graph as G
from lobule.operators import grouping, ranking, spatial
from lobule.operators import statistics as T
from lobule.plans.analysis import _CE, _D, _F, _IVM, _KN, _MOM, _PL, _V, RADIUS, VECTOR, evenly, neighbour_graph, placed, two_sides, vectors
from lobule.plans.base import CELLS, FEATURES, POSTERIORS, cells, r
from lobule.plans.tables import ivm_cells
from lobule.shared import scratch, stage, table
from lobule.sources import files as S

QUERIES, ORACLE = {}, {}
PARTS = ["component_1", "component_2", "component_3"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def long_of(names: list[str]) -> str:
    return "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, condition AS g, {c} AS x FROM cells WHERE {c} IS NOT NULL" for c in names) + ")"


_ALL = f"WITH {CELLS}, {long_of(FEATURES)}, {_MOM.format('long')}"


def all_long(spark: SparkSession, d: str) -> DataFrame:
    return T.long_values(cells(spark, d, FEATURES), ["condition"], FEATURES)


# sources and sinks


@query(f"WITH {CELLS} SELECT row_id, {', '.join(f'round({c}, 8) + 0.0 AS {c}' for c in PARTS)} FROM cells WHERE {' AND '.join(f'{c} IS NOT NULL' for c in PARTS)}")
def components_scan(spark: SparkSession, d: str) -> DataFrame:
    """Components that were computed before, complete rows."""
    return S.precomputed_components(table(spark, d, "full_concat_clusters"), "row_id").select("row_id", *[r(c).alias(c) for c in PARTS])


@query(f"WITH {CELLS} SELECT row_id, round(position, 8) + 0.0 AS position, round(component_1, 8) + 0.0 AS component_1, round(component_2, 8) + 0.0 AS component_2, cat AS cluster FROM cells WHERE cat IS NOT NULL")
def assignments_sink(spark: SparkSession, d: str) -> DataFrame:
    """Cluster assignments written as CSV and read back."""
    path = scratch(spark, "assignments")
    S.write_assignments(cells(spark, d, PARTS[:2]).where("cat is not null"), path, "row_id", "position", PARTS[:2], "cat")
    return spark.read.csv(path, header=True, schema="row_id long, position double, component_1 double, component_2 double, cluster int").select("row_id", r("position").alias("position"), *[r(c).alias(c) for c in PARTS[:2]], "cluster")


@query(f"WITH {CELLS} SELECT row_id, labels, round(area, 8) + 0.0 AS area, round(mito_density, 8) + 0.0 AS mito_density FROM cells WHERE labels IS NOT NULL AND labels NOT IN ('', '-') AND labels = trim(labels, ' ')")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """A matrix written as CSV with '-' for unknown values, read by its header from the first file that exists."""
    path = scratch(spark, "matrix")
    some = cells(spark, d, ["area", "mito_density"]).where("labels not in ('', '-') and labels = trim(labels)").select(F.col("row_id").cast("string").alias("row_id"), "labels", "area", "mito_density")
    some.write.csv(path, header=True, nullValue="-")
    got = S.scan_first(spark, [path + "-not-there", path], ["row_id", "labels"])
    return got.select(F.col("row_id").cast("long").alias("row_id"), "labels", r("area").alias("area"), r("mito_density").alias("mito_density"))


@query(f"WITH {CELLS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean FROM cells" for c in FEATURES))
def model_sink(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of a fitted model (the feature means) written as JSON and read back."""
    path = scratch(spark, "model")
    row = cells(spark, d, FEATURES).agg(*[F.avg(c).alias(c) for c in FEATURES]).first()
    S.write_model(spark, path, {"features": FEATURES, "means": [row[c] for c in FEATURES]})
    model = S.read_model(spark, path)
    return spark.createDataFrame(list(zip(model["features"], model["means"])), "feature string, mean double").select("feature", r("mean", 6).alias("mean"))


@query(f"WITH {CELLS} SELECT condition || ': ' || count(*) AS line FROM cells GROUP BY condition")
def text_sink(spark: SparkSession, d: str) -> DataFrame:
    """A report written as lines of text and read back."""
    path = scratch(spark, "report")
    S.write_lines(cells(spark, d, []).groupBy("condition").count().select(F.concat_ws(": ", "condition", "count").alias("line")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT feature, CASE WHEN feature IN (SELECT column_name FROM (DESCRIBE full_concat_clusters)) THEN 'present' ELSE 'missing' END AS status FROM feature_scale UNION ALL SELECT column_name, 'extra' FROM (DESCRIBE full_concat_clusters) WHERE column_name NOT IN (SELECT feature FROM feature_scale)")
def feature_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted features that the cell table has or lacks, and its other columns."""
    wanted = [x[0] for x in table(spark, d, "feature_scale").select("feature").collect()]  # 15 rows
    return C.feature_report(table(spark, d, "full_concat_clusters"), wanted, extras=True)


# derived columns


def _levels(c: str) -> str:
    return f"""SELECT row_id, CASE WHEN numeric THEN dense_rank() OVER (PARTITION BY numeric ORDER BY v) - 1 ELSE dense_rank() OVER (PARTITION BY numeric ORDER BY t) - 1 END AS level_no FROM
      (SELECT row_id, CAST({c} AS VARCHAR) AS t, TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS v, (SELECT count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) > 0.8 * count({c}) FROM full_concat_clusters) AS numeric FROM full_concat_clusters WHERE {c} IS NOT NULL) WHERE NOT numeric OR v IS NOT NULL"""


@query(f"""SELECT a.row_id, CAST(a.level_no AS INTEGER) AS group_level, CAST(b.level_no AS INTEGER) AS cluster_level FROM ({_levels('"group"')}) a JOIN ({_levels('Prediction')}) b ON a.row_id = b.row_id""")
def ordinal_levels(spark: SparkSession, d: str) -> DataFrame:
    """Categories as numbers from 0, in the order of numbers where most values are numbers, else of texts."""
    raw = table(spark, d, "full_concat_clusters").select("row_id", "group", "Prediction")
    both = grouping.ordinal_levels(grouping.ordinal_levels(raw, "group", "group_level"), "Prediction", "cluster_level")
    return both.where("group_level is not null and cluster_level is not null").select("row_id", "group_level", "cluster_level")


@query(f"WITH {CELLS} SELECT row_id, 'H' || dense_rank() OVER (ORDER BY cat) AS label FROM cells WHERE cat IS NOT NULL")
def auto_labels(spark: SparkSession, d: str) -> DataFrame:
    """Clusters named H1, H2, ... in the order of their numbers."""
    return labels.ordered_labels(cells(spark, d, []).where("cat is not null"), "cat", "label").select("row_id", "label")


@query(f"{_ALL}, pr AS (SELECT a.feature, a.g AS a, b.g AS b, a.m AS m1, b.m AS m2, sqrt(a.v / a.n + b.v / b.n) AS se FROM mom a JOIN mom b ON a.feature = b.feature AND a.g < b.g WHERE a.n > 1 AND b.n > 1) SELECT feature, a, b, round(CASE WHEN abs(m1 + m2) / 2 >= 1e-12 THEN (m1 - m2) / ((m1 + m2) / 2) * 100 END, 4) + 0.0 AS percent, round(CASE WHEN abs(m1 + m2) / 2 >= 1e-12 THEN se / abs((m1 + m2) / 2) * 100 END, 4) AS percent_se FROM pr")
def percent_differences(spark: SparkSession, d: str) -> DataFrame:
    """Differences of the conditions' means over the mean of both, in percent, with the standard error on that scale."""
    t = T.percent_pairs(all_long(spark, d), "condition")
    return t.select("feature", "a", "b", r("percent", 4).alias("percent"), r("percent_se", 4).alias("percent_se"))


@query()
def percent_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The same with the 95 % limits of Games-Howell comparisons, as error bars below and above."""
    t = T.percent_pairs(all_long(spark, d), "condition", intervals=True)
    return t.select("feature", "a", "b", *[r(c, 3).alias(c) for c in ("percent", "lower_error", "upper_error")])


_EXPLAINED = """b AS (SELECT acinus, cat, CASE WHEN position BETWEEN -1 AND 1 THEN CAST(least(9, greatest(0, ceil((position + 1) / 0.2) - 1)) AS INTEGER) END AS bin FROM cells WHERE acinus IS NOT NULL AND cat IS NOT NULL),
  h AS (SELECT acinus, -sum(p * log2(p)) AS h, count(*) AS categories FROM (SELECT acinus, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY acinus) AS p FROM b GROUP BY acinus, cat) GROUP BY acinus),
  g AS (SELECT acinus, bin, sum(n) AS m, -sum(n / t * log2(n / t)) AS hb, max(n / t) AS top FROM (SELECT acinus, bin, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY acinus, bin) AS t FROM b WHERE bin IS NOT NULL GROUP BY acinus, bin, cat) GROUP BY acinus, bin),
  e AS (SELECT acinus, sum(m * hb) / sum(m) AS given, sum(m * top) / sum(m) AS accuracy FROM g GROUP BY acinus)"""


@query(f"WITH {CELLS}, {_EXPLAINED} SELECT acinus, round((accuracy - 0.8) / 0.2, 6) + 0.0 AS accuracy_score, round(CASE WHEN h > 1e-12 THEN (1 - given / h - 0.7) / 0.2 END, 6) + 0.0 AS fraction_score, round(0.05 * categories * (categories + 1) / 2, 6) AS pairs_by_chance FROM h JOIN e USING (acinus)")
def decision_scores(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and explained fraction of each acinus around their thresholds, and the category pairs that chance alone makes significant."""
    c = cells(spark, d, []).where("acinus is not null and cat is not null").withColumn("bin", B.right_closed(F.col("position"), -1.0, 1.0, 10))
    e = B.conditional_entropy(c, ["acinus"], "cat").join(c.groupBy("acinus").agg(F.count_distinct("cat").alias("categories")), "acinus").where("accuracy is not null")
    s = spatial.decision_scores(e.withColumn("fraction", F.when(F.col("h") > 1e-12, F.col("fraction_explained"))), "accuracy", "fraction", "categories")
    return s.select("acinus", *[r(x, 6).alias(x) for x in ("accuracy_score", "fraction_score", "pairs_by_chance")])


@query(f"WITH {CELLS} SELECT row_id, round(-component_1, 8) + 0.0 AS mirrored, round(-component_1, 8) + 0.0 AS turned_1, round(-component_2, 8) + 0.0 AS turned_2 FROM cells WHERE component_1 IS NOT NULL AND component_2 IS NOT NULL")
def turned_components(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates mirrored in the first axis, and turned by 180 degrees."""
    c = S.precomputed_components(table(spark, d, "full_concat_clusters"), "row_id", PARTS[:2])
    return c.select("row_id", r(K.mirrored("component_1")).alias("mirrored"), *[r(x).alias(f"turned_{i}") for i, x in enumerate(K.half_turn("component_1", "component_2"), 1)])


# result tables


_WELCH = "e AS (SELECT *, n / v AS wt FROM mom WHERE n > 1 AND v > 0), t AS (SELECT feature, count(*) AS k, sum(wt) AS sw, sum(wt * m) / sum(wt) AS mu FROM e GROUP BY feature), p AS (SELECT e.feature, k, sum(wt * (m - mu) * (m - mu)) AS a, sum((1 - wt / sw) * (1 - wt / sw) / (n - 1)) AS c FROM e JOIN t ON e.feature = t.feature GROUP BY e.feature, k), wl AS (SELECT feature, round(a / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * c), 5) AS welch_f FROM p WHERE k > 1)"


@query(f"{_ALL}, {_WELCH}, an AS ({_F}) SELECT an.feature, f, eta2, welch_f FROM an LEFT JOIN wl ON an.feature = wl.feature")
def anova_welch(spark: SparkSession, d: str) -> DataFrame:
    """Both analyses of variance of every feature side by side."""
    long = all_long(spark, d)
    joined = grouping.join_results({"anova": T.anova(long, "condition"), "welch": T.welch(long, "condition").select("feature", F.col("f").alias("welch_f"))}, "feature")
    return joined.select("feature", r("f", 5).alias("f"), r("eta2").alias("eta2"), r("welch_f", 5).alias("welch_f"))


@query(f'WITH {CELLS} SELECT row_id, cat, round(component_1, 8) + 0.0 AS component_1, round(mito_density, 8) + 0.0 AS mito_density, round("0", 8) + 0.0 AS p0 FROM cells')
def zipped_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the same rows put side by side by their row id, never by place."""
    c = cells(spark, d, ["component_1", "mito_density", "0"])
    parts = [c.select("row_id", "cat"), c.select("row_id", "component_1"), c.select("row_id", "mito_density"), c.select("row_id", F.col("0").alias("p0"))]
    return grouping.zip_by_key(parts, "row_id").select("row_id", "cat", *[r(x).alias(x) for x in ("component_1", "mito_density", "p0")])


@query(f"{_PL}, every AS (SELECT a.stack_id, a.row_id AS a, b.row_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pl a JOIN pl b ON a.stack_id = b.stack_id AND a.row_id <> b.row_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS place FROM every) SELECT stack_id, a, b, CAST(place AS INTEGER) AS place, round(d, 6) AS d FROM ranked WHERE place <= 6 OR d <= 60")
def neighbours_union(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest cells of the same stack however far, and all others within a radius."""
    return spatial.neighbours_or_within(placed(spark, d), ["stack_id"], "row_id", "x", "y", 6, 60.0, RADIUS).select("stack_id", "a", "b", "place", r("d", 6).alias("d"))


_OVERLAP = "ov AS (SELECT max(o) AS o FROM (" + " UNION ALL ".join(f'SELECT avg(least("{i}", "{j}")) AS o FROM cells' for i in range(5) for j in range(i + 1, 5)) + "))"
_PE = " + ".join(f'-"{p}" * ln("{p}" + 1e-12)' for p in POSTERIORS)


@query(f"{_V}, {_CE}, {_OVERLAP}, db AS (SELECT avg(r) AS db FROM (SELECT a.cat, max((wa.s + wb.s) / {_D('a', 'b')}) AS r FROM c a JOIN c b ON a.cat <> b.cat JOIN w wa ON wa.cat = a.cat JOIN w wb ON wb.cat = b.cat GROUP BY a.cat)), en AS (SELECT avg(({_PE}) / ln(5)) AS en FROM cells) SELECT round((0.15 * (1 - o) + 0.15 * (1 / (1 + db)) + 0.15 * (1 - en)) / 0.45, 6) AS score, round(o, 6) AS overlap, round(db, 4) AS davies_bouldin, round(en, 6) AS entropy FROM ov, db, en")
def measured_composite(spark: SparkSession, d: str) -> DataFrame:
    """Composite quality of the stored clusters from what the table itself tells: overlap, Davies-Bouldin and membership entropy."""
    c = cells(spark, d, POSTERIORS)
    o = K.overlap(c, POSTERIORS).agg(F.max("overlap").alias("o"))
    e = c.agg(F.avg(K.membership_entropy(POSTERIORS)).alias("e"))
    db = K.davies_bouldin(vectors(spark, d), "cat", VECTOR).select(F.col("davies_bouldin").alias("db"))
    none = F.lit(None).cast("double")
    row = o.crossJoin(e).crossJoin(db)  # one row each
    return row.select(r(K.composite(none, F.col("o"), none, none, F.col("db"), F.col("e"), none), 6).alias("score"), r("o", 6).alias("overlap"), r("db", 4).alias("davies_bouldin"), r("e", 6).alias("entropy"))


@query(f"WITH {CELLS}, v AS (SELECT abs(component_1) AS x FROM cells WHERE component_1 IS NOT NULL), q AS (SELECT least(quantile_cont(x, 0.99), 1000.0) AS cut FROM v) SELECT count(*) AS n_before, round(min(x), 6) AS min_before, round(median(x), 6) AS median_before, round(max(x), 6) AS max_before, count(*) FILTER (x < cut) AS n_after, round(max(x) FILTER (x < cut), 6) AS max_after, round(median(x) FILTER (x < cut), 6) AS median_after FROM v, q")
def filter_summary(spark: SparkSession, d: str) -> DataFrame:
    """A column before and after its outliers are cut off at a quantile or a fixed limit."""
    c = cells(spark, d, ["component_1"]).select(F.abs("component_1").alias("x")).where("x is not null")
    s = ranking.before_after(c, ranking.outlier_cut(c, "x", 0.99, 1000.0), "x")
    return s.select("n_before", *[r(f"{x}_before", 6).alias(f"{x}_before") for x in ("min", "median", "max")], "n_after", r("max_after", 6).alias("max_after"), r("median_after", 6).alias("median_after"))


@query(f"WITH {CELLS}, v AS (SELECT row_id, condition, cat, abs(component_1) AS x FROM cells WHERE component_1 IS NOT NULL AND cat IS NOT NULL AND condition IN ('CNT', 'STV')), m AS (SELECT max(x) FILTER (condition = 'CNT' AND cat <> 4) AS c, max(x) FILTER (condition = 'STV') AS s FROM v) SELECT row_id, round(CASE WHEN condition = 'STV' THEN CASE WHEN s > 0 THEN x / s ELSE 0 END WHEN cat = 4 THEN 0 ELSE CASE WHEN c > 0 THEN -x / c ELSE 0 END END, 7) + 0.0 AS signed, round((CASE WHEN condition = 'STV' THEN CASE WHEN s > 0 THEN x / s ELSE 0 END WHEN cat = 4 THEN 0 ELSE CASE WHEN c > 0 THEN -x / c ELSE 0 END END + 1) / 2, 7) + 0.0 AS unit FROM v, m")
def signed_axis(spark: SparkSession, d: str) -> DataFrame:
    """Distances on one scale, control from -1, the root at 0, the target side to 1, and the same from 0 to 1."""
    c = cells(spark, d, ["component_1"]).where("component_1 is not null and cat is not null and condition in ('CNT', 'STV')").withColumn("x", F.abs("component_1"))
    target = F.col("condition") == "STV"
    s = ranking.signed_rescale(c, "x", (~target) & (F.col("cat") == 4), target)
    return s.select("row_id", r("signed", 7).alias("signed"), r("unit", 7).alias("unit"))


@query(f"{_ALL}, an AS ({_F}), top AS (SELECT feature FROM an ORDER BY eta2 DESC NULLS LAST, feature LIMIT 10), n AS (SELECT split_part(feature, '_', 1) AS organelle, CASE WHEN regexp_matches(feature, 'aspect_ratio|solidity|circularity') THEN 'shape' WHEN contains(feature, 'distance') THEN 'position' WHEN regexp_matches(feature, 'density|percent') THEN 'abundance' WHEN regexp_matches(feature, 'area|perimeter') THEN 'size' ELSE 'other' END AS class, count(*) AS n FROM top GROUP BY ALL) SELECT o.organelle, c.class, coalesce(n, 0) AS n FROM (VALUES ('mito'), ('peroxisome'), ('ld')) o(organelle) CROSS JOIN (VALUES ('shape'), ('size'), ('position'), ('abundance'), ('other')) c(class) LEFT JOIN n ON n.organelle = o.organelle AND n.class = c.class")
def donut_counts(spark: SparkSession, d: str) -> DataFrame:
    """The ten features that differ most between conditions, counted by organelle and class, absent pairs 0."""
    return T.feature_counts(T.anova(all_long(spark, d), "condition"), "eta2", 10)


@query()
def levene_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many features have unequal variances, by the Brown-Forsythe test at 5 %."""
    return T.violations(T.anova_p(T.levene(all_long(spark, d), "condition")), "p", 0.05)


# bins and entropies


@query(f"WITH {CELLS}, m AS (SELECT min(area) AS lo, max(area) AS hi FROM cells) SELECT CAST(least(20, greatest(1, ceil((area - lo) / ((hi - lo) / 20)))) AS INTEGER) AS bin, count(*) AS n FROM cells, m WHERE area IS NOT NULL GROUP BY 1")
def cut_twenty(spark: SparkSession, d: str) -> DataFrame:
    """Twenty equal bins over the data's own range, numbered from 1, the smallest value in the first."""
    c = cells(spark, d, ["area"])
    return B.data_range_bins(c, "area", 20).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, m AS (SELECT min(position) AS lo, max(position) AS hi FROM cells), s AS (SELECT CASE WHEN lo >= -1.2 AND hi <= 1.2 THEN -1.0 ELSE lo END AS lo, CASE WHEN lo >= -1.2 AND hi <= 1.2 THEN 1.0 ELSE hi END AS hi FROM m) SELECT CAST(least(29, greatest(0, ceil((position - lo) / ((hi - lo) / 30)) - 1)) AS INTEGER) AS bin, count(*) AS n FROM cells, s WHERE position BETWEEN lo AND hi GROUP BY 1")
def snapped_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins over -1..1 where the data keep near it, else over their own range."""
    c = cells(spark, d, [])
    low, high = B.snapped_range(*c.agg(F.min("position"), F.max("position")).first())
    return c.select(B.right_closed(F.col("position"), low, high, 30).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, b AS (SELECT acinus, cat, CASE WHEN position BETWEEN -1 AND 1 THEN CAST(least(29, greatest(0, ceil((position + 1) / (2.0 / 30)) - 1)) AS INTEGER) END AS bin FROM cells WHERE cat IS NOT NULL AND acinus IS NOT NULL), p AS (SELECT acinus, bin, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY acinus, bin) AS t FROM b WHERE bin IS NOT NULL GROUP BY acinus, bin, cat), f AS (SELECT acinus, bin, -sum(n / t * ln(n / t)) AS h, sum(n / t * n / t) AS dd FROM p GROUP BY acinus, bin) SELECT c.acinus, CAST(g.bin AS INTEGER) AS bin, round(coalesce(h, 0), 7) + 0.0 AS h, round(coalesce(dd, 0), 7) AS d, round(coalesce(h, 0) / ln(5), 7) + 0.0 AS e FROM (SELECT DISTINCT acinus FROM b) c CROSS JOIN range(30) g(bin) LEFT JOIN f ON f.acinus = c.acinus AND f.bin = g.bin")
def diversity_natural(spark: SparkSession, d: str) -> DataFrame:
    """The indices with natural logarithms along every acinus, bins without cells as zeros."""
    c = cells(spark, d, []).where("cat is not null and acinus is not null")
    out = B.zero_filled(B.diversity_curve(c, ["acinus"], F.col("position"), "cat", -1.0, 1.0, 30, 5, base="ln"))
    return out.select("acinus", "bin", r("H", 7).alias("h"), r("D", 7).alias("d"), r("E", 7).alias("e"))


@query(f"WITH {CELLS}, p AS (SELECT condition, CASE WHEN position >= 0 THEN 'PV_side' ELSE 'CV_side' END AS zone, cat, CAST(count(*) AS DOUBLE) AS n FROM cells WHERE cat IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY zone, condition) AS t FROM p) SELECT zone, condition, CAST(sum(n) AS BIGINT) AS n, round(-sum(n / t * log2(n / t)) / nullif(log2(count(*)), 0), 7) + 0.0 AS entropy FROM t GROUP BY zone, condition")
def zone_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the categories in each zone and condition over the logarithm of their number, null for a single one."""
    c = cells(spark, d, []).where("cat is not null").withColumn("zone", C.side_of_axis(F.col("position")))
    return B.diversity(c, ["zone", "condition"], "cat").select("zone", "condition", F.col("n_cells").alias("n"), r("E", 7).alias("entropy"))


@query(f"WITH {CELLS}, p AS (SELECT condition, cat, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY condition) AS p FROM cells WHERE cat IS NOT NULL GROUP BY condition, cat), s AS (SELECT *, sum(p) OVER w AS upto, row_number() OVER w AS place FROM p WINDOW w AS (PARTITION BY condition ORDER BY p DESC, cat ROWS UNBOUNDED PRECEDING)) SELECT condition, CAST(min(place) AS INTEGER) AS needed FROM s WHERE upto >= 0.9 - 1e-12 GROUP BY condition")
def shares_to_threshold(spark: SparkSession, d: str) -> DataFrame:
    """How many of the largest categories hold 90 % of a condition's cells."""
    shares = B.shares(cells(spark, d, []).where("cat is not null"), ["condition"], "cat")
    return ranking.places_to(shares, ["condition"], "share", "cat", 0.9).select("condition", "needed")


# regression


@query(f"{_IVM}, f AS (SELECT zone, CAST(count(*) AS DOUBLE) AS n, avg(ld_area) AS mx, avg(tmrm) AS my, regr_sxx(tmrm, ld_area) AS sxx, regr_slope(tmrm, ld_area) AS b, regr_syy(tmrm, ld_area) - regr_slope(tmrm, ld_area) * regr_sxy(tmrm, ld_area) AS rss, min(ld_area) AS lo, max(ld_area) AS hi FROM j WHERE tmrm IS NOT NULL AND ld_area IS NOT NULL GROUP BY zone), g AS (SELECT *, unnest([lo, mx, hi]) AS x, unnest(['low', 'mean', 'high']) AS place FROM f) SELECT zone, place, round(x, 6) AS x, round(my + b * (x - mx), 6) AS fit, round(sqrt(rss / (n - 2) * (1 / n + (x - mx) * (x - mx) / sxx)), 6) AS se_mean, round(sqrt(rss / (n - 2) * (1 + 1 / n + (x - mx) * (x - mx) / sxx)), 6) AS se_new FROM g")
def regression_bands(spark: SparkSession, d: str) -> DataFrame:
    """Fitted values of each zone's regression with the standard errors of the mean and of a new value."""
    c = ivm_cells(spark, d).where("zone is not null")
    b = T.regression_bands(c, ["zone"], "tmrm", "ld_area")
    return b.select("zone", "place", *[r(x, 6).alias(x) for x in ("x", "fit", "se_mean", "se_new")])


@query()
def regression_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The same as 95 % intervals of the mean and of a new value."""
    b = T.band_limits(T.regression_bands(ivm_cells(spark, d).where("zone is not null"), ["zone"], "tmrm", "ld_area"))
    return b.select("zone", "place", *[r(x, 5).alias(x) for x in ("fit", "mean_low", "mean_high", "new_low", "new_high")])


@query(f"{_IVM}, k AS (SELECT tmrm AS y, ld_area AS a, mito_aspect AS b FROM j WHERE tmrm IS NOT NULL AND ld_area IS NOT NULL AND mito_aspect IS NOT NULL), mo AS (SELECT covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM k) SELECT round((ya * bb - yb * ab) / (aa * bb - ab * ab), 6) AS coef_ld_area, round((yb * aa - ya * ab) / (aa * bb - ab * ab), 6) AS coef_mito_aspect FROM mo")
def two_predictors(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of two predictors in one regression."""
    t = T.ols(ivm_cells(spark, d), "tmrm", {"ld_area": F.col("ld_area"), "mito_aspect": F.col("mito_aspect")}).set_index("term")["coef"]
    return spark.createDataFrame([(round(float(t["ld_area"]), 6), round(float(t["mito_aspect"]), 6))], "coef_ld_area double, coef_mito_aspect double")


_FOLD = "((((row_id % 2147483648 * 1103515245 + 12345) % 2147483648 * 69069 + 1) % 2147483648) // 64) % 5"


@query(f"WITH {CELLS}, k AS (SELECT condition, {_FOLD} AS fold, mito_density AS x, peroxisome_density AS y FROM cells WHERE mito_density IS NOT NULL AND peroxisome_density IS NOT NULL), fit AS (SELECT o.condition, o.fold, regr_slope(k.y, k.x) AS b, regr_intercept(k.y, k.x) AS a FROM (SELECT DISTINCT condition, fold FROM k) o JOIN k ON k.condition = o.condition AND k.fold <> o.fold GROUP BY o.condition, o.fold), s AS (SELECT k.condition, k.fold, 1 - sum((y - a - b * x) * (y - a - b * x)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM k JOIN fit ON fit.condition = k.condition AND fit.fold = k.fold GROUP BY k.condition, k.fold) SELECT condition, count(r2) AS folds, round(avg(r2), 5) + 0.0 AS mean_r2, round(stddev_pop(r2), 5) AS sd_r2 FROM s GROUP BY condition")
def fold_r2(spark: SparkSession, d: str) -> DataFrame:
    """R squared of each of five folds, their mean and deviation."""
    c = cells(spark, d, ["mito_density", "peroxisome_density"]).withColumn("fold", ranking.folds(F.col("row_id"), 5))
    return T.fold_scores(c, ["condition"], "peroxisome_density", "mito_density", "fold").select("condition", "folds", r("mean_r2", 5).alias("mean_r2"), r("sd_r2", 5).alias("sd_r2"))


@query(f"WITH {CELLS}, k AS (SELECT condition AS g, position AS x FROM cells WHERE position BETWEEN -1 AND 1), b AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, 1.06 * stddev_samp(x) * pow(count(*), -0.2) AS h FROM k GROUP BY g) SELECT k.g AS condition, CAST(i AS INTEGER) AS place, round(sum(exp(-0.5 * pow((-1 + i * 0.05 - x) / h, 2))) / max(n * h * sqrt(2 * pi())), 6) AS density FROM k JOIN b ON k.g = b.g, range(41) t(i) WHERE h > 0 GROUP BY k.g, i")
def density_grid(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of the position in each condition on a grid."""
    c = cells(spark, d, []).where("position between -1 and 1")
    return T.kernel_density(c, "condition", "position", -1.0, 1.0, 41).select("condition", "place", r("density", 6).alias("density"))


# distances between groups


def _scatter(e: str, seed: int) -> str:
    return f"((({e} % 2147483648 * 1103515245 + 12345 + {seed * 7919}) % 2147483648 * 69069 + 1) % 2147483648)"


_PAIRED = f"""WITH {CELLS}, l AS (SELECT cat, acinus, position AS x FROM cells WHERE condition = 'CNT' AND cat IS NOT NULL AND acinus IS NOT NULL AND position IS NOT NULL),
  q AS (SELECT cat, acinus, position AS x FROM cells WHERE condition = 'STV' AND cat IS NOT NULL AND acinus IS NOT NULL AND position IS NOT NULL),
  la AS (SELECT cat AS a, acinus AS aa, row_number() OVER (PARTITION BY cat ORDER BY acinus) - 1 AS i, count(*) OVER (PARTITION BY cat) AS na FROM (SELECT DISTINCT cat, acinus FROM l)),
  qa AS (SELECT cat AS b, acinus AS ab, row_number() OVER (PARTITION BY cat ORDER BY acinus) - 1 AS j, count(*) OVER (PARTITION BY cat) AS nb FROM (SELECT DISTINCT cat, acinus FROM q)),
  nn AS (SELECT a, b, na, nb FROM (SELECT DISTINCT a, na FROM la), (SELECT DISTINCT b, nb FROM qa)),
  dr AS (SELECT a, b, t, CASE WHEN na * nb <= 500 THEN t // nb ELSE {_scatter('t', 1)} // 64 % na END AS i, CASE WHEN na * nb <= 500 THEN t % nb ELSE {_scatter('t', 2)} // 64 % nb END AS j FROM nn, range(500) r(t) WHERE t < na * nb),
  pr AS (SELECT dr.a, dr.b, dr.t, la.aa, qa.ab FROM dr JOIN la ON la.a = dr.a AND la.i = dr.i JOIN qa ON qa.b = dr.b AND qa.j = dr.j),
  u AS (SELECT pr.a, pr.b, pr.t, l.x, 1.0 / count(*) OVER (PARTITION BY pr.a, pr.b, pr.t) AS n FROM pr JOIN l ON l.cat = pr.a AND l.acinus = pr.aa UNION ALL SELECT pr.a, pr.b, pr.t, q.x, -1.0 / count(*) OVER (PARTITION BY pr.a, pr.b, pr.t) FROM pr JOIN q ON q.cat = pr.b AND q.acinus = pr.ab),
  s AS (SELECT a, b, t, x, sum(n) AS n FROM u GROUP BY a, b, t, x), g AS (SELECT a, b, t, abs(sum(n) OVER (PARTITION BY a, b, t ORDER BY x ROWS UNBOUNDED PRECEDING)) AS g, x, lead(x) OVER (PARTITION BY a, b, t ORDER BY x) AS nx FROM s),
  w AS (SELECT a, b, t, coalesce(sum(g * (nx - x)), 0) AS w FROM g GROUP BY a, b, t)"""


@query(f"{_PAIRED} SELECT a, b, count(*) AS support, round(avg(w), 7) AS w FROM w GROUP BY a, b")
def acinus_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of two categories' distributions over pairs of acini, all pairs or 500 drawn ones, and their number."""
    c = cells(spark, d, []).where("cat is not null and acinus is not null and position is not null")
    side = lambda g, n: c.where(F.col("condition") == g).select(F.col("cat").alias(n), F.col("acinus").alias("unit"), F.col("position").alias("x"))
    return A.unit_wasserstein(side("CNT", "a"), side("STV", "b"), 500).select("a", "b", "support", r("w", 7).alias("w"))


@query(f"WITH {CELLS}, m AS (SELECT cat, " + ", ".join(f"avg({c}) AS {c}" for c in ("mito_density", "peroxisome_density", "ld_density")) + " FROM cells WHERE cat IS NOT NULL GROUP BY cat) SELECT cat, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 6) + 0.0 AS {c}" for c in ("mito_density", "peroxisome_density", "ld_density")) + " FROM m")
def density_z(spark: SparkSession, d: str) -> DataFrame:
    """Z-scores of the categories' mean densities."""
    names = ["mito_density", "peroxisome_density", "ld_density"]
    means = cells(spark, d, names).where("cat is not null").groupBy("cat").agg(*[F.avg(c).alias(c) for c in names])
    return ranking.scaled(means, names, "zscore").select("cat", *[r(c, 6).alias(c) for c in names])


@query(f"WITH {CELLS}, g AS (SELECT " + ", ".join(f"count(*) FILTER ({c} > 0) AS n_{c}, median(greatest({c}, 0)) AS m_{c}, stddev_samp(coalesce({c}, 0)) AS s_{c}" for c in FEATURES) + f" FROM (SELECT {', '.join(f'coalesce({c}, 0) AS {c}' for c in FEATURES)} FROM cells)), n AS (SELECT count(*) AS n FROM cells), f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, n_{c} AS positive, s_{c} / nullif(m_{c}, 0) AS cv FROM g" for c in FEATURES) + "), step AS (SELECT max(cov) AS cov FROM (VALUES (1.0), (0.995), (0.99), (0.98), (0.97), (0.95), (0.9)) v(cov) WHERE (SELECT count(*) FROM f, n WHERE positive >= cov * n) >= 5) SELECT feature, CAST(row_number() OVER (ORDER BY cv NULLS LAST, feature) AS INTEGER) AS place FROM f, n WHERE positive >= coalesce((SELECT cov FROM step), 0.9) * n QUALIFY place <= 5")
def stable_reference(spark: SparkSession, d: str) -> DataFrame:
    """The five steadiest of the features that nearly all rows have, for median normalisation."""
    return K.stable_features(cells(spark, d, FEATURES), FEATURES, 5)


@query(f"WITH {CELLS}, k AS (SELECT {', '.join(f'greatest(coalesce({c}, 0), 0) AS {c}' for c in FEATURES)} FROM cells), t AS (SELECT *, {' + '.join(FEATURES)} AS total FROM k), x AS (SELECT {', '.join(f'coalesce({c} * 10000 / nullif(total, 0), 0) AS {c}' for c in FEATURES)} FROM t), v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c}) / nullif(avg({c}), 0) AS dispersion FROM x" for c in FEATURES) + ") SELECT feature, round(ln(dispersion), 5) + 0.0 AS log_dispersion, CAST(row_number() OVER (ORDER BY dispersion DESC NULLS LAST, feature) AS INTEGER) AS place FROM v QUALIFY place <= 10")
def variable_features(spark: SparkSession, d: str) -> DataFrame:
    """The ten features of largest dispersion once rows are scaled to a common total."""
    return K.variable_features(cells(spark, d, FEATURES), FEATURES, 10).select("feature", r("log_dispersion", 5).alias("log_dispersion"), "place")


@query()
def ordering_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the control categories' mean positions with those expected from the aligned categories."""
    left, right = two_sides(spark, d)
    at = A.expected_position(stage(A.consensus(left, right), "consensus"), A.interval(right, "b").select("b", "mean"))
    both = at.join(A.interval(left, "a").select("a", "mean"), "a")
    return T.correlation_p(T.spearman(both, ["expected"], "mean"), "rho").select("n", r("rho", 6).alias("rho"), r("p", 6).alias("p"))


@query()
def reconstruction_error(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each control category's distribution from the consensus-weighted mixture of the aligned ones."""
    left, right = two_sides(spark, d)
    return A.reconstruction_error(left, right, stage(A.consensus(left, right), "consensus")).select("a", r("w", 6).alias("w"))


@query()
def tau_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """X11: correlation of each category's consensus with those at half, one and two times tau, without the mask of small categories."""
    return A.tau_sensitivity(*two_sides(spark, d), (0.5, 1.0, 2.0)).select("a", "times", r("corr", 6).alias("corr"))


@query()
def transfer_intervals(spark: SparkSession, d: str) -> DataFrame:
    """95 % bootstrap intervals of the features expected from the aligned categories, 500 Poisson resamples."""
    left, right = two_sides(spark, d)
    weights = stage(A.consensus(left, right), "consensus")
    names = FEATURES
    rows = cells(spark, d, names).where("condition = 'STV' and cat is not null").select("row_id", F.col("cat").alias("b"), *names)
    out = A.transfer_intervals(weights, rows, "row_id", names, 500)
    return out.select("a", "feature", *[r(c, 5).alias(c) for c in ("value", "low", "high")])


# graphs


_POS = "t AS (SELECT row_id, position FROM cells WHERE position IS NOT NULL)"


@query(f"{_KN}, {_POS}, kept AS (SELECT src, dst, w FROM af JOIN t a ON a.row_id = src JOIN t b ON b.row_id = dst WHERE b.position + 0.001 >= a.position AND w > 0) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM kept UNION ALL SELECT DISTINCT src, src, 1.0 FROM af WHERE src NOT IN (SELECT src FROM kept)")
def forward_markov(spark: SparkSession, d: str) -> DataFrame:
    """Random walk that never goes back along the axis by more than a little; nodes without a way on stay."""
    time = cells(spark, d, []).where("position is not null").select(F.col("row_id").alias("node"), F.col("position").alias("pseudotime"))
    v = vectors(spark, d)
    near = G.knn(v, "row_id", VECTOR, 10, spent=v)
    return G.markov(G.both_ways(G.pair_weights(near, time)), both=True).select("src", "dst", r("p", 6).alias("p"))


@query(f"{_KN.replace('WITH ', 'WITH RECURSIVE ', 1)}, seen AS (SELECT row_id AS node FROM (SELECT row_id FROM k WHERE cat = 1 ORDER BY row_id LIMIT 5) UNION SELECT dst FROM seen JOIN af ON node = src) SELECT cat, count(*) AS n FROM seen JOIN k ON node = row_id GROUP BY cat")
def reach(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that can be reached from the first five cells of category 1, by category."""
    v = vectors(spark, d)
    start = v.where("cat = 1").orderBy("row_id").limit(5).select(F.col("row_id").alias("node"))
    seen = G.reachable(neighbour_graph(spark, d, v), start)
    return seen.join(v.select(F.col("row_id").alias("node"), "cat"), "node").groupBy("cat").agg(F.count("*").alias("n"))


@query(f"{_KN.replace('WITH ', 'WITH RECURSIVE ', 1)}, roots AS (SELECT row_id AS root FROM k WHERE cat = 1 ORDER BY row_id LIMIT 5), seen AS (SELECT root, root AS node FROM roots UNION SELECT root, dst FROM seen JOIN af ON node = src), comp AS (SELECT root, min(node) AS component FROM seen GROUP BY root), top AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT DISTINCT node FROM seen JOIN comp USING (root) JOIN top USING (component)")
def root_component(spark: SparkSession, d: str) -> DataFrame:
    """G2g: the component that holds most of the roots."""
    v = vectors(spark, d)
    roots = v.where("cat = 1").orderBy("row_id").limit(5).select(F.col("row_id").alias("node"))
    return G.root_component(neighbour_graph(spark, d, v), roots)


@query(f"{_V}, n AS (SELECT k.row_id, k.cat, condition FROM k JOIN cells USING (row_id)) SELECT condition, cat, count(*) AS n, min(row_id) AS first_node, max(row_id) AS last_node FROM n GROUP BY condition, cat")
def node_sets(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of each condition and category."""
    return _nodes(spark, d, vectors(spark, d)).groupBy("condition", "cat").agg(F.count("*").alias("n"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))


def _nodes(spark: SparkSession, d: str, v: DataFrame) -> DataFrame:
    return v.select(F.col("row_id").alias("node"), "cat").join(cells(spark, d, []).select(F.col("row_id").alias("node"), "condition"), "node")


def _breakdown(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chain, its nodes with their set's name, and (start, name, prob): where walks from each control category first enter the other
    condition."""
    v = vectors(spark, d)
    nodes = stage(_nodes(spark, d, v).where("condition in ('CNT', 'STV')").withColumn("name", F.concat("condition", F.col("cat").cast("string"))), "nodes")
    p = stage(G.markov(neighbour_graph(spark, d, v)), "markov")
    control = nodes.where("condition = 'CNT'")
    sizes = control.groupBy("name").agg(F.count("*").alias("m"))
    starts = control.join(F.broadcast(sizes), "name").select(F.col("name").alias("start"), "node", (1.0 / F.col("m")).alias("mass"))
    hits = G.first_hits_of(p, starts, nodes.where("condition = 'STV'").select("node"))
    return p, nodes, stage(hits.groupBy("start", "target").agg(F.sum("prob").alias("prob")), "hits")


@query()
def hub_choice(spark: SparkSession, d: str) -> DataFrame:
    """Chances of first entering each category of the other condition, from every control category, and the hub among these."""
    _, nodes, hits = _breakdown(spark, d)
    table_ = stage(hits.join(nodes.select(F.col("node").alias("target"), "name"), "target").groupBy("start", "name").agg(F.sum("prob").alias("prob")), "breakdown")
    hub = G.hub_of(table_)
    return table_.select("start", "name", r("prob", 6).alias("prob"), (F.col("start") == F.lit(hub[0])).alias("is_hub"))


@query()
def route_table(spark: SparkSession, d: str) -> DataFrame:
    """Routes from the hub to one category, or to two in order, with their unconditional probabilities; the second leg starts
    where the first one arrived, renormalised."""
    p, nodes, hits = _breakdown(spark, d)
    named = hits.join(nodes.select(F.col("node").alias("target"), "name"), "target")
    hub, _, _ = G.hub_of(named.groupBy("start", "name").agg(F.sum("prob").alias("prob")))
    arrived = stage(named.where(F.col("start") == F.lit(hub)).select("name", F.col("target").alias("node"), "prob"), "arrived")
    first = {x["name"]: x["p"] for x in arrived.groupBy("name").agg(F.sum("prob").alias("p")).collect()}
    second = {}
    for a in sorted(first):
        start = arrived.where(F.col("name") == a).select("node", (F.col("prob") / first[a]).alias("mass"))
        goals = nodes.where((F.col("condition") == "STV") & (F.col("name") != a)).select("node")
        found = G.first_hits(p, start, goals).join(nodes.select(F.col("node").alias("target"), "name"), "target")
        second |= {(a, x["name"]): x["p"] for x in found.groupBy("name").agg(F.sum("prob").alias("p")).collect()}
    rows = [(">".join(route), len(route) - 1, round(first.get(route[1], 0.0) * (second.get((route[1], route[2]), 0.0) if len(route) == 3 else 1.0), 6)) for route in G.default_routes(hub or "none", sorted(first))]
    return spark.createDataFrame(rows, "route string, legs int, prob double")
