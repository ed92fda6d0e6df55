"""Queries over statistics, clusterings, space, alignment, graphs and models, with their SQL where SQL can say the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobule.operators import alignment as A
from lobule.operators import bins as B
from lobule.operators import clustering as K
from lobule.operators import graph as G
from lobule.operators import models as M
from lobule.operators import plane as P
from lobule.operators import ranking as W
from lobule.operators import spatial as X
from lobule.operators import statistics as T
from lobule.plans.base import CELLS, DROPLETS, FEATURES, MITO, MORPH, POSTERIORS, bin_sql, cells, droplets, mito, r
from lobule.plans.tables import ivm_cells
from lobule.shared import free, stage, table

QUERIES, ORACLE = {}, {}
FEW = FEATURES
VECTOR = FEATURES  # features of the distance-based queries


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def long_cells(spark: SparkSession, d: str) -> DataFrame:
    return T.long_values(cells(spark, d, FEW), ["condition"], FEW)


_L = f"WITH {CELLS}, long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, condition AS g, {c} AS x FROM cells WHERE {c} IS NOT NULL" for c in FEW) + ")"
_MOM = "mom AS (SELECT feature, g, count(*) AS n, avg(x) AS m, var_samp(x) AS v, var_pop(x) AS vp FROM {0} GROUP BY feature, g), gr AS (SELECT feature, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * m) / sum(n) AS gm, sum(n * vp) AS w FROM mom GROUP BY feature), bt AS (SELECT feature, sum(n * (m - gm) * (m - gm)) AS b FROM mom JOIN gr g2 USING (feature, n) GROUP BY feature)"
_MOM = _MOM.replace("bt AS (SELECT feature, sum(n * (m - gm) * (m - gm)) AS b FROM mom JOIN gr g2 USING (feature, n) GROUP BY feature)", "bt AS (SELECT mom.feature, sum(mom.n * (m - gm) * (m - gm)) AS b FROM mom JOIN gr ON mom.feature = gr.feature GROUP BY mom.feature)")
_F = "SELECT gr.feature, k, n, round((b / (k - 1)) / (w / (n - k)), 5) AS f, round(b / (b + w), 8) AS eta2 FROM gr JOIN bt ON gr.feature = bt.feature"


@query(f"{_L}, {_MOM.format('long')} {_F}")
def anova_f(spark: SparkSession, d: str) -> DataFrame:
    """F and eta squared of every feature over the conditions."""
    return T.anova(long_cells(spark, d), "condition").select("feature", "k", "n", r("f", 5).alias("f"), r("eta2").alias("eta2"))


@query(f"{_L}, dev AS (SELECT feature, g, abs(x - median(x) OVER (PARTITION BY feature, g)) AS x FROM long), {_MOM.format('dev')} {_F}")
def levene_f(spark: SparkSession, d: str) -> DataFrame:
    """Brown-Forsythe test."""
    return T.levene(long_cells(spark, d), "condition").select("feature", "k", "n", r("f", 5).alias("f"), r("eta2").alias("eta2"))


@query(f"{_L}, {_MOM.format('long')}, e AS (SELECT *, n / v AS wt FROM mom WHERE n > 1 AND v > 0), t AS (SELECT feature, count(*) AS k, sum(wt) AS sw, sum(wt * m) / sum(wt) AS mu FROM e GROUP BY feature), p AS (SELECT e.feature, k, sum(wt * (m - mu) * (m - mu)) AS a, sum((1 - wt / sw) * (1 - wt / sw) / (n - 1)) AS c FROM e JOIN t ON e.feature = t.feature GROUP BY e.feature, k) SELECT feature, k, round(a / (k - 1) / (1 + 2 * (k - 2) * c / (k * k - 1)), 5) AS f, round((k * k - 1) / (3 * c), 4) AS df2, 'ok' AS status FROM p")
def welch_f(spark: SparkSession, d: str) -> DataFrame:
    """Welch's analysis of variance."""
    return T.welch(long_cells(spark, d), "condition").select("feature", "k", r("f", 5).alias("f"), r("df2", 4).alias("df2"), "status")


@query(f"{_L}, {_MOM.format('long')}, pr AS (SELECT a.feature, a.g AS a, b.g AS b, a.m - b.m AS diff, a.v / a.n AS e1, b.v / b.n AS e2, a.n AS n1, b.n AS n2 FROM mom a JOIN mom b ON a.feature = b.feature AND a.g < b.g) SELECT feature, a, b, round(diff, 8) AS diff, round(abs(diff) / sqrt(e1 + e2), 5) AS t, round((e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), 4) AS df FROM pr")
def games_howell_t(spark: SparkSession, d: str) -> DataFrame:
    """T4: pairwise comparisons, their t and degrees of freedom."""
    return T.pairwise(long_cells(spark, d), "condition").select("feature", "a", "b", r("diff").alias("diff"), r("t", 5).alias("t"), r("df", 4).alias("df"))


@query()
def games_howell_p(spark: SparkSession, d: str) -> DataFrame:
    """T4: p-values of the studentized range."""
    return T.with_p(T.pairwise(long_cells(spark, d), "condition").withColumn("k", F.lit(cells(spark, d, []).select("condition").distinct().count())), "p", T.range_p, ["q", "k", "df"]).select("feature", "a", "b", r("q", 5).alias("q"), r("p", 6).alias("p"))


@query()
def tukey_p(spark: SparkSession, d: str) -> DataFrame:
    """T5s: Tukey-Kramer comparisons."""
    return T.with_p(T.tukey(long_cells(spark, d), "condition"), "p", T.range_p, ["q", "k", "df"]).select("feature", "a", "b", r("diff").alias("diff"), r("q", 5).alias("q"), r("p", 6).alias("p"))


@query()
def anova_p_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """P-values, false discovery rate, -log10 p and significance."""
    from lobule.functions.cleaning import minus_log10, significance

    out = T.benjamini_hochberg(T.anova_p(T.anova(long_cells(spark, d), "condition")), "p", "feature")
    return out.select("feature", r("p", 10).alias("p"), r("q", 10).alias("q"), r(minus_log10(F.col("p")), 5).alias("minus_log10_p"), significance(F.col("p")).alias("mark"))


@query(f"WITH {CELLS}, k AS (SELECT * FROM cells WHERE mito_density IS NOT NULL), pool AS (SELECT o.g, k.mito_density AS x, CASE WHEN k.condition = o.g THEN 1 ELSE 0 END AS mine FROM (SELECT DISTINCT condition AS g FROM k WHERE condition <> 'CNT') o JOIN k ON k.condition = o.g OR k.condition = 'CNT'), rk AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rank FROM pool) SELECT g AS \"group\", CAST(sum(mine) AS BIGINT) AS n, CAST(count(*) - sum(mine) AS BIGINT) AS n_control, sum(mine * rank) - sum(mine) * (sum(mine) + 1) / 2 AS u FROM rk GROUP BY g")
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    """U of each condition against control."""
    return T.mann_whitney(cells(spark, d, ["mito_density"]), "mito_density", "condition", "CNT").select("group", "n", "n_control", "u")


@query(f"WITH {CELLS}, long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, position AS y, {c} AS x FROM cells WHERE {c} IS NOT NULL AND position IS NOT NULL" for c in FEW) + ") SELECT feature, count(*) AS n, round(corr(x, y), 8) AS r FROM long GROUP BY feature")
def pearson_features(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of features with the position."""
    return T.pearson(cells(spark, d, FEW), FEW, "position").select("feature", "n", r("r").alias("r"))


@query(f"WITH {CELLS}, long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, position AS y, {c} AS x FROM cells WHERE {c} IS NOT NULL AND position IS NOT NULL" for c in FEW) + "), rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM long) SELECT feature, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM rk GROUP BY feature")
def spearman_features(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of features with the position."""
    return T.spearman(cells(spark, d, FEW), FEW, "position").select("feature", "n", r("rho").alias("rho"))


@query()
def spearman_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """P-values of rank correlations and their false discovery rate."""
    return T.benjamini_hochberg(T.correlation_p(T.spearman(cells(spark, d), FEATURES, "position"), "rho"), "p", "feature").select("feature", r("rho").alias("rho"), r("p", 10).alias("p"), r("q", 10).alias("q"))


_IVM = f"WITH {MITO}, {DROPLETS}, m AS (SELECT cell, avg(ratio_01_00) AS tmrm, min(zone) AS zone, count(*) AS n_mito, avg(area_cell) AS area_cell, avg(aspect_ratio) AS mito_aspect, min(liver_id) AS liver_id FROM mito WHERE liver_id IS NOT NULL GROUP BY cell), l AS (SELECT cell, count(*) AS n_ld, avg(area) AS ld_area FROM droplets GROUP BY cell), j AS (SELECT * FROM m JOIN l USING (cell) WHERE zone IS NOT NULL)"


@query(f"{_IVM} SELECT zone, count(*) AS n, round(regr_slope(tmrm, ld_area), 8) AS slope, round(regr_intercept(tmrm, ld_area), 8) AS intercept, round(regr_r2(tmrm, ld_area), 8) AS r2 FROM j WHERE tmrm IS NOT NULL AND ld_area IS NOT NULL GROUP BY zone")
def regional_ols(spark: SparkSession, d: str) -> DataFrame:
    """Simple regression in each zone."""
    return T.group_regression(ivm_cells(spark, d).where("zone is not null"), ["zone"], "tmrm", "ld_area").select("zone", "n", r("slope").alias("slope"), r("intercept").alias("intercept"), r("r2").alias("r2"))


@query(f"WITH {CELLS}, k AS (SELECT condition, ((((row_id % 2147483648 * 1103515245 + 12345) % 2147483648 * 69069 + 1) % 2147483648) // 64) % 5 AS fold, mito_density AS x, peroxisome_density AS y FROM cells WHERE mito_density IS NOT NULL AND peroxisome_density IS NOT NULL), fit AS (SELECT c.condition, f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT DISTINCT condition FROM k) c, (SELECT DISTINCT fold FROM k) f, k WHERE k.condition = c.condition AND k.fold <> f.fold GROUP BY c.condition, f.fold) SELECT k.condition, count(*) AS n, round(1 - sum((y - a - b * x) * (y - a - b * x)) / (count(*) * var_pop(y)), 5) AS r2 FROM k JOIN fit ON k.condition = fit.condition AND k.fold = fit.fold GROUP BY k.condition")
def kfold_ols_r2(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold R squared, five folds."""
    c = cells(spark, d, ["mito_density", "peroxisome_density"]).withColumn("fold", W.folds(F.col("row_id"), 5))
    return T.kfold_regression(c, ["condition"], "peroxisome_density", "mito_density", "fold").select("condition", "n", r("r2", 5).alias("r2"))


@query()
def interaction_ols(spark: SparkSession, d: str) -> DataFrame:
    """Regression with an interaction."""
    c = ivm_cells(spark, d).where("zone is not null")
    region = (F.col("zone") == "PV").cast("double")
    return spark.createDataFrame(T.ols(c, "tmrm", {"ld_area": F.col("ld_area"), "region": region, "ld_area:region": F.col("ld_area") * region}).round(6))


@query()
def mixed_model_liver_tile(spark: SparkSession, d: str) -> DataFrame:
    """Mixed model of the ratio with liver and tile within liver."""
    m = mito(spark, d).where("zone is not null and ratio_01_00 between 0.0005 and 60 and liver_id is not null")
    table_, variances, _ = T.mixed_model(m.withColumn("y", F.ln("ratio_01_00")), "y", {"zone_PV": (F.col("zone") == "PV").cast("double"), "aspect": F.col("aspect_ratio")}, "liver_id", "tile_section")
    for name, value in variances.items():
        table_[f"variance_{name}"] = value
    return spark.createDataFrame(table_.round(6))


@query()
def planned_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Predicted means of both zones with intervals, and their difference."""
    m = mito(spark, d).where("zone is not null and ratio_01_00 between 0.0005 and 60 and liver_id is not null").withColumn("y", F.ln("ratio_01_00"))
    t, _, covariance = T.mixed_model(m, "y", {"pv": (F.col("zone") == "PV").cast("double"), "solidity": F.col("solidity")}, "liver_id")
    wanted = {"PV": [1.0, 1, 0.9], "CV": [1.0, 0, 0.9], "PV - CV": [0.0, 1, 0]}  # intercept, zone, solidity
    rows = [(n, *[round(float(x), 6) for x in T.contrast(t["coef"].to_numpy(), covariance, np.array(w)).values()]) for n, w in wanted.items()]
    return spark.createDataFrame(rows, "name string, estimate double, se double, z double, p double, low double, high double")


_ST = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, corr({c}, position) AS r_{c}" for c in FEW)


@query(f"WITH {CELLS}, k AS (SELECT * FROM cells WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEW)}), s AS (SELECT {_ST} FROM k) SELECT row_id, round((" + " + ".join(f"({c} - m_{c}) / s_{c} * r_{c}" for c in FEW) + ") / (" + " + ".join(f"abs(r_{c})" for c in FEW) + "), 7) AS score FROM k, s")
def signed_score(spark: SparkSession, d: str) -> DataFrame:
    """Correlation-weighted score of every cell."""
    return T.signed_score(cells(spark, d, FEW), "row_id", FEW, "position").select("row_id", r("score", 7).alias("score"))


@query()
def pca_explained(spark: SparkSession, d: str) -> DataFrame:
    """Explained variance of the components."""
    pca = K.principal_components(cells(spark, d), FEATURES)
    return spark.createDataFrame([(i + 1, round(float(v), 6), round(float(c), 6)) for i, (v, c) in enumerate(zip(pca["ratio"], np.cumsum(pca["ratio"])))], "component int, ratio double, upto double")


@query()
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the first two components of features that follow the position, mirrored if the first falls along it."""
    c = cells(spark, d, FEATURES)
    kept = [x["feature"] for x in T.spearman(c, FEATURES, "position").where("abs(rho) >= 0.05").collect()] or FEATURES
    known = c.na.drop(subset=kept)
    scored = K.component_scores(known, kept, K.principal_components(known, kept), 2)
    sign = -1.0 if (scored.agg(F.corr("component_1", "position")).first()[0] or 0) < 0 else 1.0
    return scored.select("row_id", r(F.col("component_1") * sign, 5).alias("component_1"), r("component_2", 5).alias("component_2"))


@query()
def mixture_selection(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures of one to ten Gaussians, their criteria, held-out log-likelihood over five folds, silhouette, and the number of the
    best weighted score."""
    names = ["component_1", "component_2"]
    known = stage(K.component_scores(cells(spark, d).na.drop(subset=FEATURES), FEATURES, K.principal_components(cells(spark, d), FEATURES), 2).select("row_id", *names), "scores")
    fold, n, ks = W.folds(F.col("row_id"), 5), known.count(), range(1, 11)
    models = iter(K.gaussian_mixtures(known, names, [(k, out) for k in ks for out in (None, *range(5))], fold))
    found = {k: [next(models) for _ in range(6)] for k in ks}

    def score(batches):
        for b in batches:
            x, at, total = np.column_stack([b.column(c).to_numpy() for c in names]), b.column("fold").fill_null(-1).to_numpy(), np.zeros(len(ks))
            for j, k in enumerate(ks):
                for i, m in enumerate(found[k][1:]):
                    total[j] += np.logaddexp.reduce(K.log_densities(x[at == i], m), axis=1).sum()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], [f"s{k}" for k in ks])

    cv = known.select(*names, fold.cast("long").alias("fold")).mapInArrow(score, ", ".join(f"s{k} double" for k in ks)).agg(*[F.sum(f"s{k}") for k in ks]).first()

    def label(batches):
        for b in batches:
            x, code, unit = np.column_stack([b.column(c).to_numpy() for c in names]), np.zeros(b.num_rows, np.int64), 1
            for k in ks[1:]:
                logs = K.log_densities(x, found[k][0])
                shares = np.exp(logs - logs.max(1, keepdims=True))
                code, unit = code + unit * (shares / shares.sum(1, keepdims=True)).argmax(1), unit * k
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(code)], ["x", "y", "code"])

    labelled = stage(known.select(*names).mapInArrow(label, "x double, y double, code long"), "labelled")
    shapes = [None, *P.silhouettes(labelled, list(ks[1:]))[1]]
    free(labelled)
    rows = [(k, found[k][0]["loglik"], *K.information(found[k][0]).values(), cv[j] / max(1, n), shapes[j]) for j, k in enumerate(ks)]
    scores = K.weighted_scores(*zip(*[x[1:] for x in rows]))
    best = int(np.nanargmax(scores))
    out = [(k, *[None if v is None else round(float(v), 3) for v in rest], round(float(s), 5) if np.isfinite(s) else None, i == best) for i, ((k, *rest), s) in enumerate(zip(rows, scores))]
    return spark.createDataFrame(out, "k int, loglik double, bic double, aic double, cv_loglik double, silhouette double, score double, chosen boolean")


@query()
def mixture_order(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of a mixture in the order of the axis."""
    known = K.component_scores(cells(spark, d).na.drop(subset=FEATURES), FEATURES, K.principal_components(cells(spark, d), FEATURES), 2).select("row_id", "position", "component_1", "component_2")
    known = stage(known, "scores")
    labelled = stage(K.mixture_labels(known, ["component_1", "component_2"], K.gaussian_mixture(known, ["component_1", "component_2"], 5)), "labelled")
    return K.order_along_axis(labelled, "prediction", ["component_1", "component_2"], "position", "row_id").select("prediction", "n", r("projection", 5).alias("projection"), r("estimated_position", 5).alias("estimated_position"), "new_label")


@query(f"WITH {CELLS}, c AS (SELECT cat AS a, cat0 AS b, CAST(count(*) AS DOUBLE) AS n FROM cells WHERE cat IS NOT NULL AND cat0 IS NOT NULL GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT CAST(t AS BIGINT) AS n, round((i - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 8) AS ari FROM i, x, y")
def ari_pair(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of two labelings."""
    return K.adjusted_rand(cells(spark, d, []), "cat", "cat0").select("n", r("ari").alias("ari"))


_V = f"WITH {CELLS}, k AS (SELECT row_id, cat, {', '.join(f'{c} AS v{i}' for i, c in enumerate(VECTOR))} FROM cells WHERE cat IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in VECTOR)})"
_D = lambda a, b: "sqrt(" + " + ".join(f"({a}.v{i} - {b}.v{i}) * ({a}.v{i} - {b}.v{i})" for i in range(len(VECTOR))) + ")"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Complete feature vectors, staged, as the optimiser's constraint sets explode over 23 derived columns in the joins that follow."""
    return stage(cells(spark, d, VECTOR).na.drop(subset=["cat", *VECTOR]).select("row_id", "cat", *VECTOR), "vectors")


@query(f"{_V}, m AS (SELECT cat, count(*) AS m FROM k GROUP BY cat), s AS (SELECT a.row_id, a.cat, b.cat AS other, sum({_D('a', 'b')}) AS total FROM k a, k b GROUP BY ALL), e AS (SELECT row_id, max(CASE WHEN s.cat = other THEN total / nullif(m - 1, 0) END) AS a, min(CASE WHEN s.cat <> other THEN total / m END) AS b FROM s JOIN m ON m.cat = s.other GROUP BY row_id) SELECT count(*) AS n, round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 7) AS silhouette FROM e")
def silhouette_exact(spark: SparkSession, d: str) -> DataFrame:
    """C14: exact mean silhouette."""
    complete = vectors(spark, d)
    found = K.silhouette(complete, "row_id", "cat", VECTOR).select("n", r("silhouette", 7).alias("silhouette"))
    free(complete)
    return found


_CE = f"c AS (SELECT cat, count(*) AS n, {', '.join(f'avg(v{i}) AS v{i}' for i in range(len(VECTOR)))} FROM k GROUP BY cat), w AS (SELECT k.cat, avg({_D('k', 'c')}) AS s, sum({_D('k', 'c')} * {_D('k', 'c')}) AS ss FROM k JOIN c ON k.cat = c.cat GROUP BY k.cat)"


@query(f"{_V}, {_CE}, p AS (SELECT a.cat, max((wa.s + wb.s) / {_D('a', 'b')}) AS r FROM c a JOIN c b ON a.cat <> b.cat JOIN w wa ON wa.cat = a.cat JOIN w wb ON wb.cat = b.cat GROUP BY a.cat) SELECT count(*) AS clusters, round(avg(r), 6) AS davies_bouldin FROM p")
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    """C15."""
    return K.davies_bouldin(vectors(spark, d), "cat", VECTOR).select("clusters", r("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"{_V}, {_CE}, g AS (SELECT {', '.join(f'avg(v{i}) AS v{i}' for i in range(len(VECTOR)))} FROM k), b AS (SELECT sum(n * {_D('c', 'g')} * {_D('c', 'g')}) AS b, count(*) AS q, CAST(sum(n) AS BIGINT) AS n FROM c, g) SELECT n, q AS clusters, round((b / (q - 1)) / ((SELECT sum(ss) FROM w) / (n - q)), 6) AS calinski_harabasz FROM b")
def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    """C16."""
    return K.calinski_harabasz(vectors(spark, d), "cat", VECTOR).select("n", "clusters", r("calinski_harabasz", 6).alias("calinski_harabasz"))


@query(f"WITH {CELLS}, c AS (SELECT count(*) * 1.0 / sum(count(*)) OVER () AS p FROM cells WHERE cat IS NOT NULL GROUP BY cat) SELECT count(*) AS clusters, round(1 / sum(p * p), 8) AS effective, round(min(p), 8) AS least_share FROM c")
def cluster_balance(spark: SparkSession, d: str) -> DataFrame:
    """Effective number of clusters."""
    return K.balance(cells(spark, d, []), "cat").select("clusters", r("effective").alias("effective"), r("least_share").alias("least_share"))


@query(f"WITH {CELLS} " + " UNION ALL ".join(f'SELECT {i} AS i, {j} AS j, round(avg(least("{i}", "{j}")), 8) AS overlap FROM cells' for i in range(5) for j in range(i + 1, 5)))
def component_overlap(spark: SparkSession, d: str) -> DataFrame:
    """C17."""
    return K.overlap(cells(spark, d, POSTERIORS), POSTERIORS).select("i", "j", r("overlap").alias("overlap"))


@query(f"WITH {CELLS}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS variance FROM cells" for c in FEATURES) + ") SELECT feature, round(variance, 5) AS variance, CAST(row_number() OVER (ORDER BY variance DESC, feature) AS INTEGER) AS rank FROM v QUALIFY rank <= 10")
def top_variance(spark: SparkSession, d: str) -> DataFrame:
    """The ten features of largest variance."""
    return K.top_variance(cells(spark, d), FEATURES, 10).select("feature", r("variance", 5).alias("variance"), "rank")


_SUM = " + ".join(f"coalesce({c}, 0)" for c in VECTOR)


@query(f"WITH {CELLS} SELECT row_id, " + ", ".join(f"round(ln(1 + coalesce(coalesce({c}, 0) * 10000 / nullif({_SUM}, 0), 0)), 6) AS {c}" for c in VECTOR) + f" FROM cells WHERE {' AND '.join(f'coalesce({c}, 1) > 0' for c in VECTOR)}")
def library_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Rows scaled to a common total, log1p."""
    fine = cells(spark, d, VECTOR)
    for c in VECTOR:
        fine = fine.where(F.coalesce(c, F.lit(1.0)) > 0)
    return K.library_normalise(fine, VECTOR).select("row_id", *[r(c, 6).alias(c) for c in VECTOR])


@query(f"WITH {CELLS}, m AS (SELECT row_id, {', '.join(VECTOR)}, list_median(list_filter([{', '.join(VECTOR)}], lambda v: v > 0)) AS md FROM cells), g AS (SELECT median(md) AS gm FROM m) SELECT row_id, " + ", ".join(f"round(CASE WHEN {c} > 0 THEN log2({c} / md * gm) END, 6) AS {c}" for c in VECTOR) + " FROM m, g")
def median_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Rows brought to a common median, log2."""
    return K.median_normalise(cells(spark, d, VECTOR), VECTOR).select("row_id", *[r(c, 6).alias(c) for c in VECTOR])


@query(f"WITH {CELLS} SELECT min(mito_density) >= 0 AND (max(mito_density) > 20 OR quantile_cont(mito_density, 0.95) > 50) AS looks_linear FROM cells")
def log_detect(spark: SparkSession, d: str) -> DataFrame:
    """Whether a feature looks like untransformed counts."""
    x = F.col("mito_density")
    return cells(spark, d, ["mito_density"]).agg(((F.min(x) >= 0) & ((F.max(x) > 20) | (F.percentile(x, 0.95) > 50))).alias("looks_linear"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Cells with a stack, plane coordinates, category and position bin."""
    c = cells(spark, d, ["centroid-0", "centroid-1"]).join(table(spark, d, "full_concat_clusters").select("row_id", "stack_id"), "row_id")
    c = c.select("row_id", "stack_id", F.col("centroid-0").alias("x"), F.col("centroid-1").alias("y"), "cat", B.left_closed(F.col("position"), -1.0, 1.0, 10).alias("bin"))
    return c.where("stack_id is not null and x between 0 and 500000 and y between 0 and 500000 and cat is not null and bin is not null")


RADIUS = 150.0
_PL = f"WITH {CELLS}, pl AS (SELECT c.row_id, f.stack_id, \"centroid-0\" AS x, \"centroid-1\" AS y, cat, CAST(least(9, floor((position + 1) / 0.2)) AS INTEGER) AS bin FROM (SELECT row_id, cat, position, \"centroid-0\", \"centroid-1\" FROM cells) c JOIN (SELECT row_id, stack_id FROM full_concat_clusters) f USING (row_id) WHERE f.stack_id IS NOT NULL AND \"centroid-0\" BETWEEN 0 AND 500000 AND \"centroid-1\" BETWEEN 0 AND 500000 AND cat IS NOT NULL AND position >= -1 AND position < 1), ed AS (SELECT a.stack_id, a.row_id AS i, b.row_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pl a JOIN pl b ON a.stack_id = b.stack_id AND a.row_id <> b.row_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {RADIUS}), nb AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS place FROM ed QUALIFY place <= 6), un AS (SELECT DISTINCT stack_id, least(i, j) AS i, greatest(i, j) AS j FROM nb)"


@query(f"{_PL} SELECT stack_id, i AS a, j AS b, CAST(place AS INTEGER) AS place, round(d, 6) AS d FROM nb")
def spatial_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest cells of the same stack within a radius."""
    return X.neighbours(placed(spark, d), ["stack_id"], "row_id", "x", "y", 6, RADIUS).select("stack_id", "a", "b", "place", r("d", 6).alias("d"))


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return X.undirected(X.neighbours(placed(spark, d), ["stack_id"], "row_id", "x", "y", 6, RADIUS), ["stack_id"])


@query(f"{_PL}, q AS (SELECT stack_id, bin, cat, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY stack_id, bin) AS p FROM pl GROUP BY stack_id, bin, cat), cl AS (SELECT DISTINCT stack_id, cat AS category FROM pl), rs AS (SELECT pl.stack_id, row_id, category, CASE WHEN pl.cat = category THEN 1.0 ELSE 0.0 END - coalesce(p, 0) AS r FROM pl JOIN cl ON pl.stack_id = cl.stack_id LEFT JOIN q ON q.stack_id = pl.stack_id AND q.bin = pl.bin AND q.cat = category), ce AS (SELECT stack_id, row_id, category, r - avg(r) OVER (PARTITION BY stack_id, category) AS r FROM rs), wh AS (SELECT stack_id, category, count(*) AS n, sum(r * r) AS ss FROM ce GROUP BY ALL), cr AS (SELECT un.stack_id, a.category, sum(a.r * b.r) AS c, count(*) AS w FROM un JOIN ce a ON a.row_id = un.i AND a.stack_id = un.stack_id JOIN ce b ON b.row_id = un.j AND b.stack_id = un.stack_id AND b.category = a.category GROUP BY ALL) SELECT wh.stack_id, wh.category, n, round(n * 1.0 / w * c / ss, 6) + 0.0 AS moran FROM wh JOIN cr ON wh.stack_id = cr.stack_id AND wh.category = cr.category WHERE ss > 1e-9")
def morans_residual(spark: SparkSession, d: str) -> DataFrame:
    """Moran's I of the categories' residuals in every stack."""
    p = stage(placed(spark, d), "placed")
    edges = X.undirected(X.neighbours(p, ["stack_id"], "row_id", "x", "y", 6, RADIUS), ["stack_id"])
    values = X.residuals(p, ["stack_id"], "row_id", "cat", "bin")
    spread = values.groupBy("stack_id", "category").agg((F.var_pop("r") * F.count("*")).alias("ss")).where("ss > 1e-9")
    return X.moran(edges, values, ["stack_id"]).join(spread, ["stack_id", "category"], "left_semi").select("stack_id", "category", "n", r("moran", 6).alias("moran"))


@query(f"{_PL}, pr AS (SELECT a.cat AS ci, b.cat AS cj FROM un JOIN pl a ON a.row_id = un.i JOIN pl b ON b.row_id = un.j), al AS (SELECT ci, cj FROM pr UNION ALL SELECT cj, ci FROM pr) SELECT ci, cj, count(*) AS n FROM al GROUP BY ci, cj")
def adjacency_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often categories are neighbours."""
    p = stage(placed(spark, d), "placed")
    edges = X.undirected(X.neighbours(p, ["stack_id"], "row_id", "x", "y", 6, RADIUS), ["stack_id"])
    return X.adjacency(edges, p.withColumnRenamed("row_id", "id"), ["stack_id"], "cat").groupBy("ci", "cj").agg(F.sum("n").alias("n"))


def niches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges and cells (id, cat, bin) of every stack."""
    p = stage(placed(spark, d), "placed")
    edges = X.undirected(X.neighbours(p, ["stack_id"], "row_id", "x", "y", 6, RADIUS), ["stack_id"])
    return edges, p.select("stack_id", F.col("row_id").alias("id"), "cat", "bin")


@query()
def adjacency_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Permutation test of neighbouring categories in every stack, shuffled within position bins."""
    return X.adjacency_test(*niches(spark, d), ["stack_id"], "cat", "bin", 200).select("stack_id", "ci", "cj", "n", r("mean", 4).alias("mean"), r("p", 6).alias("p"))


@query()
def niche_significance(spark: SparkSession, d: str) -> DataFrame:
    """Permutation tests of residual Moran's I and the explained fraction, and the number of significant pairs, of every stack."""
    t = X.niche_tests(*niches(spark, d), ["stack_id"], "cat", "bin", 200, 200, 500)
    return t.select("stack_id", "n", *[r(c, 6).alias(c) for c in ("fraction_explained", "fraction_p", "moran", "moran_p")], "pairs", "categories")


def two_sides(spark: SparkSession, d: str, other: str = "STV") -> tuple[DataFrame, DataFrame]:
    c = cells(spark, d, []).where("cat is not null and position is not null")
    return c.where("condition = 'CNT'").select(F.col("cat").alias("a"), F.col("position").alias("x")), c.where(F.col("condition") == other).select(F.col("cat").alias("b"), F.col("position").alias("x"))


_WS = f"WITH {CELLS}, l AS (SELECT cat AS a, position AS x, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY cat) AS n FROM cells WHERE condition = 'CNT' AND cat IS NOT NULL AND position IS NOT NULL GROUP BY cat, position), q AS (SELECT cat AS b, position AS x, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY cat) AS n FROM cells WHERE condition = 'STV' AND cat IS NOT NULL AND position IS NOT NULL GROUP BY cat, position), u AS (SELECT a, b, l.x, l.n FROM l, (SELECT DISTINCT b FROM q) UNION ALL SELECT a, b, q.x, -q.n FROM q, (SELECT DISTINCT a FROM l)), s AS (SELECT a, b, x, sum(n) AS n FROM u GROUP BY ALL), g AS (SELECT a, b, abs(sum(n) OVER (PARTITION BY a, b ORDER BY x ROWS UNBOUNDED PRECEDING)) AS g, x, lead(x) OVER (PARTITION BY a, b ORDER BY x) AS nx FROM s), w AS (SELECT a, b, sum(g * (nx - x)) AS w FROM g GROUP BY a, b)"


@query(" UNION ALL ".join(f"SELECT '{o}' AS other, * FROM ({_WS.replace('STV' + chr(39) + ' AND cat', o + chr(39) + ' AND cat')} SELECT a, b, round(w, 7) AS w FROM w)" for o in ("STV", "WD")))
def wasserstein_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the control categories' distributions along the axis from those of both other conditions."""
    parts = [A.wasserstein(*two_sides(spark, d, o)).select(F.lit(o).alias("other"), "a", "b", r("w", 7).alias("w")) for o in ("STV", "WD")]
    return parts[0].unionByName(parts[1])


@query()
def alignment_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Consensus of three supports, and with half and double tau."""
    left, right = two_sides(spark, d)
    base = A.consensus(left, right)
    tau = base.agg(F.percentile("w", 0.5)).first()[0] or 1.0
    out = base
    for name, factor in (("half", 0.5), ("double", 2.0)):
        out = out.join(A.consensus(left, right, 10, tau * factor).select("a", "b", F.col("consensus").alias(name)), ["a", "b"])
    return out.select("a", "b", r("w", 7).alias("w"), *[r(c, 6).alias(c) for c in ("consensus", "half", "double")])


@query()
def alignment_assignment(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one assignment of least total distance."""
    return A.assign(A.wasserstein(*two_sides(spark, d))).select("a", "b", r("w", 6).alias("w"))


@query()
def soft_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Features and positions expected from the aligned categories."""
    left, right = two_sides(spark, d)
    weights = stage(A.consensus(left, right), "consensus")
    c = cells(spark, d, FEW).where("condition = 'STV' and cat is not null")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in FEW])).alias("f")
    means = c.select(F.col("cat").alias("b"), pairs).groupBy("b", "f.feature").agg(F.avg("f.x").alias("mean"))
    at = A.expected_position(weights, A.interval(right, "b").select("b", "mean"))
    return A.transfer(weights, means).join(at, "a").select("a", "feature", r("value", 6).alias("value"), r("expected", 6).alias("expected"))


@query(f"WITH {CELLS} SELECT row_id, 'mito' AS name, round((coalesce(mito_density, 0) + coalesce(mito_percent_total_area, 0)) / nullif((mito_density IS NOT NULL)::INT + (mito_percent_total_area IS NOT NULL)::INT, 0), 8) AS score FROM cells UNION ALL SELECT row_id, 'ld', round(ld_density, 8) FROM cells")
def set_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean over named sets of columns; missing columns don't count."""
    sets = {"mito": ["mito_density", "mito_percent_total_area"], "ld": ["ld_density", "not_there"]}
    return A.mean_over_set(cells(spark, d, ["mito_density", "mito_percent_total_area", "ld_density"]), ["row_id"], sets).select("row_id", "name", r("score").alias("score"))


@query("WITH v AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY d, dst) AS INTEGER) AS place FROM p QUALIFY place <= 8")
def knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest embeddings of every embedding."""
    return G.knn(embedding_columns(spark, d), "vec_id", [f"e{i}" for i in range(64)], 8).select("src", "dst", "place")


def embedding_columns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


_KN = f"{_V}, pr AS (SELECT a.row_id AS src, b.row_id AS dst, {_D('a', 'b')} AS d FROM k a JOIN k b ON a.row_id <> b.row_id), nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS place FROM pr QUALIFY place <= 10), sc AS (SELECT src, max(d) + 1e-8 AS s FROM nn GROUP BY src), wt AS (SELECT nn.src, nn.dst, exp(-d * d / (2 * a.s * b.s)) AS w FROM nn JOIN sc a ON a.src = nn.src JOIN sc b ON b.src = nn.dst), af AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM wt UNION ALL SELECT dst, src, w FROM wt) GROUP BY src, dst)"

_KN += ", mk AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM af WHERE w > 0 UNION ALL SELECT DISTINCT src, src, 1.0 FROM af WHERE src NOT IN (SELECT src FROM af WHERE w > 0))"


def neighbour_graph(spark: SparkSession, d: str, known: DataFrame | None = None) -> DataFrame:
    """The edges among the vectors; `known`: these, if the query has staged them already."""
    v = known or vectors(spark, d)
    near = G.knn(v, "row_id", VECTOR, 10)
    if known is None:
        free(v)
    edges = stage(G.affinity(near, 10), "affinity")
    free(near)
    return edges


def evenly(nodes: DataFrame) -> DataFrame:
    """The nodes with equal masses that add up to 1."""
    return nodes.withColumn("mass", F.lit(1.0 / max(1, nodes.count())))


@query(f"{_KN} SELECT src, dst, round(w, 6) AS w FROM af")
def affinity_graph(spark: SparkSession, d: str) -> DataFrame:
    """G1: self-tuning neighbour graph."""
    return neighbour_graph(spark, d).select("src", "dst", r("w", 6).alias("w"))


@query(f"{_KN} SELECT src, dst, round(p, 6) AS p FROM mk")
def markov_rows(spark: SparkSession, d: str) -> DataFrame:
    """Random walk on the graph."""
    return G.markov(neighbour_graph(spark, d)).select("src", "dst", r("p", 6).alias("p"))


@query(f"{_KN}, p AS (SELECT * FROM mk), m0 AS (SELECT row_id AS node, 1.0 / count(*) OVER () AS mass FROM k WHERE cat = 1), m1 AS (SELECT dst AS node, sum(mass * p) AS mass FROM m0 JOIN p ON node = src GROUP BY dst), m2 AS (SELECT dst AS node, sum(mass * p) AS mass FROM m1 JOIN p ON node = src GROUP BY dst) SELECT cat, round(sum(mass), 6) AS mass FROM m2 JOIN k ON node = row_id GROUP BY cat")
def k_step_flow(spark: SparkSession, d: str) -> DataFrame:
    """Where walks from category 1 are after two steps."""
    v = vectors(spark, d)
    p = G.markov(neighbour_graph(spark, d, v))
    start = evenly(v.where("cat = 1").select(F.col("row_id").alias("node")))
    return G.k_step_flow(p, start, 2).join(v.select(F.col("row_id").alias("node"), "cat"), "node").groupBy("cat").agg(r(F.sum("mass"), 6).alias("mass"))


@query()
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """G2g: components of the graph and their sizes."""
    return G.connected_components(neighbour_graph(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


@query()
def graph_pseudotime(spark: SparkSession, d: str) -> DataFrame:
    """Pseudotime from the cells of category 1 nearest the portal side."""
    known = vectors(spark, d)
    v = known.join(cells(spark, d, []).select("row_id", "position"), "row_id")
    edges = neighbour_graph(spark, d, known)
    roots = v.where("cat = 1 and position is not null").orderBy(F.desc("position"), "row_id").limit(5).select(F.col("row_id").alias("node"))
    nodes = edges.select(F.col("src").alias("node")).distinct()
    return G.pseudotime(nodes, G.shortest_paths(edges, roots), roots).select("node", r("pseudotime", 6).alias("pseudotime"))


@query()
def first_hit_categories(spark: SparkSession, d: str) -> DataFrame:
    """Which category walks from category 1 reach first, and by which they come."""
    v = vectors(spark, d)
    p = stage(G.markov(neighbour_graph(spark, d, v)), "markov")
    of = v.select(F.col("row_id").alias("node"), "cat")
    start = evenly(of.where("cat = 1").select("node"))
    hits = G.first_hits(p, start, of.where("cat in (4, 5)").select("node"))
    named = hits.join(of.select(F.col("node").alias("target"), F.col("cat").alias("to")), "target").join(of.select(F.col("node").alias("via"), F.col("cat").alias("last")), "via")
    return named.groupBy("to", "last").agg(r(F.sum("prob"), 5).alias("prob"))


@query(f"WITH {CELLS} SELECT cat AS truth, cat0 + 1 AS predicted, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cat), 8) AS percent FROM cells WHERE cat IS NOT NULL AND cat0 IS NOT NULL GROUP BY cat, cat0")
def confusion_percent(spark: SparkSession, d: str) -> DataFrame:
    """M4: confusion matrix with row percentages."""
    c = cells(spark, d, []).withColumn("guess", F.col("cat0") + 1)
    return M.confusion(c, "cat", "guess").select("truth", "predicted", "n", r("percent").alias("percent"))


@query(f"WITH {CELLS}, t AS (SELECT min(area) AS lo, max(area) AS hi FROM cells WHERE ((row_id % 2147483648 * 1103515245 + 12345) % 2147483648 * 69069 + 1) % 2147483648 < CAST(floor(0.8 * 2147483648) AS BIGINT)) SELECT row_id, round((area - lo) / (hi - lo), 8) + 0.0 AS area FROM cells, t")
def train_minmax(spark: SparkSession, d: str) -> DataFrame:
    """M1: min-max scaling by the training rows only."""
    c = cells(spark, d, ["area"])
    return W.scaled(c, ["area"], "minmax", fitted_on=c.where(W.is_train(F.col("row_id")))).select("row_id", r("area").alias("area"))


def class_rows(spark: SparkSession, d: str) -> DataFrame:
    from lobule.functions.cleaning import map_values

    c = cells(spark, d, FEATURES).where(F.col("condition").isin("CNT", "STV", "WD")).withColumn("y", map_values(F.col("condition"), {"CNT": 0, "STV": 1, "WD": 2}))
    return W.scaled(c, FEATURES, "zscore", clip=10.0)


@query()
def lr_importance(spark: SparkSession, d: str) -> DataFrame:
    """M5: importance in a multinomial logistic regression."""
    return M.logistic_importance(class_rows(spark, d), FEATURES, "y").select("feature", r("importance", 3).alias("importance"), r("percent", 2).alias("percent"))


@query()
def rf_importance(spark: SparkSession, d: str) -> DataFrame:
    """M6f: impurity importance in a random forest."""
    model = M.forest(class_rows(spark, d), FEATURES, "y")
    return M.importance_table(class_rows(spark, d), FEATURES, model.featureImportances.toArray()).select("feature", r("importance", 6).alias("importance"))


SHAP_TREES, SHAP_DEPTH = 50, 5  # the forest that Shapley values are taken of; they cost a pass over all leaves of all trees a row


@query()
def rf_shap(spark: SparkSession, d: str) -> DataFrame:
    """M7: mean absolute Shapley values of a forest, by class."""
    rows = class_rows(spark, d)
    return M.shap_importance(rows, FEATURES, M.forest(rows, FEATURES, "y", trees=SHAP_TREES, depth=SHAP_DEPTH)).select("feature", "class", r("mean_abs", 6).alias("mean_abs"))


@query()
def mlp_confusion(spark: SparkSession, d: str) -> DataFrame:
    """M3, M4: perceptron trained on the training rows, confusion on the others."""
    rows = class_rows(spark, d)
    train = stage(rows.where(W.is_train(F.col("row_id"))).select("y", *FEATURES), "train")
    layers = M.fit_mlp(train, FEATURES, "y", 3, (64, 64, 64), 15)
    return M.confusion(M.predict_mlp(rows.where(~W.is_train(F.col("row_id"))), FEATURES, layers), "y", "predicted").select("truth", "predicted", "n", r("percent", 3).alias("percent"))


@query()
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the neighbour graph and their sizes."""
    from lobule.operators import communities as N

    return N.modularity_communities(neighbour_graph(spark, d)).groupBy("community").agg(F.count("*").alias("n"))


@query()
def community_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Communities over settings, with their measures and the best setting."""
    from lobule.operators import communities as N

    v, out = vectors(spark, d), []
    near = G.knn(v, "row_id", VECTOR, 10)  # its first six places are the six nearest
    for k in (6, 10):
        edges = stage(G.affinity(near.where(F.col("place") <= k), k), "affinity")
        for resolution in (0.5, 1.0):
            labels = stage(N.modularity_communities(edges, resolution, 5, 2), "labels")
            labelled = v.join(labels.withColumnRenamed("node", "row_id"), "row_id")
            out.append((k, resolution, labels.select("community").distinct().count(), N.modularity(edges, labels), K.davies_bouldin(labelled, "community", VECTOR).first()["davies_bouldin"]))
    best = max(out, key=lambda x: (x[3], -x[0], -x[1]))
    return spark.createDataFrame([(*o[:3], round(o[3], 5), None if o[4] is None else round(o[4], 5), o == best) for o in out], "k int, resolution double, clusters long, modularity double, davies_bouldin double, best boolean")


@query()
def mixture_stability(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of mixtures fitted to subsamples, for two to four components."""
    from lobule.operators import communities as N

    names = ["component_1", "component_2"]
    known = stage(K.component_scores(cells(spark, d).na.drop(subset=FEATURES), FEATURES, K.principal_components(cells(spark, d), FEATURES), 2).select("row_id", *names), "scores")
    out = []
    for k in (2, 3, 4):
        fit = lambda part, k=k: K.mixture_labels(part, names, K.gaussian_mixture(part, names, k, starts=2, rounds=25)).withColumnRenamed("prediction", "label")
        s = N.summary(N.stability(known, "row_id", fit, 3))
        out.append((k, *[round(x, 5) for x in s.values()], round(N.penalised(s["mean"], s["std"], k), 5)))
    return spark.createDataFrame(out, "k int, mean double, std double, q10 double, q90 double, score double")


@query(f"{_V}, pr AS (SELECT a.row_id AS src, b.row_id AS dst, {_D('a', 'b')} AS d FROM k a JOIN k b ON a.row_id <> b.row_id), nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS place FROM pr QUALIFY place <= 10), t AS (SELECT src, d, max(d) OVER (PARTITION BY src) AS top FROM nn WHERE d > 0), e AS (SELECT src, avg(ln(top / d)) AS m FROM t WHERE d < top GROUP BY src) SELECT count(*) AS n, round(avg(1 / m), 5) AS dimension FROM e WHERE m > 0")
def intrinsic_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Dimension from the growth of neighbour distances."""
    from lobule.operators import communities as N

    v = vectors(spark, d)
    return N.intrinsic_dimension(G.knn(v, "row_id", VECTOR, 10, spent=v)).select("n", r("dimension", 5).alias("dimension"))


@query()
def alignment_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """How often each pair of categories is matched in 300 Poisson resamples, and its mean consensus."""
    runs = stage(A.bootstrap_alignment(*two_sides(spark, d), 300), "resamples")
    drawn = runs.select(F.count_distinct("run").alias("runs"))
    each = runs.groupBy("a", "b").agg(F.sum("matched").alias("m"), F.avg(F.nanvl("consensus", F.lit(None))).alias("consensus")).crossJoin(drawn)
    return each.select("a", "b", r(F.col("m") / F.col("runs"), 4).alias("matched"), r("consensus", 5).alias("consensus"))


@query()
def alignment_tau(spark: SparkSession, d: str) -> DataFrame:
    """Tau, the median distance, of each of the 300 resamples."""
    return A.bootstrap_alignment(*two_sides(spark, d), 300).select("run", r("tau", 7).alias("tau")).distinct()


@query()
def root_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Spread of pseudotime over five choices of roots."""
    v = vectors(spark, d)
    edges = neighbour_graph(spark, d, v)
    nodes, out = edges.select(F.col("src").alias("node")).distinct(), None
    for run in range(5):
        roots = W.hash_sample(v.where("cat = 1"), "row_id", 5, seed=run).select(F.col("row_id").alias("node"))
        part = G.pseudotime(nodes, G.shortest_paths(edges, roots), roots)
        out = part if out is None else out.unionByName(part)
    each = out.groupBy("node").agg(F.avg("pseudotime").alias("mean"), F.max("pseudotime").alias("top"), F.min("pseudotime").alias("low"))
    return each.agg(F.count("*").alias("n"), r(F.avg("mean"), 5).alias("mean"), r(F.avg(F.col("top") - F.col("low")), 5).alias("spread"))
