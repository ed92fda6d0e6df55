"""Supervised models and what is reported of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobule.functions.cleaning import col


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n, percent): counts and their percentage of the true class."""
    counted = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    known = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return known.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def assembled(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """label and features of complete rows; awkward column names are replaced on the way."""
    plain = df.select(F.col(label).cast("double").alias("label"), *[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    return VectorAssembler(inputCols=[f"c{i}" for i in range(len(columns))], outputCol="features").transform(plain)


def logistic_importance(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(feature, importance, percent): mean |coefficient| over classes of a multinomial model with L2 penalty 1 / n, unstandardised."""
    rows = assembled(df, columns, label)
    n = rows.count()
    model = LogisticRegression(family="multinomial", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=100).fit(rows)
    weight = np.abs(model.coefficientMatrix.toArray()).mean(0)
    return importance_table(df, columns, weight)


def forest(df: DataFrame, columns: list[str], label: str, trees: int = 300, depth: int = 10, seed: int = 42) -> RandomForestClassificationModel:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(assembled(df, columns, label))


def importance_table(df: DataFrame, columns: list[str], weight: np.ndarray) -> DataFrame:
    total = float(weight.sum()) or 1.0
    return df.sparkSession.createDataFrame([(c, float(w), 100 * float(w) / total) for c, w in zip(columns, weight)], "feature string, importance double, percent double")


def forest_nodes(model: RandomForestClassificationModel) -> list[dict[str, np.ndarray]]:
    """Each tree as arrays: feature (-1 at leaves), threshold, left, right, cover, and class shares (value)."""
    out = []
    for tree in model._java_obj.trees() if hasattr(model._java_obj, "trees") else []:
        rows: list[tuple] = []

        def visit(node) -> int:
            at = len(rows)
            rows.append(None)
            stats = np.array(list(node.impurityStats().stats()), float)
            share = stats / max(stats.sum(), 1e-300)
            if node.numDescendants() > 0:
                split = node.split()
                left, right = visit(node.leftChild()), visit(node.rightChild())
                rows[at] = (split.featureIndex(), split.threshold(), left, right, stats.sum(), share)
            else:
                rows[at] = (-1, 0.0, -1, -1, stats.sum(), share)
            return at

        visit(tree.rootNode())
        f, t, a, b, c, v = zip(*rows)
        out.append({"feature": np.array(f), "threshold": np.array(t), "left": np.array(a), "right": np.array(b), "cover": np.array(c), "value": np.array(v)})
    return out


def shapley_of_tree(tree: dict[str, np.ndarray], x: np.ndarray, features: int) -> np.ndarray:
    """(rows, features, classes) path-dependent Shapley values, leaf by leaf.

    On the path to a leaf every feature has a share of cover z it would keep if unknown, and o = 1 if the row follows all its splits.
    The leaf's game is the product over features of z or o, whose Shapley value for i is (o - z) times a sum over subset sizes; that sum
    is read off the polynomial prod(z + o t) over the other features.
    """
    n, classes = len(x), tree["value"].shape[1]
    out = np.zeros((n, features, classes))
    stack = [(0, {}, np.ones((n, 0), bool), [])]
    while stack:
        node, zero, follow, names = stack.pop()
        f = tree["feature"][node]
        if f < 0:
            m = len(names)
            if m == 0:
                continue
            z = np.array([zero[i] for i in names])
            o = follow.astype(float)
            weights = np.array([1.0 / (m * _binomial(m - 1, s)) for s in range(m)])
            for a in range(m):
                poly = np.zeros((n, m))
                poly[:, 0] = 1
                for b in range(m):
                    if b != a:
                        poly[:, 1:] = poly[:, 1:] * z[b] + poly[:, :-1] * o[:, b : b + 1]
                        poly[:, 0] *= z[b]
                out[:, names[a]] += ((o[:, a] - z[a]) * (poly @ weights))[:, None] * tree["value"][node]
            continue
        goes_left = x[:, f] <= tree["threshold"][node]
        for child, here in ((tree["left"][node], goes_left), (tree["right"][node], ~goes_left)):
            share = tree["cover"][child] / max(tree["cover"][node], 1e-300)
            if f in zero:
                at = names.index(f)
                both = follow.copy()
                both[:, at] &= here
                stack.append((child, zero | {f: zero[f] * share}, both, names))
            else:
                stack.append((child, zero | {f: share}, np.column_stack([follow, here]), [*names, f]))
    return out


def _binomial(n: int, k: int) -> int:
    import math

    return math.comb(n, k)


def shap_importance(df: DataFrame, columns: list[str], model: RandomForestClassificationModel) -> DataFrame:
    """(feature, class, mean_abs): mean |Shapley value| over complete rows, for each class; one pass, partial sums per task."""
    trees = df.sparkSession.sparkContext.broadcast(forest_nodes(model))
    d = len(columns)
    rows = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    names = rows.columns

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for b in batches:
            x = b[names].to_numpy(float)
            values = sum(shapley_of_tree(t, x, d) for t in trees.value) / len(trees.value)
            part = np.abs(values).sum(0)
            total, n = part if total is None else total + part, n + len(x)
        if total is not None:
            yield pd.DataFrame([(i, k, float(total[i, k]), n) for i in range(d) for k in range(total.shape[1])], columns=["i", "class", "total", "n"])

    sums = rows.mapInPandas(partial, "i int, class int, total double, n long").groupBy("i", "class").agg((F.sum("total") / F.sum("n")).alias("mean_abs"))
    return sums.withColumn("feature", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)).select("feature", "class", "mean_abs")


def fit_mlp(df: DataFrame, columns: list[str], label: str, classes: int, hidden: tuple[int, ...] = (64, 64, 64), epochs: int = 30, rate: float = 1e-2, dropout: float = 0.25, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights of a perceptron with dropout before each ReLU, softmax and binary cross-entropy on one-hot labels, by Adam.

    Each epoch is one data-parallel pass: tasks return summed gradients, one row each, so the rows stay where they are. Complete rows
    with labels 0..classes-1 only; features should be scaled.
    """
    rng = np.random.default_rng(seed)
    sizes = [len(columns), *hidden, classes]
    layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:])]
    rows = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.col(label).cast("int").alias("y")).na.drop().where(f"y between 0 and {classes - 1}")
    names = rows.columns[:-1]
    first, second = [[np.zeros_like(p) for p in layer] for layer in layers], [[np.zeros_like(p) for p in layer] for layer in layers]
    for epoch in range(1, epochs + 1):

        def partial(batches: Iterator[pd.DataFrame], layers=layers, epoch=epoch) -> Iterator[pd.DataFrame]:
            total, n = None, 0
            for b in batches:
                x, y = b[names].to_numpy(float), np.eye(classes)[b["y"].to_numpy()]
                noise = np.random.default_rng([seed, epoch, len(x), int(abs(x[0]).sum() * 1e6) % 2**31])
                got = gradients(layers, x, y, dropout, noise)
                total, n = got if total is None else total + got, n + len(x)
            if total is not None:
                yield pd.DataFrame({"g": [total.tolist()], "n": [n]})

        parts = rows.mapInPandas(partial, "g array<double>, n long").collect()
        n = sum(r["n"] for r in parts)
        if not n:
            return layers
        flat, at = np.sum([r["g"] for r in parts], axis=0) / n, 0
        new = []
        for i, layer in enumerate(layers):
            made = []
            for j, p in enumerate(layer):
                g = flat[at : at + p.size].reshape(p.shape)
                at += p.size
                first[i][j] = 0.9 * first[i][j] + 0.1 * g
                second[i][j] = 0.999 * second[i][j] + 0.001 * g * g
                made.append(p - rate * (first[i][j] / (1 - 0.9**epoch)) / (np.sqrt(second[i][j] / (1 - 0.999**epoch)) + 1e-8))
            new.append(tuple(made))
        layers = new
    return layers


def forward(layers: list, x: np.ndarray) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0)
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(layers: list, x: np.ndarray, y: np.ndarray, dropout: float, rng: np.random.Generator) -> np.ndarray:
    """Flat gradient of the summed loss, the mean over classes of the binary cross-entropy."""
    seen, masks = [x], []
    for i, (w, b) in enumerate(layers):
        z = seen[-1] @ w + b
        if i < len(layers) - 1:
            keep = (rng.random(z.shape) >= dropout) / (1 - dropout)
            z = z * keep
            masks.append(keep * (z > 0))
            z = np.maximum(z, 0)
        seen.append(z)
    e = np.exp(seen[-1] - seen[-1].max(1, keepdims=True))
    p = np.clip(e / e.sum(1, keepdims=True), 1e-7, 1 - 1e-7)
    dp = (p - y) / (p * (1 - p)) / y.shape[1]
    d = p * (dp - (dp * p).sum(1, keepdims=True))
    out = []
    for i in range(len(layers) - 1, -1, -1):
        out.append(d.sum(0))
        out.append((seen[i].T @ d).ravel())
        if i:
            d = (d @ layers[i][0].T) * masks[i - 1]
    return np.concatenate(out[::-1])


def predict_mlp(df: DataFrame, columns: list[str], layers: list) -> DataFrame:
    """df with `predicted`, the likeliest class; null where a feature is missing."""

    @F.pandas_udf("int")
    def best(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(float) for p in parts])
        fine = np.isfinite(x).all(1)
        return pd.Series(np.where(fine, forward(layers, np.where(fine[:, None], x, 0)).argmax(1), -1)).astype("Int64").where(pd.Series(fine))

    return df.withColumn("predicted", best(*[col(c).cast("double") for c in columns]))
