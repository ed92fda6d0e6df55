"""Splits that keep related records together.

Records and entities form a bipartite graph; links join entities. Iterative minimum-label propagation with pointer jumping finds the
components. Whole components are then assigned to splits, largest first, so that sizes and label distributions stay close to the
wanted proportions: components above a fixed share of all rows singly, the many small ones in hashed bundles, so what reaches the
driver is bounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobule.shared import stage

BIG_SHARE = 4096  # a component with at least 1 / 4096 of all rows is assigned singly; there are at most 4096 of them
BUNDLES = 4096  # the rest is assigned in so many bundles of whole components
BROADCAST_ENTITIES = 100_000  # entity tables up to this are sent to the records


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, label) with the smallest node of each component, for undirected edges (a, b) of strings; a = b states a lone node.

    Null ends are ignored. Stops when no label changes; a path of n nodes takes about log2 n rounds.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(most_rounds):
        sent = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        best = sent.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        after = stage(best.join(up, "label", "left").select("node", F.least("label", F.coalesce("higher", "label")).alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old")
        if changed.isEmpty():
            return after
        labels = after
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def entities(records: DataFrame, links: DataFrame) -> DataFrame:
    """The records (tab, row_id, codes, any others) with `entity`, the smallest code of their component; without a code it is null.

    records.codes: array of entity codes of the record, null or empty where it has none; null codes in it are ignored. All codes of one
    record belong together. links: (a, b), pairs of codes that are the same entity; repeated and reversed pairs are harmless.
    """
    codes = F.array_distinct(F.filter(F.coalesce("codes", F.array().cast("array<string>")), lambda c: c.isNotNull()))
    marked = records.withColumn("codes", F.array_sort(codes)).withColumn("code", F.get("codes", F.lit(0)))
    star = marked.where("code is not null").select(F.col("code").alias("a"), F.explode("codes").alias("b")).distinct()
    found = components(star.unionByName(links.select("a", "b")))
    few = found.limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES
    names = found.select(F.col("node").alias("code"), F.col("label").alias("entity"))
    return marked.join(F.broadcast(names) if few else names, "code", "left").drop("code")


def assign_splits(records: DataFrame, proportions: dict[str, float], seed: int = 0) -> DataFrame:
    """The records (entity, stratum, others) with `split`: one split per entity, label shares as even as the entities allow.

    Records without an entity are assigned singly, by a hash of all their columns. A null stratum is a stratum of its own. The cost
    minimised is the sum over splits and strata of (rows - wanted rows)^2 / (wanted rows), plus the same for sizes.
    """
    names, share = list(proportions), np.array(list(proportions.values()), float)
    share = share / share.sum()
    counts = stage(records.where("entity is not null").groupBy("entity", F.coalesce(F.concat(F.lit("s:"), "stratum"), F.lit("none")).alias("stratum")).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    sizes = counts.groupBy("entity").agg(F.sum("n").alias("size"))
    bundle = F.concat(F.lit("b:"), F.pmod(F.xxhash64("entity", F.lit(seed)), F.lit(BUNDLES)).cast("string"))
    units = stage(sizes.select("entity", F.when(F.col("size") * BIG_SHARE >= total, F.concat(F.lit("e:"), "entity")).otherwise(bundle).alias("unit")), "units")
    table = counts.join(units, "entity").groupBy("unit", "stratum").agg(F.sum("n").alias("n")).toPandas()  # at most (BIG_SHARE + BUNDLES) x strata
    chosen: dict[str, str] = {}
    if len(table):
        wide = table.pivot_table(index="unit", columns="stratum", values="n", fill_value=0, aggfunc="sum").sort_index()
        wide["size"] = wide.sum(axis=1)
        wide = wide.iloc[np.argsort(-wide["size"].to_numpy(), kind="stable")]
        rows = wide.to_numpy(float)
        want = np.maximum(np.outer(share, rows.sum(0)), 1e-9)
        have = np.zeros_like(want)
        for unit, row in zip(wide.index, rows):
            cost = (((have + row - want) ** 2 - (have - want) ** 2) / want).sum(1)
            i = int(cost.argmin())
            have[i] += row
            chosen[unit] = names[i]
    spark = records.sparkSession
    picked = spark.createDataFrame(list(chosen.items()), "unit string, split string")
    by_entity = units.join(F.broadcast(picked), "unit").select("entity", "split")
    few = by_entity.limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES
    joined = records.join(F.broadcast(by_entity) if few else by_entity, "entity", "left")
    at = F.pmod(F.xxhash64(*[c for c in records.columns], F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    lone = F.lit(names[-1])
    for name, upto in reversed(list(zip(names, np.cumsum(share)))[:-1]):
        lone = F.when(at < float(upto), F.lit(name)).otherwise(lone)
    return joined.withColumn("split", F.coalesce("split", lone))
