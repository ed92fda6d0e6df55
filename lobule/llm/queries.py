"""Queries p1_ to p8_ but p4_, over the tables of a data folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobule.llm import clusters, digests, leakage, neighbours, packing, personal, splits
from lobule.shared import join_one_row_each, numbered, scaled_features, stage, table, usable

# The profile features and positions of the cell table.
PROFILE = ["mito_density", "mito_avg_area", "mito_aspect_ratio", "mito_percent_total_area", "mito_distance_from_edge", "peroxisome_density", "peroxisome_avg_area", "peroxisome_circularity", "peroxisome_distance_from_edge", "ld_density", "ld_avg_area", "ld_percent_total_area"]
POSITION = ["centroid-0", "centroid-1"]


def cell_vectors(spark: SparkSession, d: str, names: list[str], keep: list[str] = ["row_id"]) -> DataFrame:
    return scaled_features(table(spark, d, "full_concat_clusters"), table(spark, d, "feature_scale"), names, keep)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a probe cell and one of its ten nearest cells, smaller id first."""
    names = PROFILE + POSITION
    near = neighbours.nearest_vectors(cell_vectors(spark, d, names), "row_id", [f"v{i}" for i in range(len(names))], table(spark, d, "probe_cells"), 10)
    return near.select(F.least("query_id", "neighbour_id").alias("row_id_a"), F.greatest("query_id", "neighbour_id").alias("row_id_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest cells, among all, of every cell whose id is divisible by 100."""
    names = PROFILE + POSITION
    cells = cell_vectors(spark, d, names)
    near = neighbours.nearest_vectors(cells, "row_id", [f"v{i}" for i in range(len(names))], cells.where("row_id % 100 = 0").select("row_id"), 10)
    return near.withColumn("distance", F.round("distance", 6))


def _grouped(spark: SparkSession, d: str, degrees: bool) -> DataFrame:
    """(row_id, group_no[, degree, is_candidate]); groups are numbered by falling mean position, unknown means last."""
    cells = cell_vectors(spark, d, PROFILE, ["row_id", "ascini_position"])
    found = clusters.similarity_clusters(cells, "row_id", [f"v{i}" for i in range(len(PROFILE))], radius=2.5, degrees=degrees)
    position = F.col("ascini_position")
    finite = F.when(position.isNotNull() & ~F.isnan(position) & (F.abs(position) != float("inf")), position)
    members = stage(found.withColumnRenamed("id", "row_id").join(cells.select("row_id", finite.alias("position")), "row_id"), "members")
    means = members.groupBy("cluster").agg(F.avg("position").alias("mean"), F.count("*").alias("size"))
    numbers = numbered(means, [F.desc_nulls_last("mean"), F.asc("cluster")], "place").select("cluster", F.col("place").cast("int").alias("group_no"), "size")
    return join_one_row_each(members, numbers, ["cluster"], "size")


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, group_no, degree, is_typical) of every cell with a usable profile: degree within the whole group, and whether it is one of
    the group's candidates for its most typical cells."""
    return _grouped(spark, d, True).select("row_id", "group_no", "degree", F.col("is_candidate").alias("is_typical"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every cell with a usable profile."""
    return _grouped(spark, d, False).select("row_id", "group_no")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group's size and its five most typical cells, those of highest weighted degree within the whole group, ties by id."""
    members = stage(p2_members(spark, d), "members")
    order = [F.desc(F.round("degree", 6)), F.asc("row_id")]
    typical = members.where("is_typical").withColumn("n", F.row_number().over(Window.partitionBy("group_no").orderBy(*order))).where("n <= 5")
    lists = typical.groupBy("group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "row_id"))), lambda x: x["row_id"]).alias("typical_cells"))
    return members.groupBy("group_no").agg(F.count("*").alias("size")).join(lists, "group_no")


def mito_values(spark: SparkSession, d: str) -> DataFrame:
    """The counted mitochondria: (liver_code, tile_section, zone, day, value), rows equal but for row_id and loaded_at once."""
    mito = table(spark, d, "fig5_ivm_control_group_mitochondria_properties")
    limit = table(spark, d, "feature_scale").where("feature = 'ratio_01_00'").select("valid_min", "valid_max").first()
    label = r"(?i)^\s*CL0*(\d+)TS0*(\d+)R\d+Z\d+_\d+\s*$"
    zone = F.upper(F.regexp_replace("PV_CV", r"\s", ""))
    rows = mito.where(F.col("cell_label").rlike(label) & zone.isin("PV", "CV") & usable("ratio_01_00", limit[0], limit[1]))
    content = [F.col(f"`{c}`") for c in mito.columns if c not in ("row_id", "loaded_at")]
    rows = rows.select(
        F.concat(F.lit("CL"), F.regexp_extract("cell_label", label, 1)).alias("liver_code"), F.concat(F.lit("TS"), F.regexp_extract("cell_label", label, 2)).alias("tile_section"),
        zone.alias("zone"), F.to_date("acquired_at").alias("day"), F.col("ratio_01_00").alias("value"), F.xxhash64(*content).alias("h1"), F.xxhash64(*content, F.lit(1)).alias("h2"),
    )
    return rows.distinct().drop("h1", "h2")  # 128 bits stand for the other columns of a row


P3_KEYS, P3_LEAST = ["liver_code", "tile_section", "zone"], 150


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The 5th, 50th, 95th and 99th percentile of the ratio of every liver, tile and zone, each with its certified rank error."""
    percents = sorted(r[0] for r in table(spark, d, "tmrm_limits").select("pct").distinct().collect())
    return digests.percentiles(mito_values(spark, d), P3_KEYS, ["day"], percents)


def p3_combined(spark: SparkSession, d: str) -> DataFrame:
    """The medians of every liver and zone from digests that were saved apart, one table for even and one for odd days, and combined later;
    with the certified rank error. A liver and zone hold many more values than a digest has centroids."""
    keys = ["liver_code", "zone"]
    values = stage(mito_values(spark, d).groupBy(*keys, "day", "value").agg(F.count("*").alias("weight")).where("day is not null"), "values")
    even = F.pmod(F.datediff("day", F.lit("2000-01-01")), F.lit(2)) == 0
    saved = [stage(digests.merge_digests(digests.build_digests(values.where(side), keys, ["day"], P3_DELTA), keys, ["day"], P3_DELTA), "digests") for side in (even, ~even)]
    whole = digests.merge_digests(saved[0].withColumn("half", F.lit(0)).unionByName(saved[1].withColumn("half", F.lit(1))), keys, ["half"], P3_DELTA, 2)
    return digests.certify(values.select(*keys, "value", "weight"), digests.estimate(whole, keys, [50.0]), keys)


P3_DELTA = 100


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles outside their limits, of liver-tile-zones with at least 150 counted rows."""
    limits = table(spark, d, "tmrm_limits").withColumn("percent", F.col("pct").cast("double"))
    found = p3_percentiles(spark, d).where(F.col("n") >= P3_LEAST).join(F.broadcast(limits), ["zone", "percent"])
    return found.where("estimate < lower_limit or estimate > upper_limit").select(*P3_KEYS, "pct")


def code(text: Column) -> Column:
    """A liver code as capital letters then number, without blanks, hyphens and leading zeros; null where it is none."""
    bare = F.upper(F.regexp_replace(text, r"[\s-]", ""))
    return F.when(bare.rlike(r"^[A-Z]+\d+$"), F.regexp_replace(bare, r"^([A-Z]+)0*(\d+)$", "$1$2"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """All cells and mitochondria: (tab, row_id, codes, stratum); strata are the condition, and the zone."""
    cells, mito = table(spark, d, "full_concat_clusters"), table(spark, d, "fig5_ivm_control_group_mitochondria_properties")
    acinus = F.regexp_extract_all("labels", F.lit(r"(?i)(?:CNT|STV|WD)_(L\d+)L\d+a\d+s\d+_\d+"), F.lit(1))
    tile = F.regexp_extract_all("labels", F.lit(r"(?i)([A-Z]+[ -]*\d+)TS\d+"), F.lit(1))
    codes = F.transform(F.concat(acinus, tile), code)
    group = F.upper(F.trim("group"))
    condition = F.when(group.isin("CNT", "1"), "CNT").when(group.isin("STV", "2"), "STV").when(group.isin("WD", "3"), "WD").otherwise("unknown")
    of_cells = cells.select(F.lit("cells").alias("tab"), "row_id", codes.alias("codes"), condition.alias("stratum"))
    before = F.nullif(F.regexp_extract("cell_label", r"(?i)([A-Z]+[ -]*\d+)TS\d+", 1), F.lit(""))
    zone = F.upper(F.regexp_replace("PV_CV", r"\s", ""))
    of_mito = mito.select(F.lit("mito").alias("tab"), "row_id", F.array(F.coalesce(code(before), code(F.col("liver_id")))).alias("codes"), F.when(zone.isin("PV", "CV"), zone).otherwise("none").alias("stratum"))
    return of_cells.unionByName(of_mito)


def same_animal(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "specimen_links").where("link_kind in ('same_animal', 'reimaged', 'renamed') and status = 'confirmed'")
    return links.select(code(F.col("code_a")).alias("a"), code(F.col("code_b")).alias("b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record's animal, by the smallest of the animal's liver codes; records without a code have none."""
    return splits.entities(records(spark, d), same_animal(spark, d)).where("entity is not null").select("tab", "row_id", "entity")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """Train, validation or test (80 / 10 / 10) for every record; all records of one animal get the same."""
    named = stage(splits.entities(records(spark, d), same_animal(spark, d)).select("tab", "row_id", "entity", F.concat_ws(":", "tab", "stratum").alias("stratum")), "entities")
    return splits.assign_splits(named, {"train": 0.8, "validation": 0.1, "test": 0.1}).select("tab", "row_id", "entity", "split", "stratum")


def p5_torn(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits, by table: (tab, records, torn): all records have a split, and no animal is in two."""
    found = p5_splits(spark, d)
    torn = found.where("entity is not null").groupBy("tab", "entity").agg(F.count_distinct("split").alias("n")).groupBy("tab").agg(F.count_if(F.col("n") > 1).alias("torn"))
    return found.where("split is not null").groupBy("tab").agg(F.count("*").alias("records")).join(torn, "tab")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each split's share of every table's strata, in percent, and how far it is from the wanted one."""
    found = p5_splits(spark, d)
    each = found.groupBy("tab", "stratum", "split").agg(F.count("*").alias("records"))
    share = each.withColumn("percent", 100.0 * F.col("records") / F.sum("records").over(Window.partitionBy("tab", "stratum")))
    wanted = F.when(F.col("split") == "train", 80.0).otherwise(10.0)
    return share.select("tab", "stratum", "split", "records", F.round("percent", 3).alias("percent"), F.round(F.col("percent") - wanted, 3).alias("off"))


def p6_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing: (documents, overfull, torn): every document with a text is packed, no container is overfull, and only
    documents above the capacity are cut."""
    packed = stage(p6_packing(spark, d).where("container is not null"), "packed")
    whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > 2048).alias("overfull"))
    return whole.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("torn")).crossJoin(full)  # one row each


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces and their containers of 2,048 tokens."""
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text", 2048).withColumnRenamed("id", "doc_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """How full each container is."""
    return p6_packing(spark, d).where("container is not null").groupBy("container").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("used"), (2048 - F.sum("n_tokens")).alias("unused"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document and evaluation item that share a passage, with the shares of the item's words and characters found."""
    return leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat at least 30 % of an item's words in runs of 8 or more."""
    return p7_leaks(spark, d).where("word_share >= 0.3").select("doc_id", "item_id").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text with typed placeholders for personal information."""
    return personal.redact(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "redacted", F.size("found").alias("pieces"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Each piece of personal information, once per document."""
    found = personal.redact(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), F.explode("found").alias("f"))
    return found.select("doc_id", F.col("f.kind").alias("kind"), F.col("f.text").alias("found_text")).distinct()
