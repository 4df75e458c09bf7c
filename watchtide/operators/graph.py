"""Technique knowledge from STIX objects: who uses what, and which techniques go together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Related techniques of at least this combined score are candidates.
LEAST_SCORE = 0.40


def external_id(references: Column, source: str = "mitre-attack", prefix: str = "") -> Column:
    """external_id of the first reference of the source whose id starts with prefix."""
    return F.try_element_at(F.filter(references, lambda r: (r["source_name"] == source) & F.startswith(r["external_id"], F.lit(prefix))), F.lit(1))["external_id"]


def uses(objects: DataFrame) -> DataFrame:
    """group_id, technique_id of the 'uses' relationships between groups and techniques; objects as in a STIX bundle."""
    of = lambda kind, prefix: objects.where(F.col("type") == kind).select("id", external_id(F.col("external_references"), prefix=prefix).alias("_x")).where("_x IS NOT NULL")
    groups, techniques = of("intrusion-set", "G"), of("attack-pattern", "T")
    edges = objects.where("type = 'relationship' AND relationship_type = 'uses' AND startswith(source_ref, 'intrusion-set--')").select("source_ref", "target_ref")
    found = edges.join(groups.select(F.col("id").alias("source_ref"), F.col("_x").alias("group_id")), "source_ref")
    return found.join(techniques.select(F.col("id").alias("target_ref"), F.col("_x").alias("technique_id")), "target_ref").select("group_id", "technique_id").distinct()


def technique_pairs(edges: DataFrame) -> DataFrame:
    """t1, t2, group_count, cooccurrence, global_rarity, combined_score of all ordered pairs of techniques that a group shares.

    edges: group_id, technique_id. cooccurrence = shared / groups of t1, global_rarity = ln(all groups / groups of
    t2), combined_score their product; stored with six places. Pairs of a group are all wanted: a group's techniques
    are bounded by the catalogue.
    """
    edges = edges.where("group_id IS NOT NULL AND technique_id IS NOT NULL").distinct()
    a = edges.select("group_id", F.col("technique_id").alias("t1"))
    b = edges.select("group_id", F.col("technique_id").alias("t2"))
    shared = a.join(b, "group_id").where("t1 <> t2").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("group_count"))
    own = edges.groupBy("technique_id").agg(F.count(F.lit(1)).alias("n"))
    total = edges.agg(F.count_distinct("group_id").alias("_total"))
    out = shared.join(own.select(F.col("technique_id").alias("t1"), F.col("n").alias("_n1")), "t1").join(own.select(F.col("technique_id").alias("t2"), F.col("n").alias("_n2")), "t2")
    out = out.crossJoin(F.broadcast(total))  # one row
    together, rarity = F.col("group_count") / F.col("_n1"), F.log(F.col("_total") / F.col("_n2"))
    return out.select(
        "t1", "t2", "group_count", F.round(together, 6).alias("cooccurrence"), F.round(rarity, 6).alias("global_rarity"), F.round(together * rarity, 6).alias("combined_score")
    )


def related(pairs: DataFrame, k: int | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """pairs of at least the score, with relation_rank: by combined score, cooccurrence, group count (all falling), then id; the first k."""
    order = [F.desc("combined_score"), F.desc("cooccurrence"), F.desc("group_count"), F.col("t2")]
    out = pairs.where(F.col("combined_score") >= least).withColumn("relation_rank", F.row_number().over(Window.partitionBy("t1").orderBy(*order)).cast("long"))
    return out if k is None else out.where(F.col("relation_rank") <= k)


def knowledge(pairs: DataFrame) -> DataFrame:
    """technique_id, related_techniques: a map of technique to its statistics, for a JSON document."""
    stats = F.struct("group_count", "cooccurrence", "global_rarity", "combined_score")
    return pairs.groupBy(F.col("t1").alias("technique_id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t2", stats.alias("s"))))).alias("related_techniques"))


def candidates(documents: DataFrame) -> DataFrame:
    """technique_id, next, score > 0 of a knowledge document's technique_relations map."""
    outer = documents.select(F.explode("technique_relations").alias("technique_id", "_r"))
    inner = outer.select("technique_id", F.explode("_r.related_techniques").alias("next", "_s"))
    return inner.select("technique_id", "next", F.col("_s.combined_score").alias("score")).where("score > 0")


def missing(supported: DataFrame, found: DataFrame, key: str = "technique_id") -> DataFrame:
    """Supported techniques that were not found."""
    return supported.join(found.select(key).distinct(), key, "left_anti")


def supported_only(found: DataFrame, supported: DataFrame, key: str = "technique_id") -> DataFrame:
    return found.join(supported.select(key).distinct(), key, "left_semi")


def enriched(rows: DataFrame, more: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """rows with `name`: the sorted distinct values of more.column of the same key, an empty array where there is none. The values of a key are catalogue entries."""
    kind = more.schema[column].dataType.simpleString()
    told = more.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_set(column)).alias(name))
    return rows.join(told, rows[key] == told["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))


def counted(catalogue: DataFrame, found: DataFrame, key: str = "technique_id") -> DataFrame:
    """key, n: how often each key of the catalogue was found, zero included."""
    n = found.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return catalogue.select(key).distinct().join(n, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def techniques(objects: DataFrame) -> DataFrame:
    """technique_id, name, tactics of attack patterns that have an id."""
    own = F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack")
    found = objects.where("type = 'attack-pattern'").select(external_id(F.col("external_references"), prefix="T").alias("technique_id"), "name", F.transform(own, lambda p: p["phase_name"]).alias("tactics"))
    return found.where("technique_id IS NOT NULL")


def groups(objects: DataFrame) -> DataFrame:
    """group_id, name of intrusion sets that have an id."""
    found = objects.where("type = 'intrusion-set'").select(external_id(F.col("external_references"), prefix="G").alias("group_id"), "name")
    return found.where("group_id IS NOT NULL")
