"""Events against rules without a join: all rules of a log type are one projection over one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions.times import both
from watchtide.operators.context import Provider, boost
from watchtide.operators.predicates import Fields, alert_tree, field_of, fields_of, leaves, matched_leaves, semantic_tree

#: Rules of one projection: keeps generated code small.
RULES = 50


def log_types(rule: dict) -> list[str]:
    given = rule.get("log_type")
    return [given] if isinstance(given, str) else list(given or [])


def confidence(rule: dict) -> float:
    return min(1.0, max(0.0, float(rule.get("confidence_score") or 0.0)))


def rejected(rule: dict, fields: Fields) -> Column:
    """Why a rule doesn't match an event; null where it does."""
    if rule.get("correlation_required"):
        return F.lit("correlation_required")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    used = {leaf["field"] for leaf in leaves(rule.get("semantic_conditions") or {})}
    for name in rule.get("required_fields") or []:
        if name not in fields:
            return F.lit(f"missing_required_field:{name}")
        if name in used:
            out = out.when(fields[name].column.isNull(), F.lit(f"null_required_field:{name}"))
    if not rule.get("semantic_conditions"):
        return out.otherwise(F.lit("no_semantic_conditions"))
    return out.when(~semantic_tree(rule["semantic_conditions"], fields), F.lit("semantic_conditions_failed"))


def semantic_matches(
    events: DataFrame, rules: list[dict], names: dict[str, str] | None = None, provider: Provider | None = None, log_type: str = "log_type", kept: tuple[str, ...] = ("event_uid",)
) -> DataFrame:
    """A row for every match: kept columns, mapping_id, technique_id, tactic, base_confidence, context_boost, score, matched_conditions, context_conditions, match_rank.

    Matches of an event are ranked by score, then in the rules' order.
    """
    return _ranked(projected(events, list(enumerate(rules)), names, provider, log_type, kept), kept, by_score)


MATCH = "struct<ordinal:int,mapping_id:string,technique_id:string,tactic:string,base_confidence:double,context_boost:double,score:double,matched_conditions:array<string>,context_conditions:array<string>>"


def projected(events: DataFrame, rules: list[tuple[int, dict]], names: dict[str, str] | None, provider: Provider | None, log_type: str, kept: tuple[str, ...]) -> DataFrame:
    """kept and _m, the array of an event's matches: one projection for all (ordinal, rule)."""
    fields = fields_of(events, names)
    parts = []
    for number, rule in rules:
        technique, base = rule.get("attack_technique") or {}, confidence(rule)
        more, said = boost(rule, fields, provider)
        made = F.struct(
            F.lit(number).alias("ordinal"),
            F.lit(rule["mapping_id"]).alias("mapping_id"),
            F.lit(technique.get("technique_id")).alias("technique_id"),
            F.lit(technique.get("tactic")).alias("tactic"),
            F.lit(round(base, 4)).alias("base_confidence"),
            F.round(more, 4).alias("context_boost"),
            F.round(F.least(F.lit(1.0), F.lit(base) + more), 4).alias("score"),
            matched_leaves(rule.get("semantic_conditions") or {}, fields).alias("matched_conditions"),
            said.alias("context_conditions"),
        )
        own = F.col(log_type).isin(log_types(rule)) if log_types(rule) else F.lit(False)
        parts.append(F.when(own & rejected(rule, fields).isNull(), made))
    return _projection(events, parts or [F.lit(None).cast(MATCH)], kept)


def by_score(a: Column, b: Column) -> Column:
    return F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(F.signum(a["ordinal"] - b["ordinal"]).cast("int"))


def _projection(events: DataFrame, parts: list[Column], kept: tuple[str, ...]) -> DataFrame:
    chunks = [F.array_compact(F.array(*parts[i : i + RULES])) for i in range(0, len(parts), RULES)]
    return events.select(*kept, (F.concat(*chunks) if len(chunks) > 1 else chunks[0]).alias("_m"))


def _ranked(found: DataFrame, kept: tuple[str, ...], order) -> DataFrame:
    out = found.where(F.size("_m") > 0).select(*kept, F.posexplode(F.array_sort("_m", order)).alias("_at", "_one"))
    return out.select(*kept, "_one.*", (F.col("_at") + 1).cast("long").alias("match_rank")).drop("ordinal")


def alert_matches(events: DataFrame, rules: list[dict], names: dict[str, str] | None = None, kept: tuple[str, ...] = ("event_uid",)) -> DataFrame:
    """As semantic_matches for nested alerts: every rule sees every event; no context, score 1, rules in their order. Fields are looked up by name, then by path."""
    fields = fields_of(events, names)
    parts = []
    for number, rule in enumerate(rules):
        if rule.get("correlation_required"):
            continue
        required = [field_of(fields, f).column.isNotNull() for f in rule.get("required_fields") or []]
        technique = rule.get("attack_technique") or {}
        made = F.struct(
            F.lit(number).alias("ordinal"),
            F.lit(rule["mapping_id"]).alias("mapping_id"),
            F.lit(technique.get("technique_id")).alias("technique_id"),
            F.lit(float(rule.get("confidence_score", 0.5))).alias("confidence"),
            F.lit(rule.get("mapping_type", "semantic")).alias("mapping_type"),
            F.lit(1.0).alias("score"),
        )
        parts.append(F.when(both([*required, alert_tree(rule.get("semantic_conditions") or {}, fields)]), made))
    if not parts:
        parts = [F.lit(None).cast("struct<ordinal:int,mapping_id:string,technique_id:string,confidence:double,mapping_type:string,score:double>")]
    return _ranked(_projection(events, parts, kept), kept, lambda a, b: F.signum(a["ordinal"] - b["ordinal"]).cast("int"))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null, empty nor zero, else N/A."""
    return F.coalesce(*(F.when(~v.cast("string").isin("", "0"), v.cast("string")) for v in values), F.lit("N/A"))


def first_wins(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first event of each key; events with a null, empty or zero key are all kept. The least order tuple wins by aggregation, so a key's events are never sorted in one task."""
    told = F.coalesce(~F.col(key).cast("string").isin("", "0"), F.lit(False))
    cols = [c for c in events.columns if c != key]
    first = events.where(told).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_one"))
    return first.select(key, "_one.*").select(*events.columns).unionByName(events.where(~told))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_one")).select(key, "_one.*").select(*rows.columns)


def split_by(rules: list[dict]) -> tuple[list[dict], list[dict]]:
    """Semantic and correlation rules."""
    return [r for r in rules if not r.get("correlation_required")], [r for r in rules if r.get("correlation_required")]


def required_fields(rules: DataFrame) -> DataFrame:
    """log_type, required_fields: the sorted distinct fields of rules(log_type array, required_fields array)."""
    each = rules.select(F.explode("log_type").alias("log_type"), "required_fields").select("log_type", F.explode("required_fields").alias("field"))
    return each.where("field IS NOT NULL").groupBy("log_type").agg(F.sort_array(F.collect_set("field")).alias("required_fields"))


def union_results(*frames: DataFrame) -> DataFrame:
    """Semantic and correlation results under each other, columns that one lacks null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rejections(events: DataFrame, rules: list[dict], names: dict[str, str] | None = None, log_type: str = "log_type", kept: tuple[str, ...] = ("event_uid",)) -> DataFrame:
    """kept, mapping_id, reason: why each rule of an event's log type doesn't match it."""
    fields = fields_of(events, names)
    each = []
    for rule in rules:
        own = F.col(log_type).isin(log_types(rule)) if log_types(rule) else F.lit(False)
        why = rejected(rule, fields)
        each.append(F.when(own & why.isNotNull(), F.struct(F.lit(rule["mapping_id"]).alias("mapping_id"), why.alias("reason"))))
    found = F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<mapping_id:string,reason:string>>")
    return events.select(*kept, F.explode(found).alias("_r")).select(*kept, "_r.*")


def distinct_rows(rows: DataFrame, order: str) -> DataFrame:
    """Of rows equal in all columns but `order` the first by it."""
    return rows.groupBy(*(c for c in rows.columns if c != order)).agg(F.min(order).alias(order)).select(*rows.columns)


def by_size(rows: DataFrame, *by: str) -> DataFrame:
    """by, size: groups from the largest to the smallest, equal ones by their key."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), *by)
