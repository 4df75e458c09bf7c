"""The registered queries of the telemetry engine over the test tables, and their SQL in watchtide.plans.oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchtide.functions import text, times
from watchtide.functions.addresses import in_network
from watchtide.operators import context, correlation, graph, pairs, predicates, rule_index, scoring, semantic, sequences, sketches, timegroups
from watchtide.plans.oracles import SQL
from watchtide.sources.logs import BAD, counters, decode_flat, decode_nested, detection_report, flatten, nested_field, pair_report, report, summary
from watchtide.streaming import detections, pairing, replay

HOUR = 3600
#: Least combined score of related brands: theirs are far below those of techniques.
RELATED_SCORE = 0.02
ZONES = {"vpn_zone": ["10.1.0.0/16"], "dmz": ["10.2.0.0/17"], "internal": ["10.0.0.0/14"]}

SEMANTIC_RULES = [
    {
        "mapping_id": "E-1", "log_type": ["purchase", "view"], "required_fields": ["value", "user"], "confidence_score": 0.75,
        "attack_technique": {"technique_id": "T1021", "tactic": "Lateral Movement"},
        "semantic_conditions": {"logic": "AND", "conditions": [{"field": "value", "operator": ">", "value": 50}, {"logic": "or", "conditions": [{"field": "k", "operator": "<", "value": 10}, {"field": "user", "operator": "in", "value": [1, 2, 3, 5, 8]}]}]},
        "external_context": {"conditions": [{"context": "ip.location", "operator": "==", "value": "dmz", "confidence_boost": 0.2}, {"context": "ip.owner", "operator": "==", "value": "x", "confidence_boost": 0.5}]},
    },
    {
        "mapping_id": "E-2", "log_type": "purchase", "required_fields": ["kind"], "confidence_score": 0.68, "attack_technique": {"technique_id": "T1078", "tactic": "Initial Access"},
        "semantic_conditions": {"field": "kind", "operator": "startswith", "value": "pur"},
    },
    {
        "mapping_id": "E-3", "log_type": "error", "required_fields": ["value"], "confidence_score": 1.4, "attack_technique": {"technique_id": "T1499", "tactic": "Impact"},
        "semantic_conditions": {"logic": "OR", "conditions": [{"field": "kind", "operator": "==", "value": 5}, {"field": "k", "operator": "!=", "value": "7"}]},
    },
    {"mapping_id": "E-4", "log_type": "view", "required_fields": ["absent"], "confidence_score": 0.9, "semantic_conditions": {"field": "k", "operator": ">=", "value": 0}},
    {"mapping_id": "E-5", "log_type": "view", "correlation_required": True, "semantic_conditions": {"field": "k", "operator": ">=", "value": 0}},
]

ALERT_RULES = [
    {"mapping_id": "A-1", "required_fields": ["props.k"], "confidence_score": 0.8, "attack_technique": {"technique_id": "T1110"}, "semantic_conditions": {"conditions": [{"field": "props.k", "operator": "==", "value": " 7 "}, {"field": "kind", "operator": "not_in", "value": ["view"]}]}},
    {"mapping_id": "A-2", "required_fields": [], "attack_technique": {"technique_id": "T1059"}, "semantic_conditions": {"logic": "and", "conditions": [{"field": "kind", "operator": "Contains", "value": "URCH"}, {"field": "value", "operator": ">", "value": "99.5"}]}},
    {"mapping_id": "A-3", "required_fields": ["props.none"], "semantic_conditions": {}},
]

METRICS = {
    "n": {"function": "count"}, "users": {"function": "nunique", "field": "user"}, "avg_value": {"function": "mean", "field": "value"}, "sum_value": {"function": "sum", "field": "value"},
    "min_value": {"function": "min", "field": "value"}, "max_value": {"function": "max", "field": "value"}, "low_share": {"function": "ratio", "field": "k", "values": [0, 1, 2, 3, 4]},
    "sd": {"function": "standard_deviation", "field": "value"}, "cv": {"function": "coefficient_of_variation", "field": "value"}, "h": {"function": "entropy", "field": "k"},
    "per_second": {"function": "rate", "window_seconds": 60}, "density": {"function": "subnet_density", "field": "ip", "subnet": "10.1.2.9/24"},
}

SCAN_RULE = {
    "mapping_id": "C-1", "log_type": ["view", "click", "error"], "confidence_score": 0.9, "attack_technique": {"technique_id": "T1046"},
    "correlation_rule": {
        "window_seconds": HOUR, "group_by": ["kind"], "aggregations": {"n": {"function": "count"}, "users": {"function": "nunique", "field": "user"}},
        "conditions": [{"metric": "users", "operator": ">=", "value": 5}, {"metric": "n", "operator": ">", "value": 5}],
        "state_condition": {"field": "k", "values": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], "aggregation": "ratio", "operator": "<=", "value": 0.25},
        "scoring": {"base_weight": 0.8, "state_condition_weight": 0.5},
    },
}
USER_RULE = {
    "mapping_id": "C-2", "log_type": "purchase", "confidence_score": 0.6, "attack_technique": {"technique_id": "T1030"},
    "correlation_rule": {"window_seconds": 6 * HOUR, "group_by": ["user"], "aggregations": {"n": {"function": "count"}}, "conditions": [{"metric": "n", "operator": ">=", "value": 2}]},
}

PAIR_RULE = {
    "mapping_id": "P-1", "confidence_score": 0.7,
    "semantic_correlation": {
        "source_event": {"conditions": {"field": "kind", "operator": "==", "value": "signup"}}, "followup_event": {"conditions": {"field": "kind", "operator": "==", "value": "purchase"}},
        "context_fields": ["user"], "time_window_seconds": HOUR, "relationship": "follows",
    },
}

NAMES = {"kind": "event_type", "user": "user_id", "value": "value", "k": "k", "ip": "ip", "props.k": "k_text"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(table(spark, sf_dir, "events"))


def prepared(own: DataFrame) -> DataFrame:
    """Events with k (from props), an address made of k and the user, and the time in microseconds."""
    own = own.withColumn("k_text", F.get_json_object("props", "$.k")).withColumn("k", F.col("k_text").try_cast("bigint"))
    ip = F.concat_ws(".", F.lit("10"), F.col("k") % 4, F.col("user_id") % 256, F.col("k"))
    return own.withColumn("ip", ip).withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))


def decode_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(F.concat(F.lit("10.0.0."), F.col("user_id") % 256).alias("id.orig_h"), F.col("event_type").alias("service"), F.col("k").alias("orig_bytes"), (F.col("t") / 1e6).alias("ts")))
    made = decode_flat(events(spark, sf_dir).select("event_id", raw.alias("value")), "conn.log")
    return made.select("event_id", "telemetry_source", "log_type", "timestamp", "conn__id__orig_h", "conn__service", "conn__orig_bytes", F.col("conn__duration").alias("duration"))


def semantic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.semantic_matches(events(spark, sf_dir), SEMANTIC_RULES, NAMES, context.Networks(ZONES), "event_type", ("event_id",))
    return found.withColumn("matched_conditions", F.array_join("matched_conditions", "; ")).withColumn("context_conditions", F.array_join("context_conditions", "; "))


def semantic_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand rules, met through the index: one value of k for two users, or an interval of values."""
    rules = []
    for i in range(2000):
        same = {"field": "k", "operator": "==", "value": i % 100}
        span = {"logic": "AND", "conditions": [{"field": "value", "operator": ">", "value": i / 20}, {"field": "value", "operator": "<=", "value": i / 20 + 0.25}]}
        user = {"field": "user", "operator": "in", "value": [i % 150, i % 97]}
        rules.append({"mapping_id": f"R-{i}", "log_type": ["view", "purchase"][i % 2], "confidence_score": 0.5, "semantic_conditions": {"logic": "OR", "conditions": [{"conditions": [same, user]}, {"conditions": [span, {"field": "k", "operator": "<", "value": 50}]}]}})
    found = rule_index.indexed_matches(events(spark, sf_dir), rules, NAMES, None, "event_type", ("event_id",))
    return found.select("event_id", "mapping_id", "score", F.size("matched_conditions").cast("long").alias("n_matched"))


def alert_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.alert_matches(events(spark, sf_dir), ALERT_RULES, NAMES, ("event_id",))


def condition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).withColumn("v", F.expr("nullif(k, 5)")).withColumn("s", F.expr("nullif(event_type, 'view')"))
    f = predicates.fields_of(own)
    tests = {
        "z_null": predicates.semantic_leaf(f["v"], "is_null", True), "z_ne": predicates.semantic_leaf(f["v"], "!=", 7), "z_ne_text": predicates.semantic_leaf(f["v"], "!=", "7"), "z_lt": predicates.semantic_leaf(f["v"], "<", 50),
        "z_ends": predicates.semantic_leaf(f["s"], "endswith", "ck"), "z_text_order": predicates.semantic_leaf(f["s"], ">", "m"), "w_null": predicates.alert_leaf(f["v"], "is_null", False), "w_eq": predicates.alert_leaf(f["v"], "==", " 7"),
        "w_not_in": predicates.alert_leaf(f["v"], "NOT_IN", ["1", 2]), "w_contains": predicates.alert_leaf(f["s"], "contains", "CLI"), "w_ge": predicates.alert_leaf(f["s"], ">=", 3), "c_null": predicates.metric_leaf(f["v"], "is_null", given=False),
        "c_not_in": predicates.metric_leaf(f["v"], "not_in", [1, 2]), "c_le": predicates.metric_leaf(f["v"], "<=", 30),
        "z_empty": predicates.semantic_tree({"logic": "AND", "conditions": []}, f), "w_empty": predicates.alert_tree({"conditions": []}, f),
    }
    return own.select("event_id", *(c.alias(k) for k, c in tests.items()))


def alert_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tests of the alert dialect in any case, and membership in arrays of texts and of numbers."""
    own = events(spark, sf_dir).select("event_id", F.expr("nullif(event_type, 'view')").alias("s"), F.expr("CASE WHEN k % 7 = 0 THEN NULL ELSE array(event_type, ' x ', NULL) END").alias("texts"), F.expr("array(k, k + 1, NULL)").alias("numbers"))
    f = predicates.fields_of(own)
    tests = {
        "starts": predicates.alert_leaf(f["s"], "StartsWith", "CL"), "ends": predicates.alert_leaf(f["s"], "endswith", "ASE"), "starts_number": predicates.alert_leaf(f["s"], "startswith", 1), "starts_array": predicates.alert_leaf(f["texts"], "startswith", "v"),
        "holds": predicates.alert_leaf(f["texts"], "contains", "click"), "holds_trimmed": predicates.alert_leaf(f["texts"], "contains", "x"), "holds_case": predicates.alert_leaf(f["texts"], "contains", "CLICK"),
        "holds_number": predicates.alert_leaf(f["numbers"], "contains", 5), "holds_text_of_number": predicates.alert_leaf(f["numbers"], "contains", " 5 "), "array_equals": predicates.alert_leaf(f["texts"], "==", "click"), "array_not": predicates.alert_leaf(f["texts"], "!=", "click"),
    }
    return own.select("event_id", *(c.alias(k) for k, c in tests.items()))


def time_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    found = timegroups.anchored_groups(own.select(F.lit("all").alias("rule"), F.lit(HOUR * 1_000_000).cast("long").alias("w"), "t"))
    return own.join(found, "t").select("event_id", "time_group_id")


def correlation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    groups = timegroups.anchored_groups(own.select(F.lit("all").alias("rule"), F.lit(HOUR * 1_000_000).cast("long").alias("w"), "t")).drop("rule")
    rule = {"group_by": ["kind"], "aggregations": METRICS, "conditions": [{"metric": "n", "operator": ">", "value": 1}]}
    out = correlation.correlate(own.join(groups, "t"), rule, NAMES, ("time_group_id",))
    return out.select("time_group_id", "kind", *(F.round(k, 6).alias(k) for k in METRICS), "detected")


def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics by kind, merged from a state for each day and kind; distinct values and entropy as within their stated errors."""
    own = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400_000_000).cast("long"))
    states = sketches.summarised(own, ["kind"], METRICS, NAMES, ("day",))
    found = sketches.valued(sketches.merged(states, ["kind"], METRICS), ["kind"], METRICS)
    exact = correlation.correlate(own, {"group_by": ["kind"], "aggregations": METRICS, "conditions": []}, NAMES)
    both = found.alias("a").join(exact.select("kind", F.struct(*METRICS).alias("x")).alias("b"), F.col("a.kind").eqNullSafe(F.col("b.kind"))).drop(F.col("b.kind"))
    near = {k: F.abs(F.col(k) - F.col(f"x.{k}")) <= 0.03 * F.abs(F.col(f"x.{k}")) for k in ("users", "h", "density")}
    return both.select("kind", *(near[k].alias(k) if k in near else F.round(k, 4).alias(k) for k in METRICS))


def correlation_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.detect(events(spark, sf_dir), [SCAN_RULE, USER_RULE], NAMES, "t", "event_type")


def sliding_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("event_id", "t", "value")
    found = timegroups.band_aggregate(own, "t", 0, 600_000_000, {"n": ("count", None), "total": ("sum", "value")}, "event_id")
    return found.select("event_id", "n", F.round("total", 4).alias("total"))


def centered_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("event_id", "t")
    found = timegroups.band_aggregate(own, "t", 900_000_000, 900_000_000, {"n": ("count", None), "first": ("min", "event_id")})
    return found.select("event_id", "n", "first")


def burst_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that look forward over times of a minute's grain, with ties, extremes among them."""
    own = events(spark, sf_dir).select("event_id", F.floor(F.col("t") / 60_000_000).cast("long").alias("minute"), "value")
    found = timegroups.band_aggregate(own, "minute", 0, 240, {"n": ("count", None), "least": ("min", "value"), "most": ("max", "value"), "total": ("sum", "value")}, "event_id")
    return found.select("event_id", "n", "least", "most", F.round("total", 4).alias("total"))


def needed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchases and errors near each click, in the order of their times."""
    own = events(spark, sf_dir).select("event_id", "t", F.col("event_type").alias("log_type"))
    found = timegroups.needed_logs(own, "t", 120_000_000, "event_id", {"click": ["purchase", "error"]})
    return found.select("event_id", F.concat_ws(",", F.transform("needed", lambda x: x["event_id"].cast("string"))).alias("needed"))


def detection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of correlations."""
    return detection_report(correlation_detect(spark, sf_dir))


def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of pairs."""
    return pair_report(pairs.pair_correlation(events(spark, sf_dir), PAIR_RULE, NAMES, "event_id"))


def forward_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("event_id", "t", "user_id")
    found = timegroups.forward_window(own, "t", 60_000_000, "event_id", ["event_id", "t", "user_id"])
    return found.select("event_id", F.col("other_event_id").alias("later"), (F.col("other_user_id") == F.col("user_id")).alias("same_user"))


def centered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("event_id", "t")
    return timegroups.centered_band(own, "t", 60_000_000, ["event_id", "t"]).select("event_id", F.col("other_event_id").alias("near"))


def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.pair_correlation(events(spark, sf_dir), PAIR_RULE, NAMES, "event_id")
    return found.withColumn("evidence", F.array_join("evidence", "; "))


def pair_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs where the user is unknown for some events and the time for others."""
    own = events(spark, sf_dir).withColumn("user_id", F.expr("CASE WHEN k % 25 = 0 THEN NULL ELSE user_id END")).withColumn("t", F.expr("CASE WHEN k % 25 = 1 THEN NULL ELSE t END"))
    found = pairs.pair_correlation(own, PAIR_RULE | {"mapping_id": "P-2"}, NAMES, "event_id", counted=True)
    return found.select("mapping_id", "source_uid", "followup_uid", "n_evidence")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select(F.expr("CASE WHEN k < 3 THEN '' WHEN k < 5 THEN NULL ELSE concat(user_id, '-', k) END").alias("id"), "t", "event_id")
    return semantic.first_wins(own, "id", ["t", "event_id"])


def context_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    return own.select("event_id", "ip", context.Networks(ZONES).zone(F.col("ip")).alias("zone"), in_network(F.col("ip"), "10.3.0.0/17").alias("inside"))


def zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones from a table of networks, which nest and repeat: one for each customer and supplier, in both versions of addresses."""
    address = F.expr(
        """CASE coalesce(k, 4) % 5
        WHEN 2 THEN concat('2001:DB8::', lower(hex(user_id % 65536)), ':0:0:', hex(k)) WHEN 3 THEN '::ffff:' || ip
        WHEN 4 THEN CASE k % 3 WHEN 0 THEN '10.0.0.256' WHEN 1 THEN '1::2::' || k WHEN 2 THEN 'fe80::' || k || '%eth0' END ELSE ip END"""
    )
    named = lambda name, zone, place, network: table(spark, sf_dir, name).select(F.expr(zone).alias("zone"), F.expr(place).alias("place"), F.expr(network).alias("network"))
    networks = (
        named("customer", "c_mktsegment", "c_custkey", "concat('10.', c_custkey % 4, '.', c_custkey % 256, '.0/24')")
        .unionByName(named("supplier", "'nation ' || s_nationkey", "1000000000 + s_suppkey", "concat('10.', s_suppkey % 3, '.0.0/16')"))
        .unionByName(named("customer", "'v6 ' || c_mktsegment", "c_custkey", "concat('2001:db8:0:0:', hex(c_custkey % 65536), '::/80')"))
        .unionByName(named("region", "r_name", "r_regionkey", "'::ffff:0:0/96'"))
    )
    found = context.with_zones(events(spark, sf_dir).select("event_id", address.alias("address")), networks, "address")
    return found.withColumnRenamed("address.location", "zone")


def context_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("host"))
    assets = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ip"), F.col("c_mktsegment").alias("role"), F.col("c_nationkey").cast("string").alias("category"))
    return context.with_assets(own, assets, "host").withColumnsRenamed({"host.role": "role", "host.category": "category"})


def evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("technique_id"), F.col("p_type").alias("event_identity"))
    found = scoring.evidence_scores(rows)
    return found.select("p_partkey", "evidence_degree", "evidence_score", F.col("evidence_confidence_reason").alias("reason"))


def relationship_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("technique_id"), "p_type", F.expr("CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN p_name || ' = ' || p_type WHEN 3 THEN 'a = b' WHEN 4 THEN 'contains x' WHEN 5 THEN 'x | y' ELSE p_name END").alias("flt")
    )
    out = scoring.relationship_strength(rows, ["p_type", "flt"], "flt", {"p_type": 2.0, "flt": 1.0, "absent": 5.0})
    return out.select("p_partkey", F.round("telemetry_specificity", 6).alias("telemetry_specificity"), "filter_specificity", F.round("completeness", 6).alias("completeness"), F.round("relationship_strength", 3).alias("relationship_strength"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, lines["l_partkey"] == part["p_partkey"])
    return joined.select(F.col("o_custkey").alias("group_id"), F.col("p_brand").alias("technique_id")).distinct()


def technique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.technique_pairs(_edges(spark, sf_dir))


def related_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(graph.technique_pairs(_edges(spark, sf_dir)), 5, RELATED_SCORE).select("t1", "t2", "group_count", "relation_rank")


def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return graph.missing(customers, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return graph.supported_only(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), few, "c_nationkey").select("c_custkey", "c_nationkey")


def union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = alert_map(spark, sf_dir).select("event_id", "mapping_id", "score", F.lit("semantic").alias("result_kind"))
    two = pair_correlation(spark, sf_dir).select(F.col("source_uid").alias("event_id"), "mapping_id", "followup_uid", F.lit("correlation").alias("result_kind"))
    return semantic.union_results(one, two)


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.last_wins(events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def size_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.by_size(table(spark, sf_dir, "part"), "p_type", "p_brand").withColumn("place", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("place")).cast("long"))


def required_fields_by_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").select(F.array("p_brand").alias("log_type"), F.split("p_type", " ").alias("required_fields"))
    return semantic.required_fields(rules).withColumn("required_fields", F.array_join("required_fields", ","))


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.null_counts(events(spark, sf_dir).select(F.expr("nullif(k, 5)").alias("k"), F.expr("nullif(event_type, 'view')").alias("event_type"), "value"))


def ordered_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.sequences(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderdate", "o_orderkey"])
    return found.where(F.size("sequence") >= sequences.LEAST_LENGTH).withColumn("sequence", F.array_join("sequence", ","))


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types of a day, in order."""
    own = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400_000_000).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type")))
    return own.groupBy("user_id", "day").agg(F.transform(ordered, lambda x: x["event_type"]).alias("sequence"))


def prefix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.prefix_examples(_visits(spark, sf_dir)).select("user_id", "day", F.col("n").cast("long").alias("n"), "input_str", "target")


def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders in training, validation and test parts whose sizes in customers are exact."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sequences.exact_split(own, "o_custkey")


def markov_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.markov_counts(sequences.prefix_examples(_visits(spark, sf_dir)), 2)
    return found.withColumn("history", F.array_join("history", ","))


def _predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    examples = sequences.prefix_examples(_visits(spark, sf_dir)).withColumn("example_id", F.concat_ws("/", "user_id", "day", "n"))
    counts = sequences.markov_counts(examples.where("user_id % 10 < 7"), 2)
    items = sequences.vocabulary(_visits(spark, sf_dir)).select("item")
    tests = examples.where("user_id % 10 >= 7")
    return tests, sequences.markov_predict(counts, tests, items, 2, 3)


def markov_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir)[1].withColumn("probability", F.round("probability", 6))


def markov_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.evaluate(*_predicted(spark, sf_dir))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("top1", "top3", "top5", "mrr")))


def _rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    a = lines.groupBy(F.col("l_suppkey").alias("example_id"), F.col("l_linenumber").alias("item")).agg(F.count("*").cast("double").alias("score"))
    b = lines.where("l_linenumber > 2").groupBy(F.col("l_suppkey").alias("example_id"), (F.col("l_linenumber") + 1).alias("item")).agg(F.sum("l_quantity").alias("score"))
    return a, b


def fusion_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fuse(*_rankings(spark, sf_dir), "soft", 100).select("example_id", "item", F.round("score", 6).alias("score"), "rank")


def fusion_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fuse(*_rankings(spark, sf_dir), "hard_intersection", 3).select("example_id", "item", "score", "rank")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as JSON lines: nested ones, ones with fallbacks, broken ones, repeated keys and NaN, numbers as texts."""
    text = F.expr(
        """CASE k % 5 WHEN 0 THEN concat('{"id": "', event_id, '", "rule": {"id": "', k, '"}, "timestamp": ', t div 1000000, '}')
        WHEN 1 THEN concat('{"id": 0, "event_id": "e', event_id, '", "provider": "p", "timestamp": "2025-08-13T12:00:', lpad(k % 60, 2, '0'), 'Z"}')
        WHEN 2 THEN '{"id": broken' WHEN 3 THEN concat('{"id": "a", "id": "b', event_id, '", "x": NaN, "decoder": {"name": ""}}')
        ELSE '{"decoder": {"name": "d"}, "timestamp": "12345"}' END"""
    )
    return events(spark, sf_dir).select("event_id", text.alias("value")).withColumnRenamed("event_id", "line")


def decode_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decode_nested(_alerts(spark, sf_dir), "alerts.json")
    return made.select("line", "id", "event_id", "provider", F.unix_micros("event_time").alias("at"), nested_field("rule.id").alias("rule_id"), F.col(BAD).isNotNull().alias("bad"), "telemetry_source", "log_type")


def alert_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _alerts(spark, sf_dir)
    return counters(decode_nested(raw, "alerts.json"))


def condition_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, numbers in texts and fields that events don't have."""
    own = events(spark, sf_dir).select("event_id", F.expr("CASE k % 6 WHEN 0 THEN '1d' WHEN 1 THEN '2.5' WHEN 2 THEN 'NaN' WHEN 3 THEN ' 7 ' WHEN 4 THEN '1e3' ELSE 'x' END").alias("text"), F.expr("CASE WHEN k % 3 = 0 THEN double('NaN') WHEN k % 3 = 1 THEN k END").alias("number"))
    own = own.withColumn("inner", F.struct(F.struct(F.col("text")).alias("deep")))
    f = predicates.fields_of(own)
    leaf = lambda make, name, op, v: make(predicates.field_of(f, name), op, v)
    tests = {
        "text_gt": leaf(predicates.alert_leaf, "text", ">", 0), "text_le": leaf(predicates.alert_leaf, "text", "<=", "7"), "nan_gt": leaf(predicates.semantic_leaf, "number", ">", 1), "nan_lt": leaf(predicates.semantic_leaf, "number", "<", 1e9),
        "nan_eq": leaf(predicates.alert_leaf, "number", "==", float("nan")), "nan_ne": leaf(predicates.semantic_leaf, "number", "!=", 7), "metric_gt": leaf(predicates.metric_leaf, "number", ">", 1), "absent_null": leaf(predicates.semantic_leaf, "absent", "is_null", True),
        "absent_ne": leaf(predicates.semantic_leaf, "absent", "!=", 1), "deep": leaf(predicates.alert_leaf, "inner.deep.text", "==", "x"), "deeper": leaf(predicates.alert_leaf, "inner.deep.none", "is_null", None),
    }
    return own.select("event_id", *(c.alias(k) for k, c in tests.items()))


def correlation_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each condition's own outcome, with a metric and a grouping of fields that events don't have."""
    rule = {"group_by": ["kind", "absent"], "aggregations": {"n": {"function": "count"}, "mean": {"function": "mean", "field": "absent"}, "kinds": {"function": "nunique", "field": "absent"}},
            "conditions": [{"metric": "n", "operator": ">", "value": 2000}, {"metric": "mean", "operator": "is_null", "value": True}, {"metric": "kinds", "operator": ">=", "value": 0}]}
    out = correlation.correlate(events(spark, sf_dir), rule, NAMES).select("kind", "absent", "detected", F.explode("condition_results").alias("c"))
    return out.select("kind", "absent", "detected", "c.metric", "c.value", "c.holds")


def semantic_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.rejections(events(spark, sf_dir), SEMANTIC_RULES, NAMES, "event_type", ("event_id",))


#: Filter texts on both sides of each line of the rubric.
FILTERS = (
    "this is a long descriptive text about it", "match abc defghij klm", "start with this thing", "this matches", "foo equals bar baz qux quux", "a = b", "ActionType = CreateRemoteThread", "x == 1", "equals: value", 'Name is "calc.exe"',
    "name is calc", "contains x", "contain y z", "likely", "a like b", "regexes", "regex", "end  with z", "*.exe", "50%", "a and b", "a && b", "x|y", "band or", "one", "two words here", "four words are here now", "a!=b", " ", "=",
)


def filter_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.element_at(F.array(*map(F.lit, FILTERS)), (F.col("p_partkey") % len(FILTERS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", nth.alias("text"), scoring.filter_specificity(nth).alias("score"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A STIX bundle a nation: suppliers are groups, brands techniques, customers campaigns, order priorities their patterns."""
    refs = lambda source, i: F.array(F.struct(F.lit("other").alias("source_name"), F.lit("X1").alias("external_id")), F.struct(F.lit(source).alias("source_name"), i.alias("external_id")))
    none = F.lit(None)
    phases = F.lit(None).cast("array<struct<kill_chain_name: string, phase_name: string>>")

    def made(df, kind, i, name=none, rel=none, source=none, target=none, references=none, phase=phases, bundle=none, ordinal=none):
        return df.select(
            bundle.cast("string").alias("bundle_id"), ordinal.cast("long").alias("ordinal"), F.lit(kind).alias("type"), i.cast("string").alias("id"), name.cast("string").alias("name"), rel.cast("string").alias("relationship_type"),
            source.cast("string").alias("source_ref"), target.cast("string").alias("target_ref"), references.cast("array<struct<source_name: string, external_id: string>>").alias("external_references"), phase.alias("kill_chain_phases"),
        )

    key = lambda kind, c: F.concat(F.lit(f"{kind}--"), c)
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = part.select("p_brand").distinct()
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nations = orders.select("c_nationkey", "o_orderpriority").distinct()
    bundle = F.concat(F.lit("x/"), F.col("c_nationkey"), F.lit(".json"))
    tactic = F.expr("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Impact' WHEN '2' THEN 'initial access' WHEN '3' THEN 'execution' WHEN '4' THEN 'unheard' ELSE 'Discovery' END")
    phase = F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), tactic.alias("phase_name")))
    parts = [
        made(supplier, "intrusion-set", key("intrusion-set", F.col("s_suppkey")), F.col("s_name"), references=refs("mitre-attack", F.concat(F.lit("G"), F.col("s_suppkey")))),
        made(brands, "attack-pattern", key("attack-pattern", F.col("p_brand")), F.col("p_brand"), references=refs("mitre-attack", F.concat(F.lit("T"), F.col("p_brand")))),
        made(lines, "relationship", key("relationship", F.concat("l_suppkey", "p_brand")), rel=F.lit("uses"), source=key("intrusion-set", F.col("l_suppkey")), target=key("attack-pattern", F.col("p_brand"))),
        made(nations, "attack-pattern", key("attack-pattern", F.col("o_orderpriority")), references=refs("mitre-attack", F.concat(F.lit("T"), F.col("o_orderpriority"))), phase=phase, bundle=bundle),
        made(orders.select("c_custkey", "c_name", "c_nationkey").distinct(), "campaign", key("campaign", F.col("c_custkey")), F.col("c_name"), bundle=bundle),
        made(orders, "relationship", key("relationship", F.col("o_orderkey")), rel=F.lit("related"), source=F.when(F.col("o_orderkey") % 2 == 0, key("campaign", F.col("c_custkey"))).otherwise(key("attack-pattern", F.col("o_orderpriority"))), target=F.when(F.col("o_orderkey") % 2 == 0, key("attack-pattern", F.col("o_orderpriority"))).otherwise(key("campaign", F.col("c_custkey"))), bundle=bundle, ordinal=F.col("o_orderkey")),
    ]
    return reduce(DataFrame.unionByName, parts)


def group_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.uses(_objects(spark, sf_dir))


def campaign_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.campaign_sequences(_objects(spark, sf_dir))
    return found.select("campaign", "source_file", F.array_join("sequence", ",").alias("sequence"), F.col("length").cast("long").alias("length"))


def technique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.techniques(_objects(spark, sf_dir)).where("name IS NOT NULL").select("technique_id", "name", F.lit("technique").alias("kind"))
    return found.union(graph.groups(_objects(spark, sf_dir)).select("group_id", "name", F.lit("group")))


def knowledge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = graph.knowledge(graph.technique_pairs(_edges(spark, sf_dir)))
    documents = made.select(F.create_map("technique_id", F.struct("related_techniques")).alias("technique_relations"))
    return graph.candidates(documents)


def related_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(graph.technique_pairs(_edges(spark, sf_dir)), 20, 0.0).select("t1", "t2", "relation_rank")


def lookup_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return graph.enriched(customers, orders, "c_custkey", "o_orderpriority", "priorities").withColumn("priorities", F.array_join("priorities", ","))


def zero_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counted(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def full_row_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_orderkey")
    return semantic.distinct_rows(rows, "l_orderkey")


def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("event_id", F.array("event_type", F.col("k_text")).alias("a"), F.create_map(F.lit("k"), F.col("k")).alias("o"), F.concat(F.lit("\t "), F.col("event_type"), F.lit(" \n")).alias("s"), (F.col("k") % 2 == 0).alias("b"))
    kinds = dict(own.dtypes)
    return own.select("event_id", *(text.cell(F.col(c), kinds[c]).alias(c) for c in ("a", "o", "s", "b")))


def flat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("event_id", F.struct(F.col("event_type").alias("name"), F.struct(F.col("k").alias("k"), F.col("ip").alias("ip")).alias("at")).alias("event"))
    return flatten(own, "_")


def event_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", text.identity(F.col("event_type"), F.expr("nullif(k, 5)"), F.col("user_id")).alias("identity"))


def chained_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose time stands in one of several fields, as a number, a numeric text or an ISO text."""
    own = events(spark, sf_dir)
    chain = [F.expr("CASE WHEN k % 4 = 0 THEN 'no time' END"), F.expr("CASE WHEN k % 4 = 1 THEN cast(t div 1000000 AS string) END"), F.expr("CASE WHEN k % 4 = 2 THEN '2025-08-13T12:00:00Z' END"), F.expr("CASE WHEN k % 4 <> 3 THEN t div 1000000 END")]
    return own.select("event_id", F.unix_micros(times.first_time(*chain)).alias("at"))


def supported_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.supported_sequences(_visits(spark, sf_dir), ["view", "click", "purchase"])
    return found.select("user_id", "day", F.array_join("sequence", ",").alias("sequence"))


def encoded_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = _visits(spark, sf_dir)
    known = sequences.vocabulary(visits).where("item <> 'error'")
    found = sequences.encoded(sequences.prefix_examples(visits), known, "input", 4)
    return found.select("user_id", "day", F.col("n").cast("long").alias("n"), F.array_join("input", ",").alias("input"))


def fusion_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fuse(*_rankings(spark, sf_dir), "sequence_only", 3).select("example_id", "item", "score", "rank")


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a stream of events, batch by batch."""
    own = events(spark, sf_dir)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    work = lambda batch: correlation.detect(prepared(batch), [USER_RULE], NAMES, "t", "event_type")
    at = replay.workspace(spark)
    replay.each_batch(stream, work, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    schema = correlation.detect(own.limit(0), [USER_RULE], NAMES, "t", "event_type").schema
    return spark.read.schema(schema).parquet(f"{at}/out").select("mapping_id", "time_group_id", "group_key", "n_events")


def _in_slices(spark: SparkSession, sf_dir: str, at: str, run) -> None:
    """The events in four slices of time; run(stream) after each, so that every slice is a micro-batch."""
    own = table(spark, sf_dir, "events")
    cuts = own.agg(F.percentile_approx(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"), F.array(*map(F.lit, (0.25, 0.5, 0.75))))).first()[0]
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    edges = [None, *(cuts or []), None]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = own if low is None and high is None else own.where(F.lit(True) if high is None else micros < high).where(F.lit(True) if low is None else micros >= low)
        part.write.mode("overwrite").parquet(f"{at}/in/slice={i}")
        run(spark.readStream.schema(own.schema).parquet(f"{at}/in/slice=*")).awaitTermination()


def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a stream whose micro-batches cut time groups: the same as over the whole table."""
    at = replay.workspace(spark)
    watch = detections.Watch([SCAN_RULE, USER_RULE], at, NAMES, "t", "event_type")
    _in_slices(spark, sf_dir, at, lambda stream: watch.start(prepared(stream)))
    return watch.close(spark)


def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a stream of events, batch by batch."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = replay.workspace(spark)
    work = lambda batch: pairs.pair_correlation(prepared(batch), PAIR_RULE, NAMES, "event_id")
    replay.each_batch(stream, work, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    schema = pairs.pair_correlation(events(spark, sf_dir), PAIR_RULE, NAMES, "event_id").schema
    return spark.read.schema(schema).parquet(f"{at}/out").drop("batch").withColumn("evidence", F.array_join("evidence", "; "))


def stream_pairs_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a stream, whose rows may come in different micro-batches."""
    at = replay.workspace(spark)

    def run(stream: DataFrame):
        found = pairing.stream_pairs(prepared(stream), PAIR_RULE, NAMES, "event_id")
        return pairing.started(spark, found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True))

    _in_slices(spark, sf_dir, at, run)
    schema = pairs.pair_correlation(events(spark, sf_dir), PAIR_RULE, NAMES, "event_id").schema
    return spark.read.schema(schema).parquet(f"{at}/out").withColumn("evidence", F.array_join("evidence", "; "))


def campaign_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences in the order of their campaigns' names, numbered by where they stand."""
    found = sequences.by_campaign(sequences.campaign_sequences(_objects(spark, sf_dir)))
    return found.select("campaign", F.monotonically_increasing_id().alias("_at")).select("campaign", F.row_number().over(Window.orderBy("_at")).cast("long").alias("place"))


def context_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets joined to events answer before zones; unknown hosts have no role."""
    own = events(spark, sf_dir).withColumn("host", F.col("user_id").cast("string"))
    assets = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("ip"), F.col("c_mktsegment").alias("role"), F.col("c_nationkey").cast("string").alias("category"))
    joined = context.with_assets(own, assets, "host")
    rule = {"mapping_id": "B-1", "log_type": "click", "confidence_score": 0.9, "semantic_conditions": {"field": "kind", "value": "click"},
            "external_context": {"conditions": [{"context": "host.role", "operator": "==", "value": "BUILDING", "confidence_boost": 0.3}, {"context": "ip.location", "operator": "in", "value": ["dmz", "vpn_zone"], "confidence_boost": 0.05}]}}
    names = NAMES | {"host": "host", "host.role": "host.role", "host.category": "host.category"}
    found = semantic.semantic_matches(joined, [rule], names, context.Composite(context.Assets(), context.Networks(ZONES)), "event_type", ("event_id",))
    return found.select("event_id", "score", "context_boost", F.array_join("context_conditions", "; ").alias("said"))


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.semantic_matches(events(spark, sf_dir), SEMANTIC_RULES, NAMES, context.Networks(ZONES), "event_type", ("event_id",))
    return report(found).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(semantic.semantic_matches(events(spark, sf_dir), SEMANTIC_RULES, NAMES, context.Networks(ZONES), "event_type", ("event_id",)))


_QUERIES = (
    forward_pairs, centered_pairs, pair_nulls, decode_alerts, alert_counters, condition_traps, correlation_conditions, semantic_reasons, filter_rubric, group_uses, campaign_sequences, technique_lookup, knowledge_candidates, related_twenty,
    lookup_enriched, zero_counts, full_row_dedup, clean_cells, flat_columns, event_identity, chained_times, supported_sequences, encoded_prefixes, fusion_sequence, stream_replay, stream_detect, stream_pairs, stream_pairs_across, semantic_index, burst_frames, exact_split, alert_dialect, campaign_order, context_boosts, match_report, result_summary,
    decode_envelope, semantic_map, alert_map, condition_matrix, time_groups, correlation_metrics, merged_metrics, correlation_detect, sliding_forward, centered_band, pair_correlation, dedup_first,
    needed_logs, detection_lines, pair_lines, context_zone, zone_table, context_asset, evidence_score, relationship_strength, technique_pairs, related_topk, anti_missing, semi_filter, union_results, last_wins, size_sorted,
    required_fields_by_log, null_counts, ordered_sequences, prefix_examples, markov_counts, markov_predict, markov_eval, fusion_soft, fusion_hard,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
