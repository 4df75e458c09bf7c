"""Rules by the index against the same rules by expressions, and plans that don't grow with the rules."""

import random
import re

from pyspark.sql import functions as F

from watchtide.operators import context, rule_index, semantic


def random_tree(pick, depth=0):
    if depth < 3 and pick.random() < 0.5:
        return {"logic": pick.choice(["AND", "or", "OR"]), "conditions": [random_tree(pick, depth + 1) for _ in range(pick.randrange(0, 4))]}
    field = pick.choice(["n", "x", "s", "b", "none", "s.t"])
    op = pick.choice(["==", "!=", ">", ">=", "<", "<=", "in", "not_in", "contains", "startswith", "endswith", "is_null"])
    value = pick.choice([3, 3.0, -0.0, True, "3", "ab", "b", 7.5, None, float("nan"), 10**9])
    if op in ("in", "not_in"):
        value = [pick.choice([1, 2, 3, "ab", "b", None, False, 0]) for _ in range(pick.randrange(0, 4))]
    leaf = {"field": field, "operator": op, "value": value}
    if op == "is_null" and pick.random() < 0.5:
        del leaf["value"]
    return leaf


def test_index_equals_expressions(spark, monkeypatch):
    pick = random.Random(21)
    rows = [(i, pick.choice("xyz"), pick.choice([None, -1, 0, 1, 2, 3, 4, 7]), pick.choice([None, float("nan"), -0.0, 0.0, 3.0, 7.5, 8.25, float("inf")]), pick.choice([None, "", "3", "ab", "b", "abc"]), pick.choice([None, True, False]), pick.choice(["10.1.0.4", None, "9.9.9.9"])) for i in range(150)]
    events = spark.createDataFrame(rows, "event_uid long, log_type string, n int, x double, s string, b boolean, ip string").withColumn("keys", F.lit(1))
    rules = []
    for i in range(150):
        rule = {"mapping_id": f"m{i}", "log_type": pick.choice(["x", ["x", "y"], "w", []]), "confidence_score": pick.choice([0.5, 0.7, 1.4]), "semantic_conditions": random_tree(pick), "required_fields": pick.choice([[], ["n"], ["s", "n"], ["absent"]]), "attack_technique": {"technique_id": f"T{i}", "tactic": "t"}}
        if pick.random() < 0.4:
            rule["external_context"] = {"conditions": [{"context": pick.choice(["ip.location", "n.location", "ip.owner"]), "operator": pick.choice(["==", "!=", "in"]), "value": "dmz", "confidence_boost": 0.2}]}
            if rule["external_context"]["conditions"][0]["operator"] == "in":
                rule["external_context"]["conditions"][0]["value"] = ["dmz", "external"]
        rules.append(rule)
    rules.append({"mapping_id": "later", "log_type": "x", "correlation_required": True, "semantic_conditions": {"field": "n", "value": 3}})
    provider = context.Networks({"dmz": ["10.1.0.0/16"]})
    want = sorted(map(repr, semantic.semantic_matches(events, rules, None, provider).collect()))
    assert len(want) > 500
    for most in (64, 2):  # with 2, most rules are checked by expressions of their own
        monkeypatch.setattr(rule_index, "CLAUSES", most)
        assert sorted(map(repr, rule_index.indexed_matches(events, rules, None, provider).collect())) == want
    assert sorted(map(repr, rule_index.indexed_matches(events, rules).collect())) == sorted(map(repr, semantic.semantic_matches(events, rules).collect()))
    assert rule_index.indexed_matches(events, []).count() == 0 and rule_index.indexed_matches(events.limit(0), rules).count() == 0


def test_ten_thousand_rules_are_one_plan(spark):
    pick = random.Random(3)
    rules = []
    for i in range(10_000):
        first = {"field": "n", "operator": "==", "value": pick.randrange(10**6)} if i % 2 else {"field": "x", "operator": pick.choice([">", "<="]), "value": pick.choice([-1, 1]) * (900 + pick.random() * 99)}
        if first["operator"] in (">", "<="):
            first["value"] = abs(first["value"]) * (1 if first["operator"] == ">" else -1)
        rules.append({"mapping_id": f"m{i}", "log_type": "x", "semantic_conditions": {"conditions": [first, {"field": "s", "operator": "startswith", "value": "a"}]}})
    rows = [(i, "x", pick.randrange(10**6), pick.uniform(-1000, 1000), pick.choice(["ab", "b"])) for i in range(2000)] + [(9999, "x", rules[1]["semantic_conditions"]["conditions"][0]["value"], 0.0, "a")]
    events = spark.createDataFrame(rows, "event_uid long, log_type string, n long, x double, s string")
    # the bounds of numbers are one literal; all else is alike
    plan = lambda n: len(re.sub(r"\[[-\d., eE]*\]", "[]", rule_index.indexed_matches(events, rules[:n])._jdf.queryExecution().analyzed().toString()))
    assert plan(10_000) < 1.2 * plan(100)
    got = {(r.event_uid, r.mapping_id) for r in rule_index.indexed_matches(events, rules).collect()}
    by_n, ranges = {}, []
    for r in rules:
        c = r["semantic_conditions"]["conditions"][0]
        if c["operator"] == "==":
            by_n.setdefault(c["value"], []).append(r["mapping_id"])
        else:
            ranges.append((c["operator"], c["value"], r["mapping_id"]))
    want = {(u, m) for u, _, n, x, s in rows if s.startswith("a") for m in [*by_n.get(n, []), *(m for op, v, m in ranges if (x > v if op == ">" else x <= v))]}
    assert got == want and (9999, "m1") in got and len(got) > 1000


def test_rules_are_sent_and_not_the_events(spark, tmp_path, monkeypatch):
    """A file of events is small beside the keys that they look up: what Spark takes for small must not be collected."""
    made = spark.range(3000).select(F.col("id").alias("event_uid"), F.lit("x").alias("log_type"), (F.col("id") % 50).alias("n"), F.lit("ab").alias("s"))
    made.write.parquet(f"{tmp_path}/events")
    events = spark.read.parquet(f"{tmp_path}/events")
    rules = [{"mapping_id": f"m{i}", "log_type": "x", "semantic_conditions": {"conditions": [{"field": "n", "operator": ">", "value": i}, {"field": "n", "operator": "<=", "value": i + 1}]}} for i in range(40)]
    for sent in (100_000, 0):
        monkeypatch.setattr(rule_index, "SENT", sent, raising=False)
        found = rule_index.indexed_matches(events, rules)
        assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 40 * 60
    # intervals of one number between neighbouring bounds: nodes of the lowest levels alone are looked up
    assert rule_index.Index(rules, rule_index.fields_of(events)).levels["n"] <= {0, 1}
