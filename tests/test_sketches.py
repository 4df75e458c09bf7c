"""Metrics from merged states, against those of all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators import correlation, sketches

SPECS = {
    "n": {"function": "count"}, "users": {"function": "nunique", "field": "u"}, "avg": {"function": "mean", "field": "x"}, "total": {"function": "sum", "field": "x"},
    "least": {"function": "min", "field": "x"}, "most": {"function": "max", "field": "x"}, "share": {"function": "ratio", "field": "u", "values": [1, 2, 3]},
    "sd": {"function": "standard_deviation", "field": "x"}, "cv": {"function": "coefficient_of_variation", "field": "x"}, "h": {"function": "entropy", "field": "u"},
    "per": {"function": "rate", "window_seconds": 60}, "density": {"function": "subnet_density", "field": "ip", "subnet": "10.0.0.0/24"},
}


def test_merged_states_equal_one_pass(spark, tmp_path):
    """States stored batch by batch; groups of nulls and of one row; a null key."""
    rng = random.Random(1)
    rows = [(i % 3, rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, 1e6 + rng.random(), 1e6]), f"10.0.{rng.randrange(2)}.{rng.randrange(90)}") for i in range(600)]
    rows += [(0, "one", 1, 5.0, None), (1, "none", None, None, None), (2, "none", None, None, "x")]
    events = spark.createDataFrame(rows, "batch int, kind string, u int, x double, ip string")
    for b in range(3):
        sketches.summarised(events.where(F.col("batch") == b), ["kind"], SPECS).write.parquet(f"{tmp_path}/batch={b}")
    states = spark.read.parquet(str(tmp_path))
    got = sketches.valued(sketches.merged(states, ["kind"], SPECS), ["kind"], SPECS).collect()
    rule = {"group_by": ["kind"], "aggregations": SPECS, "conditions": []}
    want = {r["kind"]: r for r in correlation.correlate(events, rule).collect()}
    assert len(got) == len(want) == 5
    for r in got:
        for k in SPECS:
            x = want[r["kind"]][k]
            assert r[k] is None if x is None else r[k] == pytest.approx(x, rel=1e-6, abs=2e-6), (r["kind"], k)
    assert sketches.merged(states.limit(0), ["kind"], SPECS).count() == 0
    with pytest.raises(ValueError):
        sketches.summarised(events, [], {"m": {"function": "median"}})


def test_many_values_within_the_stated_error(spark):
    """50,000 values, a few of them frequent: two states' union is as near as one pass; merging is associative."""
    events = spark.range(200_000).select((F.col("id") % 2).alias("batch"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.col("id") % 50_000).alias("u"))
    specs = {"users": SPECS["users"], "h": SPECS["h"]}
    states = sketches.summarised(events, [], specs, keys=("batch",))
    r = sketches.valued(sketches.merged(states, [], specs), [], specs).first()
    want = correlation.correlate(events, {"group_by": [], "aggregations": specs, "conditions": []}).first()
    assert r["n_events"] == 200_000
    assert abs(r["users"] / want["users"] - 1) < 3 * 1.04 / 2 ** (sketches.LOG_HLL / 2)
    assert abs(r["h"] - want["h"]) < 0.1
