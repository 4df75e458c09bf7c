"""Operators on small fixtures: boundaries, nulls, ties, streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from watchtide.functions.addresses import in_network
from watchtide.functions.text import hundredths
from watchtide.functions.times import event_time, iso_time
from watchtide.operators import correlation, graph, pairs, predicates, semantic, sequences, timegroups
from watchtide.sources import logs
from watchtide.sources.tail import Files, TailReader, tail
from watchtide.streaming import replay


def greedy(times, w):
    out, anchor, gid = {}, None, -1
    for t in sorted(set(times)):
        if anchor is None or t > anchor + w:
            anchor, gid = t, gid + 1
        out[t] = gid
    return out


@pytest.mark.parametrize("bucket", [1, 7, 100_000])
def test_anchored_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(timegroups, "TIMES", bucket)
    rng = random.Random(4)
    sets = {"doc": (60, [0, 10, 55, 61, 62, 130]), "edge": (60, [0, 60, 121]), "same": (60, [5, 5, 5]), "dense": (50, list(range(0, 900, 3))), "random": (40, [rng.randrange(3000) for _ in range(300)])}
    rows = [(k, w, t) for k, (w, ts) in sets.items() for t in [*ts, None]]
    got = timegroups.anchored_groups(spark.createDataFrame(rows, "rule string, w long, t long")).collect()
    for k, (w, ts) in sets.items():
        assert {r["t"]: r["time_group_id"] for r in got if r["rule"] == k} == greedy(ts, w)


@pytest.mark.parametrize("bucket,laps", [(15, 4), (40, 2), (25, 256)])
def test_anchored_groups_of_sliced_laps(spark, monkeypatch, bucket, laps):
    """Laps with more times than a bucket takes, beside sparse ones, negative times and gaps."""
    monkeypatch.setattr(timegroups, "TIMES", bucket)
    monkeypatch.setattr(timegroups, "LAPS", laps)
    rng = random.Random(bucket)
    burst = lambda low, high, n: [rng.randrange(low, high) for _ in range(n)]
    sets = {"dense": (50, list(range(-400, 500))), "even": (30, list(range(0, 600, 2))), "zero": (0, burst(-50, 50, 90)), "early": (500, [*burst(0, 40, 40), *burst(520, 560, 40), *burst(5000, 5600, 200)])}
    sets |= {f"mixed{i}": (w, [*burst(-3000, 9000, 60), *burst(100, 100 + 6 * w, 250), *burst(4000, 4000 + w, w)]) for i, w in enumerate((20, 77, 160))}
    rows = [(k, w, t) for k, (w, ts) in sets.items() for t in ts]
    rng.shuffle(rows)
    got = timegroups.anchored_groups(spark.createDataFrame(rows, "rule string, w long, t long")).collect()
    assert len(got) == sum(len(set(ts)) for _, ts in sets.values())
    for k, (w, ts) in sets.items():
        assert {r["t"]: r["time_group_id"] for r in got if r["rule"] == k} == greedy(ts, w)


def test_a_burst_within_one_window_is_dealt_over_buckets(spark):
    """A million distinct times within one window, and windows as dense after it."""
    frame = spark.range(1_000_000).select(F.lit("r").alias("rule"), F.lit(700_000).cast("long").alias("w"), (F.col("id") + F.when(F.col("id") % 3 == 0, 0).otherwise(5_000_000)).alias("t"))
    assert timegroups._buckets(frame).groupBy("bucket").count().agg(F.max("count")).first()[0] < 3 * timegroups.TIMES
    got = timegroups.anchored_groups(frame).toPandas().sort_values("t")
    want = greedy(got["t"].tolist(), 700_000)
    assert len(got) == 1_000_000 and got["time_group_id"].tolist() == [want[t] for t in got["t"].tolist()]


@pytest.mark.parametrize("before,after,order", [(0, 10, "o"), (0, 0, "o"), (3, 0, None), (4, 7, None), (0, 0, None), (1000, 1000, None)])
def test_band_aggregates_equal_brute_force(spark, before, after, order):
    """Ties, negative times, nulls, rows alike; extremes as well as sums."""
    rng = random.Random(before + after)
    rows = [(rng.randrange(-40, 40) if rng.random() < 0.95 else None, rng.randrange(5) if rng.random() < 0.9 else None, rng.choice([None, 1.5, -2.0, 7.0, 3.25]), "x") for _ in range(200)]
    spec = {"n": ("count", None), "known": ("count", "v"), "total": ("sum", "v"), "least": ("min", "v"), "most": ("max", "v")}
    got = timegroups.band_aggregate(spark.createDataFrame(rows, "t int, o int, v double, mark string"), "t", before, after, spec, order).collect()
    place = lambda o: float("-inf") if o is None else o
    want = []
    for t, o, v, x in rows:
        if t is None:
            continue
        near = [r for r in rows if r[0] is not None and t - before <= r[0] <= t + after and (order is None or r[0] != t or place(r[1]) >= place(o))]
        known = [r[2] for r in near if r[2] is not None]
        want.append((t, o, v, x, len(near), len(known), sum(known) if known else None, min(known, default=None), max(known, default=None)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_band_aggregate_of_a_burst_is_linear(spark):
    frame = spark.range(40_000).select(F.col("id"), (F.col("id") % 1000).alias("t"), F.col("id").cast("double").alias("v"))
    began = time.time()
    found = timegroups.band_aggregate(frame, "t", 0, 5000, {"n": ("count", None), "least": ("min", "v")}, "id").agg(F.sum("n"), F.sum("least")).first()
    assert found[0] == 40_000 * 40_001 // 2 and time.time() - began < 30
    with pytest.raises(ValueError):
        timegroups.band_aggregate(frame, "t", 0, 1, {"m": ("avg", "v")})
    with pytest.raises(ValueError):
        timegroups.band_aggregate(frame, "t", 1, 1, {"n": ("count", None)}, "id")


@pytest.mark.parametrize("w", [0, 1, 7, 5000])
def test_band_pairs_equal_brute_force(spark, w):
    draw = random.Random(w)
    rows = [(i, draw.choice([None, draw.randrange(-60, 60), draw.randrange(-9000, 9000)]), draw.choice([None, "a", "b"]), [i]) for i in range(300)] + [(7, 5, "a", [7]), (7, 5, None, None)]
    events = spark.createDataFrame(rows, "id int, t long, mark string, more array<int>")
    got = timegroups.centered_band(events, "t", w, ["mark", "t", "id"])
    assert got.columns == ["id", "t", "mark", "more", "other_mark", "other_t", "other_id"]
    timed = [r for r in rows if r[1] is not None]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*a, b[2], b[1], b[0])) for a in timed for b in timed if abs(b[1] - a[1]) <= w)
    got = timegroups.forward_window(events, "t", w, "id", ["t", "id"]).select("id", "mark", "other_t", "other_id")
    wanted = [(a[0], a[2], b[1], b[0]) for a in timed for b in timed if 0 <= b[1] - a[1] <= w and (b[1] > a[1] or b[0] >= a[0])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))
    assert timegroups.centered_band(events.limit(0), "t", w, ["t"]).count() == 0


def test_band_pairs_of_a_burst_are_dealt_over_many_tasks(spark):
    events = spark.range(0, 9000, 1, 1).select("id", (F.col("id") % 50).alias("t"))
    for found, n in ((timegroups.centered_band(events, "t", 60, ["id", "t"]), 9000**2), (timegroups.forward_window(events, "t", 60, "id", ["id", "t"]), 9000 * 9001 // 2)):
        made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(made) == n and max(made) < n / 4


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 20, 147])
def test_exact_split(spark, n):
    frame = spark.createDataFrame([(None if i == 0 else f"c{i}", j) for i in range(n) for j in range(1 + i % 3)], "campaign string, step int")
    parts = {}
    for r in sequences.exact_split(frame).collect():
        parts.setdefault(r["part"], set()).add(r["campaign"])
    train, both_ = n * 70 // 100, n * 85 // 100
    assert [len(parts.get(p, ())) for p in ("train", "validation", "test")] == [train, both_ - train, n - both_]
    assert sum(map(len, parts.values())) == n
    if n == 147:
        other = {r["campaign"] for r in sequences.exact_split(frame, seed="7").where("part = 'test'").collect()}
        assert other != parts["test"]


def test_pairs_tolerate_nulls(spark):
    rows = [(1, "s", "a", 0), (2, "f", "a", 60_000_000), (3, "f", None, 10), (4, "f", "b", 5), (5, "f", "a", -1), (6, "f", "a", None), (7, "s", None, 0), (8, "f", "a", 60_000_001)]
    rule = {"mapping_id": "p", "semantic_correlation": {"source_event": {"conditions": {"field": "kind", "value": "s"}}, "followup_event": {"conditions": {"field": "kind", "value": "f"}}, "context_fields": ["c"], "time_window_seconds": 60}}
    found = pairs.pair_correlation(spark.createDataFrame(rows, "event_uid long, kind string, c string, t long"), rule)
    assert {(r["source_uid"], r["followup_uid"]) for r in found.collect()} == {(1, 2), (1, 3), (1, 6), (7, 2), (7, 3), (7, 4), (7, 6)}


def test_pairs_that_share_nothing_are_dealt_over_many_tasks(spark):
    """Every mask meets every other, once; the number of texts is told without making them."""
    rng = random.Random(2)
    rows = [(i, "sf"[i % 2], rng.choice([None, "a", "b"]), rng.choice([None, 0, 30_000_000, 90_000_000])) for i in range(240)]
    rule = {"mapping_id": "p", "semantic_correlation": {"source_event": {"conditions": {"field": "kind", "value": "s"}}, "followup_event": {"conditions": {"field": "kind", "value": "f"}}, "context_fields": ["c"], "time_window_seconds": 60, "relationship": "r"}}
    frame = spark.createDataFrame(rows, "event_uid long, kind string, c string, t long")
    may = lambda a, b: (a[2] is None or b[2] is None or a[2] == b[2]) and (a[3] is None or b[3] is None or 0 <= b[3] - a[3] <= 60_000_000)
    want = sorted((a[0], b[0], 1 + (a[2] is not None and a[2] == b[2]) + (a[3] is not None and b[3] is not None)) for a in rows[::2] for b in rows[1::2] if may(a, b))
    found = pairs.pair_correlation(frame, rule).select("source_uid", "followup_uid", F.size("evidence").cast("long").alias("n"))
    assert sorted(map(tuple, found.collect())) == want
    told = pairs.pair_correlation(frame, rule, counted=True).select("source_uid", "followup_uid", "n_evidence", F.spark_partition_id().alias("task")).collect()
    assert sorted(tuple(r)[:3] for r in told) == want
    assert len({r["task"] for r in told if r["n_evidence"] == 1}) > 32
    alone = {"mapping_id": "p", "semantic_correlation": {k: v for k, v in rule["semantic_correlation"].items() if k.endswith("_event")}}
    found = pairs.pair_correlation(frame, alone)
    assert {(r["source_uid"], r["followup_uid"]) for r in found.collect()} == {(a[0], b[0]) for a in rows[::2] for b in rows[1::2]}


def test_pairs_that_share_nothing_stay_small_when_written(spark, tmp_path):
    """Twelve million pairs of rows without a time and rows without a user: less than three quarters of a byte each in Parquet, and a task holds a small part of either side."""
    made = spark.range(20_600).selectExpr("id AS event_uid", "if(id < 20000, 's', 'f') AS kind", "if(id < 20000, NULL, 'a') AS c", "if(id < 20000, id, NULL) AS t")
    rule = {"mapping_id": "p", "semantic_correlation": {"source_event": {"conditions": {"field": "kind", "value": "s"}}, "followup_event": {"conditions": {"field": "kind", "value": "f"}}, "context_fields": ["c"], "time_window_seconds": 60}}
    found = pairs.pair_correlation(made, rule, counted=True).select("source_uid", "followup_uid", F.spark_partition_id().alias("task"))
    found.write.parquet(str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 12_000_000 == found.select(F.xxhash64("source_uid", "followup_uid")).distinct().count()
    assert found.agg(F.min("source_uid"), F.max("source_uid"), F.min("followup_uid"), F.max("followup_uid")).first()[:] == (0, 19_999, 20_000, 20_599)
    assert found.groupBy("task").agg(F.countDistinct("source_uid").alias("n")).agg(F.max("n")).first()[0] < 10_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.75 * 12_000_000


def test_null_means_three_things(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "i int, v int")
    f = predicates.fields_of(df)["v"]
    row = df.select(
        "i", predicates.semantic_leaf(f, "is_null", False).alias("z"), predicates.alert_leaf(f, "is_null", False).alias("w"), predicates.metric_leaf(f, "is_null", given=False).alias("c")
    ).orderBy("i").collect()
    assert [tuple(r)[1:] for r in row] == [(False, True, False), (True, False, True)]
    with pytest.raises(ValueError):
        predicates.semantic_leaf(f, "near", 1)


def test_matches_keep_order_and_failed_branches(spark):
    df = spark.createDataFrame([(1, "x", 5)], "event_uid long, log_type string, v int")
    tree = {"logic": "OR", "conditions": [{"logic": "AND", "conditions": [{"field": "v", "operator": "==", "value": 5}, {"field": "v", "operator": "==", "value": 6}]}, {"field": "v", "operator": ">", "value": 1}]}
    rules = [{"mapping_id": m, "log_type": "x", "confidence_score": c, "semantic_conditions": tree} for m, c in (("a", 0.5), ("b", 0.7), ("c", 0.5))]
    got = semantic.semantic_matches(df, rules).orderBy("match_rank").collect()
    assert [r["mapping_id"] for r in got] == ["b", "a", "c"]
    assert got[0]["matched_conditions"] == ["v == 5", "v > 1"]


def test_aggregates_of_odd_groups(spark):
    df = spark.createDataFrame([("a", None, "10.0.0.1"), ("b", 2.0, "10.0.0.9"), ("b", 2.0, "x")], "g string, v double, ip string")
    rule = {
        "group_by": ["g"],
        "aggregations": {"s": {"function": "sum", "field": "v"}, "m": {"function": "mean", "field": "v"}, "sd": {"function": "standard_deviation", "field": "v"}, "h": {"function": "entropy", "field": "v"}, "d": {"function": "subnet_density", "field": "ip", "subnet": "10.0.0.3/30"}},
        "conditions": [],
    }
    got = {r["g"]: r for r in correlation.correlate(df, rule).collect()}
    assert (got["a"]["s"], got["a"]["m"], got["a"]["sd"], got["a"]["h"], got["a"]["d"]) == (0.0, None, 0.0, 0.0, 0.25)
    assert (got["b"]["sd"], got["b"]["h"], got["b"]["d"], got["b"]["detected"]) == (0.0, 0.0, 0.0, True)
    with pytest.raises(ValueError):
        correlation.validate({**rule, "aggregations": {"x": {"function": "median", "field": "v"}}})


def test_times_and_addresses(spark):
    df = spark.createDataFrame([("2026",), ("2025-08-13T12:00:00Z",), ("no",), (None,)], "s string")
    assert [r[0] for r in df.select(F.unix_micros(event_time(F.col("s")))).collect()] == [2026_000_000, 1755086400_000_000, None, None]
    assert spark.range(1).select(iso_time(F.lit(1755086400.0019))).first()[0] == "2025-08-13T12:00:00.001+00:00"
    ips = spark.createDataFrame([("10.0.0.5",), ("::1",), ("fe80::1",), ("10.0.0.256",), (None,)], "ip string")
    assert [r[0] for r in ips.select(in_network(F.col("ip"), "10.0.0.0/29")).collect()] == [True, False, False, None, None]
    assert [r[0] for r in ips.select(in_network(F.col("ip"), "fe80::/10")).collect()] == [False, False, True, None, None]


def test_decode_quarantines_bad_lines(spark):
    event = {"ts": 1755086400.0, "id.orig_h": "192.168.1.50", "query": "example.com", "qtype": 15, "answers": ["mail.example.com"]}
    raw = spark.createDataFrame([(json.dumps(event),), ("{oops",)], "value string")
    good, bad = logs.decode_flat(raw, "dns.log").collect()
    assert (good["timestamp"], good["dns__query"], good["dns__answers"], good["dns__rcode"]) == ("2025-08-13T12:00:00.000+00:00", "example.com", ["mail.example.com"], None)
    assert bad[logs.BAD] == "{oops" and bad["dns__query"] is None
    nested = logs.decode_nested(spark.createDataFrame([('{"id": "7", "rule": {"id": "5"}}',), ("x",)], "value string"), "alerts")
    assert [tuple(r) for r in nested.select("id", logs.nested_field("rule.id")).collect()] == [("7", "5"), (None, None)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_tail_takes_whole_lines_and_restarts(tmp_path, size):
    path = tmp_path / "a.log"
    path.write_bytes(b"one\ntwo\nhal")
    reader = TailReader(str(path), Files(), size)

    def read(start):
        end = reader.latestOffset()
        return [r for p in reader.partitions(start, end) for r in reader.read(p)], end

    rows, end = read(reader.initialOffset())
    assert [r[1:] for r in rows] == [(0, "one"), (4, "two")] and end["start"] == 8
    path.write_bytes(b"one\ntwo\nhalf\n")
    rows, end = read(end)
    assert [r[2] for r in rows] == ["half"]
    path.write_bytes(b"new\n")
    rows, end = read(end)
    assert [r[2] for r in rows] == ["new"] and end["start"] == 4
    path.rename(tmp_path / "a.log.1")
    path.write_bytes(b"after\n")
    assert [r[2] for p in reader.partitions({"inode": end["inode"], "start": 0}, end) for r in reader.read(p)] == ["new"]  # a batch read again
    rows, end = read(end)
    assert [r[2] for r in rows] == ["after"]


def test_tail_stream_of_a_registry(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_text(f"{name}1\n{name}2\n")
    registry = [{"id": n, "source": "s", "log_type": f"{n}.log", "remote_path": str(tmp_path / f"{n}.log"), "decoder": "json"} for n in ("a", "b")]
    for more in ("", "x3\n"):
        with open(tmp_path / "b.log", "a") as f:
            f.write(more)
        query = tail(spark, registry).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["log_type"], r["start"], r["value"]) for r in got) == [("a.log", 0, "a1"), ("a.log", 3, "a2"), ("b.log", 0, "b1"), ("b.log", 3, "b2"), ("b.log", 6, "x3")]


def test_stream_batches_are_written_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"t": t}) for t in (0, 10, 61)))
    stream = spark.readStream.schema("t long").json(str(source))
    work = lambda b: timegroups.anchored_groups(b.select(F.lit("r").alias("rule"), F.lit(60).cast("long").alias("w"), "t"))
    for _ in range(2):
        replay.each_batch(stream, work, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("t").collect()
    assert [(r["t"], r["time_group_id"]) for r in got] == [(0, 0), (10, 0), (61, 1)]


def test_campaigns_and_pairs(spark):
    refs = lambda i: [{"source_name": "mitre-attack", "external_id": i}]
    tech = lambda i, t, phase: {"id": i, "type": "attack-pattern", "external_references": refs(t), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": phase}]}
    objects = [{"id": "c", "type": "campaign", "name": "C"}, tech("p1", "T1", "Impact"), tech("p2", "T2", "initial access"), tech("p3", "T3", "execution")]
    objects += [{"id": f"r{i}", "type": "relationship", "relationship_type": "uses", "source_ref": a, "target_ref": b} for i, (a, b) in enumerate([("c", "p1"), ("c", "p2"), ("p3", "c"), ("c", "p2")])]
    schema = "id string, type string, name string, relationship_type string, source_ref string, target_ref string, external_references array<struct<source_name: string, external_id: string>>, kill_chain_phases array<struct<kill_chain_name: string, phase_name: string>>, bundle_id string, ordinal int"
    names = [c.split()[0] for c in "id string,type string,name string,relationship_type s,source_ref s,target_ref s,external_references a,kill_chain_phases a".split(",")]
    df = spark.createDataFrame([tuple(o.get(c) for c in names) + ("x/b.json", i) for i, o in enumerate(objects)], schema)
    row = sequences.campaign_sequences(df).first()
    assert (row["campaign"], row["source_file"], row["sequence"]) == ("C", "b.json", ["T2", "T3", "T1"])
    edges = spark.createDataFrame([("g1", "T1048"), ("g2", "T1048"), ("g1", "T1016"), ("g2", "T1016"), ("g3", "T9")], "group_id string, technique_id string")
    made = graph.technique_pairs(edges).where("t1 = 'T1048'").first()
    assert (made["t2"], made["cooccurrence"]) == ("T1016", 1.0)


def test_detections_without_rules_or_window(spark):
    events = spark.createDataFrame([(1, "x", 0), (2, "x", 5), (3, "y", 7)], "event_uid long, log_type string, t long")
    assert correlation.detect(events, []).count() == 0 and semantic.semantic_matches(events, []).count() == 0
    rule = {"group_by": [], "aggregations": {"n": {"function": "count"}}, "conditions": [{"metric": "n", "operator": ">", "value": 1}]}
    for window in (None, 0, -1, "soon"):
        with pytest.raises(ValueError):
            correlation.detect(events, [{"mapping_id": "m", "correlation_rule": rule | {"window_seconds": window}}])
    more = rule | {"window_seconds": "1", "aggregations": {"n": {"function": "count"}, "none": {"function": "max", "field": "absent"}}}
    mappings = [{"mapping_id": "a", "correlation_rule": more}, {"mapping_id": "b", "log_type": "x", "correlation_rule": more}, {"mapping_id": "c", "log_type": ["x"], "correlation_rule": more | {"conditions": []}}]
    got = {r["mapping_id"]: (r["n_events"], r["metrics"]) for r in correlation.detect(events, mappings).collect()}
    assert got == {"a": (3, '{"n":3.0}'), "b": (2, '{"n":2.0}'), "c": (2, '{"n":2.0}')}


def test_rules_of_one_shape_share_a_scan(spark):
    events = spark.createDataFrame([(1, "x", 0)], "event_uid long, log_type string, t long")
    rule = {"group_by": ["log_type"], "window_seconds": 1, "aggregations": {"n": {"function": "count"}}, "conditions": []}
    plans = []
    for n in (1, 30):
        made = correlation.detect(events, [{"mapping_id": str(i), "log_type": "x", "correlation_rule": rule} for i in range(n)])
        plans.append(made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate"))
    assert plans[0] == plans[1]


def test_first_filled_and_flatten(spark):
    df = spark.createDataFrame([("", "0", "x"), (None, None, None), ("a", "b", "c")], "a string, b string, c string")
    assert [r[0] for r in df.select(semantic.first_filled(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["x", "N/A", "a"]
    nested = df.select(F.struct("a", F.struct("b", "c").alias("in")).alias("o"))
    assert logs.flatten(nested).columns == ["o.a", "o.in.b", "o.in.c"]
    assert sequences.split(df.selectExpr("a AS campaign")).select("part").distinct().count() >= 1


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"mappings": [{"mapping_id": "m", "correlation_required": True}, {"mapping_id": "s"}]}))
    (tmp_path / "bad.json").write_text('{"other": 1}')
    rules = logs.load_rules(str(tmp_path / "rules.json"))
    assert [[r["mapping_id"] for r in part] for part in semantic.split_by(rules)] == [["s"], ["m"]]
    with pytest.raises(ValueError):
        logs.load_rules(str(tmp_path / "bad.json"))
    (tmp_path / "raw.log").write_text("  one \n\t \n\ttwo\t\n")
    assert [r[0] for r in logs.lines(spark, str(tmp_path / "raw.log")).collect()] == ["one", "two"]
    (tmp_path / "bundles").mkdir()
    (tmp_path / "bundles" / "b.json").write_text(json.dumps({"type": "bundle", "objects": [{"id": "x", "type": "campaign", "name": "N"}, {"id": "y", "type": "tool"}]}))
    (tmp_path / "bundles" / "c.json").write_text("{broken")
    got = logs.read_bundles(spark, str(tmp_path / "bundles")).orderBy("ordinal").collect()
    assert [(r["bundle_id"].rsplit("/", 1)[1], r["ordinal"], r["id"], r["name"]) for r in got] == [("b.json", 0, "x", "N"), ("b.json", 1, "y", None)]
    rows = spark.createDataFrame([("a.log", 1, ["x", "y"]), ("b.log", 2, None)], "log_type string, n int, l array<string>")
    logs.write_table(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, logs.read_table(spark, str(tmp_path / "csv"), "log_type string, n int, l string").collect())) == [("a.log", 1, "x, y"), ("b.log", 2, None)]
    for _ in range(2):
        logs.append_events(rows, str(tmp_path / "events"))
    assert logs.read_events(spark, str(tmp_path / "events"), "n int, l array<string>, log_type string").count() == 4
    logs.write_document(rows, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).count() == 2


def test_numbers_of_two_places(spark):
    numbers = [i / 10_000 for i in range(10_001)] + [None, 12.345, 0.005]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", hundredths("x").alias("said")).collect()
    assert [r["said"] for r in rows if r["said"] != (None if r["x"] is None else f"{r['x']:.2f}")] == []


def test_needed_logs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(200)]), rng.choice("abc")) for i in range(150)]
    events = spark.createDataFrame(rows, "uid int, t long, log_type string")
    wanted = {"a": ["b", "c", "b"], "b": ["b"], "x": ["a"]}
    got = {r["uid"]: [x["uid"] for x in r["needed"]] for r in timegroups.needed_logs(events, "t", 10, "uid", wanted).collect()}
    near = lambda t, kinds: [i for _, i in sorted((u, i) for i, u, k in rows if u is not None and k in kinds and abs(u - t) <= 10)]
    assert got == {i: near(t, wanted[k]) for i, t, k in rows if t is not None and k in wanted}
    assert timegroups.needed_logs(events.limit(0), "t", 0, "uid", wanted).count() == 0


def test_needed_logs_shuffles_events_and_not_pairs(spark, tmp_path):
    """Two thousand events within one frame: four million pairs, which only the arrays hold."""
    made = spark.range(4000).select(F.col("id").alias("uid"), (F.col("id") % 100).alias("t"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("log_type"))
    found = timegroups.needed_logs(made, "t", 1000, "uid", {"a": ["b"]})
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join" in line]
    gathers = [i for i, line in enumerate(plan.splitlines()) if "collect_list" in line]
    assert len(joins) == 1 and min(gathers) > joins[0]  # gathered below the join, not above it
    assert found.agg(F.count("*"), F.sum(F.size("needed"))).first() == (2000, 4_000_000)
