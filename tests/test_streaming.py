"""Stateful streams."""

import json
import random
import time

from pyspark.sql import Observation

from watchtide.operators import correlation
from watchtide.operators.pairs import pair_correlation
from watchtide.sources import logs
from watchtide.streaming import detections, pairing, replay

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_groups_last_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for i, times in enumerate(([0, 10, 55], [60, 61, 130], [5])):
            (source / f"{i}.json").write_text("\n".join(json.dumps({"rule": "r", "w": 60, "t": t}) for t in times))
            stream = spark.readStream.schema("rule string, w long, t long").json(str(source))
            query = replay.stream_groups(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            query.trigger(availableNow=True).start().awaitTermination(60)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["t"], r["time_group_id"]) for r in got} == {(0, 0), (10, 0), (55, 0), (60, 0), (61, 1), (130, 2), (5, -1)}


def test_first_of_each_keeps_keyless(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [("a", "2025-01-01T00:00:00Z"), ("a", "2025-01-01T00:01:00Z"), ("", "2025-01-01T00:00:00Z"), ("", "2025-01-01T00:00:00Z"), (None, "2025-01-01T00:00:00Z"), ("b", "2025-01-01T00:00:00Z")]
    (source / "0.json").write_text("\n".join(json.dumps({"id": k, "at": t}) for k, t in rows))
    stream = spark.readStream.schema("id string, at timestamp").json(str(source))
    query = replay.first_of_each(stream, "id", "at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["id"] or "" for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "", "", "a", "b"]


RULES = [
    {"mapping_id": "a", "log_type": "x", "confidence_score": 0.5, "correlation_rule": {"window_seconds": 60, "group_by": ["host"], "aggregations": {"n": {"function": "count"}, "users": {"function": "nunique", "field": "user"}, "h": {"function": "entropy", "field": "user"}}, "conditions": [{"metric": "n", "operator": ">=", "value": 2}]}},
    {"mapping_id": "b", "correlation_rule": {"window_seconds": 90, "group_by": [], "aggregations": {"top": {"function": "max", "field": "v.w"}}, "conditions": [{"metric": "top", "operator": ">", "value": 3}]}},
]


def test_detections_over_batches_equal_one_batch(spark, tmp_path):
    """Groups go on over batches, one of which has no event of a rule and one is empty; a late event joins no group; a batch that comes again changes nothing."""
    rng = random.Random(8)
    rows = sorted(([rng.randrange(3_000) * 1_000_000, rng.choice("xxxy"), rng.choice(["h", "g", None]), rng.choice(["u", "v", None]), rng.randrange(9)] for _ in range(400)), key=lambda r: r[0])
    rows = [(i, *r) for i, r in enumerate(rows)]
    schema = "event_uid long, t long, log_type string, host string, user string, w int"
    names = {"v.w": "w", "host": "host", "user": "user"}
    watch = detections.Watch(RULES, str(tmp_path / "watch"), names)
    cuts = [0, 90, 91, 250, 250, 400]
    late = [(1000, rows[100][1], "x", "h", "late", 99), (1001, None, "x", "h", "u", 99)]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        own = [r for r in rows[low:high] if r[1] is not None] + (late if n == 4 else [])
        for _ in range(1 + (n == 2)):
            watch.batch(spark.createDataFrame(own, schema), n)
    whole = spark.createDataFrame(rows, schema)
    want = sorted(map(repr, correlation.detect(whole, RULES, names).collect()))
    assert sorted(map(repr, watch.close(spark).collect())) == want and len(want) > 20
    aside = spark.read.parquet(f"{watch.at}/late")
    assert {(r["rule"], r["t"]) for r in aside.collect()} == {("0", late[0][1]), ("1", late[0][1])}
    assert {r["batch"] for r in spark.read.parquet(f"{watch.at}/events").select("batch").distinct().collect()} < set(range(5))  # closed ones are dropped
    empty = detections.Watch(RULES, str(tmp_path / "none"), names)
    assert empty.close(spark).count() == 0


PAIRS = {"mapping_id": "p", "semantic_correlation": {"source_event": {"conditions": {"field": "kind", "value": "s"}}, "followup_event": {"conditions": {"field": "kind", "value": "f"}}, "context_fields": ["c"], "time_window_seconds": 60}}


def test_pairs_over_batches_are_found_once(spark, tmp_path):
    """Pairs over all batches, nulls in field and time among them, equal those of one table; state of past windows is dropped."""
    source = tmp_path / "in"
    source.mkdir()
    rng = random.Random(6)
    rows = [(i, rng.choice("sf"), rng.choice(["a", "b", None]), None if rng.random() < 0.1 else i * 10_000_000 + rng.randrange(10_000_000)) for i in range(160)]
    schema = "event_uid long, kind string, c string, t long"
    held = []
    for n in range(4):
        part = rows[40 * n : 40 * n + 40]
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("event_uid", "kind", "c", "t"), r))) for r in part))
        stream = spark.readStream.schema(schema).json(str(source))
        query = pairing.stream_pairs(stream, PAIRS, late="20 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        run = query.trigger(availableNow=True).start()
        run.awaitTermination(120)
        held.append([op["numRowsTotal"] for op in run.lastProgress["stateOperators"]])
    got = sorted((r["source_uid"], r["followup_uid"], tuple(r["evidence"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["source_uid"], r["followup_uid"], tuple(r["evidence"])) for r in pair_correlation(spark.createDataFrame(rows, schema), PAIRS).collect())
    assert got == want and any(a // 40 != b // 40 for a, b, _ in got)
    assert min(held[-1]) < 40  # rows of the timed join: those of the last minute and a half, not all


def test_pairs_hold_each_full_row_twice(spark, tmp_path):
    """Rows that have all they can are kept once for each mask that shares nothing or one thing with them, not in a copy for each part; state is on disk, in one store a task, and the session's settings are put back."""
    rows = [(i, "sf"[i % 2], f"c{i // 2}", (i + 1) * 1000) for i in range(40)] + [(40, "f", None, None), (41, "s", None, None)]
    schema = "event_uid long, kind string, c string, t long"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps(dict(zip(("event_uid", "kind", "c", "t"), r))) for r in rows))
    found = pairing.stream_pairs(spark.readStream.schema(schema).json(str(tmp_path / "in")), PAIRS)
    before = {k: spark.conf.get(k, None) for k in pairing.STATE}
    run = pairing.started(spark, found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True))
    run.awaitTermination(120)
    assert {k: spark.conf.get(k, None) for k in pairing.STATE} == before
    operators = run.lastProgress["stateOperators"]
    got = sorted((r["source_uid"], r["followup_uid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r["source_uid"], r["followup_uid"]) for r in pair_correlation(spark.createDataFrame(rows, schema), PAIRS).collect()) and len(got) == 61
    assert all(any(k.startswith("rocksdb") for k in op["customMetrics"]) for op in operators)
    # full rows: two each in the join without a time; empty ones: four masks in PARTS copies, or fewer
    assert max(op["numRowsTotal"] for op in operators) <= 2 * 40 + 2 * 4 * 16


def test_counts_while_decoding(spark, tmp_path):
    lines = ['{"id": "1"}', "broken", '{"id": "2"}', "[1]"]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    observed = Observation("own")
    made = logs.counted(logs.decode_nested(raw, "a"), observed)
    made.select("id").write.parquet(str(tmp_path / "batch"))
    assert observed.get == {"lines": 4, "decoded": 2, "errors": 2} == logs.counters(logs.decode_nested(raw, "a")).first().asDict()
    assert logs.counters(logs.decode_nested(raw.limit(0), "a")).first().asDict() == {"lines": 0, "decoded": 0, "errors": 0}

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines[: i + 1]))
    listener = logs.Counts()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        query = logs.counted(logs.decode_nested(stream, "a")).select("id").writeStream.format("parquet")
        query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        wait = time.time() + 20
        while len(listener.batches) < 3 and time.time() < wait:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals == {"lines": 6, "decoded": 4, "errors": 2}
