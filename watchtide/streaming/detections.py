"""Correlation rules over a stream: time groups and their events outlive micro-batches, a detection comes when its group closes.

State is a versioned table for each micro-batch, so a repeated batch rewrites its own version and nothing else: the open
group of every rule's span (log types and window), and the batch's events with their groups. A group closes when an
event after its window is seen; its events are then read from the batches that it lasted over, each event once, and
judged by the same code as a table's. No task holds a rule or an entity whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.functions.shared import drop, exists, written
from watchtide.operators.correlation import DETECTION, by_shape, detections, of_types
from watchtide.operators.predicates import field_of, fields_of
from watchtide.operators.timegroups import anchored_groups

OPEN = "rule string, anchor long, gid long, since long"


@dataclass
class Watch:
    """Rules over a stream, and the folder of their state and results: out, late, open and events, each by batch."""

    mappings: list[dict]
    at: str
    names: dict[str, str] | None = None
    time: str = "t"
    log_type: str = "log_type"

    def __post_init__(self) -> None:
        self.shapes = by_shape(self.mappings)
        self.spans = sorted({s[:2] for s in self.shapes})
        specs = [s for m in self.mappings for s in [*m["correlation_rule"]["aggregations"].values(), m["correlation_rule"].get("state_condition") or {}]]
        used = {f for s in self.shapes for f in s[2]} | {s["field"] for s in specs if s.get("field")}
        #: The fields that rules look at, by the columns that state keeps them in.
        self.kept = {f: f"f{i}" for i, f in enumerate(sorted(used))}

    def start(self, stream: DataFrame, now: bool = True):
        """Watch a stream; returns its query. A batch may come again: its tables are written anew."""
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.at}/checkpoint")
        return (writer.trigger(availableNow=True) if now else writer).start()

    def opened(self, spark: SparkSession, number: int) -> dict[str, tuple[int, int, int]]:
        """The open group of each span after a batch: anchor, number and first batch. One row for each span of the rules."""
        if number < 0 or not exists(spark, path := f"{self.at}/open/batch={number}"):
            return {}
        return {r["rule"]: (r["anchor"], r["gid"], r["since"]) for r in spark.read.schema(OPEN).parquet(path).collect()}

    def batch(self, events: DataFrame, number: int) -> None:
        """Group a batch's events, judge the groups that it closes, and write both. Events without a time are dropped; those before the open group's first are late: they are set aside and join no group."""
        spark = events.sparkSession
        before = self.opened(spark, number - 1)
        for old in range(min((s for _, _, s in before.values()), default=0) - 1, -1, -1):  # no open group reaches back to these
            if not exists(spark, path := f"{self.at}/events/batch={old}"):
                break
            drop(spark, path)
        events = written(events.where(F.col(self.time).isNotNull()), "batch")
        times = [of_types(events, wanted, self.log_type).select(F.lit(str(i)).alias("rule"), F.lit(w).cast("long").alias("w"), F.col(self.time).alias("t")) for i, (wanted, w) in enumerate(self.spans)]
        known = spark.createDataFrame([(r, a, g) for r, (a, g, _) in before.items()], "rule string, anchor long, last long")
        placed = reduce(DataFrame.unionByName, times).distinct().join(F.broadcast(known), "rule", "left")
        beyond = placed.where("anchor IS NULL OR t > anchor + w")
        fresh = anchored_groups(beyond.select("rule", "w", "t")).join(F.broadcast(known), "rule", "left")
        fresh = fresh.select("rule", "t", (F.col("time_group_id") + F.coalesce(F.col("last") + 1, F.lit(0))).alias("gid"))
        inside = placed.where("t <= anchor + w").select("rule", "t", F.when(F.col("t") < F.col("anchor"), -1).otherwise(F.col("last")).alias("gid"))
        groups = written(fresh.unionByName(inside), "groups")
        newest = groups.where("gid >= 0").groupBy("rule", "gid").agg(F.min("t").alias("t")).groupBy("rule").agg(F.max(F.struct("gid", "t")).alias("x"))
        after = dict(before)
        for r in newest.collect():  # a row for each span
            gid, anchor = r["x"]["gid"], r["x"]["t"]
            if r["rule"] not in before or gid > before[r["rule"]][1]:
                after[r["rule"]] = (anchor, gid, number)
        fields = fields_of(events, self.names)
        kept = [field_of(fields, f).column.alias(c) for f, c in self.kept.items()]
        each = []
        for i, (wanted, _) in enumerate(self.spans):
            mine = groups.where(F.col("rule") == str(i)).select(F.col("t").alias("_t"), F.col("gid").alias("time_group_id"))
            own = of_types(events, wanted, self.log_type).join(mine, F.col(self.time) == F.col("_t"))
            each.append(own.select(F.lit(str(i)).alias("rule"), "time_group_id", F.col("_t").alias("t"), *kept))
        own = reduce(DataFrame.unionByName, each)
        own.where("time_group_id >= 0").write.mode("overwrite").partitionBy("rule").parquet(f"{self.at}/events/batch={number}")
        own.where("time_group_id < 0").drop("time_group_id").write.mode("overwrite").parquet(f"{self.at}/late/batch={number}")
        closed = {r: (before[r] if r in before else (None, 0, number), after[r][1]) for r in after}
        self._judge(spark, {r: (of[1], to, of[2]) for r, (of, to) in closed.items() if of[1] < to}).write.mode("overwrite").parquet(f"{self.at}/out/batch={number}")
        spark.createDataFrame([(r, *x) for r, x in after.items()], OPEN).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/open/batch={number}")

    def _judge(self, spark: SparkSession, closed: dict[str, tuple[int, int, int]]) -> DataFrame:
        """Detections of the groups [first, end) of spans, whose events begin in a batch."""
        shapes = {s: m for s, m in self.shapes.items() if str(self.spans.index(s[:2])) in closed}
        if not shapes:
            return spark.createDataFrame([], DETECTION)
        stored = spark.read.parquet(f"{self.at}/events")

        def grouped(wanted: tuple, w: int) -> DataFrame:
            rule = str(self.spans.index((wanted, w)))
            first, end, since = closed[rule]
            return stored.where((F.col("batch") >= since) & (F.col("rule").cast("string") == rule) & (F.col("time_group_id") >= first) & (F.col("time_group_id") < end))

        return detections(grouped, shapes, fields_of(stored, self.kept))

    def close(self, spark: SparkSession) -> DataFrame:
        """All detections so far, with those of the groups still open as if the stream had ended."""
        numbers = [int(r["batch"]) for r in spark.read.parquet(f"{self.at}/open").select("batch").distinct().collect()] if exists(spark, f"{self.at}/open") else []
        if not numbers:
            return spark.createDataFrame([], DETECTION)
        last = self._judge(spark, {r: (gid, gid + 1, since) for r, (_, gid, since) in self.opened(spark, max(numbers)).items()})
        done = spark.read.schema(DETECTION).parquet(*(f"{self.at}/out/batch={n}" for n in sorted(numbers)))
        return done.unionByName(last)
