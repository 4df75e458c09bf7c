"""Pairs over a stream: both rows of a pair may come in different micro-batches, and are found once.

Two stream-stream joins. Where both rows have a time, the rule's window bounds what state must hold: a row is evicted
once the watermark of event times has passed all that could meet it. Where one has none, only the order of arrival can
bound it: such rows meet if they arrive within `keep` of each other, by a watermark of arrival times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.operators.pairs import offered, offered_apart, paired, side, window_of

#: State on disk instead of the heap, in one store a task instead of four; batches without data would only evict, which the next batch does too.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def stream_pairs(stream: DataFrame, rule: dict, names: dict[str, str] | None = None, uid: str = "event_uid", time: str = "t", late: str = "10 minutes", keep: str = "1 hour", arrived: Column | None = None) -> DataFrame:
    """The pairs of pair_correlation, as a stream in append mode; time in microseconds.

    late: how far an event's time may lie behind the greatest seen; a later one finds no rows that state has dropped.
    keep: how long a row waits for one that it shares no time with; null context fields pass as in a table, in either
    join. arrived: the time of arrival, the batch's if not given. A rule without a window has pairs of the second kind
    only. Each pair comes once: the joins part them by whether both rows have a time.
    """
    window = window_of(rule)
    made = stream.withColumn("_at", F.timestamp_micros(F.col(time))).withColumn("_arrived", F.current_timestamp() if arrived is None else arrived)

    def given(source: bool, timed: bool, mark: str, delay: str) -> DataFrame:
        own = side((made.where(F.col("_at").isNotNull()) if timed else made).withWatermark(mark, delay), rule, names, uid, time, source, (mark,))
        found = offered(own, rule, source, (mark,)).where("_timed" if timed else "NOT _timed")
        return found if timed else found.unionByName(offered_apart(own, rule, source, (mark,)))

    gap = F.expr(f"INTERVAL {keep}")
    near = (F.col("b._arrived") >= F.col("a._arrived") - gap) & (F.col("b._arrived") <= F.col("a._arrived") + gap)
    out = paired(given(True, False, "_arrived", "0 seconds"), given(False, False, "_arrived", "0 seconds"), rule, near)
    if window is None:
        return out
    inside = (F.col("b._at") >= F.col("a._at")) & (F.col("b._at") <= F.col("a._at") + F.expr(f"INTERVAL '{window / 1e6:.6f}' SECOND"))
    return paired(given(True, True, "_at", late), given(False, True, "_at", late), rule, inside).unionByName(out)


def started(spark: SparkSession, writer):
    """The query of a stream's writer, its state kept as STATE says; the session's settings are put back. A checkpoint stays with the kind of state that it began with."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
