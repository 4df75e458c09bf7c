"""The same operators over streams: batch after batch as a run would, or with time groups kept in state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from watchtide.functions.shared import folder


def workspace(spark: SparkSession) -> str:
    """A fresh folder for a stream's output and checkpoint."""
    return folder(spark, "stream")


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, now: bool = True):
    """Write work(batch) for every micro-batch to out/batch=<id>, replacing what an earlier attempt wrote: exactly once. Returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer).start()


class AnchoredGroups(StatefulProcessor):
    """Time groups of a stream by rule: the anchor and the number of the group stay in state; a batch's times are sorted, so they must fit into a task: bound what a trigger reads.

    Rows: rule, w, t. An event before its group's anchor (late) belongs to no group that is still open; it is given -1.
    """

    def init(self, handle) -> None:
        self.anchor = handle.getValueState("anchor", "t long, gid long")

    def handleInputRows(self, key: Any, rows: Iterator, timer_values) -> Iterator:
        import pandas as pd

        parts = [(f["t"].to_numpy(np.int64), int(f["w"].iloc[0])) for f in rows if len(f)]
        if not parts:
            return
        t, w = np.sort(np.concatenate([p for p, _ in parts])), parts[0][1]
        t0, gid = self.anchor.get() if self.anchor.exists() else (None, -1)
        found = np.full(len(t), -1, np.int64)
        at = 0
        if t0 is not None:
            late, at = np.searchsorted(t, t0, side="left"), int(np.searchsorted(t, t0 + w, side="right"))
            found[late:at] = gid
        while at < len(t):  # a step for each group, not for each row
            t0, gid = int(t[at]), gid + 1
            end = int(np.searchsorted(t, t0 + w, side="right"))
            found[at:end] = gid
            at = end
        self.anchor.update((t0, gid))
        yield pd.DataFrame({"rule": key[0], "t": t, "time_group_id": found})

    def close(self) -> None:
        pass


def stream_groups(times: DataFrame) -> DataFrame:
    """rule, t, time_group_id of a stream of rule, w, t."""
    return times.where("t IS NOT NULL").groupBy("rule").transformWithStateInPandas(AnchoredGroups(), "rule string, t long, time_group_id long", "Append", "None")


def first_of_each(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; events without a key are all kept."""
    told = stream.where(f"coalesce(nullif(nullif(`{key}`, ''), '0'), '') <> ''").withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return told.unionByName(stream.where(f"coalesce(nullif(nullif(`{key}`, ''), '0'), '') = ''").withWatermark(time, late))
