"""Time windows over events: anchored groups, forward and centred frames.

Anchored groups: a group holds the events at most w after its first; the next event opens a new group. This chain
over all events is found without passing them through one task. Time is cut into blocks of w + 1, so a block holds one
start at most, and LAPS blocks make a lap. From a start at some phase of its block, the next one is in the next block
at this phase or later, unless that block has none there: then the chain goes on with whatever comes first. So times
are range partitioned by lap and phase: a bucket holds some whole laps, or, of a lap with more times than a bucket
takes, one slice of phases in all its blocks. A chain stays in a slice for many blocks, and can enter it only at the
first time that a block has there, or anywhere in the lap's first block. Each bucket sums up where a chain that enters
it at such a place leaves it; one fold over these summaries finds where the chain really enters, and buckets then
follow it on their own. A burst within one window is thereby dealt over as many buckets as it needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, NumericType, StringType, StructField, StructType

from watchtide.functions.shared import written

#: Distinct times of a bucket, about; blocks of a lap.
TIMES, LAPS = 100_000, 256

#: A bucket's whole laps (lap 0), or its slice of one lap.
_UNIT = ["rule", "bucket", "lap", "sliced"]

#: Rows of a list of a band, at most; tasks over which pairs of lists are dealt.
LIST, DEALT = 1024, 48


def _links(t: np.ndarray, w: int, sliced: bool, laps: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a start at each of a unit's sorted distinct times: the next start's index, or their number if it is elsewhere, and from what time on it is looked for then."""
    width = w + 1
    after, out = np.searchsorted(t, t + width), t + width
    if sliced:
        following = t // width + 1
        after = np.where(np.append(t // width, np.iinfo(np.int64).min)[after] == following, after, len(t))
        # the slice has nothing more in the following block, so what follows there has a greater phase
        out = np.where(following % laps > 0, following * width + (t % width).max() + 1, out)
    return after, out


def _ends(after: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From what time on a chain goes on after the unit, and the number of its starts here. By pointer doubling: each round looks twice as many starts ahead."""
    size = len(out)
    last, n, jump = np.arange(size + 1), np.append(np.ones(size, np.int64), 0), np.append(after, size)
    while (more := jump < size).any():
        last, n = np.where(more, last[jump], last), n + np.where(more, n[jump], 0)
        jump = jump[jump]
    return out[last[:-1]], n[:-1]


def _summary(frame, laps: int):
    """The places where a chain can enter a unit, without those that come to the same as the next."""
    import pandas as pd

    t, w, sliced = np.sort(frame["t"].to_numpy()), int(frame["w"].iloc[0]), bool(frame["sliced"].iloc[0])
    out, n = _ends(*_links(t, w, sliced, laps))
    block = t // (w + 1)
    if sliced:
        enterable = np.append(True, block[1:] != block[:-1]) | (block % laps == 0)
    else:
        enterable = np.append(True, t[:-1] <= t[0] + w)
    t, out, n, block = t[enterable], out[enterable], n[enterable], block[enterable]
    same = (out[1:] == out[:-1]) & (n[1:] == n[:-1]) & ((block[1:] == block[:-1]) | (not sliced))
    last = np.append(~same, True)
    return pd.DataFrame({**{k: frame[k].iloc[0] for k in _UNIT}, "entry": t[last], "out": out[last], "n": n[last]})


def _fold(frame):
    """Where the chain enters units: from what time on, after how many starts."""
    import pandas as pd

    frame = frame.sort_values("entry")
    entry, out, n = (frame[k].to_numpy() for k in ("entry", "out", "n"))
    at, since, before, x, total = [], [], [], -(2**63), 0
    while (i := int(np.searchsorted(entry, x))) < len(entry):
        at.append(i)
        since.append(x)
        before.append(total)
        x, total = int(out[i]), total + int(n[i])
    return frame[_UNIT].iloc[at].assign(since=np.array(since, np.int64), before=np.array(before, np.int64))


def _starts(frame, entered, laps: int):
    """The starts of groups in a unit."""
    import pandas as pd

    found, gid, w = [], [], 0
    if len(frame) and len(entered):
        t, w = np.sort(frame["t"].to_numpy()), int(frame["w"].iloc[0])
        after, _ = _links(t, w, bool(frame["sliced"].iloc[0]), laps)
        for since, number in zip(entered["since"], entered["before"], strict=True):
            i = int(np.searchsorted(t, since))
            while i < len(t):  # a step for each group, not for each time
                found.append(t[i])
                gid.append(number)
                i, number = int(after[i]), number + 1
    return pd.DataFrame({"rule": frame["rule"].iloc[0] if found else None, "block": np.array(found, np.int64) // (w + 1), "start": np.array(found, np.int64), "gid": np.array(gid, np.int64)})


def _buckets(times: DataFrame) -> DataFrame:
    """rule, w, t, block, bucket, lap, sliced of distinct times, written: a bucket is a partition by lap and phase; lap is told where it is sliced, over several buckets, and else 0."""
    distinct = times.select("rule", "w", "t").where("t IS NOT NULL").distinct()
    size = times.select(F.approx_count_distinct(F.struct("rule", "t"))).first()[0]
    phased = distinct.withColumn("phase", F.expr("pmod(t, w + 1)")).withColumn("block", F.expr("(t - phase) div (w + 1)"))
    phased = phased.withColumn("nth", F.expr(f"(block - pmod(block, {LAPS})) div {LAPS}"))
    placed = phased.repartitionByRange(size // TIMES + 1, "rule", "nth", "phase").withColumn("bucket", F.spark_partition_id().cast("long"))
    placed = written(placed.drop("phase"), "times")
    # a lap is sliced if one bucket ends and another begins with it
    edge = F.struct("rule", "nth")
    edges = placed.groupBy("bucket").agg(F.array_distinct(F.array(F.min(edge), F.max(edge))).alias("edges")).select("bucket", F.explode("edges").alias("e"))
    sliced = edges.groupBy("e.rule", "e.nth").agg((F.count(F.lit(1)) > 1).alias("sliced")).where("sliced")
    told = placed.join(sliced, ["rule", "nth"], "left").withColumn("sliced", F.coalesce("sliced", F.lit(False)))
    return told.select("rule", "w", "t", "block", "bucket", F.when(F.col("sliced"), F.col("nth")).otherwise(0).alias("lap"), "sliced")


def anchored_groups(times: DataFrame) -> DataFrame:
    """rule, t, time_group_id (from 0) of each distinct time; times: rule string, w long, t long in the same unit, w one per rule, not below zero. Null times are dropped.

    Distinct times and the starts found are written once, when this is called. No task holds more than a bucket of them, but for the fold over a rule's
    summaries: of a rule whose windows hold more than TIMES / LAPS times, about a 150th of them; else less.
    """
    cut, laps = _buckets(times), LAPS
    unit = "rule string, bucket long, lap long, sliced boolean"
    grouped = cut.groupBy(*_UNIT)
    summary = grouped.applyInPandas(lambda frame: _summary(frame, laps), f"{unit}, entry long, out long, n long")
    entered = summary.groupBy("rule").applyInPandas(_fold, f"{unit}, since long, before long")
    starts = grouped.cogroup(entered.groupBy(*_UNIT)).applyInPandas(lambda frame, entered: _starts(frame, entered, laps), "rule string, block long, start long, gid long")
    # a time belongs to its block's start or, before that, to the start in the block before; a bucket's rows of a block are few
    own = F.col("own")
    reach = starts.select("rule", "start", "gid", F.posexplode(F.array(F.col("block"), F.col("block") + 1)).alias("ahead", "block")).withColumn("own", F.col("ahead") == 0)
    reach = written(reach.groupBy("rule", "block").agg(F.max(F.when(own, F.col("start"))).alias("start"), F.max(F.when(own, F.col("gid"))).alias("gid"), F.max(F.when(~own, F.col("gid"))).alias("earlier")), "starts")
    known = cut.select("rule", "bucket", "block").distinct().join(reach, ["rule", "block"])
    gid = F.when(F.col("t") >= F.col("start"), F.col("gid")).otherwise(F.col("earlier"))
    return cut.join(known, ["rule", "bucket", "block"]).select("rule", "t", gid.alias("time_group_id"))


def _listed(batches):
    """Sorted rows, the bucket first, as lists of at most LIST rows of one bucket."""
    for batch in batches:
        b = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
        starts = [np.arange(i, j, LIST) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        offsets = np.concatenate([*starts, [len(b)]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(b[offsets[:-1]]), *(pa.ListArray.from_arrays(pa.array(offsets), c) for c in batch.columns[1:])], batch.schema.names)


def _frames(low: int, high: int):
    """Of two lists of sorted times: where in the second the frame of each time of the first begins (from 1), and how many it holds."""

    @F.arrow_udf("struct<at: array<int>, n: array<int>>")
    def frames(own: pa.Array, other: pa.Array) -> pa.Array:
        x, y, i, j = own.values.to_numpy(), other.values.to_numpy(), own.offsets.to_numpy(), other.offsets.to_numpy()
        at, n = np.zeros(i[-1] - i[0], np.int32), np.zeros(i[-1] - i[0], np.int32)
        for k in range(len(own)):
            t, near, to = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], slice(i[k] - i[0], i[k + 1] - i[0])
            first = np.searchsorted(near, t + low, "left")
            at[to], n[to] = first + 1, np.searchsorted(near, t + high, "right") - first
        of = pa.array(i - i[0])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(of, pa.array(at)), pa.ListArray.from_arrays(of, pa.array(n))], ["at", "n"])

    return frames.asNondeterministic()  # so that it isn't run again for a filter


def _band(events: DataFrame, t: str, w: int, ahead: tuple[int, ...], kept: list[str]) -> DataFrame:
    """Each event with those from w * ahead[0] to w * ahead[-1] after it, itself included; kept (with t) comes as other_*.

    Time is cut into buckets of width w, and a bucket's rows, in order, into lists of at most LIST; a list meets those of
    the neighbouring buckets. Of two lists, numpy finds each row's frame in the other one, and Spark cuts it out: no
    pair is made to be thrown away. Pairs of lists are dealt over a number of tasks that stays, so a burst is made by all
    of them; what is shuffled grows with the events and, in a burst, with a LIST-th of the pairs. Columns of events are
    of types that Arrow takes.
    """
    columns, size = events.columns, F.lit(max(1, w))
    timed = events.where(F.col(t).isNotNull()).select(F.floor(F.col(t) / size).cast("long").alias("_b"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)))
    of = {c: f"_{i}" for i, c in enumerate(columns)}
    ties = [of[c] for c in kept if c != t and isinstance(events.schema[c].dataType, (NumericType, StringType))]  # a task that is run again makes the same lists
    lists = StructType([StructField("_b", LongType(), False), *(StructField(f.name, ArrayType(f.dataType)) for f in timed.schema.fields[1:])])
    made = timed.repartition("_b").sortWithinPartitions(of[t], *ties).mapInArrow(_listed, lists).withColumn("_n", F.monotonically_increasing_id()).repartition("_b")
    offered = F.array(*(F.col("_b") - i for i in range(ahead[0], ahead[-1] + 1)))
    near = made.select(F.explode(offered).alias("_b"), F.col("_n").alias("_m"), F.col(of[t]).alias("_t"), *(F.col(of[c]).alias(f"_k{i}") for i, c in enumerate(kept)))
    met = made.join(near.hint("merge"), "_b").repartition(DEALT, "_b", "_n", "_m")
    framed = met.withColumn("_f", _frames(w * ahead[0], w * ahead[-1])(of[t], "_t")).select("*", F.posexplode("_0").alias("_i", "_own"))
    at, n = F.get("_f.at", F.col("_i")), F.get("_f.n", F.col("_i"))
    own = [F.col("_own").alias("_0"), *(F.get(of[c], F.col("_i")).alias(of[c]) for c in columns[1:])]
    each = framed.where(n > 0).select(*own, *(F.slice(f"_k{i}", at, n).alias(f"_k{i}") for i in range(len(kept))))
    # a step of its own takes the frames apart (coalesce changes nothing else): pairs are made a frame at a time, not all of two lists at once
    pairs = each.coalesce(DEALT).select("*", F.posexplode_outer("_k0").alias("_j", "_other"))
    others = [F.col("_other") if i == 0 else F.get(f"_k{i}", F.col("_j")) for i in range(len(kept))]
    return pairs.select(*(F.col(of[c]).alias(c) for c in columns), *(x.alias(f"other_{c}") for x, c in zip(others, kept, strict=True)))


def centered_band(events: DataFrame, t: str, w: int, kept: list[str]) -> DataFrame:
    """Each event with all events at most w before or after it, itself included; kept (with t) comes as other_*."""
    return _band(events, t, w, (-1, 1), kept)


def forward_window(events: DataFrame, t: str, w: int, order: str, kept: list[str]) -> DataFrame:
    """Each event with itself and those after it (by t, then order) at most w later; kept (with t and order) comes as other_*."""
    later = (F.col(f"other_{t}") > F.col(t)) | (F.col(f"other_{order}") >= F.col(order))
    return _band(events, t, w, (0, 1), kept).where(later)


def needed_logs(events: DataFrame, t: str, w: int, order: str, wanted: dict[str, list[str]], log_type: str = "log_type") -> DataFrame:
    """Events of the log types that `wanted` names, with needed: an array of (t, order, log_type) of the events of their wanted types at most w before or after, by t, then order.

    An event without such neighbours has an empty array; one that wants its own type is its own neighbour; events
    without a time are neither asked for nor ask. `order` tells the events apart. An array is as long as its frame.
    """
    # what is wanted is a bounded literal: the log types by set of wanted ones, and the sets that each is in
    sets = sorted({tuple(sorted(set(v))) for v in wanted.values()})
    set_of = F.create_map(*(F.lit(x) for k, v in wanted.items() for x in (k, sets.index(tuple(sorted(set(v))))))) if wanted else None
    types = sorted({x for v in sets for x in v})
    timed = events.where(F.col(t).isNotNull())
    bucket = F.floor(F.col(t) / max(1, w)).cast("long")
    asking = timed.where(F.col(log_type).isin(list(wanted))).withColumn("_set", set_of[F.col(log_type)] if wanted else F.lit(0)).withColumn("_b", bucket)
    given = timed.where(F.col(log_type).isin(types)).select(F.struct(F.col(t), F.col(order), F.col(log_type)).alias("_it"), bucket.alias("_b0"))
    in_sets = F.create_map(*(x for k in types for x in (F.lit(k), F.array(*(F.lit(i) for i, v in enumerate(sets) if k in v))))) if types else None
    given = given.withColumn("_set", F.explode(in_sets[F.col("_it")[log_type]]) if types else F.lit(0))
    given = given.select("_it", "_set", F.explode(F.array(F.col("_b0") - 1, F.col("_b0"), F.col("_b0") + 1)).alias("_b"))
    # a bucket's events are put in order once; each row cuts its frame from them where it is, so no pair is shuffled
    lists = given.groupBy("_set", "_b").agg(F.sort_array(F.collect_list("_it")).alias("_near"))
    found = asking.join(lists.hint("merge"), ["_set", "_b"], "left")
    near = F.filter("_near", lambda x: F.abs(x[t] - F.col(t)) <= w)
    return found.select(*(F.col(f"`{c}`") for c in events.columns), F.coalesce(near, F.array().cast(lists.schema["_near"].dataType)).alias("needed"))


#: How an aggregate of parts becomes that of the whole.
MERGED = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def band_aggregate(events: DataFrame, t: str, before: int, after: int, aggregates: dict[str, tuple[str, str | None]], order: str | None = None) -> DataFrame:
    """events with aggregates over those from `before` earlier to `after` later, itself included, in linear time and without making pairs.

    aggregates: name -> (count, sum, min or max, column; None counts rows). Time is cut into blocks as wide as a frame, so
    a frame is the end of one block and the beginning of the next: both are read from running aggregates, at marks that
    are sorted among the block's rows. With `order` (a number, for frames that begin at the row itself), of rows of the
    same time only those not before the row in that order count, null first. Rows without a time are left out.
    """
    if any(f not in MERGED for f, _ in aggregates.values()):
        raise ValueError(f"aggregates are {', '.join(MERGED)}")
    if order is not None and before:
        raise ValueError("an order of ties needs a frame that begins at the row")
    own = events.where(F.col(t).isNotNull()).select(F.monotonically_increasing_id().alias("_id"), F.col(t).cast("long").alias("_t"), (F.col(order) if order else F.lit(0)).alias("_o"), F.struct("*").alias("_row"))
    width = before + after + 1
    block = lambda x: F.floor(x / F.lit(width)).cast("long") if width > 1 else x
    low, high = F.col("_t") - before, F.col("_t") + after
    tie = F.coalesce(F.col("_o").cast("double"), F.lit(float("-inf")))

    def put(ending: bool, mark: bool, x: Column, o: Column):
        """A row or a mark of it in the sort of a block: backwards for the block's end, up to the mark."""
        return F.struct(F.lit(ending).alias("ending"), block(x).alias("block"), (-x if ending else x).alias("at"), o.alias("tie"), F.lit(int(mark)).alias("mark"))

    last = F.lit(float("inf"))
    marks = [put(True, False, F.col("_t"), -tie), put(True, True, low, -tie if order else last), put(False, False, F.col("_t"), F.lit(0.0)), F.when(block(low) != block(high), put(False, True, high, last))]
    spread = own.select("_id", "_row", F.explode(F.array_compact(F.array(*marks))).alias("_m")).select("_id", "_row", "_m.*")
    running = Window.partitionBy("ending", "block").orderBy("at", "tie", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = F.col("mark") == 0
    made = {k: getattr(F, f)(F.when(plain, F.col(f"_row.`{c}`") if c else F.lit(1))).over(running).alias(f"_{i}") for i, (k, (f, c)) in enumerate(aggregates.items())}
    parts = spread.select("_id", "_row", "mark", *made.values()).where("mark = 1")
    out = parts.groupBy("_id").agg(F.first("_row").alias("_row"), *(MERGED[f](f"_{i}").alias(k) for i, (k, (f, _)) in enumerate(aggregates.items())))
    return out.select("_row.*", *aggregates)
