"""Sharding by minimax contiguous partition over atomic groups of equal texts.

Groups are ordered by the 64-bit hash of their text. The smallest shard capacity for which a greedy sweep needs no
more than the wanted number of shards is found by binary search. The driver only holds sums of hash ranges: it
starts with 2**16 ranges and splits only those in which a cut may fall, until the bounds on the capacity meet. Within that capacity shards are then cut as near equal as they can be: a group
that fills a shard alone is set apart, and what lies between such groups is spread over the other shards likewise.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import materialize, ranked

#: Bits of the hash that the first ranges share, and bits by which a range is split further.
FIRST_BITS, MORE_BITS = 16, 6
#: Groups of this part of a shard or more are cut around when shards are evened.
EVEN = 64
#: Rows numbered in one task at most, about.
RANK_ROWS = 50_000


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes + 16; a null text has none), text_crc32 (0 for null), and the group's hash."""
    return docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col(text).isNull(), F.xxhash64(F.lit("null text"), F.lit(1))).otherwise(F.xxhash64(text)).alias("h"),
    )


class Ranges:
    """Hash ranges in order: (shift, prefix, bytes, groups)."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows, key=lambda r: r[1] << r[0])
        self.ends = np.cumsum([0, *(r[2] for r in self.rows)], dtype=object).tolist()
        self.total = self.ends[-1]

    def at(self, x: int) -> int:
        """Index of the last range that starts at or before byte x."""
        return bisect.bisect_right(self.ends, x) - 1

    def sweep(self, capacity: int, shards: int, fluid: bool) -> list[int]:
        """Greedy cut positions. fluid: a range of several groups may be cut anywhere (an upper bound of each cut)."""
        x, out = 0, []
        for _ in range(shards):
            i = self.at(x + capacity)
            if i >= len(self.rows):
                x = self.total
            elif fluid and self.rows[i][3] > 1:
                x = x + capacity
            else:
                x = max(x, self.ends[i])
            out.append(min(x, self.total))
        return out

    def least(self, low: int, shards: int, fluid: bool) -> int:
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.sweep(middle, shards, fluid)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least feasible capacity, and for each shard but the first the least hash that it holds.

    groups: one row per atomic group (h, bytes). The answer is exact: ranges are split until the least capacity
    with cuts at their borders equals the least with cuts anywhere in those that hold several groups.
    """

    def summed(df: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
        prefix = F.shiftright("h", shift)
        return [(shift, r[0], int(r[1]), r[2]) for r in df.groupBy(prefix.alias("p")).agg(F.sum("bytes"), F.count(F.lit(1))).collect()]

    spark = groups.sparkSession
    ranges = Ranges(summed(groups, 64 - FIRST_BITS))
    if not ranges.total:
        return 0, []
    largest = groups.agg(F.max("bytes")).first()[0]
    floor = max(int(largest), math.ceil(ranges.total / shards))
    while True:
        low = ranges.least(floor, shards, fluid=True)
        high = ranges.least(low, shards, fluid=False)
        if low == high:
            break
        split: dict[int, set[int]] = {}
        for a, b in zip(ranges.sweep(low, shards, fluid=False), ranges.sweep(high, shards, fluid=True), strict=True):
            for i in range(ranges.at(a), min(ranges.at(b), len(ranges.rows) - 1) + 1):
                if ranges.rows[i][3] > 1:
                    split.setdefault(ranges.rows[i][0], set()).add(ranges.rows[i][1])
        rows = [r for r in ranges.rows if r[1] not in split.get(r[0], ())]
        for shift, prefixes in split.items():
            wanted = spark.createDataFrame([(p,) for p in sorted(prefixes)], "p long")
            inside = groups.withColumn("p", F.shiftright("h", shift)).join(F.broadcast(wanted), "p", "left_semi")
            rows += summed(inside, max(0, shift - MORE_BITS))
        ranges = Ranges(rows)
    found = ranges.sweep(high, shards, fluid=False)
    starts = []
    for x in found[:-1]:
        if x >= ranges.total:
            break
        shift, prefix, _, _ = ranges.rows[ranges.at(x)]
        starts.append(prefix << shift)
    return high, evened(groups, shards, ranges.total, starts)


def evened(groups: DataFrame, shards: int, total: int, starts: list[int]) -> list[int]:
    """Starts of shards that are as near equal as the least capacity allows; starts: a cut that attains it.

    Shards are cut at borders of 2**16 hash ranges, at the given starts and around the groups that weigh 1/EVEN of
    a shard or more, so that the capacity is kept.
    """
    marks: dict[int, set[int]] = {}
    shift = 64 - FIRST_BITS
    for r in groups.where(F.col("bytes") * (EVEN * shards) >= total).select("h").collect():
        for h in (r[0], r[0] + 1):
            marks.setdefault(h >> shift, set()).add(h)
    for h in starts:
        marks.setdefault(h >> shift, set()).add(h)
    known = groups.sparkSession.createDataFrame([(p, sorted(h for h in m if h < 2**63)) for p, m in marks.items()], "p long, marks array<long>")
    placed = groups.withColumn("p", F.shiftright("h", shift)).join(F.broadcast(known), "p", "left")
    nth = F.size(F.filter(F.coalesce("marks", F.array().cast("array<long>")), lambda x: x <= F.col("h")))
    rows = sorted((r[2], int(r[3])) for r in placed.groupBy("p", nth.alias("nth")).agg(F.min("h"), F.sum("bytes")).collect())
    return [rows[i][0] for i in even([b for _, b in rows], shards)[1:]]


def even(sizes: list[int], shards: int) -> list[int]:
    """Indices where the shards of a contiguous partition begin: the largest is least; what an item fills alone is set apart, and the rest cut again by the same search."""
    ends = [0, *np.cumsum(sizes, dtype=np.int64).tolist()]

    def needed(lo: int, hi: int, capacity: int, most: int) -> int:
        n = 0
        while lo < hi and n <= most:
            lo, n = bisect.bisect_right(ends, ends[lo] + capacity) - 1, n + 1
            lo = min(lo, hi)
        return n

    def cut(lo: int, hi: int, k: int) -> list[int]:
        """Starts of k shards, or of as many as there are items, for items lo to hi."""
        k = min(k, hi - lo)
        parts, alone = [(lo, hi)], []
        while parts and k:
            largest = max(max(sizes[a:b]) for a, b in parts)
            low, high = max(largest, -(-sum(ends[b] - ends[a] for a, b in parts) // k)), ends[-1]
            while low < high:
                middle = (low + high) // 2
                if sum(needed(a, b, middle, k) for a, b in parts) <= k:
                    high = middle
                else:
                    low = middle + 1
            if low > largest:
                break
            whole = [i for a, b in parts for i in range(a, b) if sizes[i] == largest]
            alone, k = alone + whole, k - len(whole)
            inside, parts = parts, []
            for a, b in inside:
                for i in [*(i for i in whole if a <= i < b), b]:
                    if a < i:
                        parts.append((a, i))
                    a = i + 1
        if not parts:
            return sorted(alone)
        share = [needed(a, b, low, k) for a, b in parts]
        for _ in range(k - sum(share)):
            more = [i for i, (a, b) in enumerate(parts) if share[i] < b - a]
            if more:
                share[max(more, key=lambda i: (ends[parts[i][1]] - ends[parts[i][0]]) / share[i])] += 1
        if len(parts) == 1 and not alone:
            return level(lo, hi, share[0], low)
        return sorted(alone + [x for (a, b), n in zip(parts, share, strict=True) for x in cut(a, b, n)])

    def level(lo: int, hi: int, k: int, capacity: int) -> list[int]:
        """Each shard near an equal part of what is left, none above capacity and none empty."""
        first = [hi]  # the least starts from which the last shards suffice
        for _ in range(k - 1):
            first.append(max(lo, bisect.bisect_left(ends, ends[first[-1]] - capacity)))
        out = [lo]
        for left in range(k - 1, 0, -1):
            at = out[-1]
            goal = ends[at] + (ends[hi] - ends[at]) / (left + 1)
            i = bisect.bisect_left(ends, goal)
            i -= i > 0 and goal - ends[i - 1] < ends[i] - goal
            top = min(bisect.bisect_right(ends, ends[at] + capacity) - 1, hi - left)
            out.append(min(max(i, first[left], at + 1), top))
        return out

    return cut(0, len(sizes), shards)


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard so that the largest shard's bytes are least and the others near equal, equal texts staying together.

    Returns key, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in its shard), grown_shard (null).
    Null texts are one group of their own and weigh 16 bytes a row; repeated rows each get a slot; an empty table
    gives no rows; other columns are ignored.
    """
    slim = materialize(sizes(docs, key, text), "sizes")
    groups = materialize(slim.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    _, starts = cuts(groups, shards)
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("h") >= F.lit(start)).cast("int")
    placed = slim.withColumn("shard", shard.cast("int"))
    n = slim.count()
    out = ranked(placed, "shard", [key, "h", "size"], max(1, min(RANK_ROWS, n // 512)))
    return out.select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
