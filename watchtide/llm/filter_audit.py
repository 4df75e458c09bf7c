"""Filter interaction audit: what each filter of a chain removes in every order, by inclusion and exclusion.

Rows are read once. For every subset of the filters the rows that fail all of them are counted, as a sum of flag
products; everything else follows from these joint counts N(S) by Moebius inversion:

    survivors of the filters T      sum over S within T of (-1)^|S| N(S)
    failing filter i and no other   sum over S holding i of (-1)^(|S|-1) N(S)
    Shapley value of filter i       sum over S holding i of d(S) / |S|, d(S) = (-1)^(|S|-1) N(S) the Harsanyi dividend

so no order is ever run over rows: an order's step is the difference of two survivor counts.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import materialize

WORD_BREAK = r"[\x20\x09-\x0D]+"


def _size(subset: int) -> int:
    return subset.bit_count()


def joint_failures(rows: DataFrame, part: str, flags: list[str], weights: list[str]) -> DataFrame:
    """One row per part; for each weight an array, by the subset's bits, of its sum over rows that fail all filters of that subset."""
    subsets = range(1 << len(flags))
    products = {s: " * ".join(f for i, f in enumerate(flags) if s >> i & 1) for s in subsets}
    sums = [F.expr(f"sum({w} * {p})" if p else f"sum({w})").alias(f"{w}_{s}") for w in weights for s, p in products.items()]
    found = rows.groupBy(part).agg(*sums)
    return found.select(part, *(F.array(*(f"{w}_{s}" for s in subsets)).alias(w) for w in weights))


def _signed(array: str, subsets: list[tuple[int, int]]) -> str:
    """SQL of a sum of an array's items times whole numbers."""
    return " + ".join(f"{times} * {array}[{s}]" for s, times in subsets) or "0"


def interactions(joint: DataFrame, part: str, filters: str, weights: list[str]) -> DataFrame:
    """joint with arrays: <weight>_left (survivors of every subset of filters), alone and shapley (by filter, of the first weight).

    A Shapley value comes times the number of orders, which makes it a whole number.
    """
    n, subsets = len(filters), range(1 << len(filters))
    left = [F.expr("array(" + ", ".join(_signed(w, [(s, (-1) ** _size(s)) for s in subsets if s & t == s]) for t in subsets) + ")").alias(f"{w}_left") for w in weights]
    with_filter = [[s for s in subsets if s >> i & 1] for i in range(n)]
    dividend = {s: -((-1) ** _size(s)) for s in subsets}
    alone = "array(" + ", ".join(_signed(weights[0], [(s, dividend[s]) for s in held]) for held in with_filter) + ")"
    shapley = "array(" + ", ".join(_signed(weights[0], [(s, dividend[s] * (factorial(n) // _size(s))) for s in held]) for held in with_filter) + ")"
    return joint.select("*", *left, F.expr(alone).alias("alone"), F.expr(shapley).alias("shapley"))


def by_order(found: DataFrame, part: str, filters: str) -> DataFrame:
    """A row for each part, order of the filters and step; weights are n, good and toxic."""
    steps = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"o": "".join(filters[k] for k in order), "k": step, "i": i, "b": before, "a": before | 1 << i})
            before |= 1 << i
    told = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,k:int,i:int,b:int,a:int>>"))
    at = lambda array, index: F.get(F.col(array), F.col(f"s.{index}"))
    failing = F.get(F.col("n"), F.expr("shiftleft(1, s.i)"))
    removed = at("n_left", "b") - at("n_left", "a")
    return found.select("*", told.alias("s")).select(
        F.col(part).alias("part"),
        F.col("s.o").alias("filter_order"),
        F.col("s.k").alias("step"),
        at("n_left", "a").alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        at("alone", "i").alias("unique_fails"),
        (at("good_left", "b") - at("good_left", "a")).alias("good_lost"),
        (at("toxic_left", "b") - at("toxic_left", "a")).alias("toxic_lost"),
        at("shapley", "i").alias("shapley"),
    )


def text_flags(text: Column) -> dict[str, Column]:
    """Filters A to D on a whole text, true where it fails."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows (part, A to E as 0 or 1, n, good, toxic): documents that agree in text, part and key, counted.

    E is set where a smaller key has the same text anywhere in the table. Texts travel as digests only: the least key
    of each digest is found by aggregation and met by digest and key together, so copies of one text don't gather. A
    null text is empty, a null part the empty string. A null key is smaller than none, so its row never fails E and
    has no label; repeated rows of one key don't fail E by each other. Of several labels of a key any counts. Other
    columns are ignored; empty tables give no rows.
    """
    whole = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    flags = {k: v.cast("long") for k, v in text_flags(F.col("t")).items()}
    slim = whole.select("id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), *(v.alias(k) for k, v in flags.items()))
    own = materialize(slim.groupBy("digest", "part", "id", *flags).agg(F.count(F.lit(1)).alias("n")), "audit")
    first = own.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    # rows without a key are dealt by their digest: nulls alone would meet in one task
    own = own.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))
    both = own.join(first, ["digest", "id"], "left").join(told.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    copy = (F.col("id").isNotNull() & F.col("first").isNull()).cast("long")
    return both.select("part", *flags, copy.alias("E"), "n", *((F.col("n") * F.coalesce(F.col(w), F.lit(0))).alias(w) for w in ("good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Every part's table of all 120 orders and their steps; rows as `flagged` says. A part has 600 rows, however large it is."""
    weights = ["n", "good", "toxic"]
    joint = joint_failures(flagged(docs, labels, key, text, part), "part", list("ABCDE"), weights)
    return by_order(interactions(joint, "part", "ABCDE", weights), "part", "ABCDE")
