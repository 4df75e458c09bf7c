"""Technique sequences: campaigns, prefix examples, Markov prediction with backoff, fusion with the graph, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.operators.graph import external_id

# Tactics in the order of an attack.
TACTICS = (
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion",
    "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
)
UNORDERED = 99
LEAST_LENGTH = 3
# Smoothing of Markov probabilities, and the weights of sequence and graph in a fusion.
ALPHA, SEQUENCE_WEIGHT, GRAPH_WEIGHT = 0.1, 0.6, 0.4


def tactic_order(phases: Column) -> Column:
    """The earliest tactic of an attack pattern's kill-chain phases."""
    ranks = F.create_map(*(F.lit(x) for i, t in enumerate(TACTICS) for x in (t, i)))
    own = F.filter(phases, lambda p: p["kill_chain_name"] == "mitre-attack")
    return F.coalesce(F.array_min(F.transform(own, lambda p: F.coalesce(F.try_element_at(ranks, F.replace(F.lower(p["phase_name"]), F.lit(" "), F.lit("-"))), F.lit(UNORDERED)))), F.lit(UNORDERED))


def campaign_sequences(objects: DataFrame) -> DataFrame:
    """campaign, source_file, sequence, length of bundles' campaigns: techniques by tactic, in the order of their edges, each once; of LEAST_LENGTH or more.

    objects: bundle_id, ordinal (within the bundle), and STIX fields. An edge counts in either direction.
    """
    patterns = objects.where("type = 'attack-pattern'").select("bundle_id", F.col("id").alias("_p"), external_id(F.col("external_references")).alias("tid"), tactic_order(F.col("kill_chain_phases")).alias("rank"))
    campaigns = objects.where("type = 'campaign'").select("bundle_id", F.col("id").alias("_c"), F.col("name").alias("campaign"))
    edges = objects.where("type = 'relationship'").select("bundle_id", "ordinal", "source_ref", "target_ref")
    forth = edges.join(patterns, (edges["bundle_id"] == patterns["bundle_id"]) & (edges["target_ref"] == patterns["_p"])).select(edges["bundle_id"], "ordinal", F.col("source_ref").alias("_c"), "tid", "rank")
    rest = edges.join(patterns, (edges["bundle_id"] == patterns["bundle_id"]) & (edges["target_ref"] == patterns["_p"]), "left_anti")
    back = rest.join(patterns, (rest["bundle_id"] == patterns["bundle_id"]) & (rest["source_ref"] == patterns["_p"])).select(rest["bundle_id"], "ordinal", F.col("target_ref").alias("_c"), "tid", "rank")
    found = forth.unionByName(back).where("tid IS NOT NULL").join(campaigns, ["bundle_id", "_c"])
    out = sequences(found, ["bundle_id", "_c", "campaign"], "tid", ["rank", "ordinal"])
    return out.select("campaign", F.element_at(F.split("bundle_id", "/"), -1).alias("source_file"), "sequence", F.size("sequence").alias("length")).where(F.col("length") >= LEAST_LENGTH)


def sequences(items: DataFrame, by: list[str], item: str, order: list[str]) -> DataFrame:
    """by, sequence: each group's items in order, later repetitions left out. The first place of each item is found by aggregation first, so only distinct items are gathered."""
    first = items.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.min(F.struct(*order)).alias("_o"))
    ordered = F.array_sort(F.collect_list(F.struct("_o", F.col(item).alias("_i"))))
    return first.groupBy(*by).agg(F.transform(ordered, lambda x: x["_i"]).alias("sequence"))


def by_campaign(rows: DataFrame) -> DataFrame:
    """Sequences in the order of their campaigns' names, then of their files."""
    return rows.orderBy("campaign", "source_file")


def supported_sequences(rows: DataFrame, supported: list[str]) -> DataFrame:
    """Sequences with only supported items, of LEAST_LENGTH or more."""
    kept = F.array(*map(F.lit, supported))
    return rows.withColumn("sequence", F.filter("sequence", lambda x: F.array_contains(kept, x))).where(F.size("sequence") >= LEAST_LENGTH)


def prefix_examples(rows: DataFrame, arrow: str = " -> ") -> DataFrame:
    """rows' columns (but sequence), n, input (the first n items), target (the next), input_str."""
    some = rows.where(F.size("sequence") >= 2)
    out = some.select(*(c for c in rows.columns if c != "sequence"), "sequence", F.explode(F.sequence(F.lit(1), F.size("sequence") - 1)).alias("n"))
    out = out.withColumn("input", F.slice("sequence", F.lit(1), F.col("n"))).withColumn("target", F.element_at("sequence", F.col("n") + 1))
    return out.withColumn("input_str", F.array_join("input", arrow)).drop("sequence")


def vocabulary(rows: DataFrame) -> DataFrame:
    """item, index: sorted distinct items from 2 on; 0 pads, 1 is unknown."""
    distinct = rows.select(F.explode("sequence").alias("item")).distinct()
    return distinct.withColumn("index", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item")) + 1).cast("long"))  # a catalogue of techniques


def encoded(rows: DataFrame, indices: DataFrame, column: str = "input", size: int = 20) -> DataFrame:
    """rows with `column` as the padded numbers of its items; indices as `vocabulary` gives, 1 for unknown items."""
    known = indices.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("item", "index"))).alias("_known"))  # a catalogue of techniques
    number = F.transform(column, lambda x: F.coalesce(F.try_element_at("_known", x), F.lit(1).cast("long")))
    return rows.crossJoin(F.broadcast(known)).withColumn(column, padded(number, size)).drop("_known")


def padded(prefix: Column, size: int = 20) -> Column:
    """The last `size` numbers, zeros before them if there are fewer."""
    last = F.slice(prefix, F.greatest(F.lit(1), F.size(prefix) - size + 1), F.lit(size))
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(size) - F.size(prefix))), last)


def split(rows: DataFrame, key: str = "campaign") -> DataFrame:
    """rows with part: train, validation or test, 70/15/15 by hashed key."""
    unit = F.pmod(F.xxhash64(key), F.lit(100))
    return rows.withColumn("part", F.when(unit < 70, "train").when(unit < 85, "validation").otherwise("test"))


#: Buckets of a shuffle, by the first four digits of its hashes: what the driver counts to find a cut.
DIGITS = 4


def exact_split(rows: DataFrame, key: str = "campaign", seed: str = "42") -> DataFrame:
    """rows with part: of n distinct keys in a seeded random order, the first 70 % train, the next 15 % validation, the rest test; cuts are rounded down.

    The order is that of a hash of seed and key. A cut is found by counting keys by the hash's first digits (65,536 counts
    at most), then within one such bucket, so keys are never numbered in one task. Rows of a key go together; a null
    key is one of its own.
    """
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"))
    hashes = rows.select(order.alias("h")).distinct()
    counts = sorted((r["d"], r["n"]) for r in hashes.groupBy(F.substring("h", 1, DIGITS).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    bounds = []
    for percent in (70, 85):
        before, bound = total * percent // 100, ""
        for digits, n in counts:
            if before <= 0:
                break
            if before <= n:
                bound = hashes.where(F.substring("h", 1, DIGITS) == digits).orderBy("h").offset(before - 1).limit(1).first()["h"]
            before -= n
        bounds.append(bound)
    return rows.withColumn("part", F.when(order <= bounds[0], "train").when(order <= bounds[1], "validation").otherwise("test"))


def history(prefix: Column, k: int) -> Column:
    return F.slice(prefix, F.greatest(F.lit(1), F.size(prefix) - k + 1), F.lit(k))


def markov_counts(examples: DataFrame, k: int) -> DataFrame:
    """history, target, n of an order-k model; shorter histories only come from the beginnings of sequences."""
    return examples.groupBy(history(F.col("input"), k).alias("history"), "target").agg(F.count(F.lit(1)).alias("n"))


def markov_predict(counts: DataFrame, examples: DataFrame, items: DataFrame, k: int, top: int = 5, key: str = "example_id") -> DataFrame:
    """key, item, probability, rank: the top items after each example's input.

    The longest history with a count, from k items down to one, scores the whole vocabulary by (n + ALPHA) / (all +
    ALPHA * V); with none, all are alike. Ties are broken by item. items: item, the vocabulary. Items are ranked once
    for each history that examples have; those that it never saw are alike, so only the first `top` by name follow.
    """
    size = items.agg(F.count(F.lit(1)).alias("_size"))  # one row
    totals = counts.groupBy("history").agg(F.sum("n").alias("total"))
    tried = examples.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(k), F.lit(1), F.lit(-1)), lambda o: F.slice(F.col("input"), F.greatest(F.lit(1), F.size("input") - o + 1), o)))).alias("history"))
    best = tried.join(totals, "history").groupBy(key).agg(F.max_by(F.struct("history", "total"), F.size("history")).alias("_b")).select(key, "_b.*")
    told = examples.select(key).join(best, key, "left").withColumn("history", F.coalesce("history", F.array().cast("array<string>")))
    used = told.select("history", "total").distinct()
    numbered = items.select("item", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("item")).alias("_i"))  # a catalogue of techniques
    seen = counts.join(numbered, counts["target"] == numbered["item"]).groupBy("history").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "_i"))).alias("_seen"))
    each = used.join(seen, "history", "left").crossJoin(F.broadcast(size)).withColumn("_seen", F.coalesce("_seen", F.array().cast("array<struct<m:bigint,_i:int>>")))
    first = F.sequence(F.lit(1), F.least(F.col("_size").cast("int"), F.size("_seen") + top))
    unseen = F.slice(F.array_except(first, F.transform("_seen", lambda x: x["_i"])), 1, top)
    shown = F.concat(F.slice("_seen", 1, top), F.transform(unseen, lambda i: F.struct(F.lit(0).cast("long").alias("m"), i.alias("_i"))))
    p = F.when(F.col("total").isNull(), F.lit(1.0) / F.col("_size")).otherwise((F.col("n") + ALPHA) / (F.col("total") + ALPHA * F.col("_size")))
    ranked = each.where("_size > 0").select("history", "total", "_size", F.posexplode(F.slice(shown, 1, top)).alias("_at", "_x"))
    ranked = ranked.withColumn("n", -F.col("_x.m")).withColumn("_i", F.col("_x._i")).join(numbered, "_i")
    ranked = ranked.select("history", "item", p.alias("probability"), (F.col("_at") + 1).cast("long").alias("rank"))
    return told.select(key, "history").join(ranked, "history").select(key, "item", "probability", "rank")


def evaluate(examples: DataFrame, predictions: DataFrame, key: str = "example_id") -> DataFrame:
    """One row: n, top1, top3, top5, mrr of predictions (key, item, rank) against examples' targets; 0 without examples."""
    hit = examples.select(key, F.col("target").alias("item")).join(predictions, [key, "item"], "left")
    share = lambda k: F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"top{k}")
    return hit.agg(F.count(F.lit(1)).alias("n"), share(1), share(3), share(5), F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def min_max(scores: DataFrame, key: str, score: str) -> DataFrame:
    """scores with `score` scaled to 0..1 within each key; equal scores are 1."""
    ends = scores.groupBy(key).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(score) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return scores.join(ends, key).withColumn(score, scaled).drop("_lo", "_hi")


def fuse(sequence: DataFrame, graph: DataFrame, mode: str = "soft", top: int = 5, key: str = "example_id") -> DataFrame:
    """key, item, score, rank of two rankings (key, item, score).

    hard_intersection: candidates of both, by the sequence's score. soft: the weighted geometric mean of both scores
    scaled to 0..1, a missing one 0. Any other mode: the sequence alone. Ties by item.
    """
    if mode == "hard_intersection":
        out = sequence.join(graph.select(key, "item"), [key, "item"]).select(key, "item", "score")
    elif mode == "soft":
        a, b = min_max(sequence, key, "score"), min_max(graph, key, "score")
        both = a.select(key, "item", F.col("score").alias("_s")).join(b.select(key, "item", F.col("score").alias("_g")), [key, "item"], "full_outer")
        s, g = F.coalesce("_s", F.lit(0.0)), F.coalesce("_g", F.lit(0.0))
        out = both.select(key, "item", (F.pow(s, F.lit(SEQUENCE_WEIGHT)) * F.pow(g, F.lit(GRAPH_WEIGHT))).alias("score"))
    else:
        out = sequence.select(key, "item", "score")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "item")).cast("long"))
    return out.where(F.col("rank") <= top)
