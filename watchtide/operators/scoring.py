"""Scores of a technique-to-telemetry mapping table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions.text import filled, hundredths, stripped, tidy
from watchtide.functions.times import either

# The rubric's scores of a filter text, from the most to the least specific kind.
FILTER_SCORES = {"long equality": 0.90, "equality": 0.85, "keyword": 0.72, "boolean": 0.65, "short": 0.42, "other": 0.52, "blank": 0.10}
# What tells the kinds of filter texts, in lower case.
EQUALITY_PATTERNS = (
    r"\b\w+\s*=\s*[^\s,;]+",
    r"\b\w+\s*==\s*[^\s,;]+",
    r"\bequals?\s*[:=]\s*[^\s,;]+",
    r'\bis\s+"[^"]+"',
)
KEYWORD_PATTERNS = (
    r"\bcontains?\b",
    r"\blike\b",
    r"\bmatch\b",
    r"\bregex\b",
    r"\bstart\s*with\b",
    r"\bend\s*with\b",
    r"\*",
    r"%",
)
BOOLEAN_WORDS = (" and ", " or ", "&", "|")
# Weights of the relationship score's parts.
RELATIONSHIP_WEIGHTS = {"telemetry_specificity": 0.5, "filter_specificity": 0.3, "completeness": 0.2}


#: What a reason says by the number of techniques that share an evidence (1, to 5, to 20, more), and by its share.
SPREAD = (
    "unique to {} across the dataset",
    "shared with only {} other technique(s), so still fairly specific",
    "shared with {} other techniques, giving it moderate specificity",
    "shared with {} other techniques, so it has low discriminative power on its own",
)
SHARE = (
    "it's also one of the primary evidence sources available for this technique",
    "it contributes a moderate share of the available evidence for this technique",
    "relative to other evidence for this technique, it's a comparatively minor source",
)


def evidence_scores(rows: DataFrame, technique: str = "technique_id", evidence: str = "event_identity", alpha: float = 0.7) -> DataFrame:
    """rows with evidence_degree, evidence_score (0 to 1, 4 places) and evidence_confidence_reason.

    An evidence's degree is its number of distinct techniques; evidence tied to few techniques tells more (itf), and
    so does evidence that makes up much of its technique's total (ri). Both are scaled over the table.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be 0 to 1")
    rows = rows.withColumns({technique: F.coalesce(technique, F.lit("unknown")), evidence: F.coalesce(evidence, F.lit("unknown"))})
    cells = rows.groupBy(technique, evidence).agg(F.count(F.lit(1)).alias("_rows"))  # all that follows is over distinct pairs
    degree = cells.groupBy(evidence).agg(F.count(F.lit(1)).alias("evidence_degree"))
    total = cells.agg(F.count_distinct(technique).alias("_techniques"))
    itf = F.log((F.col("_techniques") + 1) / (F.col("evidence_degree") + 1))
    cells = cells.join(degree, evidence).crossJoin(F.broadcast(total)).withColumn("_itf", itf)  # one row
    sums = cells.groupBy(technique).agg(F.sum(F.col("_itf") * F.col("_rows")).alias("_sum"))
    cells = cells.join(sums, technique).withColumn("_ri", F.col("_itf") / (F.col("_sum") + 1e-9))
    ends = cells.agg(*(f(c).alias(f"{n}{c}") for c in ("_itf", "_ri") for n, f in (("lo", F.min), ("hi", F.max))))
    cells = cells.crossJoin(F.broadcast(ends))  # one row

    def scaled(c: str) -> Column:
        return (F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}") + 1e-9)

    score = F.round(alpha * scaled("_itf") + (1 - alpha) * scaled("_ri"), 4)
    degree, others = F.col("evidence_degree"), (F.col("evidence_degree") - 1).cast("string")
    said = lambda text, x: F.concat(*(F.lit(t) if i == 0 else F.concat(x, F.lit(t)) for i, t in enumerate(text.split("{}"))))
    spread = F.when(degree <= 1, said(SPREAD[0], F.col(technique))).when(degree <= 5, said(SPREAD[1], others)).when(degree <= 20, said(SPREAD[2], others)).otherwise(said(SPREAD[3], others))
    share = F.when(scaled("_ri") > 0.66, SHARE[0]).when(scaled("_ri") > 0.33, SHARE[1]).otherwise(SHARE[2])
    cells = cells.select(technique, evidence, "evidence_degree", score.alias("evidence_score"), spread.alias("_spread"), share.alias("_share"))
    reason = F.concat(F.lit("Evidence score "), hundredths("evidence_score"), F.lit(": this telemetry is "), F.col("_spread"), F.lit("; "), F.col("_share"), F.lit("."))
    cells = cells.withColumn("evidence_confidence_reason", reason).drop("_spread", "_share")
    return rows.join(cells, [technique, evidence])


def signature(*columns: Column) -> Column:
    """Filled cells in lower case, joined by '|'; __empty__ if there is none."""
    joined = F.array_join(F.filter(F.array(*map(tidy, columns)), lambda x: x != ""), "|")
    return F.when(joined == "", "__empty__").otherwise(joined)


def telemetry_specificity(rows: DataFrame, columns: list[str], technique: str = "technique_id") -> DataFrame:
    """rows with _signature and telemetry_specificity: 1 / sqrt(distinct techniques of the signature), at most 1."""
    rows = rows.withColumn("_signature", signature(*map(F.col, columns)))
    counts = rows.groupBy(F.col("_signature").alias("_s")).agg(F.count_distinct(technique).alias("_n"))
    found = F.when(F.col("_n") > 0, 1 / F.sqrt("_n")).otherwise(1.0)
    return rows.join(counts, rows["_signature"] == counts["_s"]).withColumn("telemetry_specificity", F.least(F.lit(1.0), found)).drop("_s", "_n")


def filter_specificity(text: Column) -> Column:
    """How specific a filter text is, by the rubric FILTER_SCORES."""
    own = stripped(text.cast("string"))
    low, s = F.lower(own), FILTER_SCORES
    told = lambda patterns: either([low.rlike(f"(?U){p}") for p in patterns])
    words = F.size(F.split(own, r"(?U)\s+"))
    return (
        F.when(own.isNull() | (own == ""), s["blank"])
        .when(told(EQUALITY_PATTERNS), F.when(F.length(own) > 15, s["long equality"]).otherwise(s["equality"]))
        .when(told(KEYWORD_PATTERNS), s["keyword"])
        .when(either([low.contains(w) for w in BOOLEAN_WORDS]), s["boolean"])
        .when((words <= 3) & (F.length(own) < 40), s["short"])
        .otherwise(s["other"])
    )


def completeness(rows: DataFrame, weights: dict[str, float]) -> Column:
    """Weighted share of filled cells, over the columns present; 0 if none is."""
    present = {c: w for c, w in weights.items() if c in rows.columns}
    total = sum(present.values())
    if not total:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, (F.when(filled(F.col(c)), float(w)).otherwise(0.0) for c, w in present.items())) / F.lit(float(total))


def relationship_strength(rows: DataFrame, columns: list[str], filter_column: str, weights: dict[str, float], technique: str = "technique_id") -> DataFrame:
    """rows with telemetry_specificity, filter_specificity, completeness and their weighted sum relationship_strength (4 places)."""
    assert abs(sum(RELATIONSHIP_WEIGHTS.values()) - 1) < 1e-9
    out = telemetry_specificity(rows, columns, technique)
    spec = filter_specificity(F.col(filter_column)) if filter_column in rows.columns else F.lit(FILTER_SCORES["blank"])
    out = out.withColumn("filter_specificity", spec).withColumn("completeness", completeness(rows, weights))
    total = reduce(lambda a, b: a + b, (F.col(c) * w for c, w in RELATIONSHIP_WEIGHTS.items()))
    return out.withColumn("relationship_strength", F.round(total, 4)).drop("_signature")


def null_counts(rows: DataFrame) -> DataFrame:
    """One row: the number of nulls of every column."""
    return rows.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns))
