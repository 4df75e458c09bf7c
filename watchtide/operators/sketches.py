"""Metrics of correlation rules as states that merge: over batches, partitions of a table or days.

Count, rate, sum, mean, extremes, ratio and deviations merge exactly (but for rounding). Distinct values are kept as an
HLL sketch of 2**LOG_HLL registers, whose relative standard error is 1.04 / sqrt(2**LOG_HLL), below 0.9 %. Entropy is
kept as frequent items: exact while a group has at most three quarters of ITEMS values; beyond that, the values that
aren't tracked share the rest of the rows evenly, as many as the HLL sketch counts. A state's size is bounded whatever
the number of rows; a group's rows are summed up before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions.addresses import in_network, network_size
from watchtide.operators.correlation import FUNCTIONS, _in_values
from watchtide.operators.predicates import Fields, field_of, fields_of

#: Logarithm of an HLL sketch's registers; items that a sketch of frequent ones tracks, a power of two.
LOG_HLL, ITEMS = 14, 1024


def _state(spec: dict, fields: Fields) -> dict[str, Column]:
    """The aggregates over rows that a metric's state is made of."""
    name = spec["function"]
    if name in ("count", "rate"):
        return {}
    field = field_of(fields, spec["field"])
    text = field.column.cast("string")
    if name == "ratio":
        return {"inside": F.count_if(_in_values(field, spec["values"]))}
    if name == "subnet_density":
        return {"hll": F.hll_sketch_agg(F.when(F.coalesce(in_network(field.column, spec["subnet"]), F.lit(False)), text), LOG_HLL)}
    if name == "nunique":
        return {"hll": F.hll_sketch_agg(text, LOG_HLL)}
    if name == "entropy":
        return {"known": F.count(text), "hll": F.hll_sketch_agg(text, LOG_HLL), "items": F.call_function("approx_top_k_accumulate", text, F.lit(ITEMS))}
    x = field.number if not field.kind.startswith("array") else F.lit(None).cast("double")
    if name in ("min", "max"):
        return {name: getattr(F, name)(x)}
    moments = {"known": F.count(x), "sum": F.sum(x)}
    return moments if name in ("sum", "mean") else moments | {"mean": F.avg(x), "m2": F.var_pop(x) * F.count(x)}


def _merge(part: str, c: str) -> Column:
    if part == "hll":
        return F.hll_union_agg(c)
    if part == "items":
        return F.call_function("approx_top_k_combine", F.col(c), F.lit(ITEMS))
    return {"min": F.min, "max": F.max}.get(part, F.sum)(c)


def _value(spec: dict, k: str) -> Column:
    """A metric of its merged state."""
    name, n = spec["function"], F.col("n_events")
    part = lambda p: F.col(f"{k}__{p}")
    if name == "count":
        return n.cast("double")
    if name == "rate":
        seconds = spec.get("window_seconds")
        return n.cast("double") if seconds is None else F.lit(0.0) if seconds <= 0 else n / F.lit(float(seconds))
    if name == "ratio":
        return F.coalesce(part("inside") / F.nullif(n, F.lit(0)), F.lit(0.0))
    if name in ("nunique", "subnet_density"):
        found = F.coalesce(F.hll_sketch_estimate(part("hll")), F.lit(0)).cast("double")
        return found if name == "nunique" else found / F.lit(float(network_size(spec["subnet"])))
    if name in ("min", "max"):
        return part(name)
    if name == "sum":
        return F.coalesce(part("sum"), F.lit(0.0))
    known = part("known").cast("double")
    if name == "mean":
        return part("sum") / F.nullif(part("known"), F.lit(0))
    if name == "entropy":
        counts = F.transform(F.filter(F.call_function("approx_top_k_estimate", part("items"), F.lit(ITEMS)), lambda x: x["item"].isNotNull()), lambda x: x["count"].cast("double"))
        told = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
        each = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log2(c))
        rest, others = known - told, F.greatest(F.lit(1.0), F.hll_sketch_estimate(part("hll")) - F.size(counts))
        tail = F.when(rest > 0, rest * F.log2(rest / others)).otherwise(0.0)
        return F.when(known > 0, F.greatest(F.lit(0.0), F.log2(known) - (each + tail) / known)).otherwise(0.0)
    mean = part("sum") / F.nullif(part("known"), F.lit(0))
    sd = F.when(part("known") > 1, F.sqrt(part("m2") / (known - 1)))
    if name == "standard_deviation":
        return F.coalesce(sd, F.lit(0.0))
    return F.when((part("known") < 2) | (mean == 0), 0.0).otherwise(sd / F.abs(mean))


def _check(specs: dict[str, dict]) -> None:
    for spec in specs.values():
        if spec.get("function") not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {spec.get('function')}")


def summarised(events: DataFrame, group_by: list[str], specs: dict[str, dict], names: dict[str, str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """States of groups: keys, group_by fields, n_events and the parts of each metric as <metric>__<part>. Null is a value of a key; no rows make no groups. The table can be stored, and united with those of other batches."""
    _check(specs)
    fields = fields_of(events, names)
    own = events.select("*", *(field_of(fields, f).column.alias(f"g_{i}") for i, f in enumerate(group_by)))
    parts = [c.alias(f"{k}__{p}") for k, s in specs.items() for p, c in _state(s, fields).items()]
    out = own.groupBy(*keys, *(f"g_{i}" for i in range(len(group_by)))).agg(F.count(F.lit(1)).alias("n_events"), *parts)
    return out.withColumnsRenamed({f"g_{i}": f for i, f in enumerate(group_by)})


def merged(states: DataFrame, by: list[str], specs: dict[str, dict]) -> DataFrame:
    """States of coarser groups, by some of the columns that tell groups apart; the same columns as `summarised` gives."""
    _check(specs)
    parts = [tuple(c.rsplit("__", 1)) for c in states.columns if "__" in c and c.rsplit("__", 1)[0] in specs]
    varied = [k for k, p in parts if p == "m2"]
    mean = lambda k: (F.sum(F.col(f"{k}__known") * F.col(f"{k}__mean")) / F.nullif(F.sum(f"{k}__known"), F.lit(0)))
    if varied:  # squares are taken from the coarser groups' means: differences of large sums would lose them
        middle = states.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *(mean(k).alias(f"{k}__middle") for k in varied))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
        states = states.alias("a").join(middle.alias("b"), reduce(lambda x, y: x & y, same, F.lit(True))).select("a.*", *(f"b.{k}__middle" for k in varied))
    whole = []
    for k, p in parts:
        c = f"{k}__{p}"
        away = F.col(f"{k}__mean") - F.col(f"{k}__middle") if p == "m2" else None
        whole.append((mean(k) if p == "mean" else F.sum(F.col(c) + F.col(f"{k}__known") * away * away) if p == "m2" else _merge(p, c)).alias(c))
    return states.groupBy(*by).agg(F.sum("n_events").alias("n_events"), *whole)


def valued(states: DataFrame, by: list[str], specs: dict[str, dict]) -> DataFrame:
    """by, n_events and each metric of the states."""
    return states.select(*by, "n_events", *(_value(s, k).alias(k) for k, s in specs.items()))
