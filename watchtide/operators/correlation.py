"""Correlation rules: anchored time groups, entity groups, metrics, conditions, state and score."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions.addresses import in_network, network_size
from watchtide.functions.shared import written
from watchtide.functions.times import both, either
from watchtide.operators.predicates import Field, Fields, field_of, fields_of, metric_leaf
from watchtide.operators.timegroups import anchored_groups

# Names of aggregates and operators in rules.
FUNCTIONS = (
    "count", "nunique", "mean", "sum", "min", "max", "ratio", "standard_deviation", "coefficient_of_variation", "entropy", "rate", "subnet_density",
)
OPERATORS = (">", ">=", "<", "<=", "==", "!=", "in", "not_in", "is_null")
SECOND = 1_000_000
DETECTION = "mapping_id string, technique_id string, confidence double, time_group_id long, group_key string, n_events long, metrics string, score double"


def _in_values(field: Field, values: list) -> Column:
    """Whether the value is listed; a null one if null is."""
    return F.when(field.column.isNull(), F.lit(None in values)).otherwise(either([field.equals(v) for v in values if v is not None]))


def metric(spec: dict, fields: Fields) -> Column:
    """One aggregate expression of a specification {"function", "field", "values", "subnet", "window_seconds"}. entropy needs entropies()."""
    name, n = spec["function"], F.count(F.lit(1))
    if name == "count":
        return n.cast("double")
    if name == "rate":
        seconds = spec.get("window_seconds")
        return n.cast("double") if seconds is None else F.lit(0.0) if seconds <= 0 else n / F.lit(float(seconds))
    field = field_of(fields, spec["field"])
    x = field.number if not field.kind.startswith("array") else F.lit(None).cast("double")
    if name == "nunique":
        return F.count_distinct(field.column).cast("double")
    if name == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if name in ("mean", "min", "max"):
        return {"mean": F.avg, "min": F.min, "max": F.max}[name](x)
    if name == "ratio":
        return F.coalesce(F.count_if(_in_values(field, spec["values"])) / F.nullif(n, F.lit(0)), F.lit(0.0))
    if name == "standard_deviation":
        return F.coalesce(F.stddev_samp(x), F.lit(0.0))
    if name == "coefficient_of_variation":
        return F.when((F.count(x) < 2) | (F.avg(x) == 0), 0.0).otherwise(F.stddev_samp(x) / F.abs(F.avg(x)))
    if name == "subnet_density":
        inside = F.coalesce(in_network(field.column, spec["subnet"]), F.lit(False))
        return F.count_distinct(F.when(inside, field.column)) / F.lit(float(network_size(spec["subnet"])))
    raise ValueError(f"unknown aggregate {name}")


def entropies(events: DataFrame, keys: list[str], field: Field, name: str) -> DataFrame:
    """keys, name: Shannon entropy (bits) of the non-null values of each group, by counts of counts: no group is gathered."""
    counts = events.withColumn("_v", field.column).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    c = F.when(F.col("_v").isNotNull(), F.col("_c"))
    total = F.sum(c)
    return counts.groupBy(*keys).agg(F.coalesce(F.log2(total) - F.sum(c * F.log2(c)) / total, F.lit(0.0)).alias(name))


def window_seconds(rule: dict) -> float:
    """A rule's window; ValueError unless it is a number (or a text of one) above zero."""
    try:
        found = float(rule.get("window_seconds"))
    except (TypeError, ValueError):
        raise ValueError("correlation rule needs window_seconds, a number") from None
    if not found > 0:
        raise ValueError("window_seconds must be above zero")
    return found


def validate(rule: dict) -> None:
    """Raise ValueError unless the correlation rule is complete and uses known functions and operators."""
    for key in ("group_by", "aggregations", "conditions"):
        if key not in rule:
            raise ValueError(f"correlation rule lacks {key}")
    if not isinstance(rule["group_by"], list) or not isinstance(rule["aggregations"], dict) or not isinstance(rule["conditions"], list):
        raise ValueError("group_by and conditions are lists, aggregations a mapping")
    if "window_seconds" in rule:
        window_seconds(rule)
    specs = list(rule["aggregations"].values())
    if state := rule.get("state_condition"):
        specs.append({"function": state.get("aggregation"), "field": state.get("field"), "values": state.get("values", [])})
    for spec in specs:
        if spec.get("function") not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {spec.get('function')}")
        if spec["function"] not in ("count", "rate") and not spec.get("field"):
            raise ValueError(f"{spec['function']} needs a field")
        if spec["function"] == "ratio" and not isinstance(spec.get("values"), list):
            raise ValueError("ratio needs a list of values")
        if spec["function"] == "subnet_density" and not spec.get("subnet"):
            raise ValueError("subnet_density needs a subnet")
    for condition in [*rule["conditions"], *([state] if state else [])]:
        if condition.get("operator") not in OPERATORS:
            raise ValueError(f"unknown operator {condition.get('operator')}")
        if "metric" in condition and condition["metric"] not in rule["aggregations"]:
            raise ValueError(f"unknown metric {condition['metric']}")
        if condition["operator"] != "is_null" and "value" not in condition:
            raise ValueError("condition without a value")


def _specs(rule: dict) -> dict[str, dict]:
    """A rule's aggregates by metric, the state's under "state"."""
    specs = dict(rule["aggregations"])
    if state := rule.get("state_condition"):
        specs["state"] = {"function": state["aggregation"], "field": state.get("field"), "values": state.get("values", [])}
    return specs


def _aggregated(events: DataFrame, group_by: list[str], specs: dict[str, dict], fields: Fields, keys: tuple[str, ...]) -> DataFrame:
    """keys, g_0, g_1, ... (the group_by fields), n_events and a column for each specification, of every group."""
    by = [*keys, *(f"g_{i}" for i in range(len(group_by)))]
    events = events.select("*", *(field_of(fields, f).column.alias(f"g_{i}") for i, f in enumerate(group_by)))
    plain = {k: s for k, s in specs.items() if s["function"] != "entropy"}
    out = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), *(metric(s, fields).alias(k) for k, s in plain.items()))
    for k, s in specs.items():
        if s["function"] == "entropy":
            more = entropies(events, by, field_of(fields, s["field"]), k)
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] or [F.lit(True)]
            out = out.alias("a").join(more.alias("b"), reduce(lambda x, y: x & y, same)).select("a.*", f"b.{k}")
    return out


def _outcome(rule: dict, column: Callable[[str], str]) -> tuple[Column, Column, Column]:
    """condition_results, detected and score of a rule over aggregates, whose columns `column` names."""

    def holds(name: str, c: dict) -> Column:
        return metric_leaf(Field(F.col(column(name)), "double"), c["operator"], c.get("value"), "value" in c)

    state, scoring = rule.get("state_condition"), rule.get("scoring") or {}
    in_state = holds("state", state) if state else F.lit(True)
    score = F.lit(float(scoring.get("base_weight", 1.0))) * F.when(in_state, float(scoring.get("state_condition_weight", 1.0)) if state else 1.0).otherwise(1.0)
    told = [holds(c["metric"], c) for c in rule["conditions"]]
    each = [F.struct(F.lit(c["metric"]).alias("metric"), F.col(column(c["metric"])).cast("double").alias("value"), h.alias("holds")) for c, h in zip(rule["conditions"], told, strict=True)]
    results = F.array(*each) if each else F.array().cast("array<struct<metric:string,value:double,holds:boolean>>")
    return results, both(told) & in_state, score


def correlate(events: DataFrame, rule: dict, names: dict[str, str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for every group: keys, group_by fields, a column for each metric, state, condition_results, detected, score.

    Events of a group are those equal in keys and in the group_by fields (null is a value); an empty group_by is one
    group. names: field -> column; a field that events don't have is null. condition_results tells of each condition,
    in order, its metric, value and whether it holds. detected: all hold and so does the state condition, if any.
    """
    validate(rule)
    out = _aggregated(events, rule["group_by"], _specs(rule), fields_of(events, names), keys)
    results, detected, score = _outcome(rule, lambda name: name)
    out = out.withColumn("condition_results", results).withColumn("detected", detected).withColumn("score", score)
    return out.withColumnsRenamed({f"g_{i}": f for i, f in enumerate(rule["group_by"])})


def detect(events: DataFrame, mappings: list[dict], names: dict[str, str] | None = None, time: str = "t", log_type: str = "log_type") -> DataFrame:
    """Detections of all mappings: mapping_id, technique_id, confidence, time_group_id, group_key, n_events, metrics, score; no rows without mappings.

    events: time in microseconds. Time groups are formed over all events of a mapping's log types, before entities
    are told apart; events without a time are dropped. group_key and metrics are JSON. A rule without a window above
    zero is an error. Mappings alike in log types, window and group_by share a scan, their time groups and one
    aggregate, in which equal metrics are computed once.
    """
    if not mappings:
        return events.sparkSession.createDataFrame([], DETECTION)
    shapes = by_shape(mappings)
    spans = sorted({s[:2] for s in shapes})
    times = [of_types(events, wanted, log_type).select(F.lit(str(i)).alias("rule"), F.lit(w).cast("long").alias("w"), F.col(time).alias("t")) for i, (wanted, w) in enumerate(spans)]
    groups = written(anchored_groups(reduce(DataFrame.unionByName, times)), "groups")

    def grouped(wanted: tuple, w: int) -> DataFrame:
        mine = groups.where(F.col("rule") == str(spans.index((wanted, w)))).select(F.col("t").alias("_t"), "time_group_id")
        return of_types(events, wanted, log_type).join(mine, F.col(time) == F.col("_t")).drop("_t")

    return detections(grouped, shapes, fields_of(events, names))


def by_shape(mappings: list[dict]) -> dict[tuple, list[dict]]:
    """Valid mappings by (log types, window in microseconds, group_by): those of a shape share scan, groups and aggregate."""
    shapes: dict[tuple, list[dict]] = {}
    for m in mappings:
        validate(m["correlation_rule"])
        wanted = m.get("log_type") or []
        wanted = (wanted,) if isinstance(wanted, str) else tuple(sorted(wanted))
        shapes.setdefault((wanted, int(window_seconds(m["correlation_rule"]) * SECOND), tuple(m["correlation_rule"]["group_by"])), []).append(m)
    return shapes


def of_types(events: DataFrame, wanted: tuple, log_type: str) -> DataFrame:
    """Events of some log types; of all if none are named."""
    return events.where(F.col(log_type).isin(*wanted)) if wanted else events


def detections(grouped: Callable[[tuple, int], DataFrame], shapes: dict[tuple, list[dict]], fields: Fields) -> DataFrame:
    """Detections of all shapes; grouped gives the events of log types and window with their time_group_id."""
    found = []
    for (wanted, w, group_by), alike in shapes.items():
        specs: dict[str, dict] = {}
        named: list[dict[str, str]] = []
        for m in alike:
            told = {}
            for name, spec in _specs(m["correlation_rule"]).items():
                told[name] = next((k for k, s in specs.items() if s == spec), f"m_{len(specs)}")
                specs[told[name]] = spec
            named.append(told)
        out = _aggregated(grouped(wanted, w), list(group_by), specs, fields, ("time_group_id",))
        hits = []
        for m, told in zip(alike, named, strict=True):
            rule = m["correlation_rule"]
            _, detected, score = _outcome(rule, told.__getitem__)
            made = F.struct(
                F.lit(m["mapping_id"]).alias("mapping_id"),
                F.lit((m.get("attack_technique") or {}).get("technique_id")).cast("string").alias("technique_id"),
                F.lit(m.get("confidence_score")).cast("double").alias("confidence"),
                (F.to_json(F.struct(*(F.col(told[k]).alias(k) for k in rule["aggregations"]))) if rule["aggregations"] else F.lit("{}")).alias("metrics"),
                score.alias("score"),
            )
            hits.append(F.when(detected, made))
        key = F.to_json(F.struct(*(F.col(f"g_{i}").alias(f) for i, f in enumerate(group_by)))) if group_by else F.lit("{}")
        out = out.select("time_group_id", key.alias("group_key"), "n_events", F.explode(F.array_compact(F.array(*hits))).alias("_d"))
        found.append(out.select("_d.mapping_id", "_d.technique_id", "_d.confidence", "time_group_id", "group_key", "n_events", "_d.metrics", "_d.score"))
    return reduce(DataFrame.unionByName, found)
