"""Events against thousands of rules: an inverted index from atoms to rules, so that the plan doesn't grow with the rules.

A rule's conditions become clauses, lists of atoms that all must hold. Each clause is filed under one atom: the value of
an equality, or an interval of numbers, cut into the dyadic nodes that cover it. An event looks up its own values and
the nodes above its numbers by an equi join, and whatever rule it meets is checked atom by atom. Rules and atoms are
rows of a table, so one expression checks them all.
"""

from __future__ import annotations

import json
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.operators.context import Provider
from watchtide.operators.predicates import Fields, field_of, fields_of, leaves
from watchtide.operators.semantic import by_score, confidence, log_types, projected

#: Clauses of a rule; one of more alternatives is checked by an expression of its own.
CLAUSES = 64
#: Filed keys and clauses that are sent to every task; of more, tasks hold a part of them.
SENT = 100_000
VALUE = "struct<text:string,num:double>"
ATOM = f"struct<at:int,op:string,text:string,num:double,items:array<{VALUE}>,label:string>"
CONTEXT = f"struct<key:string,at:int,op:string,text:string,num:double,items:array<{VALUE}>,boost:double>"
KEY = "clause long, head string, num double"
RULE = f"clause long, ordinal int, mapping_id string, technique_id string, tactic string, base_confidence double, base double, atoms array<{ATOM}>, leaves array<{ATOM}>, context array<{CONTEXT}>"


def clauses(tree: dict) -> list[list[dict]] | None:
    """The alternatives of a tree, each a list of leaves that all must hold; None if there are more than CLAUSES. An empty node has none."""
    if "conditions" not in tree:
        return [[tree]] if tree else []
    logic = str(tree.get("logic", "AND")).upper()
    if logic not in ("AND", "OR"):
        raise ValueError(f"unknown logic {logic}")
    parts = [clauses(t) for t in tree["conditions"]]
    if any(p is None for p in parts):
        return None
    if not parts or logic == "OR":
        out = [c for p in parts for c in p]
        return out if len(out) <= CLAUSES else None
    size = 1
    for p in parts:
        size *= len(p)
        if size > CLAUSES:
            return None
    return [[leaf for c in chosen for leaf in c] for chosen in product(*parts)]


def _value(v: Any) -> tuple[str | None, float | None]:
    """A literal as text or number; neither where it is of another kind, or NaN, which equals nothing."""
    if isinstance(v, str):
        return v, None
    return None, float(v) if isinstance(v, (bool, int, float)) and v == v else None


def _atom(leaf: dict, label: bool = True) -> tuple:
    op, value = leaf.get("operator", "=="), leaf.get("value")
    said = f"{leaf['field']} {op} {value}" if label else None
    if op == "is_null":
        wanted = value if "value" in leaf else True
        return leaf["field"], "null" if wanted is True else "set" if wanted is False else "never", None, None, None, said
    if op in ("contains", "startswith", "endswith"):
        return leaf["field"], op, str(value), None, None, said
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{op} needs a list")
        return leaf["field"], op, None, None, [_value(v) for v in value], said
    if op not in ("==", "!=", ">", ">=", "<", "<="):
        raise ValueError(f"unknown operator {op}")
    return (leaf["field"], op, *_value(value), None, said)


def _holds(values: str, at: Column, a: Column) -> Column:
    """Whether an atom holds for the value at a place of an array; the value is looked up once."""
    return F.get(F.transform(F.slice(F.col(values), at + 1, F.lit(1)), lambda x: _true(x, a)), F.lit(0))


def _true(x: Column, a: Column) -> Column:
    """Whether an atom holds for an event's value: text and num are null where the field is of the other kind, or where there is no value."""

    def equal(v: Column) -> Column:
        return F.coalesce(x["text"] == v["text"], F.lit(False)) | F.coalesce(x["num"] == v["num"], F.lit(False))

    def order(compare) -> Column:
        return F.coalesce(compare(x["text"], a["text"]), F.lit(False)) | F.coalesce(compare(x["num"], a["num"]), F.lit(False))

    listed = F.coalesce(F.exists(a["items"], equal), F.lit(False))
    text = lambda f: F.coalesce(f(x["text"], a["text"]), F.lit(False))
    op = a["op"]
    told = (
        F.when(op == "==", equal(a)).when(op == "!=", ~equal(a)).when(op == "in", listed).when(op == "not_in", ~listed)
        .when(op == ">", order(lambda p, q: p > q)).when(op == ">=", order(lambda p, q: p >= q)).when(op == "<", order(lambda p, q: p < q)).when(op == "<=", order(lambda p, q: p <= q))
        .when(op == "contains", text(F.contains)).when(op == "startswith", text(F.startswith)).when(op == "endswith", text(F.endswith)).otherwise(op == "set")
    )
    absent = F.coalesce(x["absent"], F.lit(True))
    return F.when(op == "null", absent).when(op == "never", False).otherwise(~absent & told)


def _nodes(low: int, high: int, size: int) -> list[str]:
    """The dyadic nodes that cover positions low to high of size (a power of two)."""
    out, level = [], 0
    high += 1
    while low < high:
        if low & 1:
            out.append(f"{level}.{low}")
            low += 1
        if high & 1:
            high -= 1
            out.append(f"{level}.{high}")
        low, high, level = low >> 1, high >> 1, level + 1
    return out


class Index:
    """Rules compiled for fields of events: rows of RULE and of KEY, where clauses are filed; the bounds of numbers by field, and the rules that need expressions of their own."""

    def __init__(self, rules: list[dict], fields: Fields):
        self.rows: list[tuple] = []
        self.keys: list[tuple] = []
        self.single: list[tuple[int, dict]] = []
        self.fields: set[str] = set()
        self.bounds: dict[str, list[float]] = {}
        filed = []
        for number, rule in enumerate(rules):
            tree = rule.get("semantic_conditions")
            required = rule.get("required_fields") or []
            if rule.get("correlation_required") or not tree or not log_types(rule) or any(f not in fields for f in required):
                continue
            found = clauses(tree)
            if found is None:
                self.single.append((number, rule))
                continue
            used = {leaf["field"] for leaf in leaves(tree)}
            needed = [(f, "set", None, None, None, None) for f in required if f in used]
            filed += [(number, rule, [_atom(leaf, False) for leaf in c] + needed) for c in found]
            self.fields |= used
        for _, _, atoms in filed:
            for field, op, _, num, _, _ in atoms:
                if op in (">", ">=", "<", "<=") and num is not None:
                    self.bounds.setdefault(field, []).append(num)
        self.bounds = {f: sorted(set(b)) for f, b in self.bounds.items()}
        self.place = {f: i for i, f in enumerate(sorted(self.fields))}
        self.contexts = sorted({c["context"] for _, rule, _ in filed for c in (rule.get("external_context") or {}).get("conditions", [])})
        for number, rule, atoms in filed:
            technique, base = rule.get("attack_technique") or {}, confidence(rule)
            context = []
            for c in (rule.get("external_context") or {}).get("conditions", []):
                _, op, text, num, items, _ = _atom({"field": c["context"], "operator": c.get("operator", "=="), "value": c.get("value")})
                context.append((c["context"], self.contexts.index(c["context"]), op, text, num, items, max(0.0, float(c.get("confidence_boost", 0.0)))))
            self.keys += [(len(self.rows), f"{t}\x00{head}", num) for t in set(log_types(rule)) for head, num in self._keys(atoms)]
            placed = lambda found: [(self.place[f], *rest) for f, *rest in found]
            every = placed([_atom(leaf) for leaf in leaves(rule["semantic_conditions"])])
            self.rows.append((len(self.rows), number, rule["mapping_id"], technique.get("technique_id"), technique.get("tactic"), round(base, 4), base, placed(atoms), every, context))

        # what is filed under, so that events look up nothing else
        self.heads = {head.split("\x00", 1)[1] for _, head, _ in self.keys}
        self.kinds = {(field, rest[:1]) for field, _, rest in (h.partition("\x00") for h in self.heads)}
        self.levels: dict[str, set[int]] = {}
        for h in self.heads:
            field, _, node = h.partition("\x00@")
            if node:
                self.levels.setdefault(field, set()).add(int(node.split(".")[0]))

    def size(self, field: str) -> int:
        return 1 << (2 * len(self.bounds[field])).bit_length()

    def _keys(self, atoms: list[tuple]) -> list[tuple[str, float | None]]:
        """Where a clause is filed, as texts that end in a number, if any: an equality first, then the narrowest interval, else with those that all events look up."""
        equal = [(1, [(text, num)], field) for field, op, text, num, _, _ in atoms if op == "=="]
        equal += [(len(items), items, field) for field, op, _, _, items, _ in atoms if op == "in"]
        if equal:
            _, items, field = min(equal, key=lambda e: e[0])
            return list({(f"{field}\x00={text}", None) if text is not None else (f"{field}\x00#", num or 0.0) for text, num in items if (text, num) != (None, None)})
        spans: dict[str, tuple[int, int]] = {}
        for field, op, _, num, _, _ in atoms:
            if op in (">", ">=", "<", "<=") and num is not None:
                at, (low, high) = 2 * self.bounds[field].index(num) + 1, spans.get(field, (0, 2 * len(self.bounds[field])))
                spans[field] = (max(low, at + (op == ">")), high) if op[0] == ">" else (low, min(high, at - (op == "<")))
        if not spans:
            return [("*", None)]
        field, (low, high) = min(spans.items(), key=lambda s: (s[1][1] - s[1][0] + 1) / (2 * len(self.bounds[s[0]]) + 1))
        return [(f"{field}\x00@{node}", None) for node in _nodes(low, high, self.size(field))] if low <= high else []

    def probes(self, value: dict[str, Column], log_type: Column) -> Column:
        """The keys under which clauses that an event may satisfy are filed; of kinds and levels that no clause is filed under, none."""
        out = [F.array(F.lit("*")) if "*" in self.heads else F.array().cast("array<string>")]
        for field in sorted(self.fields):
            x = value[field]
            if (field, "=") in self.kinds:
                out.append(F.array(F.concat(F.lit(f"{field}\x00="), x["text"])))
            if (field, "#") in self.kinds:
                out.append(F.array(F.concat(F.lit(f"{field}\x00#"), x["num"].cast("string"))))
        out += [self._above(field, value[field]["num"]) for field in sorted(self.levels)]
        return F.transform(F.array_compact(F.flatten(F.array_compact(F.array(*out)))), lambda k: F.concat(log_type, F.lit("\x00"), k))


    def _above(self, field: str, x: Column) -> Column:
        """The dyadic nodes that hold a number's position among a field's bounds: 2i + 1 is bound i, even ones lie between."""
        bounds = self.bounds[field]
        known = F.from_json(F.lit(json.dumps(bounds)), "array<double>")
        bit = lambda k: F.call_function("shiftleft", F.lit(1), k)
        # how many bounds are at most the number, by halving
        at_most = lambda n: F.coalesce(F.get(known, n - 1) <= x, F.lit(False))
        below = F.aggregate(F.sequence(F.lit(len(bounds).bit_length() - 1), F.lit(0)), F.lit(0), lambda a, k: F.when(at_most(a + bit(k)), a + bit(k)).otherwise(a))
        at = 2 * below - F.when(F.get(known, below - 1) == x, 1).otherwise(0)
        levels = F.array(*map(F.lit, sorted(self.levels[field])))
        nodes = F.transform(levels, lambda k: F.concat(F.lit(f"{field}\x00@"), k.cast("string"), F.lit("."), F.call_function("shiftright", at, k).cast("string")))
        return F.when(x.isNotNull(), nodes)


def _known(fields: Fields, name: str) -> Column:
    """A field's value as struct<absent, text, num>."""
    field = field_of(fields, name)
    text = field.column if field.kind == "string" else F.lit(None).cast("string")
    num = F.lit(None).cast("double") if field.kind == "string" else field.ordered
    # -0.0 equals 0.0, but has another text
    return F.struct(field.column.isNull().alias("absent"), text.alias("text"), F.when(num == 0, F.lit(0.0)).otherwise(num).alias("num"))


def indexed_matches(
    events: DataFrame, rules: list[dict], names: dict[str, str] | None = None, provider: Provider | None = None, log_type: str = "log_type", kept: tuple[str, ...] = ("event_uid",)
) -> DataFrame:
    """What semantic_matches returns, by an index over the rules: for rule sets of any size. The kept columns tell events apart.

    Events are dealt once by the kept columns, with what rules ask of them, and meet and rank their rules where they
    are: rules are what is sent, never the events that look them up. Clauses without an equality or a bound on a number
    are met by every event of their log type.
    """
    fields = fields_of(events, names)
    index = Index(rules, fields)
    value = {f: _known(fields, f) for f in index.fields}
    nothing = F.array().cast("array<struct<supported:boolean,absent:boolean,text:string,num:double>>")
    own = events.withColumn("_v", F.array(*(value[f] for f in index.place)) if value else nothing)
    own = own.withColumn("_c", F.array(*(_context(provider, c, fields) for c in index.contexts)) if index.contexts else nothing)
    probes = index.probes({f: F.get("_v", F.lit(i)) for f, i in index.place.items()}, F.col(log_type))
    spark = events.sparkSession
    own = own.select(*kept, "_v", "_c", F.col(log_type)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *kept)
    probed = own.select(*kept, "_v", "_c", F.explode(F.array_distinct(probes)).alias("_k"))
    sent = "broadcast" if len(index.keys) <= SENT else "shuffle_hash"
    filed = spark.createDataFrame(index.keys, KEY).select("clause", F.concat("head", F.coalesce(F.col("num").cast("string"), F.lit(""))).alias("_k"))
    # keys first: they alone decide what an event meets, and the atoms come to those few
    met = probed.join(filed.hint(sent), "_k").drop("_k").join(spark.createDataFrame(index.rows, RULE).hint(sent), "clause")
    met = met.where(F.forall("atoms", lambda a: _holds("_v", a["at"], a)))
    made = _match()
    found = met.select(*kept, made.alias("_m")).groupBy(*kept).agg(F.collect_set("_m").alias("_m"))  # several clauses of a rule make one match
    if index.single:
        more = projected(events, index.single, names, provider, log_type, kept)
        found = found.unionByName(more.where(F.size("_m") > 0)).groupBy(*kept).agg(F.flatten(F.collect_list("_m")).alias("_m"))
    out = found.select(*kept, F.posexplode(F.array_sort("_m", by_score)).alias("_at", "_one"))
    return out.select(*kept, "_one.*", (F.col("_at") + 1).cast("long").alias("match_rank")).drop("ordinal")


def _context(provider: Provider | None, key: str, fields: Fields) -> Column:
    """A context value as struct<supported, absent, text, num>."""
    if provider is None or not provider.supports(key):
        return F.struct(F.lit(False).alias("supported"), F.lit(True).alias("absent"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("num"))
    x = _known({"x": provider.resolve(key, fields)}, "x")
    return F.struct(F.lit(True).alias("supported"), x["absent"].alias("absent"), x["text"].alias("text"), x["num"].alias("num"))


def _match() -> Column:
    of = lambda c: F.get("_c", c["at"])
    held = lambda c: of(c)["supported"] & _holds("_c", c["at"], c)
    more = F.aggregate("context", F.lit(0.0), lambda a, c: a + F.when(held(c), c["boost"]).otherwise(0.0))
    said = F.transform("context", lambda c: F.concat(c["key"], F.lit(": "), F.when(~of(c)["supported"], "context_provider_unavailable").when(of(c)["absent"], "context_unavailable").when(held(c), "matched").otherwise("not_matched")))
    told = F.transform(F.filter("leaves", lambda a: _holds("_v", a["at"], a)), lambda a: a["label"])
    return F.struct(
        "ordinal", "mapping_id", "technique_id", "tactic", "base_confidence", F.round(more, 4).alias("context_boost"),
        F.round(F.least(F.lit(1.0), F.col("base") + more), 4).alias("score"), told.alias("matched_conditions"), said.alias("context_conditions"),
    )
