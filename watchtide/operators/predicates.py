"""Declarative conditions compiled to Catalyst expressions: one tree, four dialects of leaves.

A field is a Column with its type name. Conditions are {"field", "operator", "value"} leaves or
{"logic", "conditions"} nodes. Compiled conditions are never null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.functions.text import shown
from watchtide.functions.times import both, either

#: Texts that are numbers; a cast alone would take "1d" too.
_NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?|nan))\s*$"
_ORDER = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class Field:
    column: Column
    kind: str

    def comparable(self, value: Any) -> bool:
        """Whether a literal's type can equal the field's values; true and false are numbers too."""
        return isinstance(value, str) if self.kind == "string" else isinstance(value, (bool, int, float)) and self.kind in (*_NUMBERS, "boolean")

    @property
    def number(self) -> Column:
        """As a double; null where the value is no number."""
        if self.kind == "boolean":
            return self.column.cast("int").cast("double")
        if self.kind == "string":
            return F.when(self.column.rlike(_NUMBER), F.trim(self.column).try_cast("double"))
        return self.column.try_cast("double") if self.kind in _NUMBERS or self.kind.startswith("decimal") else F.lit(None).cast("double")

    @property
    def ordered(self) -> Column:
        """As a number that compares: null where it is none or NaN, which is neither equal to, less nor greater than anything."""
        return F.when(~F.isnan(self.number), self.number)

    def equals(self, value: Any) -> Column:
        """Never null: nothing equals null."""
        if not self.comparable(value):
            return F.lit(False)
        return _never_null(self.column == F.lit(value) if self.kind == "string" else self.ordered == F.lit(float(value)))


Fields = dict[str, Field]


def fields_of(df, names: dict[str, str] | None = None) -> Fields:
    """Fields of a DataFrame's columns; names: field name -> column name, by default the same."""
    kinds = dict(df.dtypes)
    return {f: Field(F.col(f"`{c}`"), kinds[c]) for f, c in (names or {c: c for c in kinds}).items()}


def field_of(fields: Fields, name: str) -> Field:
    """A field by its exact name, else by its dotted path in a column of structs, else null: no event has it."""
    if name in fields:
        return fields[name]
    for at in range(name.count("."), 0, -1):
        parts = name.split(".")
        head = fields.get(".".join(parts[:at]))
        if head is None:
            continue
        column, kind = head.column, T.DataType.fromDDL(head.kind) if head.kind.startswith("struct") else None
        for part in parts[at:]:
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                kind = None
                break
            column, kind = column.getField(part), kind[part].dataType
        if kind is not None:
            return Field(column, kind.simpleString())
        if head.kind == "variant":
            return Field(F.try_variant_get(head.column, "$." + ".".join(parts[at:]), "string"), "string")
    return Field(F.lit(None).cast("string"), "string")


def _never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _typed(field: Field, op: str, value: Any) -> Column:
    """Comparison without coercion between texts and numbers, for non-null values."""
    if op == "==":
        return field.equals(value)
    if op == "!=":
        return ~field.equals(value)
    if op in _ORDER:
        if not field.comparable(value):
            return F.lit(False)
        return _ORDER[op](field.column, F.lit(value)) if field.kind == "string" else _ORDER[op](field.ordered, F.lit(float(value)))
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{op} needs a list")
        found = either([field.equals(v) for v in value])
        return found if op == "in" else ~found
    raise ValueError(f"unknown operator {op}")


def semantic_leaf(field: Field, op: str, value: Any = None, given: bool = True) -> Column:
    """Leaf of the flat-event dialect: case-sensitive, null fails everything but is_null."""
    null = field.column.isNull()
    if op == "is_null":
        wanted = value if given else True
        return null if wanted is True else ~null if wanted is False else F.lit(False)
    if op in ("contains", "startswith", "endswith"):
        if field.kind != "string":
            return F.lit(False)
        return _never_null(getattr(field.column, op)(str(value)))
    return ~null & _never_null(_typed(field, op, value))


def alert_leaf(field: Field, op: str, value: Any = None, given: bool = True) -> Column:
    """Leaf of the nested-alert dialect: equality also of trimmed texts, case-insensitive text tests; unknown operators fail."""
    op = op.strip().lower()
    null = field.column.isNull()
    if op == "is_null":
        return null
    many = field.kind.startswith("array")

    def same(c: Column, kind: str, v: Any) -> Column:
        plain = Field(c, kind).equals(v)
        return _never_null(plain) | _never_null(F.trim(shown(c, kind)) == F.lit(str(v).strip()))

    inner = field.kind[6:-1] if many else field.kind
    if op in ("==", "!="):
        found = F.lit(False) if many else same(field.column, inner, value)
        return ~null & (found if op == "==" else ~found)
    if op in ("in", "not_in"):
        if isinstance(value, (list, tuple)):
            found = F.lit(False) if many else either([same(field.column, inner, v) for v in value])
        elif isinstance(value, str) and field.kind == "string":
            found = F.lit(value).contains(field.column)
        else:
            found = F.lit(False)
        return _never_null(~null & (found if op == "in" else ~found))
    if op == "contains":
        if many:
            return _never_null(F.exists(field.column, lambda x: same(x, inner, value)))
        return _never_null(F.contains(F.lower(field.column), F.lower(F.lit(value)))) if field.kind == "string" and isinstance(value, str) else F.lit(False)
    if op in ("startswith", "endswith"):
        if field.kind != "string" or not isinstance(value, str):
            return F.lit(False)
        return _never_null(getattr(F, op)(F.lower(field.column), F.lower(F.lit(value))))
    if op in _ORDER and not many:
        try:
            bound = float(value)
        except (TypeError, ValueError):
            return F.lit(False)
        return _never_null(_ORDER[op](field.ordered, F.lit(bound))) if not math.isnan(bound) else F.lit(False)
    return F.lit(False)


def metric_leaf(field: Field, op: str, value: Any = None, given: bool = True) -> Column:
    """Leaf over a correlation's metrics: is_null tests against its value, which is false if not given."""
    if op == "is_null":
        return field.column.isNull() if given and bool(value) else field.column.isNotNull()
    return field.column.isNotNull() & _never_null(_typed(field, op, value))


Leaf = Callable[..., Column]


def leaves(tree: dict) -> list[dict]:
    """Leaves in depth-first order."""
    if "conditions" in tree:
        return [leaf for t in tree["conditions"] for leaf in leaves(t)]
    return [tree] if tree else []


def leaf_of(tree: dict, fields: Fields, leaf: Leaf) -> Column:
    field = field_of(fields, tree["field"])
    return leaf(field, tree.get("operator", "=="), tree.get("value"), "value" in tree)


def semantic_tree(tree: dict, fields: Fields) -> Column:
    """AND or OR in any case; an empty node is false."""
    if "conditions" not in tree:
        return leaf_of(tree, fields, semantic_leaf) if tree else F.lit(False)
    parts = [semantic_tree(t, fields) for t in tree["conditions"]]
    logic = str(tree.get("logic", "AND")).upper()
    if logic not in ("AND", "OR"):
        raise ValueError(f"unknown logic {logic}")
    return F.lit(False) if not parts else both(parts) if logic == "AND" else either(parts)


def alert_tree(tree: dict, fields: Fields) -> Column:
    """Exactly "AND" (the default) is AND, anything else OR; no condition at all is true, an empty AND true, an empty OR false."""
    if not tree:
        return F.lit(True)
    if "conditions" not in tree:
        return leaf_of(tree, fields, alert_leaf)
    parts = [alert_tree(t, fields) for t in tree["conditions"]]
    return both(parts) if tree.get("logic", "AND") == "AND" else either(parts)


def matched_leaves(tree: dict, fields: Fields, leaf: Leaf = semantic_leaf) -> Column:
    """Every true leaf in depth-first order, those under failed branches included, as 'field operator value' texts."""
    found = [F.when(leaf_of(t, fields, leaf), F.lit(f"{t['field']} {t.get('operator', '==')} {t.get('value')}")) for t in leaves(tree)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
