"""Text as the mapping tables need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tidy(c: Column) -> Column:
    """Lower case, stripped, never null."""
    return F.lower(stripped(F.coalesce(c.cast("string"), F.lit(""))))


def shown(c: Column, kind: str) -> Column:
    """A value as text: True and False, whole doubles with one decimal place, nan, inf and -inf; null stays null."""
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e16)
        odd = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
        return F.coalesce(odd, F.when(whole, F.concat(c.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string")))
    return c.cast("string")


def listed(c: Column) -> Column:
    """An array of texts joined by ', '; null stays null."""
    return F.array_join(c, ", ")


def cell(c: Column, kind: str) -> Column:
    """A cell as clean text: lists joined by ', ', objects as JSON, anything else stripped; null stays null."""
    if kind.startswith("array<string"):
        return listed(c)
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c)
    return stripped(shown(c, kind))


def filled(c: Column) -> Column:
    """Whether a cell holds something: not null, blank, nan, none or null."""
    return ~tidy(c).isin("", "nan", "none", "null")


def identity(*parts: Column) -> Column:
    """Parts joined by '|'; a missing part reads None."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def hundredths(name: str) -> Column:
    """A column of numbers of at most four places as text of two, rounded by the exact value of the double, ties to even; null stays null."""
    x = F.col(name)
    halves = F.round(x * 200).cast("long")  # the number lies at halves / 200, or not near a tie
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of the digits, so that products below are exact
    over = (high * 200 - halves) + (x - high) * 200
    lower = F.floor(halves / 2)
    up = F.when(halves % 2 == 0, lower).when(over > 0, lower + 1).when(over < 0, lower).otherwise(lower + lower % 2)
    return F.when(x.isNotNull(), F.format_string("%.2f", up / 100))
