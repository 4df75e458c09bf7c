"""Event times: epoch numbers, numeric strings and ISO strings. The session zone is UTC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that an event's time is looked for in, in this order.
TIME_FIELDS = ("timestamp", "zeek.ts", "conn.ts", "dns.ts", "http.ts", "ssl.ts", "ssh.ts", "ts")


def iso_time(epoch: Column) -> Column:
    """Epoch seconds as a UTC ISO string, milliseconds truncated; null stays null."""
    moment = F.timestamp_micros(F.floor(epoch.cast("double") * 1000).cast("long") * 1000)
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def event_time(value: Column) -> Column:
    """A timestamp of an epoch number, a numeric string or an ISO string; null where it is none of them.

    Numbers come first: '2026' is the 2,026th second.
    """
    text = value.cast("string")
    number = text.try_cast("double")
    return F.coalesce(
        F.when(F.abs(number) < 2.5e11, F.timestamp_micros(F.round(number * 1e6).cast("long"))),
        F.when(number.isNull(), F.try_to_timestamp(text)),
    )


def first_time(*values: Column) -> Column:
    """The first of the values that is a time."""
    return F.coalesce(*map(event_time, values))


def nested_event_time(value: Column) -> Column:
    """As event_time, for sources whose numeric strings aren't times."""
    text = value.cast("string")
    return F.when(text.try_cast("double").isNull(), F.try_to_timestamp(text))


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def both(conditions: list[Column]) -> Column:
    """All of them; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def either(conditions: list[Column]) -> Column:
    """Any of them; false for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
