"""Reading logs: lines to envelopes, rules, STIX bundles and tables; and writing results."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StringType

from watchtide.functions.text import stripped
from watchtide.functions.times import TIME_FIELDS, event_time, first_time, iso_time, nested_event_time
from watchtide.operators.semantic import first_filled
from watchtide.sources.catalog import column, fields, raw_name, raw_schema

BAD = "_bad_line"
#: Fields of STIX objects that the operators read.
OBJECT = (
    "id: string, type: string, name: string, description: string, relationship_type: string, source_ref: string, target_ref: string, "
    "external_references: array<struct<source_name: string, external_id: string>>, kill_chain_phases: array<struct<kill_chain_name: string, phase_name: string>>"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of text files, without white space of any kind at either end, that aren't blank. Lines end at \\n, \\r or \\r\\n."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("value")).where("value <> ''")


def decode_flat(raw: DataFrame, log_type: str, source: str = "Zeek", value: str = "value") -> DataFrame:
    """Typed events of JSON lines: telemetry_source, log_type, timestamp (ISO), event_time, a column for each field, and _bad_line.

    A missing field is null; a line that is no JSON object of the log's types has it in _bad_line and no fields.
    event_time is the first of the timestamp and the fields TIME_FIELDS that is a time.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*raw_schema(log_type).fields, T.StructField(BAD, T.StringType())])
    parsed = raw.select("*", F.from_json(F.col(value), schema, {"columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"}).alias("_r"))
    cols, ts = [], F.lit(None).cast("double")
    for f, kind in fields(log_type).items():
        own = F.col(f"_r.`{raw_name(log_type, f)}`")
        if kind == "time":
            ts = own if raw_name(log_type, f) == "ts" else ts
            own = iso_time(own)
        cols.append(own.alias(column(f)))
    kept = [c for c in raw.columns if c != value]
    others = [F.col(f"_r.`{raw_name(log_type, f)}`") for f in TIME_FIELDS if f in fields(log_type)]
    return parsed.select(
        *kept, F.lit(source).alias("telemetry_source"), F.lit(log_type).alias("log_type"), iso_time(ts).alias("timestamp"), first_time(iso_time(ts), *others).alias("event_time"), *cols, F.col(f"_r.{BAD}").alias(BAD)
    )


@pandas_udf(StringType())
def _repaired(lines: pd.Series) -> pd.Series:
    """JSON objects that repeat a key (the last one holds) or hold NaN and the like (null), in plain form; null for what is no object."""

    def one(line):
        if line is None:
            return None
        try:
            found = json.loads(line, parse_constant=lambda _: None)
        except ValueError:
            return None
        return json.dumps(found) if isinstance(found, dict) else None

    return lines.map(one)


def decode_nested(raw: DataFrame, log_type: str, source: str = "Wazuh", value: str = "value") -> DataFrame:
    """Alerts of JSON lines with any nesting: telemetry_source, log_type, id, event_id, provider, timestamp (as written), event_time, raw_event, decoded (variant), _bad_line.

    id is null where an alert has none; event_id and provider fall back from one filled field to the next, N/A in the
    end. A timestamp is a number or an ISO text; a text of a number is none. A line that is no JSON object has it in
    _bad_line; repeated keys and NaN literals don't make a line bad.
    """
    plain = F.try_parse_json(F.col(value))
    # only lines that fail reach Python
    v = F.coalesce(plain, F.try_parse_json(_repaired(F.when(plain.isNull(), F.col(value)))))
    v = F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)
    at = lambda path, kind="string": F.try_variant_get(F.col("decoded"), path, kind)
    out = raw.select(*(c for c in raw.columns if c != value), v.alias("decoded"), F.col(value).alias("raw_event"))
    written = F.schema_of_variant(F.try_variant_get(F.col("decoded"), "$.timestamp", "variant"))
    number = F.when(~F.coalesce(written.isin("STRING", "BOOLEAN", "VOID"), F.lit(True)), at("$.timestamp", "double"))
    return out.select(
        *(c for c in out.columns if c not in ("decoded", "raw_event")),
        F.lit(source).alias("telemetry_source"),
        F.lit(log_type).alias("log_type"),
        at("$.id").alias("id"),
        first_filled(at("$.rule.id"), at("$.id"), at("$.event_id")).alias("event_id"),
        first_filled(at("$.decoder.name"), at("$.provider")).alias("provider"),
        at("$.timestamp").alias("timestamp"),
        F.coalesce(F.when(number.isNotNull(), event_time(number)), nested_event_time(at("$.timestamp"))).alias("event_time"),
        "raw_event",
        "decoded",
        F.when(F.col("decoded").isNull(), F.col("raw_event")).alias(BAD),
    )


def nested_field(path: str, kind: str = "string"):
    """A field of a decoded alert by its dotted path; null where it is missing or of another type."""
    return F.try_variant_get(F.col("decoded"), "$." + path, kind)


def _counts() -> list:
    return [F.count(F.lit(1)).alias("lines"), F.count_if(F.col(BAD).isNull()).alias("decoded"), F.count_if(F.col(BAD).isNotNull()).alias("errors")]


def counters(decoded: DataFrame) -> DataFrame:
    """One row: lines, decoded, errors; a decoded frame has a row for each line, so one pass tells all."""
    return decoded.agg(*_counts())


def counted(decoded: DataFrame, name: str = "decode") -> DataFrame:
    """decoded, which counts itself while it is written or streamed.

    Give an Observation for name in a batch and ask its `get` after the action; of a stream, counts of each batch reach
    `Counts` (or any listener) under the text given. A count is of rows that pass: don't cut them off by a limit.
    """
    return decoded.observe(name, *_counts())


class Counts(StreamingQueryListener):
    """Totals of lines, decoded and errors over a stream's batches; spark.streams.addListener(Counts()). A batch is counted once, by its number."""

    def __init__(self, name: str = "decode"):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = found.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def totals(self) -> dict:
        return {k: sum(b[k] for b in self.batches.values()) for k in ("lines", "decoded", "errors")}


def load_rules(path: str) -> list[dict]:
    """Rules of a JSON file: a list, or an object with mappings."""
    found = json.loads(Path(path).read_text())
    found = found.get("mappings") if isinstance(found, dict) else found
    if not isinstance(found, list):
        raise ValueError("a rule file holds a list or an object with mappings")
    return found


def sources(path: str) -> list[dict]:
    """The registry of sources: a JSON list, or an object with sources; each has id, source, log_type, remote_path, decoder."""
    found = json.loads(Path(path).read_text())
    return found["sources"] if isinstance(found, dict) else found


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The objects of STIX bundles, one document a file: bundle_id (the file's path), ordinal and the fields of OBJECT; broken files give none."""
    found = spark.read.schema(f"objects array<struct<{OBJECT}>>").option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    found = found.select(F.col("_metadata.file_path").alias("bundle_id"), F.posexplode("objects").alias("ordinal", "_o"))
    return found.select("bundle_id", "ordinal", "_o.*")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    stats = "struct<group_count: long, cooccurrence: double, global_rarity: double, combined_score: double>"
    return spark.read.schema(f"technique_relations map<string, struct<related_techniques: map<string, {stats}>>>").option("multiLine", True).json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def append_events(events: DataFrame, path: str, form: str = "json") -> None:
    """Append events under a folder for each log type."""
    events.write.partitionBy("log_type").mode("append").format(form).save(path)


def read_events(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(form).load(path)


def flatten(rows: DataFrame, separator: str = ".") -> DataFrame:
    """rows with the fields of structs, at any depth, as columns of their own: outer, separator, inner."""
    from pyspark.sql import types as T

    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return rows.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(rows.schema)))


def write_table(rows: DataFrame, path: str) -> None:
    """CSV part files with a header; arrays are joined by ', '."""
    cells = [F.array_join(c, ", ").alias(c) if kind.startswith("array<string") else F.col(f"`{c}`") for c, kind in rows.dtypes]
    rows.select(*cells).write.mode("overwrite").csv(path, header=True)


def write_document(rows: DataFrame, path: str) -> None:
    """JSON part files, one object a line, nulls left out."""
    rows.write.mode("overwrite").json(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """The table of a Markov model."""
    counts.write.mode("overwrite").parquet(path)


def report(matches: DataFrame) -> DataFrame:
    """A line of text for each semantic match."""
    return matches.select(F.format_string("%s %s score=%.2f [%s]", "mapping_id", "technique_id", "score", F.array_join("matched_conditions", "; ")).alias("line"))


def detection_report(detections: DataFrame) -> DataFrame:
    """A line of text for each detection of a correlation."""
    return detections.select(F.format_string("%s %s group=%s window=%d events=%d score=%.2f %s", "mapping_id", "technique_id", "group_key", "time_group_id", "n_events", "score", "metrics").alias("line"))


def pair_report(found: DataFrame) -> DataFrame:
    """A line of text for each pair."""
    return found.select(F.format_string("%s %s -> %s confidence=%.2f [%s]", "mapping_id", F.col("source_uid").cast("string"), F.col("followup_uid").cast("string"), "confidence", F.array_join("evidence", "; ")).alias("line"))


def summary(results: DataFrame, by: str = "technique_id") -> DataFrame:
    """by, n, best: results of each technique and their greatest score."""
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
