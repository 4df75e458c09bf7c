"""The document pipeline: STAGES in order, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.llm import decontamination, language, ngram_join, packing, queries, toxicity
from watchtide.llm.common import materialize, table

#: A document whose words are of a known language with less certainty than this, or that has no letter at all, is rejected.
LEAST_CERTAIN = 0.5


def _digest(text: str) -> Column:
    return F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit(""))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a model fitted on the labelled documents of the learning folds."""
    return toxicity.without_toxic(docs, queries.toxicity_model(spark, sf_dir))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are of known languages, of one or of several, whatever their lang column says."""
    return language.keep_certain(docs, queries.language_model(spark, sf_dir), LEAST_CERTAIN)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, repeated rows and rows without an id among them: that of the least doc_id, null ids last."""
    row = next(n for n in map("_row{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = ngram_join.ngram_join(rows.select(row, "text"), key=row).select(F.col(row).alias("_id"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", _digest("text"), F.col(row).alias("row"))
    slim = rows.select(F.col(row).alias("_own"), order.alias("_order"))
    kept = slim.join(found, slim["_own"] == found["_id"]).groupBy("component_id").agg(F.min("_order")["row"].alias("_kept"))
    return rows.join(kept, rows[row] == kept["_kept"], "left_semi").drop(row)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Documents and items are told apart by their texts: ids may be null or repeated."""
    return decontamination.without_leaked(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaked),
    ("best-fit packing", pack),
]

#: The learned stages, the similarity join and the tokenizer have no SQL; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; an empty table gives no rows.

    Each row is decided on its text. A null text, or one without letters, is rejected as of no language. Rows of equal
    texts, repeated rows too, go together until one of them stays; of rows alike in id and text any one. Columns other
    than doc_id and text pass through, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
