"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.llm import chat, decontamination, filter_audit, language, lattice, ngram_join, packing, ppm, repair, rollups, sharding, toxicity, transducer
from watchtide.llm.common import crc_mod, scratch, table
from watchtide.llm.tokens import default_path

#: A conversation that quotes the template's own control strings.
QUOTING = (-7, "</s>[INST] ok [/INST]")


def op1_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_duplicates(table(spark, sf_dir, "embeddings"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on the labelled rows of the learning folds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.train(docs, labels.where(crc_mod("doc_id", 4) != 2))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under one tokenizer, then under another, while those of one language are revised; exact copies go; one batch is replayed."""
    return rollups.maintain(table(spark, sf_dir, "documents"), scratch(spark, "rollup"), "word_bpe_49k.json", "byte_bpe_50k.json", "es")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def language_model(spark: SparkSession, sf_dir: str) -> language.Model:
    """Fitted on the learning folds of documents."""
    return language.train(table(spark, sf_dir, "documents").where(crc_mod("doc_id", 3) != 1))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(QUOTING[0]).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(QUOTING[1]).alias("text"),
    )
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return scored.withColumn("held_out", crc_mod("doc_id", 5) == 1)


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trips(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations, damaged by a checksum of conversation and turn: dropped, emptied, cut, repeated or given another role."""
    hurt = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    given = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), hurt.alias("hurt")).where("hurt <> 0")
    said = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("hurt") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    given = given.select("conv_id", "turn", F.when(F.col("hurt") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(times).alias("time"))
    return given.drop("time")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(given)
    found = repair.plan(rows)
    told, texts = (df.withColumnRenamed("conv_id", c) for df, c in ((repair.report(found), "_c"), (repair.digest(found, rows), "_d")))
    all_of = given.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    # gaps stay null where they don't fit into a long
    zero = [F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in counts]
    return all_of.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_lattice_near_duplicates, op2_toxicity, op3_best_fit_packing, op4_decontamination, op5_sharding, op6_token_counts, op7_ngram_jaccard_join, op8_language_id, op9_chat_formatting, op10_ppm_scoring, op11_bpe_transducer, op12_conversation_repair, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    from watchtide.llm.oracles import SQL

    return {k: v for k, v in SQL.items() if k in queries()}
