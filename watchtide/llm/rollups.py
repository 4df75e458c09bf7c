"""Delta-maintained token rollups.

A batch of changes (insert, revise, delete of a document's count under a tokenizer version) is turned into signed
rows against the current state and summed by source, language and tokenizer version. A batch leaves two Parquet
tables under `<root>/rows/batch=<id>` (the new state of what it changed) and `<root>/deltas/batch=<id>` (the signed
sums), and is committed by the last write, an empty file `<root>/commits/<id>`. Tables without it don't count, so a
batch that dies half way is overwritten when it is tried again, and a committed one is never applied twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.llm.common import materialize, slices, small_batches
from watchtide.llm.tokens import default_path, space_counts, space_parted, whole_words, word_ids

INSERT, REVISE, DELETE = "insert", "revise", "delete"
GROUP = ["source", "lang", "tokenizer"]
ROWS = "doc_id long, part string, tokenizer string, source string, lang string, n_tokens long, alive boolean"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, name: str, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their text, with tokenizer = name and n_tokens (null and empty texts: 0) by the file at path. Columns of these two names are replaced.

    Files of a tokenizer that lower-cases and parts at white space are counted word by word, and byte-level ones that
    keep the space before a word by spaces with their word, both with a cache; others by encoding whole texts. Special
    tokens are taken as plain text by the last two.
    """
    import pyarrow as pa

    path = path or default_path(name)
    by_word, by_space = whole_words(path), space_parted(path)
    rest = [c for c in docs.columns if c not in (text, "n_tokens", "tokenizer")]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if by_word:
            encoder = word_ids(path)
        elif by_space:
            counter = space_counts(path)
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
        for batch in slices(batches, len(rest)):
            texts = batch.column(len(rest)).to_pylist()
            if by_word:
                n = [len(encoder.text(t)) // 4 for t in texts]
                encoder.trim()
            elif by_space:
                n = [counter.text(t) for t in texts]
            else:
                n = [len(whole.encode(t, add_special_tokens=False)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, text).mapInArrow(counted, f"{fields}, n_tokens long").withColumn("tokenizer", F.lit(name))


class Rollup:
    """Totals by source, language and tokenizer version under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[int]:
        """Committed batches in order."""
        fs, path = self._at("commits")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, name: str, schema: str, ids: list[int]) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        parts = [f"{self.root}/{name}/batch={i}" for i in ids]
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.root}/{name}").parquet(*parts)

    def _base(self) -> int | None:
        """The batch up to which rows and deltas are compacted."""
        fs, path = self._at("bases")
        return max((int(x.getPath().getName()) for x in fs.listStatus(path)), default=None) if fs.exists(path) else None

    def _history(self, name: str, schema: str) -> DataFrame:
        """Rows or deltas of all committed batches; those up to the compacted one in compacted form."""
        ids, base = self.batches(), self._base()
        if base is None:
            return self._read(name, schema, ids)
        compact = self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/compact/{base}/{name}")
        return compact.unionByName(self._read(name, schema, [i for i in ids if i > base]))

    def state(self, of: DataFrame | None = None) -> DataFrame:
        """The last committed row of every (doc_id, part, tokenizer), deleted ones with alive = false; only of the keys in `of`, if given, whose history alone is then gathered."""
        rows = self._history("rows", ROWS).withColumn("part", F.coalesce("part", F.lit("")))
        if of is not None:
            keys = of.select("doc_id", "part", "tokenizer").distinct()
            same = F.expr("h.doc_id <=> n.doc_id AND h.part = n.part AND h.tokenizer <=> n.tokenizer")
            rows = rows.alias("h").join(keys.alias("n"), same, "left_semi")
        last = F.max_by(F.struct("source", "lang", "n_tokens", "alive"), "batch").alias("s")
        return rows.groupBy("doc_id", "part", "tokenizer").agg(last).select("doc_id", "part", "tokenizer", "s.*")

    def compact(self) -> None:
        """Keep one row of each key that is alive, and one sum of each group, for all batches committed so far. Totals stay as they are; a compaction that dies half way doesn't count."""
        ids = self.batches()
        if not ids or self._base() == ids[-1]:
            return
        at = f"{self.root}/compact/{ids[-1]}"
        self.state().where("alive").withColumn("batch", F.lit(ids[-1])).write.mode("overwrite").parquet(f"{at}/rows")
        self._sums().withColumn("batch", F.lit(ids[-1])).write.mode("overwrite").parquet(f"{at}/deltas")
        fs, path = self._at(f"bases/{ids[-1]}")
        fs.create(path, True).close()

    def _sums(self) -> DataFrame:
        return self._history("deltas", DELTAS).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (doc_id, tokenizer, action, source, lang, n_tokens, seq where order matters, and part where ids may be null or shared); False if done before.

        part tells the documents of one doc_id, or without one, apart: a change names the part that it was inserted
        with; without the column there is one. Of several changes to one (doc_id, part, tokenizer) in a batch the one of greatest seq holds (then the greatest
        action and values); null ids of one part are one document. Inserting what is there revises it; deleting or revising
        what isn't there deletes nothing or inserts. A null count is 0. Batches must come in rising order.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes before the committed batch {done[-1]}")
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        last = F.max(F.struct(seq.alias("q"), "action", "source", "lang", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))).alias("c")
        part = F.coalesce(F.col("part").cast("string"), F.lit("")) if "part" in changes.columns else F.lit("")
        incoming = changes.groupBy(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), "tokenizer").agg(last)
        rows = incoming.select("doc_id", "part", "tokenizer", "c.source", "c.lang", "c.n_tokens", (F.col("c.action") != DELETE).alias("alive"))
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch}")
        fresh = self.spark.read.schema(ROWS).parquet(f"{self.root}/rows/batch={batch}")
        signed = fresh.where("alive").select(*GROUP, F.lit(1).alias("sign"), "n_tokens")
        if done:
            was = self.state(fresh).where("alive")
            signed = signed.unionByName(was.select(*GROUP, F.lit(-1).alias("sign"), "n_tokens"))
        delta = signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        fs, path = self._at(f"commits/{batch}")
        fs.create(path, False).close()  # fails if another writer has committed the batch meanwhile
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of what is alive; groups without documents are left out."""
        return self._sums().where("n_docs <> 0")


def maintain(docs: DataFrame, root: str, first: str, second: str, revised: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Totals of docs after three batches, the second delivered twice.

    Batch 1 inserts all documents as counted by `first`, batch 2 all as counted by `second` and revises the first
    counts of the language `revised`; batch 3 deletes the copies of every text but the one of least key (null keys
    last), null texts excepted. A document is a key and a text; every row without a key is one of its own.
    """
    docs = docs.select(F.col(key).alias("doc_id"), "source", "lang", F.col(text).alias("text"), F.col(text).alias("again"), F.sha2(F.col(text).cast("binary"), 256).alias("digest"))
    said = count_tokens(docs, first).drop("tokenizer").withColumnRenamed("n_tokens", "n_first")
    both = count_tokens(said, second, text="again").drop("tokenizer").withColumnRenamed("n_tokens", "n_second")
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id().cast("string")).otherwise("")
    with small_batches(docs.sparkSession):  # whole texts pass through Arrow
        both = materialize(both.withColumn("part", F.concat_ws("/", "digest", own)), "counted")

    def changes(rows: DataFrame, tokenizer: str, n: str, action: str) -> DataFrame:
        return rows.select("doc_id", "part", "source", "lang", F.col(n).alias("n_tokens"), F.lit(tokenizer).alias("tokenizer"), F.lit(action).alias("action"))

    ledger = Rollup(docs.sparkSession, root)
    ledger.commit(1, changes(both, first, "n_first", INSERT))
    recount = changes(both, second, "n_second", INSERT).unionByName(changes(both.where(F.col("lang") == revised), first, "n_first", REVISE))
    ledger.commit(2, recount)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part")
    told = both.where("digest IS NOT NULL")
    kept = told.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("first.doc_id").alias("doc_id"), F.col("first.part").alias("part"), "digest")
    # a text's copies share its digest; what is deleted are the rows of such digests that aren't the kept one: two semi joins, so no group of copies is gathered beside a row
    copies = told.join(kept.select("digest"), "digest", "left_semi").alias("t").join(kept.alias("k"), F.expr("t.doc_id <=> k.doc_id AND t.part = k.part"), "left_anti")
    ledger.commit(3, changes(copies, first, "n_first", DELETE).unionByName(changes(copies, second, "n_second", DELETE)))
    ledger.commit(2, recount)
    return ledger.totals()
