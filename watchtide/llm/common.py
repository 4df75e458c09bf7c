"""What the training-data operators share: tables, shared scratch, ranks and components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of whole texts that a Python worker looks at together, about.
TEXT_ROWS, TEXT_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and driver and executors are one process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="watchtide-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; its scratch folder goes with it
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS):
    """Arrow batches of few rows for what is written within; the session's own setting is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def slices(batches: Iterator[pa.RecordBatch], text: int | None, rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into smaller ones, of at most `rows` rows and about TEXT_BYTES of the text column, if any (one row at least)."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64) if text is None else pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, side="right"))
            end = min(max(full, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def sampled(docs: DataFrame, key: str, text: str, label: str, most_docs: int, most_bytes: int, most_labels: int) -> list[tuple]:
    """(label, text) of a bounded sample for fitting a model: whole texts, at most most_docs and most_bytes of each label.

    Rows without key, text or label are left out, equal rows count once. Rows are taken in the order of a hash of key
    and text, so the sample doesn't depend on partitions; a text that no longer fits is passed over. The driver sees
    no more than the sample and the hashes and sizes of about twice as many rows.
    """
    own = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(label).isNotNull())
    own = own.select(F.col(label).alias("_l"), F.col(text).alias("_t"), F.xxhash64(key, text).alias("_h"))
    counts = own.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    if not counts:
        return []
    # rows below a limit of the hash: twice as many as are wanted, so that large ones may be passed over
    limits = docs.sparkSession.createDataFrame([(r[0], min(1.0, 2.0 * (most_docs + 50) / r[1])) for r in counts], own.select("_l", F.lit(0.0).alias("_share")).schema)
    unit = F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = own.join(F.broadcast(limits), "_l").where(unit < F.col("_share")).select("_l", "_h", F.octet_length("_t").alias("_b")).distinct()
    chosen, n, size = [], {}, {}
    for r in sorted(near.collect(), key=lambda r: (r["_h"] % (1 << 30), r["_h"])):
        held, held_bytes = n.get(r["_l"], 0), size.get(r["_l"], 0)
        if held < most_docs and held_bytes + r["_b"] <= most_bytes:
            n[r["_l"]], size[r["_l"]] = held + 1, held_bytes + r["_b"]
            chosen.append((r["_l"], r["_h"]))
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, own.select("_l", "_h").schema)
    rows = own.join(F.broadcast(wanted), ["_l", "_h"], "left_semi").dropDuplicates(["_l", "_h"]).orderBy("_h", "_l")
    return [(r["_l"], r["_t"]) for r in rows.select("_l", "_t", "_h").collect()]


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n: the fold rule of the learned operators; -1 for a null id, so that it is in no special fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def ranked(df: DataFrame, group: str, spread: list[str], chunk: int) -> DataFrame:
    """Add `rank` (long, gapless from 0 within group) without sorting a group in one task.

    A group of n rows is split into ceil(n / chunk) salted parts; parts are numbered on their own and shifted by
    the sizes of the parts before them. `group` must have few values (its counts are joined as a small table). Rows
    equal in `spread` are told apart by their place, so df must be a written table, as `materialize` gives.
    """
    df = df.withColumn("_place", F.monotonically_increasing_id())
    spread = [*spread, "_place"]
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    salts = counts.select(F.col(group).alias("_g"), F.ceil(F.col("_n") / chunk).cast("int").alias("_salts"))
    salted = df.join(F.broadcast(salts), F.col(group) == F.col("_g")).withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")
    )
    parts = salted.groupBy("_g", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("_g", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_g", "_salt").orderBy(*spread)
    numbered = salted.withColumn("_row", F.row_number().over(within) - 1)
    return (
        numbered.join(shift, ["_g", "_salt"])
        .withColumn("rank", (F.col("_row") + F.col("_shift")).cast("long"))
        .drop("_g", "_salt", "_salts", "_row", "_shift", "_place")
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (src, dst): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps; every step is a min aggregate and a join, so a hub's neighbours
    are never gathered. Each round's edges are written to the shared folder. Nodes without an edge don't appear.
    """
    now = edges.select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).where("u <> v").distinct()
    now = materialize(now, "components")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "components")
        found = state(now)
        if found == was:
            break
        was = found
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v"))
    return stars.groupBy("node").agg(F.min("root").alias("root"))
