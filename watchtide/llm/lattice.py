"""Embedding near-duplicates by lattice hashing.

Random projections of a unit vector are decoded to points of the E8 lattice, two points to a cell, in several
tables; a vector lies in its own cell and probes the cells of the lattice neighbours nearest to it. Vectors that meet
in a cell are chained to the cell's least owner, so that the connected components of the chains hold every candidate
pair. A component is cut into blocks and a task takes a pair of blocks: it verifies cosines in double precision and
returns sums of links and spanning edges, so the pairs of a group never leave their task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import components, materialize, slices

THRESHOLD = 0.98
#: Tables, lattice points of a cell, and the length of a unit vector's projection to one coordinate, about. A pair of
#: cosine 0.98 in 64 dimensions meets with probability 0.996, one of 0.99 with 0.9997, one of 0.8 with 0.02.
TABLES, POINTS, SCALE = 8, 2, 0.8
#: Vectors of a block.
BLOCK = 8192


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def decode(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row of x: of the nearest of D8 and of D8 shifted by a half, the nearer."""

    def even(y: np.ndarray) -> np.ndarray:
        z = np.rint(y)
        odd = np.flatnonzero(z.sum(1) % 2 != 0)
        gap = y[odd] - z[odd]
        worst = np.abs(gap).argmax(1)
        z[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return z

    a, b = even(x), even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def _hash(points: list[np.ndarray], table: int) -> np.ndarray:
    h = np.full(len(points[0]), table + 1, np.uint64)
    for p in points:
        for column in (2 * p).astype(np.int64).astype(np.uint64).T:
            h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector: its own cell in every table, and the neighbouring cells that it probes."""
    n, d = unit.shape
    own, probed = np.empty((n, TABLES), np.int64), np.empty((n, TABLES, 2**POINTS - 1), np.int64)
    for t in range(TABLES):
        rng = np.random.default_rng([seed, t])
        at, near = [], []
        for _ in range(POINTS):
            x = unit @ rng.normal(size=(d, 8)) * SCALE + rng.uniform(0, 2, 8)
            v = decode(x)
            at.append(v)
            near.append(v + neighbours()[((x - v) @ neighbours().T).argmax(1)])
        own[:, t] = _hash(at, t)
        others = [c for c in itertools.product((0, 1), repeat=POINTS) if any(c)]
        for k, c in enumerate(others):
            probed[:, t, k] = _hash([near[i] if step else at[i] for i, step in enumerate(c)], t)
    return own, probed.reshape(n, -1)


def sketch(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label, digest of the vector and label, own and probed cells, vector; digest and cells are null where a vector can't link."""
    import hashlib

    import pyarrow as pa

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, None, 2000):
            ids, labels, raw = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            digest, own, probed = [None] * len(raw), [None] * len(raw), [None] * len(raw)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                if v and labels[i] is not None and None not in v:
                    by_size.setdefault(len(v), []).append(i)
            for some in by_size.values():
                x, fine = units(np.array([raw[i] for i in some], np.float64))
                if not fine.any():
                    continue
                a, b = cells(x[fine])
                for i, mine, theirs in zip(np.array(some)[fine], a, b, strict=True):
                    own[i], probed[i] = mine, theirs
                    digest[i] = hashlib.blake2b(repr((labels[i], len(raw[i]))).encode() + np.array(raw[i], np.float64).tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(digest, pa.binary()), pa.array(own, longs), pa.array(probed, longs), batch.column(2)], names=["id", "label", "digest", "own", "probed", "vector"])

    return vectors.where(F.col(key).isNotNull()).select(key, label, vector).mapInArrow(
        run, f"id {kinds[key]}, label {kinds[label]}, digest binary, own array<long>, probed array<long>, vector {kinds[vector]}"
    )


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and which of them could be: finite and not zero."""
    top = np.abs(x).max(1, keepdims=True) if x.shape[1] else np.zeros((len(x), 1))
    fine = np.isfinite(top[:, 0]) & (top[:, 0] > 0)
    scaled = x / np.where(fine, top[:, 0], 1.0)[:, None]
    return scaled / np.where(fine, np.sqrt((scaled**2).sum(1)), 1.0)[:, None], fine


def _verify(threshold: float):
    from watchtide.llm.ngram_join import _roots

    def run(table):
        import pyarrow as pa

        rep, root, block, m = (table.column(c).to_numpy() for c in ("rep", "root", "block", "m"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sizes = np.array(table.column("vector").combine_chunks().value_lengths())
        flat = np.asarray(table.column("vector").combine_chunks().flatten(), np.float64)
        weight, ps, qs = np.zeros(len(rep), np.int64), [], []
        ends = np.cumsum(sizes)
        order = np.lexsort((sizes, root))
        cut = np.flatnonzero((np.diff(root[order]) != 0) | (np.diff(sizes[order]) != 0)) + 1
        for own in np.split(order, cut):
            d = sizes[own[0]]
            x, _ = units(flat[(ends[own] - d)[:, None] + np.arange(d)])
            a, b = np.flatnonzero(block[own] == i), np.flatnonzero(block[own] == j)
            for at in range(0, len(a), 512):
                part = a[at : at + 512]
                p, q = np.nonzero(x[part] @ x[b].T >= threshold)
                p, q = own[part[p]], own[b[q]]
                keep = rep[p] < rep[q] if i == j else rep[p] != rep[q]
                p, q = p[keep], q[keep]
                np.add.at(weight, p, m[q])
                np.add.at(weight, q, m[p])
                top = _roots(len(rep), p, q)  # a chunk's links come down to spanning edges
                ps.append(np.flatnonzero(top != np.arange(len(rep))))
                qs.append(top[ps[-1]])
        top = _roots(len(rep), np.concatenate(ps), np.concatenate(qs)) if ps else np.arange(len(rep))
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, top, rep)
        some = weight > 0
        return pa.table({"rep": rep[some], "weight": weight[some], "top": least[top[some]]})

    return run


def lattice_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per key: key, n_links (other vectors of its label with cosine >= threshold), component_id, kept.

    component_id is the least key reachable by links, itself included; kept is key = component_id. Vectors that are
    null, empty, zero or hold a null or non-finite component, and those without a label, link with nothing; vectors
    of different sizes don't link. Equal vectors are one class with a count. Rows without a key are left out;
    repeated rows are one vector, and different vectors under one key are vectors of their own, with a row each; an
    empty table gives no rows; other columns are ignored. Keys are integers.
    """
    made = materialize(sketch(vectors, key, vector, label), "lattice")
    ids = made.select(F.col("id").cast("long").alias("id"), "digest").distinct()
    counted = ids.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"))
    # a class has a number of its own, since one key may stand before several vectors
    classes = materialize(counted.withColumn("rep", F.monotonically_increasing_id()), "classes")
    held = made.withColumn("id", F.col("id").cast("long"))
    first = held.join(classes, (held["digest"] == classes["digest"]) & (held["id"] == classes["least"])).select("rep", "m", "label", "vector", "own", "probed")
    reps = materialize(first.dropDuplicates(["rep"]), "reps")

    mine = reps.select("rep", "label", F.explode("own").alias("cell"))
    least = mine.groupBy("label", "cell").agg(F.min("rep").alias("low"))
    visits = mine.union(reps.select("rep", "label", F.explode("probed").alias("cell")))
    chains = visits.join(least, ["label", "cell"]).where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")).distinct()
    clusters = materialize(components(chains), "clusters")

    inside = materialize(reps.join(clusters, reps["rep"] == clusters["node"]).select("rep", "m", "vector", "root"), "inside")
    size = inside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    total = inside.count()
    bundles = max(1, total // BLOCK)
    full = inside.join(size, "root")
    # small clusters share tasks; a large one has a task for each pair of its blocks
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root") + bundles)
    grid = full.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = grid.select(task.alias("task"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "m", "root", "vector")
    checked = materialize(grid.groupBy("task", "i", "j").applyInArrow(_verify(threshold), "rep long, weight long, top long"), "links")

    roots = components(checked.where("rep <> top").select(F.col("rep").alias("src"), F.col("top").alias("dst")))
    weights = checked.groupBy("rep").agg(F.sum("weight").alias("weight"))
    linked = classes.join(roots, classes["rep"] == roots["node"])
    tops = linked.join(linked.groupBy("root").agg(F.min("least").alias("top")), "root").select("rep", "top")
    found = classes.join(weights, "rep", "left").join(tops, "rep", "left")
    found = found.select("digest", (F.col("m") - 1 + F.coalesce("weight", F.lit(0))).alias("links"), F.coalesce("top", "least").alias("top"))
    own = F.coalesce("top", "id")
    return ids.join(found, "digest", "left").select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (own == F.col("id")).alias("kept")
    )
