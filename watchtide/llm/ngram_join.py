"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of five-word shingles are one class; only class representatives are compared. Min-wise
hashes are banded; buckets of a band chain representatives to their least member, and the connected components of
these chains are clusters that hold every candidate pair. A cluster is cut into blocks, and a task takes a pair of
blocks: it compares the hashes of all its pairs a few at a time, drops a pair as soon as the posterior probability
of reaching the threshold falls below the tolerance, and verifies the rest on their whole shingle sets.
Tasks return sums of links and spanning edges, so no pair of a group leaves its task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import components, materialize, slices, small_batches

SHINGLE, THRESHOLD = 5, 0.8
#: Bands and hashes in each: a pair of similarity 0.8 shares a band with probability 0.998, one of 0.85 with 0.99995.
BANDS, BAND = 21, 6
HASHES = BANDS * BAND
#: Hashes compared between looks at the posterior, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 18, 1e-6
#: Texts and shingles of a block, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 400_000

_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, hashed: _WordHash) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of five lower-case words; of all words if there are fewer; empty if none."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        h += w[j : j + n] * _MIX[j]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return np.unique(h)


def _digest(shingles) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def signatures(sets: list[np.ndarray], seed: int = 11) -> np.ndarray:
    """Min-wise hashes (one row per non-empty set), high 32 bits."""
    odd = np.random.default_rng(seed).integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    room = np.empty_like(flat)
    for j, a in enumerate(odd):
        np.multiply(flat, a, out=room)
        out[:, j] = np.minimum.reduceat(room, starts) >> np.uint64(32)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n hashes, the fewest equal ones with P(similarity >= threshold | matches) >= tolerance, from a uniform prior."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:  # P(Binomial(n + 1, threshold) <= m) is the posterior of m matches
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest of the shingle set (null: no words), n shingles, sig (min-wise hashes)."""
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            hashed = _WordHash()
            sets = [shingle_set(t, hashed) for t in batch.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig, digest = [None] * len(sets), [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                    sig[i] = row.tobytes()
                    digest[i] = _digest(sets[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), batch.column(2)], names=["id", "digest", "n", "sig", "same"]
            )

    return docs.select(key, text, F.xxhash64(text).alias("same")).mapInArrow(run, f"id {kind}, digest binary, n long, sig binary, same long")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    sizes = [len(x) for x in (*a, *b)]
    _, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.bincount(column) > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, wide = np.zeros((len(a), len(b)), np.float32), 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        s, e = np.searchsorted(column, (lo, lo + wide))
        dense = np.zeros((len(sizes), wide), np.float32)
        dense[row[s:e], column[s:e] - lo] = 1
        out += dense[: len(a)] @ dense[len(a) :].T
    return out.astype(np.int64)


def links(sig_a: np.ndarray, sig_b: np.ndarray, set_a: list, set_b: list, same: bool, need: dict[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs of two blocks (same: of one block, each pair once)."""
    first = np.zeros((len(sig_a), len(sig_b)), np.int16)
    for j in range(STEP):
        first += sig_a[:, j, None] == sig_b[None, :, j]
    live = first >= need[STEP]
    p, q = np.nonzero(np.triu(live, 1) if same else live)
    equal = first[p, q].astype(np.int64)
    for n in range(2 * STEP, HASHES + 1, STEP):
        for at in range(0, len(p), 100_000):
            cut = slice(at, at + 100_000)
            equal[cut] += (sig_a[p[cut], n - STEP : n] == sig_b[q[cut], n - STEP : n]).sum(1)
        keep = equal >= need[n]
        p, q, equal = p[keep], q[keep], equal[keep]
    if not len(p):
        return p, q
    rows, p_at = np.unique(p, return_inverse=True)
    cols, q_at = np.unique(q, return_inverse=True)
    if len(p) < 32:
        inter = np.array([len(np.intersect1d(set_a[i], set_b[j], assume_unique=True)) for i, j in zip(p, q, strict=True)])
    else:
        inter = intersections([set_a[i] for i in rows], [set_b[j] for j in cols])[p_at, q_at]
    union = np.array([len(set_a[i]) for i in rows])[p_at] + np.array([len(set_b[j]) for j in cols])[q_at] - inter
    keep = inter >= threshold * union - 1e-9
    return p[keep], q[keep]


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes by links (p, q)."""
    root = np.arange(n)
    while True:
        was = root.copy()
        least = np.minimum(root[p], root[q])
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
        root = root[root]
        if (root == was).all():
            return root


def _verify(threshold: float):
    need = least_matches(threshold)

    def run(table):
        import pyarrow as pa

        rep = table.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        table = table.take(pa.array(order))
        rep, root, block, m = (table.column(c).to_numpy() for c in ("rep", "root", "block", "m"))
        cell = np.stack([table.column("i").to_numpy(), table.column("j").to_numpy()])
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        found = []
        by = np.argsort(root, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(root[by])) + 1):
            i, j = cell[:, own[0]]
            a, b = own[block[own] == i], own[block[own] == j]
            if not len(a) or not len(b):
                continue
            p, q = links(sig[a], sig[b], [sets[x] for x in a], [sets[x] for x in b], i == j, need, threshold)
            if len(p):
                p, q = a[p], b[q]
                found.append((p, q))
        n = len(rep)
        weight, top = np.zeros(n, np.int64), np.arange(n)
        if found:
            p, q = (np.concatenate(x) for x in zip(*found, strict=True))
            np.add.at(weight, p, m[q])
            np.add.at(weight, q, m[p])
            top = _roots(n, p, q)
        some = weight > 0
        return pa.table({"rep": rep[some], "weight": weight[some], "top": rep[top[some]]})

    return run


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_links (other documents of similarity >= threshold), component_id, kept.

    component_id is the least key reachable by links, itself included; kept is key = component_id. Words are runs
    of letters, digits and underscores in lower case; a text of fewer than five words is one shingle, one without
    words (null, empty) links with nothing. Repeated rows are one document, and texts of different shingles under one
    key are documents of their own, with a row each; rows without a key likewise: they are compared and counted, but no
    other document stands under them, and groups of such rows alone have no component_id and are kept. An empty table
    gives no rows; other columns are ignored. Keys are integers.
    """
    with small_batches(docs.sparkSession):  # whole texts pass through Arrow
        return _ngram_join(docs, threshold, key, text)


def _ngram_join(docs: DataFrame, threshold: float, key: str, text: str) -> DataFrame:
    import pyarrow as pa

    made = materialize(sketch(docs, key, text), "sketch")
    ids = made.select(F.col("id").cast("long").alias("id"), "digest").distinct()
    counted = ids.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"))
    # a class has a number of its own, since one key may stand before several texts
    classes = materialize(counted.withColumn("rep", F.monotonically_increasing_id()), "classes")
    first = made.join(classes, (made["digest"] == classes["digest"]) & made["id"].eqNullSafe(classes["least"])).select("rep", "least", classes["digest"], "m", "n", "sig", "same")
    reps = materialize(first.dropDuplicates(["rep"]), "reps")

    keys = F.array(*(F.struct(F.lit(b).alias("b"), F.xxhash64(F.substring("sig", 1 + 4 * BAND * b, 4 * BAND)).alias("h")) for b in range(BANDS)))
    banded = reps.select("rep", F.explode(keys).alias("k")).select("rep", "k.b", "k.h")
    buckets = banded.groupBy("b", "h").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("b", "h", "low")
    chains = banded.join(buckets, ["b", "h"]).where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")).distinct()
    clusters = materialize(components(chains), "clusters")

    inside = reps.join(clusters, reps["rep"] == clusters["node"]).select("rep", "least", "digest", "m", "n", "sig", "same", "root")
    inside = materialize(inside, "inside")
    size = inside.groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    total = inside.agg(F.sum("n")).first()[0] or 0
    bundles = max(1, total // BLOCK_SHINGLES)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 6):
            hashed = _WordHash()
            sets = [shingle_set(t, hashed).tobytes() for t in batch.column(6).to_pylist()]
            own = pa.array([_digest(s) == d for s, d in zip(sets, batch.column(5).to_pylist(), strict=True)])  # a key's other texts aren't meant
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sets, pa.binary())], names=["rep", "m", "sig", "root", "blocks", "shingles"]).filter(own)

    placed = inside.join(size, "root")
    # a text is met by its key and a hash of it: rows that share a key don't meet each other's classes
    whole = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_same"), F.col(text).alias("_text"))
    texts = placed.join(whole, placed["least"].eqNullSafe(whole["_id"]) & (placed["same"] == whole["_same"])).select("rep", "m", "sig", "root", "blocks", "digest", "_text")
    sets = texts.mapInArrow(shingled, "rep long, m long, sig binary, root long, blocks int, shingles binary").dropDuplicates(["rep"])
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # small clusters share tasks; a large one has a task for each pair of its blocks
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root") + bundles)
    grid = sets.withColumn("block", block).select("*", other).withColumn("task", task)
    grid = grid.select("task", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "m", "root", "sig", "shingles")
    checked = materialize(grid.groupBy("task", "i", "j").applyInArrow(_verify(threshold), "rep long, weight long, top long"), "links")

    roots = components(checked.where("rep <> top").select(F.col("rep").alias("src"), F.col("top").alias("dst")))
    weights = checked.groupBy("rep").agg(F.sum("weight").alias("weight"))
    linked = classes.join(roots, classes["rep"] == roots["node"])
    least = linked.groupBy("root").agg(F.min("least").alias("top"))
    tops = linked.join(least, "root").select("rep", "top")
    held = classes.join(weights, "rep", "left").join(tops, "rep", "left")
    held = held.select("digest", (F.col("m") - 1 + F.coalesce("weight", F.lit(0))).alias("links"), F.coalesce("top", "least").alias("top"))
    own = F.coalesce("top", "id")
    out = ids.join(held, "digest", "left").select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("id")).alias("kept")
    )
    return out


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that another document of their group stands for; rows without a key stay."""
    gone = ngram_join(docs, threshold, key, text).where("NOT kept").select(F.col(key).alias("_gone"))
    return docs.join(gone, docs[key].cast("long") == gone["_gone"], "left_anti")
