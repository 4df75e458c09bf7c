"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts: the counts of all runs of ORDER + 1 bytes of the training texts, kept as a table
and never gathered. A byte's probability in its context is that of method D: each byte seen there gives half a count
to the escape, and an escaped context's bytes are excluded from the shorter ones. It depends on the run alone, so it is computed once for each distinct run of the corpus.

Texts are cut into bounded chunks. A chunk asks for its distinct runs and words, once each, and their values come
back to it; only distinct keys cross the network, and the texts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.llm.common import materialize, slices, small_batches

#: Bytes of context, and bytes of text of a chunk, about.
ORDER, CHUNK_BYTES = 5, 64 << 20
#: Bytes that UTF-8 never uses: before a text, and its end.
START, END = 0xFE, 0xFF
_BYTE = np.int64(8)


def runs(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Runs of order + 1 bytes ending at each byte of the texts and at their ends, one text after another; runs of each text."""
    data = np.frombuffer(b"".join(bytes([START]) * order + t + bytes([END]) for t in texts), np.uint8)
    n = max(0, len(data) - order)
    out = np.zeros(n, np.int64)
    for j in range(order + 1):
        out = (out << _BYTE) | data[j : j + n]
    return out[(out & 255) != START], np.array([len(t) + 1 for t in texts], np.int64)


def _kept(grams: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct last k + 1 bytes, their counts, and where each run's are."""
    keys, at = np.unique(grams & np.int64((1 << (8 * (k + 1))) - 1), return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)), at


#: Runs that are looked at together, about: contexts of three bytes are spread over so many groups.
GROUP_RUNS = 500_000


class Short:
    """What is known of the contexts of up to two bytes: training counts of all runs of three bytes, 256**3 of them at most, whatever the corpus."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(float)
        context, near = self.keys >> _BYTE, self.keys & np.int64(0xFFFF)
        self.pairs = np.bincount(near, self.counts, 1 << 16)
        self.ones = self.pairs.reshape(256, 256).sum(0)
        self.totals = [np.array([self.ones.sum()]), self.pairs.reshape(256, 256).sum(1), np.bincount(context, self.counts, 1 << 16)]
        self.kinds = [np.array([np.count_nonzero(self.ones)]), np.count_nonzero(self.pairs.reshape(256, 256), axis=1), np.bincount(context, self.counts > 0, 1 << 16)]
        # counts, in the context without its first byte, of the bytes seen in a context of one and of two bytes
        self.excluded = [(self.pairs.reshape(256, 256) > 0) @ self.ones, np.bincount(context, self.pairs[near] * (self.counts > 0), 1 << 16)]

    def count(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Counts of the last k + 1 bytes, k up to 2."""
        if k < 2:
            return (self.ones, self.pairs)[k][grams & np.int64((1 << (8 * (k + 1))) - 1)]
        if not len(self.keys):
            return np.zeros(len(grams))
        last = grams & np.int64(0xFFFFFF)
        at = np.minimum(np.searchsorted(self.keys, last), len(self.keys) - 1)
        return np.where(self.keys[at] == last, self.counts[at], 0.0)


def logarithms(grams: np.ndarray, counts: np.ndarray, short: Short, order: int = ORDER) -> np.ndarray:
    """log10 probability of each distinct run's last byte, by training counts (0 for runs only asked for).

    grams hold, of some contexts of three bytes, all runs of the corpus that end in them and one byte more.
    """
    tables: dict[int, tuple] = {k: _kept(grams, counts, k) for k in range(order, 2, -1)}

    def held(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run: its count, and the total count and the number of different bytes of its context of order k."""
        if k <= 2:
            context = (grams >> _BYTE) & np.int64((1 << (8 * k)) - 1)
            return short.count(grams, k), short.totals[k][context], short.kinds[k][context].astype(float)
        keys, n, at = tables[k]
        _, context = np.unique(keys >> _BYTE, return_inverse=True)
        return n[at], np.bincount(context, n)[context][at], np.bincount(context, n > 0)[context][at].astype(float)

    def excluded(k: int) -> np.ndarray:
        """Counts, in the context of order k, of the bytes seen in the context of order k + 1 of each run."""
        if k < 2:
            return short.excluded[k][(grams >> _BYTE) & np.int64((1 << (8 * (k + 1))) - 1)]
        above, n, at = tables[k + 1]
        if k == 2:
            low = short.count(above, 2)
        else:
            keys, m, _ = tables[k]
            low = m[np.searchsorted(keys, above & np.int64((1 << (8 * (k + 1))) - 1))]
        _, context = np.unique(above >> _BYTE, return_inverse=True)
        return np.bincount(context, low * (n > 0))[context][at]

    out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    before = np.zeros(len(grams))  # different bytes excluded so far
    for k in range(order, -1, -1):
        n, total, kinds = held(k)
        rest = total - (excluded(k) if k < order else 0)
        new = kinds - before
        seen = open_ & (n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.log10((n - 0.5) / rest)
            miss = np.where(rest > 0, np.log10(0.5 * new / rest), 0.0)
        out = np.where(seen, out + hit, np.where(open_, out + miss, out))
        open_ &= ~seen
        before = kinds
    return np.where(open_, out - np.log10(np.maximum(1.0, 256 - before)), out)


def _chunked(docs: DataFrame, key: str, text: str, learns: Column, chunk_bytes: int) -> DataFrame:
    """id, text, learns, chunk: copied to the shared folder, so that later reads see the same chunks."""
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 24, 0
        for batch in slices(batches, 1):
            size = batch.column(1).nbytes
            if held and held + size > chunk_bytes:
                chunk, held = chunk + 1, 0
            held += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), chunk, np.int64))], names=["id", "text", "learns", "chunk"])

    chosen = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    return materialize(chosen.mapInArrow(run, f"id {kind}, text string, learns boolean, chunk long"), "chunks")


def _lower(values) -> list[bytes]:
    import pyarrow as pa

    return [v.lower() for v in values.cast(pa.binary()).to_pylist()]


def _word(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


class _Words(dict):
    """word -> its number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


class Lookup:
    """Values of distinct keys by a table of slots; keys that another one keeps from their slot are searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(len(keys) + 1))))
        self.shift = np.uint64(64 - bits)
        slots = self._slots(keys)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        self.keys[slots], self.values[slots] = keys, values
        out = np.flatnonzero(self.keys[slots] != keys)
        out = out[np.argsort(keys[out], kind="stable")]
        self.rest, self.rest_values = keys[out], values[out]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        slots = self._slots(keys)
        found = self.values[slots]
        missed = np.flatnonzero(self.keys[slots] != keys)
        if len(missed):
            found[missed] = self.rest_values[np.searchsorted(self.rest, keys[missed])]
        return found


#: Distinct keys that a chunk's counts grow by before they are merged.
MERGE = 1_000_000


def _keys(chunks: DataFrame, order: int) -> DataFrame:
    """run (or a word's hash), chunk, n training occurrences: every distinct run and word of a chunk once for each task that reads some of it."""
    import pyarrow as pa

    names = ["word", "key", "chunk", "n"]

    def flush(chunk: int, words: _Words, said: np.ndarray, parts: list) -> Iterator[pa.RecordBatch]:
        grams, n = _distinct(parts)
        hashes = np.fromiter(map(_word, words), np.int64, len(words))
        for is_word, keys, counts in ((False, grams, n), (True, hashes, said[: len(words)])):
            for at in range(0, len(keys), 100_000):
                k = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), is_word)), pa.array(k), pa.array(np.full(len(k), chunk, np.int64)), pa.array(counts[at : at + 100_000])], names=names
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, said, parts = None, _Words(), np.zeros(1, np.int64), []
        for batch in slices(batches, 0, 250):
            for chunk in np.unique(batch.column(2).to_numpy()):
                own = batch.filter(pa.array(batch.column(2).to_numpy() == chunk))
                if now is not None and chunk != now:
                    yield from flush(now, words, said, parts)
                    words, said, parts = _Words(), np.zeros(1, np.int64), []
                now = int(chunk)
                texts, learns = _lower(own.column(0)), own.column(1).to_numpy(zero_copy_only=False)
                for wanted in (True, False):
                    some = [t for t, x in zip(texts, learns, strict=True) if x == wanted]
                    if not some:
                        continue
                    grams, n = np.unique(runs(some, order)[0], return_counts=True)
                    parts.append((grams, n if wanted else np.zeros(len(grams), np.int64)))
                    ids = np.fromiter((words[w] for t in some for w in t.split()), np.int64)
                    said = np.pad(said, (0, max(0, 2 * len(words) - len(said)))) if len(said) < len(words) else said
                    if wanted:
                        said += np.bincount(ids, minlength=len(said))
                if sum(len(p[0]) for p in parts[1:]) > MERGE:
                    parts = [_distinct(parts)]
        if now is not None:
            yield from flush(now, words, said, parts)

    return chunks.select("text", "learns", "chunk").mapInArrow(run, "word boolean, key long, chunk long, n long")


def code_lengths(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """key, value: log10 probability of the last byte of every run; grams: key, n (training count, 0 for runs only asked for), a written table.

    Runs are grouped by the three bytes before their last, so a task holds about GROUP_RUNS of them, and no more than
    the 256**3 runs of one context and order 5 in any case. Counts of three bytes reach every task: bounded likewise.
    """
    import pandas as pd

    few = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("last")).agg(F.sum("n").alias("n")).toArrow()
    short = Short(few.column("last").to_numpy(), few.column("n").to_numpy())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        found = logarithms(frame["key"].to_numpy(), frame["n"].to_numpy().astype(float), short, order)
        return pd.DataFrame({"key": frame["key"].to_numpy(), "value": found})

    groups = max(1, -(-grams.count() // GROUP_RUNS), int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = F.shiftright("key", 8).bitwiseAND(0xFFFFFF)
    return grams.groupBy(F.pmod(F.xxhash64(near), F.lit(groups)).alias("near")).applyInPandas(run, "key long, value double")


def score(docs: DataFrame, learns: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score of every row; the model is learned from the rows where `learns` holds.

    A text's words are what white space parts, A-Z in lower case, and one end follows; base_score is the log10
    probability of these tokens by smoothed training counts, score that of the bytes and the end by the trie. A null
    text is an empty one: one end. Null `learns` is false; with nothing learned every byte is equally likely and
    base_score is that of no counts. Repeated rows are learned from and scored each; rows without a key are scored;
    an empty table gives no rows; other columns are ignored.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    with small_batches(docs.sparkSession):  # whole texts pass through Arrow
        return _score(docs, learns, key, text, order, chunk_bytes)


def _score(docs: DataFrame, learns: Column, key: str, text: str, order: int, chunk_bytes: int) -> DataFrame:
    import pyarrow as pa

    chunks = _chunked(docs, key, text, learns, chunk_bytes)
    keys = materialize(_keys(chunks, order), "keys")
    words = keys.where("word")
    ends = chunks.agg(F.coalesce(F.count_if("learns"), F.lit(0))).first()[0]  # the end's count
    spoken = words.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")
    n_words, kinds = spoken.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = int(n_words) + ends, kinds + (ends > 0)
    grams = keys.where("NOT word").groupBy("key").agg(F.sum("n").alias("n"))
    values = code_lengths(materialize(grams, "grams"), order)
    by_run = keys.where("NOT word").join(values, "key").select("chunk", "word", "key", "value")
    counted = F.sum("n").over(Window.partitionBy("key")).cast("double")
    by_word = words.select("chunk", "word", "key", counted.alias("value"))
    answers = by_run.unionByName(by_word)
    kind = docs.schema[key].dataType.simpleString()

    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        is_word, keys, values = (given.column(c).to_numpy() for c in ("word", "key", "value"))
        known = dict(zip(keys[is_word].tolist(), values[is_word].tolist(), strict=True))
        # a chunk that several tasks read has asked for some runs more than once
        grams, first = np.unique(keys[~is_word], return_index=True)
        lookup = Lookup(grams, values[~is_word][first])
        least = np.log10(total + 0.5 * (kinds + 1))

        class Seen(dict):
            def __missing__(self, word: bytes) -> float:
                found = self[word] = known[_word(word)]
                return found

        seen, out = Seen(), []
        end = float(ends)
        for batch in asked.to_batches(max_chunksize=500):
            texts = _lower(batch.column("text"))
            if not texts:
                continue
            found, sizes = runs(texts, order)
            logs = np.add.reduceat(lookup(found), np.cumsum(sizes) - sizes)
            split = [t.split() for t in texts]
            c = np.fromiter((x for s in split for x in (*map(seen.__getitem__, s), end)), np.float64)
            n = np.array([len(s) + 1 for s in split], np.int64)
            starts = np.cumsum(n) - n
            out.append(
                pa.table(
                    {
                        "id": batch.column("id"),
                        "n_tokens": n,
                        "n_known": np.add.reduceat((c > 0).astype(np.int64), starts),
                        "base_score": np.add.reduceat(np.log10(c + 0.5) - least, starts),
                        "score": logs,
                    }
                )
            )
        return pa.concat_tables(out)

    asked = chunks.select("chunk", "id", "text")
    scored = asked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return materialize(scored, "scores").select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def adaptive_code_length(text: str | None, order: int = ORDER) -> float:
    """log10 probability of one text by a trie that starts empty and learns each byte after coding it."""
    data = (text or "").encode().lower() + bytes([END])
    past, trie, total = bytes([START]) * order, {}, 0.0
    for byte in data:
        shut: set[int] = set()
        for k in range(order, -1, -1):
            here = trie.get(past[len(past) - k :], {})
            rest, new = sum(n for b, n in here.items() if b not in shut), sum(b not in shut for b in here)
            if byte in here:
                total += np.log10((here[byte] - 0.5) / rest)
                break
            total += np.log10(0.5 * new / rest) if rest else 0.0
            shut |= here.keys()
        else:
            total -= np.log10(256 - len(shut))
        for k in range(order + 1):
            here = trie.setdefault(past[len(past) - k :], {})
            here[byte] = here.get(byte, 0) + 1
        past = (past + bytes([byte]))[-order:] if order else b""
    return float(total)


def adaptive_score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """key, score: each text's own adaptive code length as a log10 probability; a null text is an empty one."""
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 100):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([adaptive_code_length(t, order) for t in batch.column(1).to_pylist()], pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
