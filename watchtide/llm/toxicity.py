"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained by zstandard on toxic text, one of the same size on ordinary text. Each is read after a
common one of ordinary text, because toxic documents are ordinary in most of their words: without it the two differ
by chance more than by toxicity. A text is cut into windows of WINDOW_WORDS words; each is compressed with either
dictionary, and the bytes that the toxic one saves are its distance. How many windows of a document pass each of
the thresholds SAVED is calibrated to a probability by logistic regression, on documents that did not train the
dictionaries which measured them.

The toxic dictionary is trained on excerpts: runs of words of toxic documents that lean to the toxic class, alone, as
pairs or by their beginning. What counts is the number of different contexts, so copies of one document teach nothing twice.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import sampled, slices

#: The sample that a model is fitted on: labelled documents of each class, and bytes of their whole texts, at most.
CLASS_DOCS, CLASS_BYTES = 3000, 8 << 20
#: Words of a window and bytes that one word adds at most (longer ones are cut up); bytes of the common dictionary and of the two that are compared; bytes appended to a window, without which zstandard stores short ones raw.
WINDOW_WORDS, WORD_BYTES, COMMON, DICTIONARY, TAIL = 4, 64, 16384, 2048, 128
#: Bytes of the segments that toxic dictionaries are made of, as tried; 0: as zstandard finds best for compression.
SEGMENTS = (0, 16, 32, 64)
#: A word leans to the toxic class if it is said this many times as often there, and so often that chance explains less than CHANCE such words of the whole vocabulary.
RATIO, CHANCE = 5.0, 0.05
#: Letters of the beginnings of longer words that are looked at like words.
STEMS = (4, 6)
#: Bytes saved that windows are counted by.
SAVED = (2, 3, 4, 5, 7, 9)
#: The share of the calibrating documents whose length is told apart no further: they are short.
SHORT = 0.02
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def windows(text: str | None) -> list[bytes]:
    """Runs of WINDOW_WORDS words, parted by white space, in lower case; the last may be shorter."""
    words = text.lower().encode(errors="replace").split() if text else []
    if words and max(map(len, words)) > WORD_BYTES:
        words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return [b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]


def _terms(texts: list[str], vocabulary: dict[str, int], stems: list[dict[int, int]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Keys and numbers of different neighbours of words, of pairs of words and of stems, and the sum over words. Words are numbered in `vocabulary`, 0 is a text's border."""
    ids = [np.array([0, *(vocabulary.setdefault(w, len(vocabulary) + 1) for w in _WORD.findall(t.lower())), 0, 0], np.int64) for t in texts]
    flat = np.concatenate([*ids, np.zeros(3, np.int64)])
    before, here, after, later = (flat[i : len(flat) - 3 + i].astype(np.uint64) for i in range(4))

    def around(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y * np.uint64(0xC2B2AE3D27D4EB4F))

    def counted(keys: np.ndarray, near: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = np.unique(np.stack([keys[keep], near[keep]], axis=1), axis=0)
        return np.unique(each[:, 0], return_counts=True)

    beside, names = around(before, after), [*vocabulary]
    out = [counted(here, beside, here > 0), counted((here << np.uint64(32)) | after, around(before, later), (here > 0) & (after > 0))]
    for n, stem in zip(STEMS, stems, strict=True):
        of = np.array([0, *(stem.setdefault(w[:n], len(stem) + 1) if len(w) > n else 0 for w in names)], np.uint64)[here.astype(np.int64)]
        out.append(counted(of, beside, of > 0))
    return out, int(out[0][1].sum())


def leaning(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words, pairs of words ("a b") and stems ("abcd*") that toxic texts say in more contexts than chance explains, and RATIO times as often as ordinary ones."""
    vocabulary: dict[str, int] = {}
    stems: list[dict[str, int]] = [{} for _ in STEMS]
    (a, all_a), (b, all_b) = _terms(toxic, vocabulary, stems), _terms(ordinary, vocabulary, stems)
    if not all_a or not all_b:
        return set()
    words, out = ["", *vocabulary], set()
    named = [lambda k: words[k], lambda k: f"{words[k >> 32]} {words[k & 0xFFFFFFFF]}"]
    named += [lambda k, s=["", *stem]: f"{s[k]}*" for stem in stems]
    share, limit = all_a / (all_a + all_b), math.log(CHANCE / sum(len(keys) for keys, _ in a))
    for name, (keys, n), (others, m) in zip(named, a, b, strict=True):
        at = np.minimum(np.searchsorted(others, keys), max(0, len(others) - 1))
        rest = np.where(others[at] == keys, m[at], 0) if len(others) else np.zeros(len(keys), np.int64)
        q = n / (n + rest)
        with np.errstate(divide="ignore", invalid="ignore"):
            # Chernoff's bound of the logarithm of P(n of n + rest contexts are toxic)
            bound = -(n + rest) * (q * np.log(q / share) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0.0))
        lean = (q > share) & ((n + 0.5) / all_a >= RATIO * (rest + 0.5) / all_b) & (bound < limit)
        out |= {name(int(k)) for k in keys[lean]}
    return out


def excerpts(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Runs of leaning words in toxic texts."""
    lean, out = leaning(toxic, ordinary), []
    for t in toxic if lean else ():
        w = _WORD.findall(t.lower())
        mark = np.zeros(len(w) + 1, bool)
        for i, x in enumerate(w):
            mark[i] |= x in lean or any(f"{x[:n]}*" in lean for n in STEMS if len(x) > n)
            if i + 1 < len(w) and f"{x} {w[i + 1]}" in lean:
                mark[i : i + 2] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mark])))
        out += [f" {' '.join(w[i:j])} ".encode() for i, j in zip(edges[::2], edges[1::2], strict=True)]
    return out


def trained(samples: list[bytes], size: int, segment: int = 0) -> bytes:
    """The dictionary that zstandard trains on the samples, of segments of so many bytes if given; too few to train on, their end."""
    import zstandard as z

    try:
        how = {"k": segment, "d": 6} if segment else {}
        return z.train_dictionary(size, samples, **how).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Pair:
    """The common dictionary and the two that are compared."""

    common: bytes
    toxic: bytes
    ordinary: bytes

    @classmethod
    def each(cls, toxic: list[str], ordinary: list[str]) -> list[Pair]:
        """A pair for each of SEGMENTS, by which the toxic dictionary is trained; the two dictionaries are of equal size."""
        own = [windows(t) for t in ordinary]
        common, plain = (trained([w for t in own[i::2] for w in t], size) for i, size in ((0, COMMON), (1, DICTIONARY)))
        some, out = excerpts(toxic, ordinary), []
        for segment in SEGMENTS:
            a = trained(some, DICTIONARY, segment)
            n = min(len(a), len(plain))
            out.append(cls(common, a[len(a) - n :], plain[len(plain) - n :]))
        return out

    def saved(self) -> Callable[[list[bytes]], np.ndarray]:
        """The bytes that the toxic dictionary saves on each window."""
        import zstandard as z

        how = z.ZstdCompressionParameters(
            window_log=17, hash_log=15, chain_log=16, search_log=6, min_match=4, target_length=32, strategy=z.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )

        def compress(own: bytes):
            d = z.ZstdCompressionDict((self.common + own) or b"\0" * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return z.ZstdCompressor(dict_data=d, compression_params=how).compress

        plain, toxic, tail = compress(self.ordinary), compress(self.toxic), b" " + self.common[-TAIL:]

        def measure(some: list[bytes]) -> np.ndarray:
            texts = [b" " + w + tail for w in some]
            return np.fromiter((len(plain(t)) - len(toxic(t)) for t in texts), np.int64, len(texts))

        return measure


def counts(saved: np.ndarray) -> list[int]:
    """Numbers of windows that save at least each of SAVED bytes, and of all windows."""
    return [*(int(np.count_nonzero(saved >= c)) for c in SAVED), len(saved)]


def features(n: np.ndarray, least: float) -> np.ndarray:
    """Logs of the numbers of windows that save at least each of SAVED bytes, and of all windows, at least `least`."""
    return np.log1p(np.column_stack([n[:, :-1], np.maximum(n[:, -1], least)]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """least: the windows that shorter texts count as having, since the weights were calibrated on texts as long."""

    pair: Pair
    least: float
    weights: list[float]

    def scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        """Probabilities of texts."""
        saved, weights = self.pair.saved(), np.array(self.weights)

        def run(texts: list[str | None]) -> np.ndarray:
            x = features(np.array([counts(saved(windows(t))) for t in texts]).reshape(-1, len(SAVED) + 1), self.least)
            return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))

        return run


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """A model of texts of both classes; share: the toxic share of the corpus, to which scores are calibrated.

    Of every three documents of a class two train the dictionaries, and the third, which they haven't seen, calibrates
    the weights and tells which of the toxic dictionaries is the best.
    """
    none = [0.0] * (len(SAVED) + 1)
    if not toxic or not ordinary:
        return Model(Pair(b"", b"", b""), 0.0, [*none, 30.0 if toxic else -30.0])
    pairs = Pair.each(*([t for i, t in enumerate(texts) if i % 3 < 2] for texts in (toxic, ordinary)))
    fresh = [texts[2::3] for texts in (toxic, ordinary)]
    prior = math.log(share / (1 - share))
    if not all(map(len, fresh)):  # nothing to calibrate on
        return Model(pairs[0], 0.0, [*none, prior])
    own = [windows(t) for texts in fresh for t in texts]
    y = np.repeat([1.0, 0.0], [len(texts) for texts in fresh])
    least, best = float(np.quantile([*map(len, own)], SHORT)), None
    for pair in pairs:
        saved = pair.saved()
        x = features(np.array([counts(saved(w)) for w in own]), least)
        w = logistic(x, y)
        z = x @ w[:-1] + w[-1]
        fits = -np.logaddexp(0, np.where(y == 1, -z, z)).sum()
        if best is None or fits > best[0]:
            best = (fits, pair, w)
    _, pair, w = best
    w[-1] += prior - math.log(len(fresh[0]) / len(fresh[1]))
    return Model(pair, least, w.tolist())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a sample of the labelled documents: whole texts, of each class at most CLASS_DOCS and CLASS_BYTES.

    labels: (key, label), 1 is toxic; a key labelled both ways is toxic; null keys and labels teach nothing. Repeated
    rows teach once, and each of different texts under one key teaches.
    """
    each = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg((F.max(F.col(label)) == 1).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in each.groupBy("_y").count().collect()}
    own = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    # of each class three times as many keys as are wanted, by their hash: few enough to be sent to the documents
    unit = F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = each.where(unit * F.when(F.col("_y") == 1, counts.get(1, 0)).otherwise(counts.get(0, 0)) < 3.0 * CLASS_DOCS + 100)
    rows = sampled(own.join(F.broadcast(few), own["_id"] == few["_k"]), "_id", "_text", "_y", CLASS_DOCS, CLASS_BYTES, 2)
    total = sum(counts.values())
    return fit([t for y, t in rows if y == 1], [t for y, t in rows if y == 0], min(0.99, max(0.01, counts.get(1, 0) / total if total else 0)))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, that `score` doesn't predict toxic. Each row is decided on its own text: ids may be null or shared, repeated rows go or stay together."""
    import pyarrow as pa

    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probability = model.scorer()
        for batch in slices(batches, at):
            yield batch.filter(pa.array(probability(batch.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score (probability of toxicity), predicted (1 from the threshold on). Texts without a word, null ones too, get the score of no window; repeated rows are scored each; other columns are ignored; an empty table gives no rows."""
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probability = model.scorer()
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(batch.column(1).to_pylist()))], names=[key, "score"])

    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
