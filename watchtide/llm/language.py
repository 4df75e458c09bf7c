"""Language identification by a linear-chain conditional random field over words.

Features are hashed affixes, letter trigrams and the word itself (the lexicon); transitions between languages are
learned with them, from sequences that switch language in the middle. Forward-backward gives each word of a text
its marginals; a document's language is the one with the greatest mean marginal over all its words. Texts are cut
into chunks whose transfer matrices are chained, so marginals are exact however long a text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import sampled, slices

#: The sample that a model is fitted on: labelled documents of each language, bytes of their whole texts, and languages, at most.
LANGUAGE_DOCS, LANGUAGE_BYTES, LANGUAGES = 300, 512 << 10, 200
#: Texts that are looked at together.
ROWS = 500
#: Hashed weights, letters of a word that features see (both ends of longer words), words of a chunk.
WEIGHTS, LETTERS, CHUNK = 1 << 17, 24, 128
SEQUENCE, EPOCHS, RATE, RIDGE = 32, 6, 0.4, 1e-5
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(batch: list[str]) -> np.ndarray:
    """Indices of each word's features, 0 where it has fewer."""
    half = LETTERS // 2
    short = [w if len(w) <= LETTERS else w[:half] + w[-half:] for w in batch]
    n = len(short)
    size = np.fromiter(map(len, short), np.int64, n)
    c = np.zeros((n, LETTERS + 3), np.uint64)
    c[:, 1 : LETTERS + 1] = np.array(short, f"U{LETTERS}").view(np.uint32).reshape(n, LETTERS)
    row = np.arange(n)
    c[:, 0], c[row, size + 1] = 1, 2  # word borders
    out = np.zeros((n, LETTERS + 9), np.int32)

    def put(column: int, kind: int, h: np.ndarray, keep: np.ndarray) -> None:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[:, column] = np.where(keep, (h >> np.uint64(33)) % np.uint64(WEIGHTS - 1) + np.uint64(1), 0)

    p = np.uint64(0x100000001B3)
    head, tail, whole = (np.zeros(n, np.uint64) for _ in range(3))
    for k in range(4):
        head = head * p + c[:, 1 + k]
        tail = tail * p + c[row, np.maximum(size - k, 0)]
        put(k, 1 + k, head, size > k)
        put(4 + k, 11 + k, tail, size > k)
    for k in range(1, LETTERS + 1):
        whole = whole * p + c[:, k]
        put(8 + k, 31, (c[:, k - 1] * p + c[:, k]) * p + c[:, k + 1], size >= k)
    put(8, 21, whole, size > 0)
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # of hashed features by language
    moves: np.ndarray  # logarithms, from by to

    def emissions(self, batch: list[str]) -> np.ndarray:
        out = np.empty((len(batch), len(self.langs)), np.float64)
        for i in range(0, len(batch), 8192):
            out[i : i + 8192] = self.weights[features(batch[i : i + 8192])].sum(1)
        return out


def marginals(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior of every label at every word: e holds the emissions of texts of the given lengths (each > 0), one after another."""
    return forward_backward(e, lengths, moves)[0]


def forward_backward(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: the posterior of its labels, the forward message up to it, and the backward message from it on (its own emission included).

    The pair of labels (i, j) at two neighbouring words has a posterior in proportion to forward[i] * exp(moves[i, j])
    * backward[j]. A text's first label is reached by a move from any label.
    """
    k = e.shape[1]
    step = np.exp(moves - moves.max())
    ends = np.cumsum(lengths)
    chunks = -(-lengths // CHUNK)
    doc = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = np.repeat(ends - lengths, chunks) + nth * CHUNK
    size = np.minimum(CHUNK, ends[doc] - start)
    order = np.argsort(-size, kind="stable")  # long chunks first: those still running are a prefix
    start, size, doc, nth = start[order], size[order], doc[order], nth[order]
    running = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if len(size) else 0)]
    b = np.exp(e - e.max(1, keepdims=True))
    transfer = np.tile(np.eye(k), (len(start), 1, 1))
    for t, n in enumerate(running):
        m = (transfer[:n] @ step) * b[start[:n] + t][:, None, :]
        transfer[:n] = m / m.sum((1, 2), keepdims=True)
    before, after = np.full((len(start), k), 1 / k), np.full((len(start), k), 1 / k)
    by = np.lexsort((nth, doc))
    first = np.searchsorted(doc[by], np.arange(len(lengths)))
    for i in range(1, int(chunks.max()) if len(chunks) else 0):  # chain the chunks of long texts, both ways
        d = np.flatnonzero(chunks > i)
        here, last = by[first[d] + i], by[first[d] + i - 1]
        v = (before[last][:, None, :] @ transfer[last])[:, 0]
        before[here] = v / v.sum(1, keepdims=True)
        here, last = by[first[d] + chunks[d] - 1 - i], by[first[d] + chunks[d] - i]
        v = (transfer[last] @ after[last][:, :, None])[:, :, 0]
        after[here] = v / v.sum(1, keepdims=True)
    alpha = np.empty_like(e)
    for t, n in enumerate(running):
        a = (before[:n] @ step) * b[start[:n] + t]
        before[:n] = a / a.sum(1, keepdims=True)
        alpha[start[:n] + t] = before[:n]
    posterior, ahead = np.empty_like(e), np.empty_like(e)
    for t, n in reversed(list(enumerate(running))):
        at = start[:n] + t
        g = alpha[at] * after[:n]
        posterior[at] = g / g.sum(1, keepdims=True)
        own = b[at] * after[:n]
        ahead[at] = own / own.sum(1, keepdims=True)
        a = own @ step.T
        after[:n] = a / a.sum(1, keepdims=True)
    return posterior, alpha, ahead


def gradient(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of the conditional log likelihood of labels y (sequences one after another, features x), by emissions and by moves."""
    k = len(model.langs)
    post, alpha, ahead = forward_backward(model.weights[x].sum(1), lengths, model.moves)
    gold, step = np.eye(k)[y], np.exp(model.moves - model.moves.max())
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), bool)
    inner[first] = False
    j = np.flatnonzero(inner)
    pair = alpha[j - 1][:, :, None] * step * ahead[j][:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    up = np.einsum("ni,nj->ij", gold[j - 1], gold[j]) - pair.sum(0)
    up += step / step.sum(0) * (gold[first] - post[first]).sum(0)  # the move to the first label
    return gold - post, up


def sequences(samples: list[tuple[str, list[str]]], langs: list[str], seed: int) -> list[list[tuple[str, int]]]:
    """Labelled word sequences of SEQUENCE words: pieces of the samples in random order, so that they switch language."""
    rng = np.random.default_rng(seed)
    pieces = []
    for lang, w in samples:
        at = 0
        while at < len(w):
            n = int(rng.geometric(1 / 12))
            pieces.append((langs.index(lang), w[at : at + n]))
            at += n
    flat = [(x, y) for i in rng.permutation(len(pieces)) for y, piece in [pieces[i]] for x in piece]
    return [flat[i : i + SEQUENCE] for i in range(0, len(flat), SEQUENCE)]


def fit(samples: list[tuple[str, list[str]]]) -> Model:
    """Gradient ascent (Adagrad) on the conditional likelihood; samples: (language, words)."""
    langs = sorted({lang for lang, _ in samples})
    k = len(langs)
    model = Model(langs, np.zeros((WEIGHTS, k)), np.zeros((k, k)))
    if k < 2:
        return model
    names = sorted({w for _, ws in samples for w in ws})
    ids, known = {w: i for i, w in enumerate(names)}, features(names)
    sum_w, sum_m = np.full((WEIGHTS, k), 1e-6), np.full((k, k), 1e-6)
    for epoch in range(EPOCHS):
        seqs = [s for s in sequences(samples, langs, epoch) if len(s) == SEQUENCE] or sequences(samples, langs, epoch)
        for at in range(0, len(seqs), 128):
            part = seqs[at : at + 128]
            lengths = np.array([len(s) for s in part])
            x = known[[ids[w] for s in part for w, _ in s]]
            y = np.array([label for s in part for _, label in s])
            up_e, up_m = gradient(x, y, lengths, model)
            up_w = np.stack([np.bincount(x.ravel(), np.repeat(up_e[:, c], x.shape[1]), WEIGHTS) for c in range(k)], axis=1)
            up_w[0] = 0
            up_w -= RIDGE * len(y) * model.weights
            sum_w += up_w**2
            sum_m += up_m**2
            model.weights += RATE * up_w / np.sqrt(sum_w)
            model.moves += 0.1 * up_m / np.sqrt(sum_m)
    return model


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a sample of the labelled documents: whole texts, of each language at most LANGUAGE_DOCS and LANGUAGE_BYTES; more than LANGUAGES languages are an error.

    Rows without an id, text or language teach nothing, repeated rows teach once, and each of different texts under
    one id teaches. A text under several languages teaches them all.
    """
    rows = sampled(docs, key, text, lang, LANGUAGE_DOCS, LANGUAGE_BYTES, LANGUAGES)
    return fit([(lang, w) for lang, t in rows if (w := words(t))])


def _spread(texts: list[str | None], model: Model) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; numbers of the texts that have some, their lengths, and the marginals of all their words."""
    import pandas as pd

    own = [words(t) for t in texts]
    some = np.array([i for i, w in enumerate(own) if w], np.int64)
    if not len(some) or not model.langs:
        return own, some[:0], some[:0], np.zeros((0, len(model.langs)))
    code, names = pd.factorize(np.array([w for i in some for w in own[i]], object))
    lengths = np.array([len(own[i]) for i in some])
    return own, some, lengths, marginals(model.emissions(list(names))[code], lengths, model.moves)


def keep_certain(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose words are of learned languages with a certainty of at least `least`.

    Certainty is the mean over all words of each word's greatest marginal, so texts of several languages are as
    certain as their words. Texts without letters are left out. Each row is decided on its own text.
    """
    import pyarrow as pa

    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, ROWS):
            keep = np.zeros(batch.num_rows, bool)
            _, some, lengths, post = _spread(batch.column(at).to_pylist(), model)
            if len(some):
                keep[some] = np.add.reduceat(post.max(1), np.cumsum(lengths) - lengths) / lengths >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (mean marginal of lang_pred over the text's words).

    A text that is null or without letters is `und` with score 0; so is every text if nothing was learned. Of
    languages with equal means the first by name is taken. Repeated rows are scored each; other columns are ignored.
    """
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, ROWS):
            texts = batch.column(1).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            _, some, lengths, post = _spread(texts, model)
            if len(some):
                mean = np.add.reduceat(post, np.cumsum(lengths) - lengths) / lengths[:, None]
                for i, m in zip(some, mean, strict=True):
                    lang[i], score[i] = model.langs[int(m.argmax())], min(1.0, float(m.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, words, langs: the most probable language of every word of a code-switched text (empty arrays without words)."""
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, ROWS):
            own, some, lengths, post = _spread(batch.column(1).to_pylist(), model)
            langs: list[list[str]] = [[UNKNOWN] * len(w) for w in own]
            best = post.argmax(1) if len(post) else []
            for i, end, n in zip(some, np.cumsum(lengths), lengths, strict=True):
                langs[i] = [model.langs[x] for x in best[end - n : end]]
            kinds = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, kinds), pa.array(langs, kinds)], names=[key, "words", "langs"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, words array<string>, langs array<string>")
