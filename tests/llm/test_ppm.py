import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchtide.llm import ppm

ROWS = [(i, t) for i, t in enumerate(["The cat sat", "the cat\n sat on THE mat", "a dog", None, "", "é ü the catalogue", "the the the", "x" * 300, "cat\x0bdog cow"] * 3)]


def brute(rows, learns, order):
    trie, words, ends = defaultdict(Counter), Counter(), 0
    low = {k: (t or "").encode().lower() for k, t in rows}
    for k, t in low.items():
        if learns(k):
            words.update(t.split())
            ends += 1
            data = bytes([ppm.START]) * order + t + bytes([ppm.END])
            for i in range(order, len(data)):
                for n in range(order + 1):
                    trie[data[i - n : i]][data[i]] += 1
    total, kinds = sum(words.values()) + ends, len(words) + (ends > 0)
    out = {}
    for k, t in low.items():
        counts = [words[w] for w in t.split()] + [ends]
        data, logs = bytes([ppm.START]) * order + t + bytes([ppm.END]), 0.0
        for i in range(order, len(data)):
            shut = set()
            for n in range(order, -1, -1):
                here = {b: c for b, c in trie[data[i - n : i]].items() if b not in shut}
                if data[i] in here:
                    logs += np.log10((here[data[i]] - 0.5) / sum(here.values()))
                    break
                if here:
                    logs += np.log10(0.5 * len(here) / sum(here.values()))
                shut |= here.keys()
            else:
                logs -= np.log10(256 - len(shut))
        out[k] = (len(counts), sum(c > 0 for c in counts), total, sum(np.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in counts), logs)
    return out


@pytest.mark.parametrize("order", [1, 2, 4])
def test_score_matches_brute_force(spark, order):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n", F.lit(1))
    learns = lambda k: zlib.crc32(str(k).encode()) % 5 != 1
    made = ppm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, order=order, chunk_bytes=300).collect()
    want = brute(ROWS, learns, order)
    assert len(made) == len(ROWS)
    for r in made:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == pytest.approx(want[r["doc_id"]])


def test_score_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, None)], "doc_id long, text string")
    made = sorted(r["score"] for r in ppm.score(docs, F.lit(None).cast("boolean")).collect())
    assert made == pytest.approx(sorted([-3 * np.log10(256)] * 2 + [-np.log10(256)]))
    assert ppm.score(docs.limit(0), F.lit(True)).count() == 0


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(list(b"abcde "), 400).tolist())
    grams, counts = np.unique(ppm.runs([text])[0], return_counts=True)
    context = grams[50] >> 8
    asked = np.setdiff1d((context << 8) | np.arange(256), grams)
    keys, n = np.concatenate([grams, asked]), np.concatenate([counts, 0 * asked]).astype(float)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    last, at = np.unique(grams & 0xFFFFFF, return_inverse=True)
    near = (keys >> 8) & 0xFFFF == (context & 0xFFFF)
    logs = ppm.logarithms(keys[near], n[near], ppm.Short(last, np.bincount(at, counts)))
    assert (10 ** logs[(keys[near] >> 8) == context]).sum() == pytest.approx(1)


def test_groups_do_not_change_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in ROWS] + [(100, "long text " * 20_000)], "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS n", "3 AS word", "4 AS chunk")
    want = sorted((r["doc_id"], r["score"]) for r in ppm.score(docs, F.col("doc_id") % 2 == 0).collect())
    monkeypatch.setattr(ppm, "GROUP_RUNS", 20)
    got = sorted((r["doc_id"], r["score"]) for r in ppm.score(docs, F.col("doc_id") % 2 == 0).collect())
    assert [a for a, _ in got] == [a for a, _ in want] and [b for _, b in got] == pytest.approx([b for _, b in want])


def test_adaptive(spark):
    docs = spark.createDataFrame([(1, "abcabcabcabcabcabc"), (2, None), (3, "qzjxkvbwpy")], "doc_id long, text string")
    made = {r["doc_id"]: r["score"] for r in ppm.adaptive_score(docs).collect()}
    assert made[2] == pytest.approx(-np.log10(256))
    assert made[1] / 19 > made[3] / 11


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000))
    lookup = ppm.Lookup(keys, np.arange(len(keys), dtype=float))
    asked = np.random.default_rng(1).permutation(np.repeat(np.arange(len(keys)), 2))
    assert (lookup(keys[asked]) == asked).all()
    assert len(ppm.Lookup(keys[:0], np.zeros(0))(keys[:0])) == 0
