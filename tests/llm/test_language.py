import itertools
import random

import numpy as np

from watchtide.llm import language as lg

SYLLABLES = {"aa": ["the", "an", "er", "on", "ing"], "bb": ["que", "ción", "los", "an", "ez"], "cc": ["sch", "ung", "üb", "er", "keit"]}


def say(lang, n):
    return ["".join(random.choice(SYLLABLES[lang]) for _ in range(random.randrange(1, 4))) for _ in range(n)]


def test_marginals_against_all_paths():
    rng = np.random.default_rng(4)
    e, moves, lengths = rng.normal(size=(9, 2)), rng.normal(size=(2, 2)), np.array([5, 1, 3])
    got, at = lg.marginals(e, lengths, moves), 0
    for n in lengths:
        want = np.zeros((n, 2))
        for path in itertools.product(range(2), repeat=int(n)):
            start = np.log(np.exp(moves[:, path[0]]).sum())
            p = np.exp(start + sum(e[at + t, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, s in enumerate(path):
                want[t, s] += p
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(7)
    n, k, lengths = 14, 3, np.array([6, 1, 7])
    x, y = rng.integers(1, 5, size=(n, 2)), rng.integers(0, k, n)

    def likelihood(weights, moves):
        e, at, total = weights[x].sum(1), 0, 0.0
        for m in lengths:
            logs = {}
            for path in itertools.product(range(k), repeat=int(m)):
                start = np.log(np.exp(moves[:, path[0]]).sum())
                logs[path] = start + sum(e[at + t, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            total += logs[tuple(y[at : at + m])] - np.log(np.exp(list(logs.values())).sum())
            at += m
        return total

    weights, moves, step = rng.normal(size=(5, k)), rng.normal(size=(k, k)), 1e-5
    up_e, up_m = lg.gradient(x, y, lengths, lg.Model(["a", "b", "c"], weights, moves))
    for i, j in itertools.product(range(k), repeat=2):
        d = np.zeros((k, k))
        d[i, j] = step
        assert np.isclose((likelihood(weights, moves + d) - likelihood(weights, moves - d)) / (2 * step), up_m[i, j], atol=1e-4)
    up_w = np.zeros_like(weights)
    np.add.at(up_w, x.ravel(), np.repeat(up_e, 2, axis=0))
    for i, j in itertools.product(range(1, 5), range(k)):
        d = np.zeros_like(weights)
        d[i, j] = step
        assert np.isclose((likelihood(weights + d, moves) - likelihood(weights - d, moves)) / (2 * step), up_w[i, j], atol=1e-4)


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["bb", "aa"] * 20)] * 2, "doc_id long, text string, lang string")
    model = lg.train(docs)
    assert lg.train(docs.dropDuplicates().repartition(3)).langs == model.langs == ["aa", "bb"]
    flat = lg.Model(["aa", "bb"], np.zeros((lg.WEIGHTS, 2)), np.zeros((2, 2)))
    rows = spark.createDataFrame([(1, "any words"), (1, "any words")], "doc_id long, text string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    assert [(r.lang_pred, r.score) for r in lg.identify(rows, flat).collect()] == [("aa", 0.5)] * 2


def test_chunks_do_not_change_marginals(monkeypatch):
    rng = np.random.default_rng(5)
    e, moves, lengths = rng.normal(size=(400, 3)), rng.normal(size=(3, 3)), np.array([300, 1, 7, 92])
    whole = lg.marginals(e, lengths, moves)
    monkeypatch.setattr(lg, "CHUNK", 4)
    assert np.allclose(lg.marginals(e, lengths, moves), whole)


def test_held_out_and_code_switching(spark):
    random.seed(6)
    rows = [(i, " ".join(say(lang, random.randrange(5, 80))), lang) for i in range(300) for lang in [random.choice([*SYLLABLES])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lg.train(docs.where("doc_id < 200").unionByName(spark.createDataFrame([(900, "x", None), (901, None, "aa")], docs.schema)))
    assert model.langs == ["aa", "bb", "cc"]
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "12 !?"), (903, " ".join(say("bb", 30_000))), (None, "Schung keit")], "doc_id long, text string")
    got = {r.doc_id: r for r in lg.identify(docs.select("doc_id", "text").unionByName(odd).selectExpr("*", "1 AS score"), model).collect()}
    assert sum(got[i].lang_pred != lang for i, _, lang in rows if i >= 200) <= 1
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und"] * 3 + ["bb", "cc"]
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = say("aa", 12) + say("cc", 12) + say("bb", 12)
    r = lg.label_words(spark.createDataFrame([(1, " ".join(mixed)), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert r[0].words == mixed and sum(a != b for a, b in zip(r[0].langs, ["aa"] * 12 + ["cc"] * 12 + ["bb"] * 12)) <= 3 and r[1].langs == []


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in lg.identify(docs, lg.train(docs)).collect()] == ["und"]
    assert lg.identify(docs.limit(0), lg.train(docs.limit(0))).count() == 0
