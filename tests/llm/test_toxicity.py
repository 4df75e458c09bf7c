import math
import random

from watchtide.llm import toxicity as tx


def corpus(seed=2, n=400):
    random.seed(seed)
    syllables = ["the", "an", "er", "on", "ti", "sh", "ea", "wh", "ou", "nd"]
    docs = []
    for i in range(n):
        w = ["".join(random.choice(syllables) for _ in range(random.randrange(1, 4))) for _ in range(random.randrange(20, 200))]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            w.insert(random.randrange(len(w)), random.choice(["Blurgh", "kwazzit!", "zompo" + random.choice(syllables)]))
        docs.append((i, " ".join(w), int(bad)))
    return docs


def test_held_out_accuracy(spark, monkeypatch):
    docs = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic").where("doc_id < 250")
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "?!"), (None, "kwazzit blurgh blurgh"), (903, "the an " * 50_000)], "doc_id long, text string")
    whole = table.select("doc_id", "text").unionByName(odd).selectExpr("*", "1 AS score", "2 AS toxic")
    model = tx.train(whole.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in tx.score(whole, model).collect()}
    assert len(got) == len(docs) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    wrong = sum(got[i].predicted != y for i, _, y in docs if i >= 250)
    assert wrong <= 2
    assert got[None].predicted == 1 and not any(got[i].predicted for i in (900, 901, 902, 903))


def test_without_labels(spark):
    table = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    model = tx.train(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in tx.score(table, model).collect()] == [0]
    assert tx.score(table.limit(0), model).count() == 0


def test_support_scales_with_the_sample():
    ordinary = [f"plain w{chr(97 + i % 26)}{chr(97 + i // 26)} words about weather" for i in range(400)]
    toxic = [f"plain w{chr(97 + i)}x blurgh w{chr(97 + i)}y weather" for i in range(8)] + ["plain words about weather"] * 42
    assert "blurgh" in tx.leaning(toxic, ordinary)  # eight contexts in 50 documents


def test_phrases_of_common_words_and_words_with_digits_lean():
    random.seed(5)
    say = lambda: " ".join(random.choice(["you", "all", "are", "bad", "good", "news", "today", "here"]) for _ in range(30))
    ordinary = [say().replace("bad news", "good news") for _ in range(300)]
    toxic = [f"{say()} bad news {say()} k1ller {random.choice('abcdef')}" for _ in range(60)]
    lean = tx.leaning(toxic, ordinary)
    assert {"bad news", "k1ller"} <= lean and not lean & {"you", "all", "are", "bad", "good", "news"}
    assert tx.leaning([], ordinary) == tx.leaning(toxic, []) == set()
    assert tx.leaning([toxic[0]] * 200, ordinary) <= {"bad news", "k1ller"}  # copies teach once


def test_both_dictionaries_are_trained(monkeypatch):
    import zstandard

    sizes, real = [], zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda n, samples, **how: sizes.append(n) or real(n, samples, **how))
    docs = corpus(n=900)
    pairs = tx.Pair.each([t for _, t, y in docs if y], [t for _, t, y in docs if not y])
    assert sorted(sizes) == [*[tx.DICTIONARY] * (1 + len(tx.SEGMENTS)), tx.COMMON]
    for pair in pairs:
        assert len(pair.toxic) == len(pair.ordinary) > 0
        assert b"blurgh" in pair.toxic and b"blurgh" not in pair.ordinary + pair.common


def test_score_against_brute_force(spark):
    import zstandard as z

    docs = corpus(n=300)
    model = tx.fit([t for _, t, y in docs if y], [t for _, t, y in docs if not y], 0.2)
    how = z.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=6, min_match=4, target_length=32, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(own, w):
        d = z.ZstdCompressionDict(model.pair.common + own, dict_type=z.DICT_TYPE_RAWCONTENT)
        return len(z.ZstdCompressor(dict_data=d, compression_params=how).compress(b" " + w + b" " + model.pair.common[-tx.TAIL :]))

    texts = [docs[0][1], docs[1][1], "One word", "", None, "x" * 1000]
    table = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").selectExpr("*", "'t' AS score", "3 AS predicted")
    got = tx.score(table, model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words = [w[i : i + 64] for w in (texts[r.doc_id] or "").lower().split() for i in range(0, len(w), 64)]
        runs = [" ".join(words[i : i + 4]).encode() for i in range(0, len(words), 4)]
        saved = [length(model.pair.ordinary, w) - length(model.pair.toxic, w) for w in runs]
        n = [*(sum(s >= c for s in saved) for c in tx.SAVED), max(len(runs), model.least)]
        z0 = sum(math.log1p(m) * k for m, k in zip(n, model.weights)) + model.weights[-1]
        assert abs(r.score - 1 / (1 + math.exp(-z0))) < 1e-9


def test_repeated_rows_and_shared_ids(spark):
    docs = corpus()
    table = spark.createDataFrame([(i, t) for i, t, _ in docs] * 2 + [(0, docs[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(None, 1), (3, None)], "doc_id long, toxic int")
    once = tx.train(table.dropDuplicates(), labels)
    assert tx.train(table.repartition(5), labels) == once
    left = tx.without_toxic(table.selectExpr("*", "'x' AS label"), once).collect()
    assert [c for c in left[0].asDict()] == ["doc_id", "text", "label"]
    assert len(left) % 2 == 0 or (0, docs[1][1]) in {(r.doc_id, r.text) for r in left}
