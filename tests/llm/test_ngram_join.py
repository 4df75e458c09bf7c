import random
import re
from collections import defaultdict

import numpy as np

from watchtide.llm import ngram_join as nj


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, threshold=0.8):
    docs = dict(docs)
    sets = {d: shingles(t) for d, t in docs.items()}
    near = defaultdict(set)
    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                near[a].add(b), near[b].add(a)
    top = {d: d for d in docs}
    for _ in docs:
        for d in docs:
            top[d] = min([top[d], *(top[x] for x in near[d])])
    return sorted((d, len(near[d]), top[d], top[d] == d) for d in docs)


def corpus():
    random.seed(7)
    say = lambda n: [f"w{random.randrange(400)}" for _ in range(n)]
    docs = [(i, " ".join(say(random.randrange(1, 80)))) for i in range(60)]
    base, long = say(120), say(2000)
    for i in range(90):  # a large group of near copies, at all distances
        w = base[:]
        for _ in range(i % 5):
            w[random.randrange(len(w))] = "changed"
        docs.append((100 + i, " ".join(w)))
    docs += [(300 + i, " ".join(long[i * 3 :])) for i in range(8)]
    docs += [(400, None), (401, ""), (402, " ?! "), (403, "one two"), (404, "One, TWO!"), (405, docs[3][1].upper()), (405, docs[3][1].upper())]
    return docs


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    table = spark.createDataFrame([*docs, (None, "one two")], "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS id", "3 AS n_links", "'x' AS digest")
    for texts in (1024, 16):
        monkeypatch.setattr(nj, "BLOCK_TEXTS", texts)
        got = sorted(tuple(r if r[0] is not None else (10**9, *r[1:])) for r in nj.ngram_join(table).collect())
        assert got == brute([*docs, (10**9, "one two")])  # a row without a key is a document too
    kept = [r.doc_id for r in nj.deduplicate(table).select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == sorted(r[0] for r in brute(docs) for _ in range(1 + (r[0] == 405)) if r[3])
    assert None in kept


def test_rows_without_keys_alone(spark):
    said = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, said), (None, said + " x"), (None, "other"), (7, None)], "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in nj.ngram_join(docs).collect())))
    assert got == sorted(map(repr, [(None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (7, 0, 7, True)]))


def test_a_shared_key_is_no_hot_key(spark):
    """Texts are met by key and text: all texts under one key cost no more than each alone."""
    pick = random.Random(2)
    rows = [(1, " ".join(f"w{pick.randrange(10**6)}" for _ in range(30))) for _ in range(300)]
    docs = spark.createDataFrame([*rows, (2, rows[0][1] + " more")], "doc_id long, text string")
    got = [tuple(r) for r in nj.ngram_join(docs).collect()]
    assert len(got) == 301 and sorted(r for r in got if r[1]) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_empty(spark):
    assert nj.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intersections():
    random.seed(1)
    sets = [np.unique(np.array([random.randrange(50) for _ in range(random.randrange(1, 60))], np.uint64)) for _ in range(12)]
    got = nj.intersections(sets[:5], sets[5:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]
    assert nj.least_matches()[nj.HASHES] < 0.8 * nj.HASHES


def test_texts_that_share_a_key_keep_their_links(spark):
    a = [f"a{i}" for i in range(60)]
    b = [f"b{i}" for i in range(60)]
    near = lambda w: " ".join([*w[:58], "x", "y"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (1, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS digest", "3 AS n")
    got = sorted(tuple(r) for r in nj.ngram_join(docs).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_long_texts(spark):
    w = [f"w{i}" for i in range(60_000)]
    rows = [(5, " ".join(w)), (6, " ".join([*w[:30_000], "x", *w[30_000:]])), (7, " ".join(w[:20_000]))]
    got = {r.doc_id: (r.n_links, r.component_id) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: (1, 5), 6: (1, 5), 7: (0, 7)}
