import hashlib
import random
import re

from watchtide.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width):
    wins = {(i, tuple(w[k : k + min(width, len(w))])) for i, t in items if (w := words(t)) for k in range(len(w) - min(width, len(w)) + 1)}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    if i is not None:
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    random.seed(3)
    vocabulary = ["the", "of", "a", "Ünd", "été", "x1", "zebra", "Omega"]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(1, say(6)), (2, say(3)), (10, "zebra"), (3, "the the the the"), (4, None), (5, "?!"), (6, say(9)), (7, say(6)), (None, "omega x1 omega"), (1, "a a")]
    docs = [(i, say(random.randrange(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{say(4)}, {t}. {say(3)}; {t}-{t}") for i, t in items if t and i] + [(200, None), (201, ""), (202, items[0][1].upper()), (202, items[0][1].upper()), (None, "ZEBRA")]
    ds = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS n_hit", "3 AS term")
    bs = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit, block in ((was, 512), ("-1", 512), ("-1", 2)):
        monkeypatch.setattr(dc, "BLOCK", block)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = sorted((tuple(r) for r in dc.decontaminate(ds, bs, width=5).collect()), key=repr)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        assert got == brute(docs, items, 5)
    assert dc.decontaminate(ds, bs.limit(0), width=5).where("contaminated OR n_items > 0").count() == 0
    assert dc.decontaminate(ds.limit(0), bs).count() == 0


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "beta gamma")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.decontaminate(docs, items).collect()}
    assert got == {1: (4, 2, 0, hashlib.sha256().hexdigest(), True), 2: (1, 0, 0, hashlib.sha256().hexdigest(), False)}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zebra one two Omega"), (2, "omega zebra"), (3, "zebra " + "x " * 9 + "omega")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "the omega zebra")], "item_id long, text string")
    more = docs.union(spark.createDataFrame([(4, "the the the the")], "doc_id long, text string"))
    assert sorted(r._key for r in dc.proximity_matches(more, items, slop=4).collect()) == [1, 2]


def test_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "the of a " * 70_000 + item + " the of a" * 1000
    docs = spark.createDataFrame([(1, text), (2, item[3:]), (3, "the of a " * 100)], "doc_id long, text string")
    items = spark.createDataFrame([(5, item), (6, "the of a " * 4)], "item_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in dc.decontaminate(docs, items).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {1: (213_030, 213_030, 2), 2: (29, 29, 1), 3: (300, 300, 1)}
