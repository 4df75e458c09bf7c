"""The audit by inclusion and exclusion against filters run row by row in every order."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from watchtide.llm import filter_audit

SCHEMA = "doc_id long, text string, source string"


def brute(docs, labels):
    def fails(d):
        t = d[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any(e[0] is not None and d[0] is not None and e[0] < d[0] and (e[1] or "") == t for e in docs)
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}

    good, toxic = ({k for k, q, x in labels if k is not None and (q, x)[i] == 1} for i in (0, 1))
    rows = [(d[2] or "", fails(d), d[0] in good, d[0] in toxic) for d in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                fail = [r for r in own if r[1][f]]
                out[part, order, step] = [len(left), len(gone), len(fail) - len(gone), sum(sum(r[1].values()) == 1 for r in fail), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def made(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_equals_filters_run_in_every_order(spark):
    pick = random.Random(3)
    texts = [None, "", " \t\n", "A B", "one # two", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "same " * 300, "Xy z\x00 " * 210, "É" * 50 + "E", " ".join(f"W{i}" for i in range(250)) + " 5%", "a" * 300_000, "w " * 1 + "word " * 20_000]
    docs = [(pick.choice([None, *range(40)]), pick.choice(texts), pick.choice([None, "", "web", "Wéb", "hot", "hot", "hot"])) for _ in range(150)]
    docs += [(5, "one # two", "hot")] * 3 + [(6, "one # two", "web")]
    labels = [(k, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for k in [None, *range(0, 40, 2), 4, 4]]
    frame = spark.createDataFrame(docs, SCHEMA).withColumns({"part": F.lit("x"), "A": F.lit(7), "n": F.lit("y"), "good": F.lit(1)})
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))
    got, want = made(filter_audit.audit(frame, told)), brute(docs, labels)
    assert got == want and len(got) == 600 * len({d[2] or "" for d in docs})
    assert filter_audit.audit(frame.limit(0), told).count() == 0
    none = made(filter_audit.audit(frame, told.limit(0)))
    assert {k: v[:4] for k, v in none.items()} == {k: v[:4] for k, v in want.items()} and not any(v[4] or v[5] for v in none.values())
