"""Repair against a search over whole edit strings, on conversations of every kind, one of them cut over partitions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from watchtide.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def in_order(rows):
    same = lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    return sorted(((t, r or "", x or "") for _, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", same(r)))), key=lambda r: (r[0] is not None, r[0] or 0))


def brute(rows):
    """(counts, cost, audit, repaired) of one conversation's rows; paths carry their whole strings."""
    rows, faults, seen = in_order(rows), [], set()
    for _, r, x in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("blank" if not visible else "duplicate" if (r, x) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((r, x))
    def suffix(i, q, inserts, memo):
        key = (i, q, inserts)
        if key in memo:
            return memo[key]
        found = []
        if i == len(rows):
            found += [(0, "", ())] if q in ("", "a") else []
        else:
            _, r, x = rows[i]
            c, s, o = suffix(i + 1, q, 0, memo)
            found.append((c + 4, "D" + s, o))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                for letter, name in (("u", "user"), ("a", "assistant")):
                    if letter in NEXT[q]:
                        c, s, o = suffix(i + 1, letter, 0, memo)
                        found.append((c + 3 + more, "R" + s, ((name, x), *o)))
                if r[:1] in NEXT[q]:
                    c, s, o = suffix(i + 1, r[:1], 0, memo)
                    found.append((c + more, "K" + s, ((r, x), *o)))
        if inserts < 3:
            for letter, name in (("u", "user"), ("a", "assistant")):
                if letter in NEXT[q] and (more := suffix(i, letter, inserts + 1, memo)):
                    found.append((more[0] + 3, "I" + more[1], ((name, ""), *more[2])))
        memo[key] = min(found, key=lambda f: f[:2]) if found else (10**9, "", ())
        return memo[key]

    cost, audit, out = suffix(0, "", 0, {})
    turns = [t for t, *_ in rows if t is not None]
    legal = {"su", "ua", "au"}
    illegal = sum(a[1][:1] + b[1][:1] not in legal for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return [gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost], audit, out


def random_rows(pick, conv, n):
    text = lambda: pick.choice(["", " ", "\t\n", "Fine.", "cut", "ok?", "go! \n", "Wait", "é.", "x" * pick.randint(0, 3) + ".", None])
    return [(conv, pick.choice([None, *range(n)]) if pick.random() < 0.3 else i, pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]), text()) for i in range(n)]


def test_repair_equals_search_over_strings(spark):
    pick = random.Random(12)
    rows = [r for conv in [None, *range(120)] for r in random_rows(pick, conv, pick.randint(1, 9))]
    rows += [(500, 0, "system", "Only."), (501, None, "assistant", "Hi."), (502, -(2**63), "user", "a."), (502, 2**63 - 1, "assistant", "b."), (503, 0, "user", "very long " * 50_000 + ".")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit("x"), "pos": F.lit(1), "same": F.lit("y"), "place": F.lit(0)})
    found = repair.plan(frame)
    told = {r.conv_id: r for r in repair.report(found).collect()}
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digest(found, frame).collect()}
    out = {}
    for r in sorted(repair.repaired(found, frame).collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(told) == set(by)
    for conv, own in by.items():
        counts, audit, want = brute(own)
        t = told[conv]
        got = [t.gaps, t.blank, t.duplicate, t.truncated, t.illegal, t.cost]
        assert got == counts or conv == 502 and t.gaps == 2**64 - 2 or conv == 502 and t.gaps is None and got[1:] == counts[1:]
        assert (t.audit, tuple(out.get(conv, ()))) == (audit, want), (conv, own)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in want))
        assert hashes.get(conv, hashlib.sha256().hexdigest()) == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in want).encode()).hexdigest()
    none = repair.plan(frame.limit(0))
    assert repair.report(none).count() == 0 and repair.digest(none, frame.limit(0)).count() == 0


def test_conversation_over_several_partitions(spark):
    """Two conversations hold nearly all rows, one of them many equal ones: they are cut, and repaired as if whole."""
    pick = random.Random(5)
    rows = random_rows(pick, None, 400) + random_rows(pick, 1, 300) + [(1, 7, "user", "again.")] * 200 + random_rows(pick, 2, 3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = repair.plan(frame)
    finally:
        spark.conf.set(name, was)
    assert {r.conv_id: r.n for r in found.groupBy(F.col("conv").alias("conv_id")).agg(F.count(F.lit(1)).alias("n")).collect()}[None] > 1
    told = {r.conv_id: r for r in repair.report(found).collect()}
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digest(found, frame).collect()}
    for conv in (None, 1, 2):
        own = repair_by_steps([r for r in rows if r[0] == conv])
        t = told[conv]
        assert ([t.gaps, t.blank, t.duplicate, t.truncated, t.illegal, t.cost], t.audit) == own[:2]
        assert hashes[conv] == own[2]


def repair_by_steps(rows):
    """brute, without its depth of recursion: whole strings by state, from the last row to the first."""
    ordered, seen, faults = in_order(rows), set(), []
    for _, r, x in ordered:
        visible = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("blank" if not visible else "duplicate" if (r, x) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((r, x))
    grow = lambda w: {q: min([w[q]] + [(w[p][0] + 3 * len(e), e + w[p][1]) for p, e in ways]) for q, ways in (("", (("u", "I"), ("a", "II"))), ("s", (("u", "I"), ("a", "II"))), ("u", (("a", "I"),)), ("a", (("u", "I"),)))}
    never = (10**9, "")
    w = grow({"": (0, ""), "s": never, "u": never, "a": (0, "")})
    for (_, r, _x), f in zip(reversed(ordered), reversed(faults)):
        now = {}
        for q in w:
            ways = [(w[q][0] + 4, "D" + w[q][1])]
            if f not in ("blank", "duplicate"):
                more = 3 * (f == "truncated")
                ways += [(w[to][0] + 3 + more, "R" + w[to][1]) for to in NEXT[q] if to != "s"]
                ways += [(w[to][0] + more, "K" + w[to][1]) for to in NEXT[q] if to == r[:1]]
            now[q] = min(ways)
        w = grow(now)
    cost, audit = w[""]
    out, q, i = [], "", 0
    for e in audit:
        _, r, x = ordered[min(i, len(ordered) - 1)]
        if e in "RI":
            q = next(to for to in NEXT[q] if to != "s")
            out.append(({"u": "user", "a": "assistant"}[q], "" if e == "I" else x))
        elif e == "K":
            q = r[:1]
            out.append((r, x))
        i += e != "I"
    turns = [t for t, *_ in ordered if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(ordered, ordered[1:]))
    counts = [max(turns) - min(turns) + 1 - len(set(turns)), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost]
    return counts, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()


def test_damage_names_nulls_by_one_space(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(40)) for r, x in ((None, "Some. text!"), ("assistant", None))]
    made = sorted(repr(tuple(r)) for r in queries.damaged(spark.createDataFrame(rows, SCHEMA)).collect())
    from zlib import crc32

    want = []
    for c, t, r, x in rows:
        h = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if h:
            want += [(c, t, "user" if h == 4 else r, "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x)] * (2 if h == 3 else 1)
    assert sorted(map(repr, want)) == made
