import numpy as np
import pytest

from watchtide.llm import lattice


def brute(rows, threshold=0.98):
    fine = {}
    for k, v, label in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            fine[k] = (np.array(v) / np.linalg.norm(v), label)
    links = {k: [o for o in fine if o != k and fine[o][1] == fine[k][1] and len(fine[o][0]) == len(fine[k][0]) and fine[o][0] @ fine[k][0] >= threshold] if k in fine else [] for k, _, _ in rows}
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for o in links[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        out[k] = (len(links[k]), min(seen), min(seen) == k)
    return out


def near(rng, base, n, noise):
    return [(base + noise * rng.normal(size=len(base))).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for g in range(12):
        base = rng.normal(size=32)
        out += [(v, g % 3) for v in near(rng, base, 6, 0.08)] + [(base.tolist(), g % 3)] * 3 + [(base.tolist(), (g + 1) % 3), (base.tolist(), None)]
    out += [(None, 1), ([], 1), ([0.0] * 32, 1), ([1.0, None] * 16, 1), ([float("nan")] * 32, 1), ([float("inf")] * 32, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    return [(k, v, label) for k, (v, label) in enumerate(out)]


def found(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    made = lattice.lattice_duplicates(spark.createDataFrame(rows, schema))
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in made.collect()}


def test_lattice_matches_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 5)  # groups span blocks
    single = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    assert found(spark, rows) == brute(single)


def test_lattice_repeated_and_empty(spark, rows):
    kept = [r for r in rows if r[0] < 20]
    assert found(spark, kept + kept + [(None, [1.0], 1)]) == found(spark, kept)
    assert found(spark, []) == {}


def test_decode_is_nearest():
    x = np.random.default_rng(0).uniform(-2, 2, (500, 8))
    v = lattice.decode(x)
    gap = ((x - v) ** 2).sum(1)
    for u in lattice.neighbours():
        assert (gap <= ((x - v - u) ** 2).sum(1) + 1e-9).all()
    assert (gap <= 1 + 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    (a, p), (b, q) = lattice.cells(x), lattice.cells(y)
    p, q = p.reshape(len(x), lattice.TABLES, -1), q.reshape(len(x), lattice.TABLES, -1)
    hit = ((a == b) | (a[:, :, None] == q).any(2) | (b[:, :, None] == p).any(2)).any(1)
    assert hit.mean() > 0.99


def test_vectors_that_share_a_key_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 16))
    rows = [(1, a.tolist(), 7), (1, b.tolist(), 7), (2, (a * 3).tolist(), 7), (3, (b + 0.001).tolist(), 7), (1, a.tolist(), 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS own", "3 AS digest", "4 AS m", "5 AS vector")
    got = sorted(tuple(r) for r in lattice.lattice_duplicates(table).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    assert lattice.lattice_duplicates(table.limit(0)).count() == 0


def test_recall_on_planted_pairs(spark):
    """The test embeddings hold no links, so pairs of cosine 0.98 and a little more are planted among them."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rng, rows, planted = np.random.default_rng(3), [], 0
    for r in vectors:
        rows.append((r.vec_id, [float(x) for x in r.embedding], r.label))
        if r.vec_id % 10 == 0 and r.label is not None:
            v = np.array(r.embedding, float)
            v /= np.linalg.norm(v)
            w = rng.normal(size=len(v))
            w -= w @ v * v
            w /= np.linalg.norm(w)
            c = 0.98 + 0.002 * rng.random() + 1e-9
            rows.append((1_000_000 + r.vec_id, (c * v + np.sqrt(1 - c * c) * w).tolist(), r.label))
            planted += 1
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in lattice.lattice_duplicates(table).collect()}
    assert len(got) == len(rows) and planted > 100
    found = sum(got[k].n_links == 1 and got[k].component_id == k - 1_000_000 for k in got if k >= 1_000_000)
    assert found >= 0.98 * planted
    assert sum(r.n_links for r in got.values()) == 2 * found
