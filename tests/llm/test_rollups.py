import random
from collections import defaultdict

from watchtide.llm import rollups
from watchtide.llm.rollups import DELETE, INSERT, REVISE

CHANGE = "doc_id long, tokenizer string, action string, source string, lang string, n_tokens long, seq long, n_docs int"


def test_batches_against_a_replay(spark, tmp_path):
    random.seed(5)
    ledger, state = rollups.Rollup(spark, str(tmp_path)), {}
    assert ledger.totals().count() == 0
    for batch in range(1, 5):
        changes = [
            (random.choice([*range(12), None]), random.choice(["v1", "v2"]), random.choice([INSERT, REVISE, DELETE]), random.choice(["a", None]), random.choice(["en", "de"]), random.choice([3, 5, None]), q, 9)
            for q in range(25)
        ]
        for d, tok, act, src, lang, n, *_ in changes:
            state[d, tok] = None if act == DELETE else (src, lang, n or 0)
        table = spark.createDataFrame(changes + changes[-2:], CHANGE)
        assert ledger.commit(batch, table)
        assert not ledger.commit(batch, table)
        want = defaultdict(lambda: [0, 0])
        for (_, tok), v in state.items():
            if v:
                want[v[0], v[1], tok][0] += 1
                want[v[0], v[1], tok][1] += v[2]
        assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in ledger.totals().collect()} == dict(want)
    assert ledger.commit(9, spark.createDataFrame([], CHANGE))
    assert ledger.batches() == [1, 2, 3, 4, 9]


def test_a_half_written_batch_is_overwritten(spark, tmp_path):
    ledger = rollups.Rollup(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "v", INSERT, "s", "en", 5, 0, 0)], CHANGE)
    ledger.commit(1, rows)
    fs, path = ledger._at("commits/1")
    fs.delete(path, False)
    assert ledger.totals().count() == 0
    assert ledger.commit(1, rows) and ledger.totals().first().n_tokens == 5


def test_counts(spark):
    from tokenizers import Tokenizer

    texts = ["Hello, world's end", None, "", "été " * 3000, "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        whole = Tokenizer.from_file(rollups.default_path(name))
        whole.encode_special_tokens = "byte" in name
        got = {r.doc_id: r.n_tokens for r in rollups.count_tokens(docs, name).collect()}
        assert got == {i: len(whole.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}


def test_query_counts_every_document_under_both_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer

    from watchtide.llm import queries

    rows = [(None, "one text"), (None, "another, longer text"), (None, "one text"), (None, None), (None, None), (1, "first of one id"), (1, "second of one id"), (1, "second of one id"), (2, "one text"), (3, "tres")]
    rows = [(d, t, "s", "es" if t == "tres" else "en") for d, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in queries.op6_token_counts(spark, str(tmp_path)).collect()}
    want = {}
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        whole = Tokenizer.from_file(rollups.default_path(name))
        n = {t: len(whole.encode(t, add_special_tokens=False)) for _, t, *_ in rows if t}
        want["es", name], want["en", name] = (1, n.pop("tres")), (6, sum(n.values()))  # four texts and two rows without one
    assert got == want


def test_compaction_keeps_totals(spark, tmp_path):
    schema = "doc_id long, tokenizer string, action string, source string, lang string, n_tokens long"
    batches = {
        1: [(i, "t", rollups.INSERT, "s", "en", i) for i in range(10)],
        2: [(i, "t", rollups.DELETE, None, None, None) for i in range(3)] + [(5, "t", rollups.REVISE, "s", "fr", 50)],
        3: [(5, "t", rollups.DELETE, None, None, None), (1, "t", rollups.INSERT, "s", "en", 7), (20, "t", rollups.INSERT, None, None, 4)],
    }
    plain, tidy = (rollups.Rollup(spark, str(tmp_path / n)) for n in ("plain", "tidy"))
    tidy.compact()  # nothing yet
    for b, rows in batches.items():
        for ledger in (plain, tidy):
            assert ledger.commit(b, spark.createDataFrame(rows, schema))
        tidy.compact()
        tidy.compact()
        assert sorted(map(tuple, tidy.totals().collect()), key=repr) == sorted(map(tuple, plain.totals().collect()), key=repr)
    assert not tidy.commit(2, spark.createDataFrame(batches[2], schema)) and tidy.batches() == [1, 2, 3]
    alive = {tuple(r) for r in tidy.state().where("alive").collect()}
    assert alive == {tuple(r) for r in plain.state().where("alive").collect()}


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", 77, "x", 5)], "doc_id long, text string, n_tokens int, tokenizer string, part int")
    r = rollups.count_tokens(docs, "word_bpe_49k.json").first()
    assert (r.doc_id, r.n_tokens, r.tokenizer, r.part) == (1, 2, "word_bpe_49k.json", 5)
    assert rollups.count_tokens(docs.limit(0), "word_bpe_49k.json").count() == 0


def test_byte_level_counts_by_spaces_equal_the_library():
    """With a cache of spaces and words: white spaces of all kinds, separators that Python alone takes for such, endings, marks and special tokens."""
    import random

    from tokenizers import Tokenizer

    from watchtide.llm.tokens import SpaceCounts, default_path, space_parted

    path = default_path("byte_bpe_50k.json")
    assert space_parted(path) and not space_parted(default_path("word_bpe_49k.json"))
    whole, counter, pick = Tokenizer.from_file(path), SpaceCounts(path), random.Random(5)
    whole.encode_special_tokens = True
    pool = [*" \n\t\r\x0b\x1c\x1d\x1e\x1f\x85\xa0 ​  　abcXYZ019'.,!-###é漢א١²_$€😀́", "'s", "'ll", " the", "<|endoftext|>", "  ", "\n\n", "ing"]
    for _ in range(5000):
        text = "".join(pick.choice(pool) for _ in range(pick.randrange(1, 14)))
        assert counter.text(text) == len(whole.encode(text, add_special_tokens=False)), text
    assert counter.text(None) == counter.text("") == 0
    long = " " + "x" * 1000
    assert counter.text(long) == len(whole.encode(long, add_special_tokens=False)) and long not in counter
