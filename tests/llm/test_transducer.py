"""The transducers against the tokenizers library, and the lookahead against every continuation of small alphabets."""

import hashlib
import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from watchtide.llm import queries, transducer
from watchtide.llm.tokens import default_path

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def random_text(pick, n):
    kinds = ["ab cDé'S't \n", "ȩ́ä 각ΣΑΣ ς", "!!''ll're 've'", "<|endoftext|> <|x", "一二三 ٣４ ½", "the in ing an th er on", "\x1c\x1f\x85　\U0001f600\x00"]
    return "".join(pick.choice(pick.choice(kinds)) if pick.random() < 0.9 else pick.choice(["<|endoftext|>", "<|startoftext|>", "the", "ing", "'s"]) for _ in range(n))


def test_streams_equal_the_library(library, monkeypatch):
    """Small blocks and windows, so that words, marks and contractions are cut everywhere."""
    monkeypatch.setattr(transducer, "BLOCK", 40)
    monkeypatch.setattr(transducer, "WINDOW", 16)
    pick, encoder = random.Random(4), transducer.Encoder(WORD)
    monkeypatch.setattr(transducer, "CACHE", 50)
    texts = [random_text(pick, pick.choice([0, 1, 5, 60, 400])) for _ in range(400)] + ["a" * 3000 + "!" * 900 + "'s" * 500, "ab" * 2000, "é" * 1500, "e" + "́" * 1000 + "x", "1" * 999, ".," * 500]
    for text in texts:
        machine, ids, said = transducer.Decoder(encoder.bpe, True), [], []
        for piece in encoder.text(text):
            ids.append(piece)
            said.append(machine.feed(piece))
        want = library.encode(text, add_special_tokens=False).ids
        assert b"".join(ids) == packed(want), text
        assert "".join(said) + machine.finish() == library.decode(want, skip_special_tokens=False)


def test_every_plane_of_characters(library):
    encoder = transducer.Encoder(WORD)
    for c in itertools.chain(range(0x3000), range(0x3000, 0x110000, 97)):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b 1{chr(c)}"
            assert b"".join(encoder.text(text)) == packed(library.encode(text, add_special_tokens=False).ids), hex(c)


def test_memory_of_a_long_word_is_a_window():
    encoder = transducer.Encoder(WORD)
    run, most = transducer.Run(encoder.bpe, encoder.sizes), 0
    for _ in range(40):
        for _ in run.feed("entionsth" * 1000):
            most = max(most, len(run.held))
        most = max(most, len(run.held))
    assert most < encoder.bpe.lookahead + 2 * transducer.WINDOW and encoder.bpe.lookahead < 1000


def small_merges(pick):
    merges, tokens = [], ["a", "b", "c"]
    while len(merges) < 9:
        u, v = pick.choice(tokens), pick.choice(tokens)
        if u + v not in tokens and len(u + v) < 9:
            merges.append((u, v))
            tokens.append(u + v)
    return merges


def apply(merges, symbols):
    for u, v in merges:  # rank by rank, from the left
        out, i = [], 0
        while i < len(symbols):
            if symbols[i : i + 2] == [u, v]:
                out.append(u + v)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def test_lookahead_is_sufficient():
    """Tokens that end a lookahead before the end of a text stand in every continuation of it."""
    pick = random.Random(9)
    for _ in range(60):
        merges = small_merges(pick)
        reach = transducer.sufficient_lookahead(merges, len)
        for _ in range(40):
            text = [pick.choice("abc") for _ in range(reach + 12)]
            at, settled = 0, []
            for t in apply(merges, text):
                at += len(t)
                if at <= len(text) - reach:
                    settled.append(t)
            for more in ("a", "b", "c", "ab", "ca", "bcb", "".join(pick.choice("abc") for _ in range(20))):
                assert apply(merges, [*text, *more])[: len(settled)] == settled
    with pytest.raises(ValueError):
        transducer.sufficient_lookahead([("ab", "c"), ("a", "b")], len)
    with pytest.raises(ValueError):
        transducer.sufficient_lookahead([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")], len)


def test_on_tables(spark, library):
    rows = [(1, "Hello, été it's <|endoftext|> DON'T!! 123"), (2, None), (3, ""), (None, "same"), (4, "same"), (4, "same"), (5, "naïve \U0001f600 words " * 30_000), (6, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "key": F.lit(1)})
    got = sorted(map(repr, (tuple(r) for r in transducer.round_trips(docs).collect())))
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(map(repr, want))
    encoded = transducer.encode(docs)
    said = {r.doc_id: r.text for r in transducer.decode(encoded).collect()}
    assert said[1] == "hello , été it 's <|endoftext|>don 't !! 1 2 3 " and said[5] == "naïve \U0001f600 words " * 30_000 and said[2] == said[3] == ""
    joined = {r.doc_id: r.text for r in transducer.decode(encoded, joined=True).collect()}
    assert joined[4] == "same</w>"
    assert transducer.round_trips(docs.limit(0)).count() == 0 and transducer.decode(encoded.limit(0)).count() == 0
    assert transducer.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).collect()[0].text == ""


def test_bytes_come_as_whole_characters():
    bpe = transducer.BPE(BYTE)
    text = "naïve \U0001f600 日本"
    ids = Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    machine = transducer.Decoder(bpe, False)
    assert "".join(machine.feed(packed([i])) for i in ids) + machine.finish() == text
    broken = transducer.Decoder(bpe, False)
    cut = Tokenizer.from_file(BYTE).encode("\U0001f600", add_special_tokens=False).ids[:1]
    assert broken.feed(packed(cut)) + broken.finish() == "�"
    with pytest.raises(ValueError):
        transducer.Encoder(BYTE)


def test_query_over_the_table(spark, library):
    path = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    made = queries.op11_bpe_transducer(spark, path).collect()
    assert len(made) == len(docs)
    for r in made:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
