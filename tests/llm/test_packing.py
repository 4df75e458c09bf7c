import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from watchtide.llm import packing, tokens

WHOLE = Tokenizer.from_file(tokens.default_path())
ENCODER = tokens.WordIds(tokens.default_path())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aB éÉß.,'s<|endoftx>\n\t́İΣσ\xa0\x85\x1c1٣", max_size=40)))
def test_word_ids_are_the_tokenizers(text):
    assert ENCODER.text(text) == struct.pack(f"<{len(i := WHOLE.encode(text, add_special_tokens=False).ids)}I", *i)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_rank_once(histogram):
    table, bins = packing.plan(histogram, capacity=64)
    lengths = [n for n in sorted(histogram, reverse=True) for _ in range(histogram[n])]
    spans, ranks = defaultdict(list), []
    for lo, hi, first, per, offset, n in table.tolist():
        for r in range(lo, hi):
            assert lengths[r] == n
            ranks.append(r)
            at = offset + (r - lo) % per * n
            spans[first + (r - lo) // per].append((at, at + n))
    assert sorted(ranks) == list(range(len(lengths)))
    assert sorted(spans) == list(range(bins))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert bins >= max(math.ceil(sum(lengths) / 64), sum(n > 32 for n in lengths))  # no two lengths above half fit together
    assert bins <= 2 * sum(lengths) / 64 + 1  # at most one sequence is half empty


def optimum(lengths, capacity):
    """Fewest sequences by trying everything."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {*rooms}:
            if r >= lengths[i]:
                rest = [*rooms]
                rest.remove(r)
                place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_tiny_plans_against_the_optimum(lengths):
    _, bins = packing.plan(dict(Counter(lengths)), capacity=20)
    least = optimum(sorted(lengths, reverse=True), 20)
    assert least <= bins <= least + 1


def test_lengths_above_half_stand_alone():
    assert packing.plan({33: 13}, capacity=64)[1] == 13


def test_plan_is_near_the_bound_on_mixed_lengths():
    import random

    random.seed(1)
    histogram = Counter(min(4096, int(random.lognormvariate(6.5, 1.0)) + 1) for _ in range(20_000))
    _, bins = packing.plan(histogram)
    assert bins <= 1.002 * sum(n * c for n, c in histogram.items()) / 4096 + 1


def test_documents(spark):
    long = "word " * 5000
    rows = [(1, "a b", "x", 5), (2, None, "y", 6), (3, "", "y", 7), (4, long, "z", 8), (1, "a b", "x", 5), (None, "The end.", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")
    got = packing.pack_documents(docs).collect()
    assert len(got) == 7
    spans = defaultdict(list)
    for r in got:
        text = next(t for d, t, *_ in rows if d == r.doc_id) or ""
        ids = [*WHOLE.encode(text, add_special_tokens=False).ids, 1]
        part = ids[4096 * r.piece : 4096 * (r.piece + 1)]
        assert (r.start, r.length) == (4096 * r.piece, len(part))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        spans[r.sequence_id].append((r.offset, r.offset + r.length))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert packing.pack_documents(docs.limit(0)).count() == 0
