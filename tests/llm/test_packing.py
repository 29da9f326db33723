"""Packing against the tokenizer itself and a naive sum-of-squares placement."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dossier.llm import packing
from dossier.llm.encoding import Encoder
from dossier.llm.queries import word_tokenizer

SCHEMA = "doc_id long, text string, length string, ids int, sequence_id string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_tokenizer())


@pytest.fixture(scope="module")
def memory():
    return Encoder(word_tokenizer())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_remembered_ids_are_those_of_the_tokenizer(tokenizer, memory, text):
    assert np.frombuffer(memory.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["Don't WE'LL it's", "é É ß ñ Ünï", "a<|endoftext|>B <|startoftext|>", "İ K ſ ΑΣ", "x²³½ª", "a\x0bb\x1cc\x85d\xa0e f", "%%%&&& _a_ 12 3.4", "é ́"],
)
def test_awkward_texts(tokenizer, memory, text):
    assert np.frombuffer(memory.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def naive_place(levels, size, window):
    best = None
    for level in [0, *sorted(l for l, n in levels.items() if n and l + size <= window)]:
        after = dict(levels)
        if level:
            after[level] -= 1
        if level + size < window:
            after[level + size] = after.get(level + size, 0) + 1
        cost = sum(n * n for n in after.values())
        if best is None or cost < best[0] or (cost == best[0] and level > best[1]):
            best = (cost, level)
    return best[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=80))
def test_each_piece_goes_where_the_squares_grow_least(sizes):
    packer = packing.Packer(16, 0)
    levels: dict[int, int] = {}
    for n, size in enumerate(sizes):
        expected = naive_place(levels, size, 16)
        assert packer._level_for(size) == expected
        packer.add((n, 0, b"\0" * 4 * size, size))
        if expected:
            levels[expected] -= 1
        if expected + size < 16:
            levels[expected + size] = levels.get(expected + size, 0) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(8, 200))
def test_all_tokens_once_and_little_padding(lengths, epoch):
    documents = [(n, np.arange(size, dtype="<u4").tobytes()) for n, size in enumerate(lengths)]
    rows = list(packing.packed_rows(iter(documents), 16, epoch, 5))
    seen: dict[int, list] = {}
    fill: dict[int, list] = {}
    for key, start, ids, total, number, offset in rows:
        assert ids and total == lengths[key]
        seen.setdefault(key, []).append((start, np.frombuffer(ids, "<u4").tolist()))
        fill.setdefault(number, []).append((offset, len(ids) // 4))
    for key, size in enumerate(lengths):
        assert [i for _, part in sorted(seen[key]) for i in part] == list(range(size))
    padded = 0
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 16
        padded += at < 16
    assert padded <= 1 + sum(lengths) // epoch


def test_table(spark, tokenizer):
    long = "the quick brown fox " * 5000
    rows = [(1, "a b c", "x", 1, "y"), (2, None, None, None, None), (3, "", "", 0, ""), (None, "no id", "", 0, ""), (1, "a b c", "x", 1, "y"), (4, long, "", 0, "")]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), word_tokenizer()).collect()
    got: dict = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    assert got[2] == got[3] == [(0, [2], 1)]
    assert [p[1] for p in got[1]] == [[*tokenizer.encode("a b c", add_special_tokens=False).ids, 2]] * 2
    assert [i for p in sorted(got[4]) for i in p[1]] == [*tokenizer.encode(long, add_special_tokens=False).ids, 2]
    assert len(got[None]) == 1
    empty = packing.pack_documents(spark.createDataFrame([], SCHEMA), word_tokenizer())
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_partitions_get_sequences_of_their_own(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * (i % 50)) for i in range(300)], "doc_id long, text string").repartition(5)
    rows = packing.pack_documents(docs, word_tokenizer(), window=64).collect()
    spans: dict = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
