"""Ranked lexical search against a brute force over all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dossier.llm import lexicalsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    found = []
    for item, text in items:
        wanted, scored = Counter(words(text)), []
        for i, w, c in held:
            m = 100 - 75 + (75 * len(w) * n) // length
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, q in wanted.items()
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        found += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return found


def fixture(seed=3, documents=400):
    r = random.Random(seed)
    common = ["the", "of", "Und", "É", "数据", "a1", "ß\x85x"]
    rare = [f"w{i}" for i in range(300)]

    def text():
        size = r.choice((0, 1, 3, 20, 20, 60))
        return r.choice((" ", "-", "\n", "\x7f")).join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(size))

    docs = [(i, text()) for i in range(documents)]
    copy = "the of w1 w2 w3 w3"
    docs += [(i, copy) for i in range(1000, 1040)] + [(2000, copy.upper()), (2000, copy), (None, copy), (3000, None), (3001, ""), (3002, "\t\n")]
    docs += [(3003, "w1 " * 50_000 + "of")]
    items = [(i, text()) for i in range(40)] + [(90, copy), (90, copy), (91, None), (92, "absent nowhere"), (93, "the the the The w1"), (None, "w2 of")]
    return docs, items


@pytest.mark.parametrize("block_docs, block_terms", [(20_000, 200_000), (40, 60)])
def test_against_brute_force(spark, monkeypatch, block_docs, block_terms):
    monkeypatch.setattr(lexicalsearch, "BLOCK_DOCS", block_docs)
    docs, items = fixture()
    d = spark.createDataFrame([(*x, 1, "clash") for x in docs], "doc_id long, text string, _item int, score string").repartition(3)
    i = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, rank int").repartition(2)
    got = lexicalsearch.rank_documents(d, i, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(docs, items)))


@pytest.mark.parametrize("k", [1, 3])
def test_other_sizes_of_the_list(spark, k):
    docs, items = fixture(8, 100)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(str, map(tuple, lexicalsearch.rank_documents(d, i, k).collect()))) == sorted(map(str, brute(docs, items, k)))


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, "a b")], schema)
    nothing = spark.createDataFrame([], "item_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexicalsearch.rank_documents(none, item).collect() == []
    assert lexicalsearch.rank_documents(some, nothing).collect() == []
    assert [tuple(r)[:3] for r in lexicalsearch.rank_documents(some, item).collect()] == [(1, 1, 1)]


def test_accumulators_stop():
    """Documents that only hold the common term get no accumulator once the rare terms have settled the list."""
    n = 5000
    rare = [[0, 1] if d < 20 else [1] for d in range(n)]
    held = np.array([len(x) for x in rare])
    term = np.concatenate([np.array(x) for x in rare])
    lists = lexicalsearch.Postings(pa.array(range(n)), np.full(n, 10), held, term, np.ones(len(term)), n, 10 * n)
    holding = [20, n]
    weights = [lexicalsearch.term_weight(n, 20), 1]
    best, made = lists.rank({0: 1, 1: 1}, weights, holding, 1, 10)
    assert made == 20 and [d for _, d in best] == list(range(10))
    # With nothing left to lose, every document of the only term gets one.
    _, made = lists.rank({1: 1}, [0, 5], holding, 1, 10)
    assert made == n
