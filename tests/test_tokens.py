"""Encoding, padding, masks and block packing against Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossier.operators import tokens

TEXTS = {i: " ".join(f"w{(i * k) % 7} the" for k in range(i % 9)) for i in range(60)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").cache()


def python_ids(size):
    found = {i: re.findall(r"\w\w+", t.lower()) for i, t in TEXTS.items()}
    counts = Counter(t for ts in found.values() for t in ts)
    ranked = sorted(counts, key=lambda t: (-counts[t], t))[:size]
    ids = {t: n + 2 for n, t in enumerate(ranked)}
    return {i: [ids.get(t, 1) for t in ts] for i, ts in found.items()}


@pytest.mark.parametrize("size", [3, 100])
def test_encode(docs, size):
    coded = tokens.encode(docs, tokens.build_vocabulary(docs, size=size))
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == python_ids(size)


@pytest.mark.parametrize("block_bytes", [100, 10**6])
def test_encode_with_a_vocabulary_that_stays_a_table(spark, docs, block_bytes):
    texts = docs.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "unheard of")], "doc_id long, text string"))
    vocabulary = tokens.build_vocabulary(docs, size=5)
    coded = tokens.encode(texts, vocabulary, vocabulary_size=10**9, block_bytes=block_bytes)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {**python_ids(5), 900: [], 901: [], 902: [1, 1]}


def test_large_vocabulary_is_not_repeated(docs):
    coded = tokens.encode(docs, tokens.build_vocabulary(docs), vocabulary_size=10**9, block_bytes=100)
    assert "sequence(" not in coded._jdf.queryExecution().optimizedPlan().toString()


def test_small_vocabulary_moves_no_text(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    texts = spark.read.parquet(f"{tmp_path}/docs")
    plan = tokens.encode(texts, tokens.build_vocabulary(texts))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "explode" not in plan.lower()


@pytest.mark.parametrize("rows_per_range", [7, 1000])
@pytest.mark.parametrize("block", [4, 16])
def test_blocks(docs, rows_per_range, block):
    coded = tokens.encode(docs, tokens.build_vocabulary(docs))
    run = [t for _, ids in sorted(python_ids(1000).items()) for t in ids]
    got = tokens.packed_blocks(coded, block_size=block, rows_per_range=rows_per_range, order_values=docs).collect()
    assert {r["block"]: r["input_ids"] for r in got} == {
        b: run[b * block : (b + 1) * block] for b in range(len(run) // block)
    }


def test_padding_and_masks(spark):
    rows = spark.createDataFrame([(1, [5, 0, 7]), (2, []), (3, [9] * 6)], "id long, ids array<int>")
    got = {r["id"]: r for r in tokens.training_rows(rows, length=4).collect()}
    assert got[1]["input_ids"] == [5, 0, 7, 0] and got[1]["attention_mask"] == [1, 1, 1, 0]
    # A genuine token with the pad's id is masked as well.
    assert got[1]["labels"] == [5, -100, 7, -100]
    assert got[2]["input_ids"] == [0] * 4 and got[2]["attention_mask"] == [0] * 4
    assert got[3]["input_ids"] == [9] * 4 and got[3]["labels"] == [9] * 4


def test_stats(spark):
    rows = spark.createDataFrame([([1] * 3,), ([1] * 200,), ([],)], "ids array<int>")
    assert tuple(tokens.token_stats(rows).first()) == (128, pytest.approx(131 / 3))
    assert tuple(tokens.token_stats(rows.filter("false")).first()) == (None, None)


def test_caller_tokenizer(docs):
    coded = tokens.encode_with(docs, lambda texts: [[len(t)] for t in texts])
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: [len(t)] for i, t in TEXTS.items()}
    assert coded.select(F.size("ids").alias("n")).agg(F.max("n")).first()[0] == 1
