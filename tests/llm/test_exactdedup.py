"""Exact dedup against plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dossier.llm import exactdedup

SCHEMA = "doc_id long, text string, _digest int, keep_id string, _Keep int"


def fixture():
    r = random.Random(1)
    texts = [f"text {i} é😀 " * r.randrange(1, 4) for i in range(60)] + ["", None, "x" * 300_000]
    rows = [(i, "hot" if r.random() < 0.4 else r.choice(texts)) for i in range(500)]
    rows += [(None, "hot"), (None, "only here"), (None, "only here"), (600, "tied"), (600, "tied"), (600, "hot"), (600, "hot"), (-1, " hot")]
    r.shuffle(rows)
    return [(*row, 1, "clash", 2) for row in rows]


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def groups(rows):
    found = {}
    for i, text, *_ in rows:
        found.setdefault(digest(text), []).append(i)
    return found


def largest(ids):
    return max((i for i in ids if i is not None), default=None)


@pytest.fixture(params=[0.001, 0.05, 1.0], ids=["all frequent", "some", "none"])
def share(request, monkeypatch):
    monkeypatch.setattr(exactdedup, "SHARE", request.param)


def test_labels_against_plain_python(spark, share):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exactdedup.label_copies(docs).collect()
    by_digest = groups(rows)
    expected = sorted((i, largest(by_digest[digest(t)]), len(by_digest[digest(t)]), digest(t)) for i, t, *_ in rows if i is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got if r.doc_id is not None) == expected
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        if r.kept:
            assert r.text_sha256 not in kept
            kept[r.text_sha256] = r.doc_id
    assert kept == {h: largest(ids) for h, ids in by_digest.items()}


def test_kept_rows_with_all_columns(spark, share):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = exactdedup.drop_copies(docs)
    assert kept.columns == docs.columns
    by_digest = groups(rows)
    assert sorted((digest(r.text), str(r.doc_id), r.keep_id, r._Keep) for r in kept.collect()) == sorted(
        (h, str(largest(ids)), "clash", 2) for h, ids in by_digest.items()
    )


def test_normalised_texts(spark):
    docs = spark.createDataFrame([(1, " A "), (2, "a"), (3, "b")], "doc_id long, text string")
    got = exactdedup.label_copies(docs, normalise=lambda c: F.lower(F.trim(c))).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept, r.text_sha256) for r in got) == [
        (1, 2, False, digest("a")), (2, 2, True, digest("a")), (3, 3, True, digest("b")),
    ]


def test_other_id_types(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "name string, body string")
    got = exactdedup.label_copies(docs, "name", "body").collect()
    assert sorted((r["name"], r.keep_id, r.kept) for r in got) == [("a", "b", False), ("b", "b", True), ("c", "c", True)]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exactdedup.label_copies(docs).collect() == []
    assert exactdedup.drop_copies(docs).collect() == []


def test_summary_holds_every_frequent_digest(spark):
    rows = [(str(i % 7) if i % 3 == 0 else f"lone {i}",) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "_digest string").repartition(40)
    found = {r._digest for r in exactdedup.frequent_digests(docs).collect()}
    assert {str(i) for i in range(7)} <= found and len(found) <= exactdedup.MOST_CANDIDATES


def test_plans_move_no_texts_and_run_no_python(spark, tmp_path):
    spark.createDataFrame(fixture(), SCHEMA).write.parquet(f"{tmp_path}/docs")
    plan = exactdedup.label_copies(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
    assert "text#" not in plan and "BroadcastExchange" in plan
    source = open(exactdedup.__file__).read()
    assert "udf" not in source and ".rdd" not in source and "InPandas" not in source and "InArrow" not in source
