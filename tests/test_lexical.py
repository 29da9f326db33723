"""Closed-form TF-IDF against the vectoriser written out for two texts."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.operators import lexical, scaling


def two_text_score(a: str, b: str, stop=()):
    counts = [Counter(t for t in re.findall(r"\b\w\w+\b", x.lower()) if t not in stop) for x in (a, b)]
    terms = set(counts[0]) | set(counts[1])
    idf = {t: math.log(3 / (1 + sum(t in c for c in counts))) + 1 for t in terms}
    rows = [[c[t] * idf[t] for t in sorted(terms)] for c in counts]
    lengths = [math.sqrt(sum(x * x for x in r)) for r in rows]
    if 0 in lengths:
        return 0.0
    return sum(x * y for x, y in zip(*rows)) / (lengths[0] * lengths[1])


DOCS = [
    (1, 10, "Python developer with Spark, Spark and Hadoop skills"),
    (2, 10, "Chef de cuisine à Paris; été 2020"),
    (3, 20, "spark SPARK spark"),
    (4, 20, "the and of"),
    (5, 20, ""),
    (6, 10, "Python developer with Spark, Spark and Hadoop skills"),
    (7, 10, "a b c d"),
]
JDS = [(10, "Looking for a Spark developer (Python); été"), (20, "the chef of Spark")]


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, session_id long, text string")
    jds = spark.createDataFrame(JDS, "session_id long, text string")
    return docs, jds


@pytest.mark.parametrize("stop", [(), lexical.ENGLISH_STOP_WORDS])
@pytest.mark.parametrize("salted", [False, True])
def test_pairs(frames, stop, salted, monkeypatch):
    if salted:
        monkeypatch.setattr(scaling.join_small, "__defaults__", ("inner", (), 4, 1, 1, None))
    docs, jds = frames
    found = lexical.tfidf_scores(docs, jds.withColumnRenamed("session_id", "jd_id"), stop_words=stop)
    got = {(r["jd_id"], r["doc_id"]): r["tfidf_score"] for r in found.collect()}
    for jd_id, jd in JDS:
        for doc_id, _, text in DOCS:
            assert got.get((jd_id, doc_id), 0.0) == pytest.approx(two_text_score(jd, text, stop), abs=1e-12)


def test_own_session_only(frames):
    docs, jds = frames
    found = lexical.tfidf_scores(docs, jds.withColumn("jd", F.col("session_id")), desc_id="jd", on=["session_id"])
    rows = found.collect()
    assert all(r["jd"] == r["session_id"] for r in rows)
    wanted = {(d, s): two_text_score(dict(JDS)[s], t, lexical.ENGLISH_STOP_WORDS) for d, s, t in DOCS}
    assert {(r["doc_id"], r["session_id"]): round(r["tfidf_score"], 9) for r in rows} == {
        k: round(v, 9) for k, v in wanted.items() if v > 0
    }


WORDS = st.lists(st.sampled_from(["spark", "data", "lake", "ml", "python", "x"]), max_size=8).map(" ".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=12))
def test_bounds_and_equality(spark, pairs):
    docs = spark.createDataFrame([(i, i, a) for i, (a, _) in enumerate(pairs)], "doc_id long, s long, text string")
    jds = spark.createDataFrame([(i, i, b) for i, (_, b) in enumerate(pairs)], "jd_id long, s long, text string")
    found = lexical.tfidf_scores(docs, jds, on=["s"], stop_words=())
    got = {r["doc_id"]: r["tfidf_score"] for r in found.collect()}
    for i, (a, b) in enumerate(pairs):
        score = got.get(i, 0.0)
        assert -1e-12 <= score <= 1 + 1e-12
        assert score == pytest.approx(two_text_score(b, a), abs=1e-12)


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    from dossier.operators import lexical

    monkeypatch.setattr(lexical, "TASK_PAIRS", 40)
    docs = spark.createDataFrame([(i, f"spark data{i}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, "spark query") for i in range(10)], "jd_id long, text string")
    scored = lexical.tfidf_scores(docs, asked)
    assert scored.rdd.getNumPartitions() >= 60 * 10 // 40
    assert scored.count() == 600


ODD = [
    (1, 10, "spark data"), (1, 10, "Spark lake the"), (1, 20, "lake"), (None, 10, "data data"), (None, 10, "the lake"),
    (2, None, "spark"), (3, 30, "spark data lake"), (4, 10, None), (5, 10, "x"), (6, 10, "quite other terms"),
]


def test_paired_blocks_equal_the_joins(spark, monkeypatch):
    """Rows of one id, in pieces of any size, null ids and sessions, and two descriptions of one session."""
    docs = spark.createDataFrame(ODD * 3, "doc_id long, s long, text string")
    asked = [(1, 10, "spark data data"), (2, 10, "the lake"), (2, 10, "data"), (3, None, "spark"), (4, 20, "lake and spark")]
    jds = spark.createDataFrame(asked, "jd_id long, s long, text string")

    def found():
        scored = lexical.tfidf_scores(docs, jds, on=["s"])
        assert scored.columns == ["jd_id", "doc_id", "s", "tfidf_score"]
        return sorted(map(tuple, scored.collect()), key=repr)

    monkeypatch.setattr(lexical, "PAIRED_ROWS", 0)
    joined = found()
    assert len(joined) == 5
    for rows in (1, 2, 1_000):
        monkeypatch.setattr(lexical, "PAIRED_ROWS", 200_000)
        monkeypatch.setattr(lexical, "PAIRED_DOCUMENTS", rows)
        assert found() == joined


def test_paired_scores_are_not_exploded(spark):
    """Terms of a document stay in its row: no row per word, no join and no list collected from such rows."""
    docs = spark.createDataFrame(DOCS, "doc_id long, session_id long, text string")
    jds = spark.createDataFrame(JDS, "session_id long, text string")
    scored = lexical.tfidf_scores(docs, jds.withColumn("jd", F.col("session_id")), desc_id="jd", on=["session_id"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "MapInArrow" in plan
