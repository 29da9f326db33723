"""Keyword-first order, over-fetch, filters and the search report."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dossier.operators import matching, search

STORE = "doc_id string, document string, embedding array<float>, name string, email string, filename string, tfidf_score double, embedding_score double, hybrid_score double, matches_jd int, uploaded_at timestamp"


def record(doc_id, document, vector, hybrid, matched):
    return (doc_id, document, vector, None, None, None, None, None, hybrid, matched, datetime(2024, 5, 6, 23, 0))


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        record("d1", "distributed systems", [1.0, 0.0], 0.9, 1),
        record("d2", "HADOOP cluster", [0.9, 0.1], 0.72, 0),
        record("d3", "cooking", [0.8, 0.3], 0.1, 1),
        record("d4", "hadoop too", [0.0, 1.0], None, 1),
        record("d5", None, [0.7, 0.4], 0.5, None),
    ]
    return spark.createDataFrame(rows, STORE)


def asked(spark, query_text):
    return spark.createDataFrame([(1, query_text, [1.0, 0.0])], "query_id long, query_text string, query_vector array<float>")


def ids(df):
    return [r["doc_id"] for r in df.orderBy("search_rank").collect()]


def test_keyword_hits_come_first(spark, store):
    assert ids(search.search_store(asked(spark, "find Hadoop"), store, 2)) == ["d2", "d1"]
    # Twice the wanted number is fetched: d4 is fifth and stays out for 2, gets in for 3.
    assert ids(search.search_store(asked(spark, "find Hadoop"), store, 3)) == ["d2", "d4", "d1"]


def test_no_keyword_keeps_order(spark, store):
    assert ids(search.search_store(asked(spark, "show me the people"), store, 3)) == ["d1", "d2", "d3"]


def test_filter_precedes_fetch(spark, store):
    assert ids(search.search_store(asked(spark, "hadoop"), store, 1, only_matched=True)) == ["d1"]
    assert ids(search.search_store(asked(spark, "hadoop"), store, 2, only_matched=True)) == ["d4", "d1"]


def test_report(spark, store):
    results = search.search_store(asked(spark, "hadoop"), store, 4)
    first = results.filter("search_rank = 1").first()
    assert (first["name"], first["email"], first["filename"], first["uploaded"]) == ("Unknown", "N/A", "", "2024-05-06")
    assert first["fit"] == "Good" and first["matches_jd"] is False
    summary = search.search_summary(results).first()
    # The top match is the first after the re-rank, not the most similar one.
    assert (summary["returned"], summary["top_hybrid"]) == (4, 0.72)
    assert summary["top_similarity"] == first["search_similarity"] < 1.0


def test_edges(spark, store):
    assert search.search_store(asked(spark, "  \n "), store).count() == 0
    assert search.search_store(asked(spark, "hadoop"), store.filter("false")).count() == 0
    assert [search.result_count(n) for n in (None, 1, 7, 99)] == [5, 1, 7, 99]
    for wrong in (0, -4):
        with pytest.raises(ValueError):
            search.result_count(wrong)


def test_ranking_and_summary(spark):
    rows = [("s", i, 0.7 if i % 2 else 0.9, i % 2 == 0) for i in range(6)] + [("t", 9, 0.1, False)]
    scored = spark.createDataFrame(rows, "session_id string, seq long, hybrid_score double, matches_jd boolean")
    ranked = matching.rank_resumes(scored).filter("session_id = 's'").orderBy("rank").collect()
    assert [(r["rank"], r["seq"]) for r in ranked] == [(1, 0), (2, 2), (3, 4), (4, 1), (5, 3), (6, 5)]
    totals = {r["session_id"]: r.asDict() for r in matching.session_summary(scored).collect()}
    assert totals["s"] == {"session_id": "s", "shortlisted": 3, "below_threshold": 3, "total": 6}


def test_pipeline_rounds_before_deciding(spark):
    resumes = spark.createDataFrame(
        [
            (1, "s", 0, "a.docx", "spark data\nx@y.org", [1.0, 0.0]),
            (2, "s", 1, "b.docx", "nothing shared", [0.0, 1.0]),
            (3, "s", 2, "c.docx", None, [0.0, 1.0]),
            (4, "s", 3, "d.docx", "no vector", None),
        ],
        "resume_id long, session_id string, seq long, filename string, text string, embedding array<float>",
    )
    jds = spark.createDataFrame([("s", "spark data", [1.0, 0.0])], "session_id string, text string, embedding array<float>")
    scored = matching.score_resumes(matching.with_metadata(resumes), jds, stop_words=())
    got = {r["resume_id"]: r for r in scored.collect()}
    assert set(got) == {1, 2}
    assert got[1]["matches_jd"] and got[1]["doc_id"] == "x_y.org__a.docx"
    assert got[2]["tfidf_score"] == 0.0 and got[2]["hybrid_score"] == 0.0 and got[2]["fit"] == "Weak"
    counts = matching.skipped_counts(resumes).first()
    assert (counts["skipped"], counts["processed"]) == (2, 2)
    stored = matching.store_rows(scored, F.lit("2024-01-01").cast("timestamp")).filter("name is not null")
    assert stored.count() == 2


def test_new_files_and_cap(spark):
    incoming = spark.createDataFrame([("s", i, f"f{i}") for i in range(15)], "session_id string, seq long, filename string")
    done = spark.createDataFrame([("f0",), ("f3",), ("f3",)], "filename string")
    fresh = matching.new_files(incoming, done)
    assert {r["seq"] for r in fresh.collect()} == set(range(15)) - {0, 3}
    assert {r["seq"] for r in matching.cap_batch(fresh).collect()} == {1, 2, 4, 5, 6, 7, 8, 9, 10, 11}
