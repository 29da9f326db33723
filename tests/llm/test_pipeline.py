"""The pipeline stage by stage, the queries with SQL, and the entry file."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from dossier.llm import decontamination, jaccardjoin, linededup, memo, toxicity
from dossier.llm.memo import Memo
from dossier.llm.queries import QUERIES, SQL

from ..oracle import connection, differences

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connection(SF_DIR), SQL[name]) is None


def test_entry_lists_everything():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
    numbers = sorted(int(n.split("_")[0][2:]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = [f.simpleString() for f in docs.schema.fields]
    tables = [docs.toPandas().sort_values("doc_id").reset_index(drop=True)]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert [f.simpleString() for f in docs.schema.fields] == columns
            tables.append(docs.toPandas().sort_values("doc_id").reset_index(drop=True))
    given, clean, lines, single, decontaminated = tables

    model = toxicity.learn(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    memo = Memo(model.chunk)
    good = given[[model.score(t, memo) < 0.5 for t in given["text"]]]
    assert clean["doc_id"].tolist() == good["doc_id"].tolist() and clean["text"].tolist() == good["text"].tolist()

    assert lines["doc_id"].tolist() == clean["doc_id"].tolist()
    seen = set()
    for before, after in zip(clean["text"], lines["text"], strict=True):
        left = after.split("\n") if after else []
        assert all(l in before.split("\n") for l in left)
        for line in left:
            words = tuple(linededup.normalised(line))
            if len(words) >= linededup.LEAST_WORDS:
                assert words not in seen
                seen.add(words)
    assert (lines["n_chars"] == lines["text"].str.len()).all()

    groups = {r["doc"]: r["component"] for r in jaccardjoin.link_documents(spark.createDataFrame(lines)).collect()}
    assert single["doc_id"].tolist() == [d for d in lines["doc_id"] if groups[d] == d]

    items = duckdb.sql(f"SELECT item_id::VARCHAR, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    automaton = decontamination.Automaton([(n, decontamination.words_of(t)) for n, t in items], 13)
    kept = []
    for doc, text in zip(single["doc_id"], single["text"], strict=True):
        words = decontamination.words_of(text)
        hits = sum(e - s for s, e in automaton.match(words)[0])
        if not (hits and 20 * hits >= len(words)):
            kept.append(doc)
    assert decontaminated["doc_id"].tolist() == kept
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(kept)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def test_stages_bound_the_bytes_of_a_batch(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, "x " * (1 << 20), None, None, 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    try:
        spark.conf.unset(name)
        corpus_pipeline.pack(spark, docs, SF_DIR)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

        found = [r["n"] for r in docs.mapInArrow(run, "n long").collect()]
        assert sum(found) == 6 and max(found) <= 3
        spark.conf.set(name, "1m")
        corpus_pipeline.pack(spark, docs, SF_DIR)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_workers_forget_what_earlier_steps_kept():
    memo.kept("toxic:a", dict)["chunk"] = 1
    memo.forget()
    assert memo.kept("toxic:a", dict) == {}
