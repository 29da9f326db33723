"""The saved vector index: certified results against brute force, recall, and what a search reads."""

from __future__ import annotations

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import nearest, vectorindex

from .test_nearest import brute, found, frame, vectors

SF_DIR = "/root/testdata/sf0.01"


def search(queries, root, *args, **kw):
    return found(vectorindex.search_index(queries, root, *args, **kw).withColumnRenamed("vec_id", "vector_id"))


@pytest.mark.parametrize("sub_vectors, copies, blocks", [(4, 1, False), (8, 3, True), (3, 1, True)])
def test_certified_search_is_exact(spark, tmp_path, sub_vectors, copies, blocks):
    stored, asked = vectors(), vectors(9, 60)
    table = frame(spark, stored, "vec_id long, embedding array<float>").repartition(5)
    table = table.unionByName(spark.createDataFrame([(999, None)], table.schema))
    root = f"{tmp_path}/index"
    vectorindex.build_index(table, root, cells=12, sub_vectors=sub_vectors, copies=copies, sample_rows=100)
    queries = frame(spark, asked, "query_id long, query_vector array<float>")
    rows = 7 if blocks else 4000
    got = search(queries, root, 6, probes=2, rescore=10, certified=True, query_rows=rows)
    assert got == brute(asked, stored, 6, "l2")


def test_codes_bound_the_distance(spark, tmp_path):
    made = np.random.default_rng(2).normal(size=(400, 16)).astype(np.float32)
    root = f"{tmp_path}/index"
    vectorindex.build_index(frame(spark, made, "vec_id long, embedding array<float>"), root, cells=8, sub_vectors=4, sample_rows=150)
    codec = vectorindex.read_codec(spark, root)
    for r in spark.read.parquet(f"{root}/codes").collect():
        near = codec.centres[r["cell"]] + codec.decode(np.frombuffer(r["code"], np.uint8)[None])[0]
        whole = made[r["vector_id"]].astype(float)
        assert abs(np.linalg.norm(whole - near) - r["error"]) < 1e-9 and abs((near**2).sum() - r["square"]) < 1e-9
        if r["cell"] == r["home"]:
            assert np.linalg.norm(whole - codec.centres[r["cell"]]) <= codec.radius[r["cell"]] + 1e-9


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_recall_of_three_cells_outside_the_sample(spark, tmp_path):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    root = f"{tmp_path}/index"
    vectorindex.build_index(table, root, cells=32, copies=8, sample_rows=250)
    sample = vectorindex.training_sample(table.select(F.col("vec_id").alias("vector_id"), "embedding"), 250, 17)
    queries = table.select(F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("query_vector"))
    outside = table.join(sample.select(F.col("vector_id").alias("vec_id")), "vec_id", "left_anti")
    assert 100 < sample.count() < 400
    queries = queries.unionByName(outside.select((F.col("vec_id") + 10_000).alias("query_id"), F.col("embedding").alias("query_vector")))
    true = found(nearest.nearest(queries, table, 4, vector_id="vec_id").withColumnRenamed("vec_id", "vector_id"))
    got = search(queries, root, 4, probes=3)
    hits = sum(len(set(got[q]) & set(true[q])) for q in true)
    assert hits >= 0.9 * 4 * len(true)


def test_only_probed_cells_are_read(spark, tmp_path):
    made = np.random.default_rng(4).normal(size=(300, 8)).astype(np.float32)
    made += 12 * np.eye(8)[np.arange(300) % 8]
    root = f"{tmp_path}/index"
    vectorindex.build_index(frame(spark, made, "vec_id long, embedding array<float>"), root, cells=8, sub_vectors=8)
    query = frame(spark, made[:1], "query_id long, query_vector array<float>")
    before = search(query, root, 4, probes=2)
    codec = vectorindex.read_codec(spark, root)
    probed = {int(c) for c in np.argsort(codec.cell_gaps(made[:1].astype(float))[0])[:2]}
    assert before == brute(made[:1], made, 4, "l2")
    # The other folders are not needed.
    for cell in set(range(8)) - probed:
        shutil.rmtree(f"{root}/codes/cell={cell}")
        shutil.rmtree(f"{root}/vectors/home={cell}")
    assert search(query, root, 4, probes=2) == before


def test_nothing_to_find(spark, tmp_path):
    root = f"{tmp_path}/index"
    vectorindex.build_index(frame(spark, vectors(), "vec_id long, embedding array<float>"), root, cells=4, sub_vectors=2)
    none = spark.createDataFrame([(1, None)], "query_id long, query_vector array<float>")
    assert vectorindex.search_index(none, root).collect() == []


def test_queries_and_limits_stay_off_the_driver(spark, tmp_path, monkeypatch):
    stored, asked = vectors(), vectors(9, 120)
    root = f"{tmp_path}/index"
    vectorindex.build_index(frame(spark, stored, "vec_id long, embedding array<float>"), root, cells=4, sub_vectors=4)
    kind = type(spark.range(1))
    collect, to_pandas = kind.collect, kind.toPandas
    taken = []

    def collected(self):
        taken.append((self.columns, rows := collect(self)))
        return rows

    def as_pandas(self):
        taken.append((self.columns, rows := to_pandas(self)))
        return rows

    monkeypatch.setattr(kind, "collect", collected)
    monkeypatch.setattr(kind, "toPandas", as_pandas)
    queries = frame(spark, asked, "query_id long, query_vector array<float>")
    df = vectorindex.search_index(queries, root, 4, probes=1, certified=True, query_rows=16)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    for columns, rows in taken:
        assert not {"query_id", "query_vector"} & set(columns)
        assert len(rows) <= 4 * vectorindex.CODES
    monkeypatch.undo()
    assert found(df.withColumnRenamed("vec_id", "vector_id")) == brute(asked, stored, 4, "l2")
