"""Upserts, replays, compaction, the chunk index and version numbers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dossier.operators import modelcalls, store, versions
from dossier.session import claim

COLUMNS = "doc_id string, hybrid_score double, uploaded_at timestamp, batch_seq long"


def batch(spark, *rows):
    return spark.createDataFrame([(i, s, datetime(2024, 1, d), q) for i, s, d, q in rows], COLUMNS)


def current(spark, root):
    return {r["doc_id"]: r["hybrid_score"] for r in store.read_store(spark, root).collect()}


def test_last_write_wins(spark, tmp_path):
    root = str(tmp_path)
    assert store.read_store(spark, root) is None
    first = batch(spark, ("a", 0.111111, 1, 0), ("b", 0.2, 1, 1), ("a", 0.3, 1, 2))
    store.write_batch(first, root, 0)
    assert current(spark, root) == {"a": 0.3, "b": 0.2}
    store.write_batch(first.filter("batch_seq = 0"), root, 1)
    assert current(spark, root) == {"a": 0.1111, "b": 0.2}
    # A replayed batch changes nothing.
    store.write_batch(first.filter("batch_seq = 0"), root, 1)
    assert current(spark, root) == {"a": 0.1111, "b": 0.2}
    assert store.read_log(spark, root).count() == 4


def test_compaction(spark, tmp_path):
    root = str(tmp_path)
    store.compact(spark, root)
    store.write_batch(batch(spark, ("a", 0.1, 1, 0), ("a", 0.2, 2, 0), ("b", 0.5, 1, 0)), root, 0)
    store.write_batch(batch(spark, ("b", 0.6, 3, 0)), root, 1)
    before = current(spark, root)
    store.compact(spark, root)
    assert store.read_log(spark, root).count() == 2 and current(spark, root) == before
    # An upload that is older than the stored record does not replace it.
    store.write_batch(batch(spark, ("c", 0.7, 1, 0), ("b", 0.9, 2, 0)), root, 2)
    assert current(spark, root) == {"a": 0.2, "b": 0.6, "c": 0.7}
    store.compact(spark, root)
    assert current(spark, root) == {"a": 0.2, "b": 0.6, "c": 0.7}
    stats = store.store_stats(store.read_store(spark, root), root).first()
    assert (stats["total"], stats["collection"], stats["path"]) == (3, "resumes", root)


def test_runs_do_not_touch_each_other(spark, tmp_path):
    root = str(tmp_path)
    store.write_batch(batch(spark, ("a", 0.1, 1, 0)), root, 0, "one")
    store.write_batch(batch(spark, ("b", 0.2, 1, 0)), root, 0, "two")
    store.write_batch(batch(spark, ("a", 0.3, 1, 0)), root, 1, "one")
    assert current(spark, root) == {"a": 0.3, "b": 0.2}
    store.compact(spark, root)
    # A new run writes batch 0 after the compaction; a replay of a held batch changes nothing.
    store.write_batch(batch(spark, ("c", 0.4, 1, 0)), root, 0, "three")
    store.write_batch(batch(spark, ("a", 0.1, 1, 0)), root, 0, "one")
    assert current(spark, root) == {"a": 0.3, "b": 0.2, "c": 0.4}
    store.compact(spark, root)
    store.compact(spark, root)
    store.drop_compacted(spark, root)
    assert current(spark, root) == {"a": 0.3, "b": 0.2, "c": 0.4}
    store.write_batch(batch(spark, ("a", 0.5, 2, 0)), root, 2, "one")
    assert current(spark, root) == {"a": 0.5, "b": 0.2, "c": 0.4}


def test_hot_id(spark):
    log = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("doc_id"),
        F.col("id").alias("batch_seq"), F.lit(0).alias("batch_id"), F.lit(datetime(2024, 1, 1)).alias("uploaded_at"),
    )
    latest = store.latest_records(log)
    assert latest.count() == 2001
    assert latest.filter("doc_id = 'hot'").first()["batch_seq"] == 2997


def test_index_embeds_only_what_is_missing(spark, tmp_path):
    root = f"{tmp_path}/index"
    calls = spark.sparkContext.accumulator(0)

    def embed(missing):
        def model(items):
            calls.add(len(items))
            return [[float(len(i))] for i in items]

        return modelcalls.embed_texts(missing, model)

    def chunks(*rows):
        return spark.createDataFrame(list(rows), "source string, chunk_no int, text string")

    a, b = ("s1", 0, "alpha"), ("s1", 1, "beta")
    assert store.update_index(chunks(a, b), root, embed, 500, 50).count() == 2 and calls.value == 2
    assert store.update_index(chunks(a, b), root, embed, 500, 50).count() == 2 and calls.value == 2
    # Changed text and another chunk size are new work; the old chunk is no longer returned.
    rows = store.update_index(chunks(a, ("s1", 1, "gamma")), root, embed, 500, 50)
    assert {r["text"] for r in rows.collect()} == {"alpha", "gamma"} and calls.value == 3
    store.update_index(chunks(a), root, embed, 1000, 200)
    assert calls.value == 4
    store.update_index(chunks(("s2", 0, "other")), root, embed, 500, 50)
    store.update_index(chunks(a, b), root, embed, 500, 50, force_reload=True)
    assert calls.value == 7
    assert store.cached_chunks(spark, root, "s1", 500, 50).count() == 2
    assert store.cached_chunks(spark, root, "s2", 500, 50).count() == 1
    assert store.cached_chunks(spark, f"{tmp_path}/none", "s1", 500, 50) is None


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, page int, chunk_no int, text string")


def letters(missing):
    return modelcalls.embed_texts(missing, lambda items: [[float(len(i))] for i in items])


def live(index):
    return sorted((r["source"], r["page"], r["text"], r["born"]) for r in index.collect())


def test_index_forgets(spark, tmp_path):
    root = f"{tmp_path}/index"
    update = lambda chunks, **kw: store.update_index(chunks, root, letters, 500, 50, identity=("page",), **kw)
    update(pages_of(spark, ("007", 1, 0, "a"), ("007", 2, 0, "b"), ("s2", None, 0, "c"), ("s3", 1, 0, "d")))
    # One page changed, one gone, one source gone, one left alone.
    at_hand = spark.createDataFrame([("007",), ("s2",)], "source string")
    rows = update(pages_of(spark, ("007", 1, 0, "A")), sources=at_hand)
    assert live(rows) == [("007", 1, "A", 1)]
    assert live(store.read_index(spark, root)) == [("007", 1, "A", 1), ("s3", 1, "d", 0)]
    # An earlier generation stays readable; a text that comes back is embedded again.
    assert live(store.read_index(spark, root, 0)) == [("007", 1, "a", 0), ("007", 2, "b", 0), ("s2", None, "c", 0), ("s3", 1, "d", 0)]
    update(pages_of(spark, ("007", 1, 0, "a")))
    assert live(store.read_index(spark, root)) == [("007", 1, "a", 2), ("s3", 1, "d", 0)]
    update(pages_of(spark, ("s3", 1, 0, "d")), force_reload=True)
    assert live(store.read_index(spark, root)) == [("007", 1, "a", 2), ("s3", 1, "d", 3)]
    # Nothing is left, and nothing comes of nothing.
    none = pages_of(spark, ("x", 1, 0, "")).filter("false")
    assert update(none, sources=spark.createDataFrame([("007",), ("s3",)], "source string")).count() == 0
    assert store.read_index(spark, root).count() == 0
    assert store.update_index(none, f"{root}-2", letters, 500, 50, identity=("page",)).count() == 0


def test_unfinished_update_is_not_seen(spark, tmp_path):
    root = f"{tmp_path}/index"
    store.update_index(pages_of(spark, ("s", 1, 0, "a")), root, letters, 500, 50, identity=("page",))

    def broken(missing):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        store.update_index(pages_of(spark, ("s", 1, 0, "b")), root, broken, 500, 50, identity=("page",))
    assert live(store.read_index(spark, root)) == [("s", 1, "a", 0)]
    store.update_index(pages_of(spark, ("s", 1, 0, "b")), root, letters, 500, 50, identity=("page",))
    assert live(store.read_index(spark, root)) == [("s", 1, "b", 2)]


def test_reads_are_pruned_to_the_sources_at_hand(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    root = f"{tmp_path}/index"
    store.update_index(pages_of(spark, *[(f"s{i}", 1, 0, f"t{i}") for i in range(6)]), root, letters, 500, 50)
    store.update_index(pages_of(spark, ("s2", 1, 0, "new")), root, letters, 500, 50)
    plan = store.cached_chunks(spark, root, "s1", 500, 50)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 2 and all("= s1)" in s[s.index("PartitionFilters") : s.index("PushedFilters")] for s in scans)
    # An update reads the folders of its sources only, found when the query runs.
    live_rows = store.read_index(spark, root, sources=store._sources_of(spark, root, 1))
    plan = live_rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("dynamicpruningexpression(source") == 2
    assert live(live_rows) == [("s2", 1, "new", 1)]


def test_buckets_need_no_shuffle(spark, tmp_path):
    root = str(tmp_path)
    wide = "doc_id string, document string, embedding array<float>, uploaded_at timestamp"
    rows = [(f"d{i}", "text " * 50, [1.0, 2.0], datetime(2024, 1, 1)) for i in range(200)]
    for number in range(3):
        store.write_batch(spark.createDataFrame(rows[number * 20 :], wide), root, number)
        if number == 1:
            store.compact(spark, root)
    current = store.read_store(spark, root)
    plan = current._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "Union" not in plan
    assert current.count() == 200 and {r["batch_id"] for r in current.collect()} == {0, 1, 2}
    # A reader that listed before a replay still finds its files afterwards.
    earlier = store.read_store(spark, root)
    store.write_batch(spark.createDataFrame(rows[:1], wide), root, 2)
    assert earlier.count() == 200
    assert store.read_store(spark, root).filter("batch_id = 2").count() == 1


def test_claims_are_given_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: claim(spark, f"{tmp_path}/claims/{i % 10}"), range(80)))
    assert sum(won) == 10


def test_versions(spark):
    names = ["gpt2-v1", "t5_v12_lora", "v3_epochs_1", "v4", "vX", "x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(
        versions.any_version(F.col("n")), versions.exact_version(F.col("n")), versions.leading_version(F.col("n"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (1, None, None), (12, None, None), (3, None, 3), (4, 4, 4), (None, None, None), (None, None, None),
    ]
    registry = spark.createDataFrame(
        [("a", 1, "a1"), ("a", 2, "a2"), ("a", 4, "a4"), ("b", 2, "b2"), ("c", None, "cX"), ("a", 2, "a2b"), ("d", 1, "d1")],
        "family string, version int, path string",
    )

    def by_family(df):
        return {r["family"]: r["next"] for r in df.collect()}

    assert by_family(versions.next_version(registry)) == {"a": 5, "b": 3, "c": 1, "d": 2}
    assert by_family(versions.next_version(registry, "first_free")) == {"a": 3, "b": 1, "c": 1, "d": 2}
    latest = {r["family"]: (r["version"], r["path"]) for r in versions.latest_path(registry).collect()}
    assert latest == {"a": (4, "a4"), "b": (2, "b2"), "d": (1, "d1")}


def test_racing_writers_get_versions_of_their_own(spark, tmp_path):
    registry = spark.createDataFrame([("a/b", 1), ("a/b", 3), ("c", None)], "family string, version int")
    with ThreadPoolExecutor(4) as pool:
        runs = list(pool.map(lambda _: versions.claim_next(registry, str(tmp_path)).collect(), range(4)))
    got = sorted((r["family"], r["version"]) for rows in runs for r in rows)
    assert got == [("a/b", 2), ("a/b", 4), ("a/b", 5), ("a/b", 6), ("c", 1), ("c", 2), ("c", 3), ("c", 4)]
    after = versions.claim_next(registry, str(tmp_path), "after_highest").collect()
    assert sorted((r["family"], r["version"]) for r in after) == [("a/b", 7), ("c", 5)]
