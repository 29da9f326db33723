"""Language identification and toxicity: held-out accuracy and awkward rows."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import langid, toxicity
from dossier.llm.memo import Memo
from dossier.llm.samples import held_out, sampled

SF_DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


def test_folds_and_samples(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(400)], "doc_id long, l int")
    for r in rows.withColumn("h", held_out()).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    taken = sampled(rows.union(rows), "doc_id", "l", 20).collect()
    assert len(taken) == len({r["_id"] for r in taken}) == 60
    assert all(zlib.crc32(str(r["_id"]).encode()) % 5 and r["_label"] is not None for r in taken)


def test_words_come_first_and_grams_get_shorter():
    model = langid.Model(["a", "b"], {"strong": [9, 0], "strand": [3, 0], "kanu": [0, 9], "kane": [0, 9], "xx": [1, 0]})
    assert model.word("strong") == model.tables[0]["strong"]
    longest = [g for g in map(model.tables[4].get, langid.grams("strange", 4)) if g]
    longest = [g for g in map(model.tables[5].get, langid.grams("strange", 5)) if g] or longest
    assert model.word("strange") == tuple(sum(c) / len(longest) for c in zip(*longest))
    assert model.predict("strange strong", Memo(model.chunk))[0] == "a"
    assert model.predict("kanube", Memo(model.chunk))[0] == "b"
    for text in (None, "", " 12 ² ½ !?"):
        assert model.predict(text, Memo(model.chunk)) == ("und", 0.0)


@tables
def test_languages_are_found(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    got = langid.identify(docs, langid.learn(docs)).join(given, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "der hund und die katze " * 3, "en" if i % 2 else "de", 1) for i in range(40)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (None, "der hund", "de", 1), (102, "the cat " * 50_000, None, 1), (102, "the cat", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert found[100] == found[101] == "und" and found[102] == "en" and found[None] == "de"
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(nothing)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.learn(docs)).collect() == []


@tables
def test_toxic_documents_are_found(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity.score_documents(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    bad = np.array([r["score"] for r in got if r["toxic"] == 1])
    good = np.array([r["score"] for r in got if r["toxic"] == 0])
    assert (bad[:, None] > good[None, :]).mean() > 0.95
    assert (bad >= 0.5).mean() > 0.8 and (good >= 0.5).mean() < 0.02


def test_group_terms_lose_their_pull():
    names = ["women", "men", "idiot", "good"]
    rows = [[0, 2]] * 8 + [[2]] * 2 + [[1, 3]] * 8 + [[3]] * 2
    labels = [1] * 10 + [0] * 10
    pairs = [([0], [1])] * 8 + [([1], [0])] * 8
    free, _ = toxicity.fit(rows, labels, pairs, len(names), strength=0.0)
    held, _ = toxicity.fit(rows, labels, pairs, len(names), strength=10.0)
    assert abs(held[0] - held[1]) < 0.1 * abs(free[0] - free[1])
    assert held[2] > 1 > -1 > held[3]
    same, _ = toxicity.fit(rows, labels, [([2], [2])], len(names))
    assert same.shape == (4,)


def test_sentences_are_swapped():
    pairs = toxicity.counterfactuals("Nothing here. The Women sang! Bye.")
    assert len(pairs) == 1 and pairs[0][0] == "the women sang!" and pairs[0][1] != pairs[0][0]
    assert toxicity.counterfactuals(None) == toxicity.counterfactuals("no group") == []


def test_toxicity_edges(spark):
    rows = [(i, f"you idiot number{i}" if i % 2 else f"nice day number{i}") for i in range(60)]
    rows += [(100, None), (101, ""), (None, "you idiot"), (102, "nice day " * 50_000 + "idiot"), (102, "nice day")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r["predicted"])
    assert found[None] == [1] and found[100] == found[101] and found[0] == [0] and found[1] == [1]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").isEmpty() and kept.filter("doc_id = 0").count() == 1
    one_sided = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert {r["predicted"] for r in toxicity.score_documents(docs, one_sided).collect()} == {0}
    assert toxicity.score_documents(docs.limit(0), model).collect() == []
