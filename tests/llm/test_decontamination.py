"""Suffix-automaton matching against brute force."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(len(w), window)
        wanted = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(doc) - size + 1) if w else ():
            if tuple(doc[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                names.add(name)
    return len(doc), sorted(hit), names


texts = st.lists(st.sampled_from("a b c d".split()), max_size=30).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(texts, st.lists(texts, max_size=6), st.integers(1, 6))
def test_matches_are_those_of_brute_force(text, items, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    automaton = dec.Automaton([(n, dec.words_of(t)) for n, t in named], window)
    spans, found = automaton.match(dec.words_of(text))
    n, hit, names = brute(text, named, window)
    assert [i for s, e in spans for i in range(s, e)] == hit and found == names


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_words(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert [w.decode() for w in dec.words_of(text)] == words(text)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."), (2, "short item"), (3, None), (4, "..."), (2, "other words"), (None, "null id item")]
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"
DOCS = [
    (1, f"x {LONG} y"), (2, None), (3, ""), (4, "A SHORT-item, twice: short item"), (5, "w " * 50_000 + LONG), (None, "short item"),
    (4, "A SHORT-item, twice: short item"), (6, "null id item other words"), (7, "One two three"),
]


def rows(frame):
    return [(r["doc_id"], r["_found"]["n_words"], [(s["start"], s["end"]) for s in r["_found"]["spans"]], r["_found"]["items"]) for r in frame.collect()]


def expected():
    items = [("" if i is None else str(i), t) for i, t in ITEMS]
    out = []
    for doc, text in DOCS:
        n, hit, names = brute(text, items)
        out.append((doc, n, len(hit), sorted(names)))
    return out


def test_table_in_one_and_many_shards(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("n_words", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for shard in (400_000, 3):
        got = rows(dec.find_items(docs, items, shard_words=shard))
        assert [(d, n, sum(e - s for s, e in spans), names) for d, n, spans, names in got] == expected()
    judged = dec.find_items(docs, items).select("doc_id", dec.is_contaminated().alias("c")).collect()
    assert [r["c"] for r in judged] == [n > 0 and hit > 0 and 20 * hit >= n for _, n, hit, _ in expected()]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(spans == [] and names == [] for _, _, spans, names in rows(dec.find_items(docs, none)))
    assert rows(dec.find_items(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string"))) == []
    assert dec.drop_contaminated(docs, none).count() == len(DOCS)


def test_removal(spark):
    docs = spark.createDataFrame([(1, f"Keep, this. {LONG.upper()}! and this"), (2, "short item"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    cut = dec.remove_spans(docs, items, coverage_percent=90).collect()
    assert [tuple(r) for r in cut] == [(1, "Keep, this. ! and this"), (3, None)]
    kept = dec.drop_contaminated(docs, items).collect()
    assert [r["doc_id"] for r in kept] == [3]
    digest = dec.find_items(docs, items).select(F.sha2(F.array_join("_found.items", ","), 256).alias("h")).collect()
    assert digest[2]["h"] == hashlib.sha256(b"").hexdigest()


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, LONG, "mine", 5), (2, "clean words", "too", 6)], "doc_id long, text string, _found string, __FOUND int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dec.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean words", "too", 6)]
    cut = dec.remove_spans(docs, items, coverage_percent=101)
    assert cut.columns == docs.columns and sorted(tuple(r) for r in cut.collect()) == [(1, "", "mine", 5), (2, "clean words", "too", 6)]
