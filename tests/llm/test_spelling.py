"""Spelling variants against a brute force over all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dossier.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return sorted(rows, key=str)


def changed(r, word):
    at = r.randrange(len(word))
    letter = r.choice("abcdefghijklmnopqrstuvwxyzéßÿÀ×")
    return r.choice((word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]))


def fixture():
    r = random.Random(11)
    base = ["".join(r.choice("abcdeéß") for _ in range(r.randrange(7, 11))) for _ in range(25)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaab", "z" * 70, "z" * 71, "ÀÉÀÉÀÉÀ", "q" * 5000, "q" * 5001]
    words = []
    for w in base:
        words += [w] * r.choice((1, 2, 30, 300))
        for _ in range(6):
            v = changed(r, w)
            words += [v] * r.choice((1, 2, 3, 20))
            words += [changed(r, v)] * r.choice((1, 2))
    r.shuffle(words)
    docs = [(i, r.choice((" ", "-", "1", "\n", "ŝ")).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in words[i::40])) for i in range(40)]
    return docs + [(100, None), (101, ""), (102, "short one"), (None, "aaaaaaa " * 40), (7, "aaaaaaa aaaaaaa"), (7, "aaaaaaa aaaaaaa")]


def rows_of(found):
    return sorted((tuple(r) for r in found.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


@pytest.mark.parametrize("subtree_words, searchers, leaf", [(50_000, 200_000, 24), (6, 10, 1), (1, 3, 4)])
def test_against_brute_force(spark, monkeypatch, subtree_words, searchers, leaf):
    monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    docs = fixture()
    table = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, n int, word string").repartition(3)
    expected = brute(docs)
    assert any(r[5] != r[0] and r[5] != r[3] for r in expected), "no chain of forms"
    assert rows_of(spelling.group_variants(table, subtree_words=subtree_words, searchers=searchers)) == expected


def test_empty_tables(spark):
    assert rows_of(spelling.group_variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert rows_of(spelling.group_variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string"))) == []


def test_search_finds_each_pair_once(monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 7)
    r = random.Random(5)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(7, 10))) for _ in range(300)})
    levels = spelling.Levels({"a": 2, "b": 1})
    counts, mask = levels.of([w.encode("latin-1") for w in words])
    held = spelling.Words([w.encode("latin-1") for w in words], counts, mask)
    rows = np.arange(len(words))
    got = [(int(x), int(y)) for a, b in spelling.search(held, rows, rows, levels.depth) for x, y in zip(a, b)]
    expected = [(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if is_near(w, v) and len(v) >= len(w)]
    assert sorted(got) == expected


def test_budget_prunes():
    """Searchers that have overspent do not go down to a leaf."""
    levels = spelling.Levels({c: 1 for c in "abcdefghijklmnop"})
    counts, _ = levels.of([b"abcdefg", b"bbcdefg", b"bbbdefg", b"abcdefgh", b"abcdefghi"])
    homes = counts[0]
    reach = spelling.Budget(np.arange(5), counts)
    for level in range(levels.depth):
        reach = reach.after(level, int(homes[level]))
    assert list(reach.rows) == [0, 1]
