"""Host rules against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

from dossier.llm import hostrules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [l for l in text.split("\n") if WORD.search(l)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)


def fails(b):
    n, chars, symbols, dup, repeat, lines = b
    return [n < 10, repeat * 100 > n * 20, symbols * 2 > chars, dup * 2 > lines, chars < 2 * n or chars > 30 * n]


def verdicts(rows, limit=0.5):
    hosts = {}
    for _, text, host in rows:
        hosts.setdefault(host or "", []).append(fails(base(text)))
    total = sum(map(len, hosts.values()))
    ok = dict.fromkeys(hosts, True)
    for rule in range(5):
        f = {h: sum(x[rule] for x in v) for h, v in hosts.items()}
        mean = sum(f.values()) / total
        spread = sum(f[h] ** 2 / len(v) for h, v in hosts.items()) / total - mean * mean
        for h, v in hosts.items():
            strength = max(0.0, mean * (1 - mean) / spread - 1) if spread > 1e-12 else None
            rate = mean if strength is None else (f[h] + mean * strength) / (len(v) + strength)
            ok[h] &= rate <= limit
    return ok


def fixture():
    r = random.Random(4)
    rows = []
    for i in range(120):
        host = r.choice(["good", "good", "good", "bad", None])
        words = [f"{r.choice('alpha beta gamma delta # ** é😀 x'.split())}{r.randrange(9)}" for _ in range(r.choice((0, 4, 5, 9, 10, 30, 80, 80)))]
        if r.random() < 0.4 or host == "bad":
            words = words + words[:12]
        text = r.choice((" ", "\n", "\t ", "\x0b")).join(words) + r.choice(("", "\n", "\n\n \n", "\x85 \xa0"))
        rows.append((i, text, host))
    spam = "\n".join(["buy now # $$"] * 20)
    return rows + [(200, None, "good"), (201, "", None), (202, spam, "bad"), (None, spam, "bad"), (202, spam, "bad"), (203, "w " * 40_000, "good")]


def test_against_plain_python(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, source string, n_words int, kept string").repartition(3)
    ok = verdicts(rows)
    assert set(ok.values()) == {True, False}
    expected = []
    for i, text, host in rows:
        b = base(text)
        failed = any(fails(b)[:2])
        expected.append((i, *b[:5], failed, not failed and ok[host or ""]))
    got = [tuple(r) for r in hostrules.judge_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert hostrules.judge_documents(docs).collect() == []


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(fixture(), "doc_id long, text string, source string")
    plan = hostrules.base_columns(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
