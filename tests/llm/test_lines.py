"""Line dedup and the similarity join against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.llm import jaccardjoin, linededup, shingles
from dossier.llm.components import connected

words = st.lists(st.sampled_from("a b c d e".split()), max_size=12)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_edit_distance(a, b):
    assert linededup.edit_distance(a, b) == plain_distance(a, b)


def test_simhash_counts_every_word():
    r = random.Random(6)
    lines = [[b"w%d" % r.randrange(5000) for _ in range(n)] for n in (1, 5, 254, 255, 256, 600, 3000, 7)]
    for words, found in zip(lines, linededup.simhashes(lines).tolist(), strict=True):
        hashes = [xxhash.xxh3_64_intdigest(w) for w in set(words)]
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert found == (bits - (1 << 64) if bits >> 63 else bits)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x17F), max_size=30))
def test_normalised_lines(line):
    plain = ["".join("0" if c.isdecimal() else c for c in chunk if c.isalnum()) for chunk in line.lower().split()]
    assert [w.decode() for w in linededup.normalised(line)] == [w for w in plain if w]


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_connected(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 5), (7, 7)]
    groups = Groups([*range(300), *range(1000, 1061)])
    for a, b in edges:
        if a is not None:
            groups.join(a, b)
    got = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {n: groups.find(n) for n in groups.up if any(n in e and e[0] != e[1] and e[0] is not None for e in edges)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(vocabulary, k=r.randint(5, 60))) for _ in range(40)]
    docs = []
    for n in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = r.choice(base).split()
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                line[r.randrange(len(line))] = r.choice(vocabulary)
            lines.append(" ".join(line) if r.random() < 0.8 else " ".join(line).upper() + "!")
        if r.random() < 0.3:
            lines += ["short one", "", "short one"]
        docs.append((n, "\n".join(lines)))
    return docs + [(100, None), (101, ""), (102, docs[5][1]), (None, docs[5][1]), (103, "x " * 30_000), (104, "X " * 30_000), (5, docs[5][1])]


def brute_lines(docs):
    first, order = {}, []
    for d, t in sorted((d for d in docs if d[0] is not None and d[1] is not None), key=lambda x: x[0]):
        for i, line in enumerate(t.split("\n")):
            w = tuple(linededup.normalised(line))
            if len(w) >= linededup.LEAST_WORDS:
                order.append((d, i, w))
                first[w] = min(first.get(w, (d, i)), (d, i))
    keys = list(first)
    sims = linededup.simhashes([list(k) for k in keys]).tolist()
    groups = Groups(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            near = bin((sims[i] ^ sims[j]) & (1 << 64) - 1).count("1") <= linededup.DISTANCE
            if near and plain_distance(keys[i], keys[j]) <= 0.1 * max(len(keys[i]), len(keys[j])) + 1e-9:
                groups.join(i, j)
    kept = {}
    for i, k in enumerate(keys):
        g = groups.find(i)
        kept[g] = min(kept.get(g, first[k]), first[k])
    place = {k: i for i, k in enumerate(keys)}
    return {(d, i) for d, i, w in order if kept[groups.find(place[w])] != (d, i)}


def test_lines_against_brute_force(spark):
    docs = corpus()
    gone = brute_lines(docs)
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, line string").repartition(4)
    got = linededup.dedup_lines(frame)
    assert got.columns == [*frame.columns, "_n_lines", "_n_removed"]
    rows = got.collect()
    assert len(rows) == len(docs)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    expected = []
    for d, t in docs:
        left = t if t is None or d is None else "\n".join(l for i, l in enumerate(t.split("\n")) if (d, i) not in gone)
        expected.append((d, left))
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=key) == sorted(expected, key=key)
    assert any(gone)


def test_no_lines(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in linededup.dedup_lines(one).collect()) == [(1, "a b", 1, 0), (2, None, 0, 0)]


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_every_block_scheme_brings_near_hashes_together(spark, blocks):
    r = random.Random(blocks)
    pairs = []
    for i in range(60):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        pairs += [(2 * i, a - (1 << 64) if a >> 63 else a), (2 * i + 1, b - (1 << 64) if b >> 63 else b)]
    rows = spark.createDataFrame(pairs, "id long, simhash long")
    none = spark.createDataFrame([], "id long, component long")
    got = {(x["a"], x["b"]) for x in linededup.far_pairs(rows, none, 3, blocks).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(60)} <= got
    assert all((x["a"] < x["b"]) for x in linededup.hub_pairs(rows, 3).collect())
    assert linededup.blocks_for(1000) == 4 and linededup.blocks_for(10**9) > 4


def shingle_list(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar_texts(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(2000)]
    passage = " ".join(r.choices(vocabulary, k=60))
    docs = []
    for n in range(25):
        base = r.choices(vocabulary, k=r.choice((1, 3, 5, 7, 9, 12, 30, 100, 700)))
        docs.append(" ".join(base))
        for _ in range(r.choice((0, 1, 5))):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * r.uniform(0.7, 1.0)))]
            docs.append(" ".join(copy))
        docs.append(passage + " " + " ".join(r.choices(vocabulary, k=r.randint(0, 60))))
    r.shuffle(docs)
    rows = list(enumerate(docs))
    return rows + [(900, None), (901, ""), (902, "  \n"), (903, docs[0].upper() + "  "), (None, docs[0]), (904, docs[1]), (904, docs[2]), (-3, docs[3])]


def brute_groups(rows):
    sets = [(d, shingle_list(t)) for d, t in rows]
    groups = Groups({d for d, _ in rows if d is not None})
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and a != b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                groups.join(a, b)
    return sorted(((d, len(s), None if d is None else groups.find(d) if s else d) for d, s in sets), key=str)


def near_copies(seed):
    """Copies of one text with up to ten words changed: most pairs are near, many are not linked."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(146)]
    rows = []
    for n in range(150):
        copy = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 4, 5, 6, 8, 10)) if seed % 2 else r.randint(2, 6)):
            copy[r.randrange(len(copy))] = f"e{r.randrange(60)}" if r.random() < 0.5 else f"x{n}-{r.randrange(10**6)}"
        rows.append((n, " ".join(copy[: r.choice((146, 146, 140, 130))])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_groups_against_brute_force(spark, seed):
    rows = near_copies(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in jaccardjoin.link_documents(frame).collect()]
    assert sorted(got, key=str) == brute_groups(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_against_brute_force(spark, seed):
    rows = similar_texts(seed)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(5)
    got = [tuple(r) for r in jaccardjoin.link_documents(frame).collect()]
    assert sorted(got, key=str) == brute_groups(rows)
    kept = jaccardjoin.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted({r["doc_id"] for r in kept.collect() if r["doc_id"] is not None}) == sorted({d for d, n, c in got if d is not None and c == d})


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccardjoin.link_documents(empty).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 900), st.integers(0, 2**32))
def test_linked_sets_meet_in_a_segment_whatever_is_left_out(n, seed):
    """A set that asks in any ``needed`` of its segments finds every linked set at least as large."""
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    extra = r.integers(0, 2**64, n, dtype=np.uint64)
    least = -(-6 * n // 7)
    drop = int(r.integers(0, n - least + 1))
    b = np.unique(np.concatenate((a[drop:], extra[: int(r.integers(0, n))])))
    if len(b) < len(a) or not shingles.linked(len(a), len(b), shingles.overlap(a, b)):
        return
    sigs, asks = shingles.signatures(a)
    other, _ = shingles.signatures(b)
    assert int(asks.sum()) == shingles.own_segments(a)
    missed = int((~np.isin(sigs[asks], other)).sum())
    assert missed < shingles.needed(len(a)) and 7 * missed <= 4 * len(a) - 3 * len(b)


def test_crowded_segments_are_found_by_their_parts(monkeypatch):
    monkeypatch.setattr(shingles, "segment_bits", lambda band: 3)
    r = np.random.default_rng(2)
    for _ in range(30):
        b = np.unique(r.integers(0, 2**64, 24, dtype=np.uint64))
        a = b[r.random(len(b)) < 0.93]
        sigs, asks = shingles.signatures(a)
        other, _ = shingles.signatures(b)
        assert len(a) >= 1 and np.isin(sigs[asks], other).all()


def test_shingle_hashes_are_those_of_the_words():
    words = shingles.plain_words("The  cat\tsat ON the\nmat the cat sat on the mat")
    sets = shingles.shingle_set(words)
    assert len(sets) == len(shingle_list("the cat sat on the mat the cat sat on the mat")) == 6
    assert len(shingles.shingle_set(b"a b")) == 1 and len(shingles.shingle_set(b"")) == 0
    again = shingles.shingle_set(shingles.plain_words("zzz the cat sat on the"))
    assert np.isin(again, sets).sum() == 1


def test_copies_read_before_the_smallest_id_keep_their_links(spark):
    r = random.Random(11)
    rows, expected = [], {}
    for n in range(6):
        base = [f"t{n}-{i}" for i in range(120)]
        variant = list(base)
        variant[r.randrange(120)] = "changed"
        rows += [(100 + n, " ".join(base)), (50 + n, " ".join(base)), (10 + n, " ".join(base)), (200 + n, " ".join(variant))]
        expected |= {d + n: 10 + n for d in (100, 50, 10, 200)}
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {x["doc"]: x["component"] for x in jaccardjoin.link_documents(frame).collect()} == expected
    assert sorted(x["doc_id"] for x in jaccardjoin.keep_one(frame).collect()) == list(range(10, 16))


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_texts_of_one_id_are_linked_each_by_its_own_size(spark, kind, turned):
    short, long = [f"s{i}" for i in range(14)], [f"l{i}" for i in range(1004)]
    rows = [(7, " ".join(long)), (7, " ".join(short)), (8, " ".join([*short, "more"])), (9, " ".join([*long[:-1], "end"])), (6, "some other words of no one else")]
    rows = [(str(d) if kind == "string" else d, t) for d, t in (rows[::-1] if turned else rows)]
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string").coalesce(1)
    got = [tuple(x) for x in jaccardjoin.link_documents(frame).collect()]
    assert sorted(got, key=str) == brute_groups(rows)
    assert len({c for _, _, c in got}) == 2


def letters(r):
    return "".join(r.choices("abcdefghij", k=7))


def edited_lines(seed):
    """Lines and copies of them about as many edits apart as word edit similarity 0.9 allows, and one more."""
    r = random.Random(seed)
    docs = []
    for n in [*range(5, 42), 50, 60, 79, 80, 100, 119, 200]:
        for _ in range(4):
            base = [letters(r) for _ in range(n)]
            copy = list(base)
            most = n // 10
            for k in range(most + r.randint(0, 1)):
                at = min(len(copy) - 1, (k + 1) * len(copy) // (most + 1)) if r.random() < 0.7 else r.randrange(len(copy))
                copy[at : at + r.randint(0, 1)] = [letters(r)] * r.randint(0, 1)
            docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(copy))]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_all_lines_of_the_edit_similarity_are_found(spark, seed):
    docs = edited_lines(seed)
    lines = [t.split() for _, t in docs]
    gone, fuzzy = set(), 0
    for i in range(0, len(docs), 2):
        a, b = lines[i], lines[i + 1]
        if min(len(a), len(b)) >= 5 and 10 * plain_distance(a, b) <= max(len(a), len(b)):
            gone.add(i + 1)
            fuzzy += a != b
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x["doc_id"] for x in linededup.dedup_lines(frame).collect() if x["_n_removed"]}
    assert got == gone and fuzzy > 50


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 120), st.integers(0, 2**32), st.sampled_from([0.9, 0.8, 0.95]))
def test_lines_alike_share_a_key(n, seed, similarity):
    r = random.Random(seed)
    a = [b"%d" % r.randrange(50) for _ in range(n)]
    b = list(a)
    for _ in range(r.randint(0, linededup.edits(n, similarity) + 1)):
        at = r.randrange(len(b))
        b[at : at + r.randint(0, 1)] = [b"%d" % r.randrange(60)] * r.randint(0, 1)
    if b and a != b and linededup.alike(a, b, similarity):
        (x, y), (low, high) = linededup.run_keys([a, b], similarity)
        assert set(x.tolist()) & set(y.tolist())
        turned = sum((int(v[0] ^ v[1]) & (1 << 64) - 1).bit_count() for v in (low, high))
        assert turned <= 2 * linededup.edits(max(len(a), len(b)), similarity)


def test_a_bound_on_simhash_bits_still_holds(spark):
    docs = edited_lines(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    removed = [{x["doc_id"] for x in linededup.dedup_lines(frame, distance=d).collect() if x["_n_removed"]} for d in (3, 10, 64)]
    assert removed[0] <= removed[1] <= removed[2] and len(removed[0]) < len(removed[2])


def test_long_lines_of_few_words_are_compared(spark):
    chinese = "研究人员昨天公布了一项关于城市空气质量的新报告并提出建议"
    changed = chinese.replace("昨天", "今天")
    other = "这本书讲述了一个完全不同的故事发生在很久以前的小村庄里面"
    thai = "กรุงเทพมหานครเป็นเมืองหลวงและนครที่มีประชากรมากที่สุดของประเทศไทย"
    few = "Internationalisation considerations overview"
    lines = [chinese, chinese, changed, other, thai, thai, few, few.upper(), "All rights reserved.", "All rights reserved.", "版权所有。不得转载", "版权所有。不得转载"]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x["doc_id"] for x in linededup.dedup_lines(frame).collect() if x["_n_removed"]}
    assert got == {1, 2, 5, 7}


def test_clashing_columns_of_lines_pass_through(spark):
    line = "the same long line of quite a few words"
    rows = [(1, f"{line}\nown words of the first document here", 1, "a", 7, "b"), (2, f"{line}\nx", 2, "c", 8, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc int, _lines string, _n_lines int, _N_REMOVED string")
    cleaned = linededup.dedup_lines(docs)
    lines, removed = linededup.count_columns(docs)
    assert cleaned.columns == [*docs.columns, lines, removed] and len({c.lower() for c in cleaned.columns}) == 8
    got = sorted(tuple(r) for r in cleaned.collect())
    assert got == [(*rows[0], 2, 0), (2, "x", *rows[1][2:], 2, 1)]


def test_words_said_over_and_over_turn_bits_of_the_sketch():
    lines = [w.split() for w in ("the " * 40 + "ly " * 40, "the " * 40 + "er " * 40, "the " * 40 + "er " * 38)]
    _, sketch = linededup.run_keys([[w.encode() for w in words] for words in lines], 0.9, 4)

    def turned(i, j):
        return sum((int(s[i] ^ s[j]) & (1 << 64) - 1).bit_count() for s in sketch)

    assert turned(0, 1) > 2 * linededup.edits(80, 0.9) and turned(1, 2) <= 4


def test_crowded_keys_deal_out_the_keys_once(spark):
    keyed = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 8), (4, 9), (4, 9)], "id long, key long")
    lines = spark.createDataFrame([(i, i * 10) for i in range(1, 5)], "id long, n long")
    found = linededup.crowded_keys(keyed, lines)
    assert sorted(tuple(r) for r in found.select("id", "key", "n").collect()) == [(1, 7, 10), (2, 7, 20)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1


def long_lines(seed, n, changed):
    """Two lines of about ``n`` words that share a stretch, and a copy of the first with ``changed`` edits."""
    r = random.Random(seed)
    a, b = ([f"{side}{r.randrange(10**6)}" for _ in range(n)] for side in "ab")
    b[200:230] = a[100:130]
    copy = list(a)
    for at in r.sample(range(len(copy)), changed):
        copy[at] = r.choice(("", f"c{at}", f"c{at} c{at}"))
    return [" ".join(words).split() for words in (a, b, copy)]


def run_row_pairs(spark, lines):
    encoded = [[w.encode() for w in words] for words in lines]
    keys, sketch = linededup.run_keys(encoded, 0.9, 4)
    wide = linededup.wide_sketches(encoded)
    rows = [
        (i, i, k, len(lines[i]), *[int(s[i]) for s in sketch], None if wide[i] is None else wide[i].tolist(), 0)
        for i, own in enumerate(keys) for k in own.tolist()
    ]
    columns = "id long, component long, key long, n long, s0 long, s1 long, s2 long, s3 long, wide array<long>, simhash long"
    found = linededup.far_run_pairs(spark.createDataFrame(rows, columns), linededup.BITS, 0.9)
    return {(r["a"], r["b"]) for r in found.collect()}


@pytest.mark.parametrize("n", [300, 700, 1020, 1100, 3000, 9000])
def test_long_lines_that_share_a_stretch_are_told_apart_before_they_pair(spark, n):
    lines = long_lines(n, n, n // 24)
    assert linededup.alike(lines[0], lines[2], 0.9) and not linededup.alike(lines[0], lines[1], 0.9)
    assert run_row_pairs(spark, lines) == {(0, 2)}


@settings(max_examples=60, deadline=None)
@given(st.integers(385, 5000), st.integers(0, 2**32))
def test_wide_sketches_of_lines_alike_differ_in_two_bits_an_edit(n, seed):
    r = random.Random(seed)
    lines = long_lines(seed, n, r.randint(0, n // 15))
    a, b = (w for w in linededup.wide_sketches([[w.encode() for w in lines[i]] for i in (0, 2)]))
    if b is not None and linededup.alike(lines[0], lines[2], 0.9):
        while len(a) != len(b):
            a, b = (x[: len(x) // 2] ^ x[len(x) // 2 :] if len(x) == max(len(a), len(b)) else x for x in (a, b))
        most = linededup.edits(max(len(lines[0]), len(lines[2])), 0.9)
        assert sum((int(x) & (1 << 64) - 1).bit_count() for x in a ^ b) <= 2 * most


def test_lines_of_other_words_need_no_distance(monkeypatch):
    monkeypatch.setattr(linededup, "edit_distance", None)
    a, b, _ = long_lines(1, 500, 0)
    assert not linededup.alike(a, b, 0.9)


def test_shared_keys_are_given_alone_before_their_lines_are_joined(spark):
    keyed = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "id long, key long")
    lines = spark.createDataFrame([(i, i * 10) for i in range(1, 4)], "id long, n long")
    given = []
    found = linededup.crowded_keys(keyed, lines, lambda keys: given.append(keys) or keys)
    assert given[0].columns == ["id", "key"]
    assert sorted(map(tuple, given[0].collect())) == [(1, 7), (2, 7)]
    assert sorted(map(tuple, found.select("id", "n").collect())) == [(1, 10), (2, 20)]


def test_unlike_sets_that_share_many_segments_are_told_apart_where_they_meet(spark, monkeypatch):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    common = words(500)
    texts = [" ".join(common + words(330)) for _ in range(12)]
    copy = texts[3].split()
    copy[600] = "other"
    texts.append(" ".join(copy))
    named, plain = [], jaccardjoin.verified

    def verified(pairs, sets):
        named.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(jaccardjoin, "verified", verified)
    found = jaccardjoin.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc"]: r["component"] for r in found.collect()} == {i: 3 if i == 12 else i for i in range(13)}
    assert sum(named[1:]) <= 1


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 400), st.integers(0, 400), st.integers(0, 2**32))
def test_sketches_of_sets_differ_in_a_bit_a_shingle_at_most(n, gone, come, seed):
    g = np.random.default_rng(seed)
    numbers = g.integers(0, 1 << 63, n + come, dtype=np.uint64)
    a, b = numbers[:n], numbers[min(gone, n - 1) :]
    x, y = shingles.parity_sketch(a), shingles.parity_sketch(b)
    while len(x) != len(y):
        x, y = (s[: len(s) // 2] ^ s[len(s) // 2 :] if len(s) == max(len(x), len(y)) else s for s in (x, y))
    assert sum((int(s) & (1 << 64) - 1).bit_count() for s in x ^ y) <= min(gone, n - 1) + come


@pytest.mark.parametrize("similarity", [0.9, 0.8, 0.5, 1.0])
def test_lines_alike_are_in_neighbouring_length_classes(spark, similarity):
    lengths = spark.range(1, 5_001).select(F.col("id").alias("n"), linededup.length_class(F.col("id"), similarity).alias("c"))
    of = {r["n"]: r["c"] for r in lengths.collect()}
    for n in of:
        assert of[n] - of[n - linededup.edits(n, similarity)] <= 1 if n > linededup.edits(n, similarity) else True


def test_lines_of_a_key_meet_only_those_about_as_long(spark):
    """Lines of one key, nearly all of lengths far apart: the join's keys part them, not its condition."""
    rows = [(i, i, 7, 20 * 2**i, 0, 0, 0, 0, None, 0) for i in range(12)] + [(100, 100, 7, 22, 1, 0, 0, 0, None, 0)]
    columns = "id long, component long, key long, n long, s0 long, s1 long, s2 long, s3 long, wide array<long>, simhash long"
    found = linededup.far_run_pairs(spark.createDataFrame(rows, columns), linededup.BITS, 0.9)
    assert [tuple(r) for r in found.collect()] == [(0, 100)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "meets" in plan and "size#" in plan.split("Join Inner")[1].split("\n")[0]


def test_small_buckets_are_not_compared_with_hubs_again(spark, monkeypatch):
    """After the first turn the hubs see crowded buckets only, and the lines that go are the same."""
    docs = edited_lines(5)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    turns, real = [], linededup.hub_run_pairs

    def seen(rows, turn, *rest):
        turns.append((turn, rows.groupBy("key").count().filter("count <= 16").count()))
        return real(rows, turn, *rest)

    monkeypatch.setattr(linededup, "hub_run_pairs", seen)
    whole = sorted((r["doc"], sorted(x["line"] for x in r["lines"])) for r in linededup.repeated_lines(frame).collect())
    assert turns[0][1] > 0 and all(small == 0 for _, small in turns[1:])
    for few in (0, 10**6):
        monkeypatch.setattr(linededup, "FEW_LINES", few)
        assert sorted((r["doc"], sorted(x["line"] for x in r["lines"])) for r in linededup.repeated_lines(frame).collect()) == whole
