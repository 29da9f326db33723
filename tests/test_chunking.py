"""Chunk contract on generated texts, fixed windows against Python slices."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.operators import chunking

TEXTS = st.text(alphabet=st.sampled_from("ab \n"), max_size=400) | st.text(max_size=200)


def plain_split(value: str, size: int, overlap: int, separators=chunking.SEPARATORS) -> list[str]:
    """The same chunks from prefix sums over the pieces, written for checking only."""
    found = [s for s in separators if s == "" or s in value]
    separator = found[0] if found else separators[-1]
    if separator:
        marked = value.replace(separator, "\x00" + separator).split("\x00")
    else:
        marked = list(value)
    finer = separators[separators.index(separator) + 1 :] if separator else ()
    out, run = [], []

    def flush():
        ends = [0]
        for piece in run:
            ends.append(ends[-1] + len(piece))
        start, text = 0, "".join(run)
        while start < len(run):
            stop = start + 1
            while stop < len(run) and ends[stop + 1] - ends[start] <= size:
                stop += 1
            out.append(text[ends[start] : ends[stop]])
            if stop == len(run):
                break
            start += 1
            while start < stop and (ends[stop] - ends[start] > overlap or ends[stop + 1] - ends[start] > size):
                start += 1
        run.clear()

    for piece in marked:
        if 0 < len(piece) < size:
            run.append(piece)
        elif piece:
            flush()
            out.extend(plain_split(piece, size, overlap, finer) if finer else [piece])
    flush()
    return [c.strip() for c in out if c.strip()]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(2, 60), st.data())
def test_equals_plain_version(value, size, data):
    value = value.replace("\x00", "")
    overlap = data.draw(st.integers(0, size))
    assert chunking.split_text(value, size, overlap) == plain_split(value, size, overlap)


def squeezed(value: str) -> str:
    return "".join(value.split())


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(5, 60), st.integers(0, 5))
def test_contract(value, size, overlap):
    chunks = chunking.split_text(value, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    # Without overlap the chunks hold every visible character once, in order.
    plain = chunking.split_text(value, size, 0)
    assert squeezed("".join(plain)) == squeezed(value)
    at = 0
    for chunk in chunks:
        found = value.find(chunk, max(0, at - size))
        assert found >= 0
        at = found + len(chunk)


def test_known_splits():
    assert chunking.split_text("aaa bbb ccc", 7, 0) == ["aaa bbb", "ccc"]
    assert chunking.split_text("para one\n\npara two\n\npara three", 20, 0) == ["para one\n\npara two", "para three"]
    assert chunking.split_text("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"]
    assert chunking.split_text("one two three four", 11, 5) == ["one two", "two three", "four"]
    assert chunking.split_text("", 10, 2) == [] == chunking.split_text(None, 10, 2) == chunking.split_text(" \n", 10, 2)


def test_frames(spark):
    docs = spark.createDataFrame([(1, "x " * 900, "a"), (2, "", "b"), (3, "short", "c")], "doc_id long, text string, tag string")
    rows = chunking.recursive_chunks(docs).orderBy("doc_id", "chunk_no").collect()
    assert [r["text"] for r in rows if r["doc_id"] == 1] == chunking.split_text("x " * 900)
    assert [r["chunk_no"] for r in rows if r["doc_id"] == 1] == list(range(len(chunking.split_text("x " * 900))))
    assert {r["tag"] for r in rows} == {"a", "c"}
    assert [r["text"] for r in rows if r["doc_id"] == 3] == ["short"]


def test_windows(spark):
    values = ["", "a", "abcdefghij" * 3, "é\U0001F600" * 9]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = {}
    for r in chunking.window_chunks(docs, size=7, overlap=2).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["text"]
    for i, value in enumerate(values):
        starts = range(0, max(len(value) - 2 - 1, 0) + 1, 5) if value else []
        assert got.get(i, {}) == {n: value[s : s + 7] for n, s in enumerate(starts)}
