"""JSON arrays by byte ranges against the whole file."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from dossier.sources import readers, splitting


def items(seed=1, count=60):
    r = random.Random(seed)

    def text():
        return "".join(r.choice(['"', "\\", "\\\\", "[", "]", "{", "}", ",", "é", "😀", "a", " ", "\n"]) for _ in range(r.randrange(12)))

    def value(depth=0):
        kind = r.randrange(6 if depth < 3 else 3)
        if kind < 2:
            return text()
        if kind == 2:
            return r.choice([1, -2.5, True, None])
        if kind == 3:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        return {text(): value(depth + 1) for _ in range(r.randrange(4))}

    return [value() for _ in range(count)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_states_of_ranges(size):
    """Ranges put together give the borders of the whole."""
    data = json.dumps(items(), ensure_ascii=False).encode()
    whole = splitting.borders(*splitting.structure(data, splitting.OUTSIDE)[:2], 0)
    state, depth, found = splitting.OUTSIDE, 0, []
    for at in range(0, len(data), size):
        signs, kinds, end = splitting.structure(data[at : at + size], state)
        found += [at + int(p) for p in splitting.borders(signs, kinds, depth)]
        depth += int(splitting._turns(kinds).sum())
        state = end
    assert found == list(whole) and len(found) == 61 and depth == 0


@pytest.mark.parametrize("size", [13, 200, 10**6])
def test_items_of_a_file(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(splitting, "MORE_BYTES", 5)
    made = items(4, 25)
    (tmp_path / "a.json").write_text(json.dumps(made, indent=1, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(" [ ] ")
    (tmp_path / "c.json").write_text('{"a": [1, 2]}')
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text('["' + "long " * 300 + '"]')
    rows = splitting.split_json_arrays(spark, f"file://{tmp_path}", size).orderBy("path", "start").collect()
    assert [json.loads(r["raw"]) for r in rows] == [*made, "long " * 300]


def test_same_texts_as_the_reader_of_whole_files(spark, tmp_path):
    made = [{"a": 1, "b": ""}, "text, with [signs]", {"c": {"d": [1]}}, 7, [1, "x"], {"e": True}]
    (tmp_path / "a.json").write_text(json.dumps(made))
    split = splitting.split_json_records(spark, f"file://{tmp_path}", 20)
    whole = readers.json_corpus(spark, str(tmp_path))
    assert sorted(r["text"] for r in split.collect()) == sorted(r["text"] for r in whole.collect())
    # Every range is a task's own piece of work.
    assert splitting.split_json_arrays(spark, f"file://{tmp_path}", 20).select(F.spark_partition_id().alias("p")).distinct().count() > 1
