"""The durable memory of seen files."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np

from dossier.session import child_folders
from dossier.streaming import seen

START = datetime(2024, 1, 4)  # a week, counted from 1970, begins here


def test_filters_forget_nothing():
    rng = np.random.default_rng(1)
    held, others = rng.integers(-(2**62), 2**62, 5000), rng.integers(-(2**62), 2**62, 5000)
    bits = seen.bloom_filter(held)
    assert seen.may_hold(bits, held).all()
    assert seen.may_hold(bits, others).mean() < 0.02
    assert seen.may_hold(seen.bloom_filter(held[:1]), held[:1]).all()


def test_batches_replays_and_late_rows(spark, tmp_path):
    root, week, day = str(tmp_path), timedelta(days=7), timedelta(days=1)

    def take(number, *rows):
        names = spark.createDataFrame([(n, START + timedelta(hours=h)) for n, h in rows], "filename string, ts timestamp")
        seen.take_batch(names, number, root, week, day)

    def found():
        return sorted((r["filename"], r["batch"]) for r in seen.new_files(spark, root).collect())

    take(0, ("a", 1), ("b", 2), ("a", 3), (None, 4))
    take(1, ("a", 5), ("c", 6))
    assert found() == [("a", 0), ("b", 0), ("c", 1)]
    # A repeated batch replaces itself and does not find its own names.
    take(1, ("a", 5), ("c", 6))
    assert found() == [("a", 0), ("b", 0), ("c", 1)]
    # In the next week a name is new again; the week before stays open for a day.
    take(2, ("a", 24 * 7 + 1), ("d", 8))
    assert found() == [("a", 0), ("a", 2), ("b", 0), ("c", 1), ("d", 2)]
    take(3, ("e", 24 * 8 + 1))
    take(4, ("late", 9), ("a", 24 * 7 + 2), ("f", 24 * 7 + 2))
    assert found() == [("a", 0), ("a", 2), ("b", 0), ("c", 1), ("d", 2), ("e", 3), ("f", 4)]
    # The filters of the closed week are gone.
    first = int(START.timestamp())
    kept = {p for b in child_folders(spark, f"{root}/filters") for p in child_folders(spark, f"{root}/filters/{b}")}
    assert f"period={first}" not in kept and f"period={first + 7 * 86400}" in kept


def test_empty_batch(spark, tmp_path):
    none = spark.createDataFrame([], "filename string, ts timestamp")
    seen.take_batch(none, 0, str(tmp_path), timedelta(days=1), timedelta(0))
    assert seen.new_files(spark, str(tmp_path)).count() == 0
