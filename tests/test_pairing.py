"""Pairing of a stream: any cut into batches and a restart give what a loop over all events gives."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.streaming import events, pairing

START = dt.datetime(2024, 1, 1)
KINDS = "run_id string, node string, kind string, ts timestamp"


def write(spark, rows, path):
    spark.createDataFrame([(r, n, k, START + dt.timedelta(minutes=m)) for r, n, k, m in rows], KINDS).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, folder, patience=60):
    stream = events.read_events(spark, source, 1)
    rows = events.appended(pairing.paired(stream, "10 minutes", patience * 60_000), f"{folder}/table", f"{folder}/checkpoint")
    minute = lambda c: ((F.unix_micros(c) / 1_000_000 - int(START.replace(tzinfo=dt.UTC).timestamp())) / 60).cast("int")
    found = rows.select("run_id", "node", "outcome", minute("started").alias("a"), minute("ended").alias("b"), "ms").collect()
    return sorted((tuple(r) for r in found), key=str)


def test_all_outcomes_late_events_and_a_restart(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}"
    write(spark, [("a", "n", "end", 5), ("b", "n", "start", 1), ("b", "m", "start", 4), ("c", "n", "end", 3), ("d", "n", "start", 2), (None, "n", "end", 2), ("a", "n", "other", 1), ("e", None, "start", 3)], source)
    write(spark, [("a", "n", "start", 0), ("b", "x", "end", 9), ("z", "n", "start", 30), ("e", None, "end", 3)], source)
    first = run(spark, source, folder)
    assert first == [("a", "n", "paired", 0, 5, 300_000), ("b", "m", "paired", 4, 9, 300_000), ("b", "n", "restarted", 1, None, None), ("c", "n", "no start", None, 3, None), ("e", None, "paired", 3, 3, 0)]
    write(spark, [("d", "n", "end", 10), ("z", "n", "end", 31), ("y", "n", "start", 200)], source)  # the first is behind the watermark of minute 20
    second = run(spark, source, folder)
    assert sorted(set(second) - set(first), key=str) == [("d", "n", "unfinished", 2, None, None), ("z", "n", "paired", 30, 31, 60_000)]


def test_batches_and_order_of_arrival_do_not_matter(spark, tmp_path):
    rng = random.Random(5)
    rows = [(str(rng.randrange(6)), rng.choice("nm"), rng.choice(["start", "end"]), m) for m in range(300) for _ in range(rng.randrange(2))]
    write(spark, [*rows, ("last", "n", "start", 400)], f"file://{tmp_path}/one")
    for at in range(0, len(rows), 40):
        part = rows[at : at + 40]
        rng.shuffle(part)
        write(spark, part, f"file://{tmp_path}/many")
    write(spark, [("last", "n", "start", 400)], f"file://{tmp_path}/many")
    expected = []
    for r in sorted({r for r, *_ in rows}):
        out, _, _ = pairing.settle([(m, k == "end", n) for x, n, k, m in rows if x == r], None, 390, 20)
        expected += [(r, n, o, a, b, (b - a) * 60_000 if o == "paired" else None) for n, o, a, b in out]
    expected = sorted(expected, key=str)
    assert {x[2] for x in expected} == {"paired", "restarted", "unfinished", "no start"}
    assert run(spark, f"file://{tmp_path}/one", f"file://{tmp_path}/x", 20) == expected
    assert run(spark, f"file://{tmp_path}/many", f"file://{tmp_path}/y", 20) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.booleans(), st.sampled_from("nm")), max_size=30), st.lists(st.integers(0, 80), max_size=5))
def test_settling_in_steps_is_settling_at_once(found, steps):
    whole = pairing.settle(found, None, 80, 9)
    out, waiting, opened = [], found, None
    for until in [*sorted(steps), 80]:
        more, waiting, opened = pairing.settle(waiting, opened, until, 9)
        out += more
    assert (out, waiting, opened) == whole
    ends, starts = sum(e for _, e, _ in found), sum(not e for _, e, _ in found)
    assert sum(b is not None for *_, b in out) == ends and sum(a is not None for _, _, a, _ in out) == starts


def test_counts_go_on_after_a_restart(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}"
    write(spark, [("a", "n", "start", i) for i in range(3)], source)
    stream = lambda: events.read_events(spark, source, 1)
    once = events.appended(stream(), f"{folder}/t", f"{folder}/c")
    assert [tuple(r) for r in events.progress(once, F.count_if(F.col("kind") == "end").alias("ends")).collect()] == [(0, 3, 0, 3, 0)]
    write(spark, [("a", "n", "end", i) for i in range(2)], source)
    write(spark, [("b", "n", "end", 7)], source)
    again = events.appended(stream(), f"{folder}/t", f"{folder}/c")
    found = events.progress(again, F.count_if(F.col("kind") == "end").alias("ends")).orderBy("batch").collect()
    assert [tuple(r)[:3] for r in found][0] == (0, 3, 0) and len(found) == 3
    assert (found[-1]["total_rows"], found[-1]["total_ends"]) == (6, 3)


def test_a_stream_without_data_and_a_negative_patience(spark, tmp_path):
    spark.createDataFrame([], KINDS).write.parquet(f"file://{tmp_path}/in")
    assert run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}") == []
    with pytest.raises(ValueError, match="negative"):
        pairing.paired(events.read_events(spark, f"file://{tmp_path}/in"), patience_ms=-1)


@pytest.mark.parametrize("buckets", [1, 3])
def test_runs_share_the_state_of_their_bucket(spark, tmp_path, buckets):
    """60 runs in a few groups, in five batches: the outcomes are those of a loop over each run, and the store holds a row for each bucket."""
    rng = random.Random(8)
    rows = [(f"r{rng.randrange(60)}", rng.choice(["n", None]), rng.choice(["start", "end"]), m) for m in range(300) for _ in range(3)]
    rows = [*{(r, k, m): (r, n, k, m) for r, n, k, m in rows}.values()]
    for at in range(0, len(rows), 180):
        write(spark, rng.sample(part := rows[at : at + 180], len(part)), f"file://{tmp_path}/in")
    expected = []
    for r in {r for r, *_ in rows}:
        out, _, _ = pairing.settle([(m, k == "end", n) for x, n, k, m in rows if x == r], None, 289, 20)
        expected += [(r, n, o, a, b) for n, o, a, b in out]
    stream = pairing.paired(events.read_events(spark, f"file://{tmp_path}/in", 1), "10 minutes", 20 * 60_000, buckets=buckets)
    found = events.appended(stream, f"file://{tmp_path}/table", f"file://{tmp_path}/checkpoint")
    minute = lambda c: ((F.unix_micros(c) / 1_000_000 - int(START.replace(tzinfo=dt.UTC).timestamp())) / 60).cast("int")
    got = [tuple(r) for r in found.select("run_id", "node", "outcome", minute("started"), minute("ended")).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {o for _, _, o, *_ in got} == {"paired", "restarted", "unfinished", "no start"}
    assert spark.read.format("statestore").load(f"file://{tmp_path}/checkpoint").count() == buckets
