"""Starts and ends of runs, paired in a stream whatever the order of arrival.

Each run keeps the events that the watermark has not passed yet, and one open start. An event is settled when the
watermark has passed it, so all events of a run are settled in the order of their times, and the outcomes depend neither on
how the events were cut into batches nor on a restart. Timers settle runs that bring no more events, so state goes: a run
holds its events of the time that `late` allows, and an open start for `patience_ms` at most.

Runs are dealt to `buckets` groups by a hash, and a group's state holds the runs of its bucket: a call for each of many
short runs costs far more than their events do. A group grows with the input over `buckets`, so larger inputs want more of
them; a stream keeps the number that it was started with.

Outcomes: `paired` (an end after a start), `restarted` (a start that another start followed), `unfinished` (no event within
the patience), `no start` (an end without an open start). At equal times a start comes before an end. Events that come
behind the watermark are dropped, as are those without run, time or one of the two kinds. Repeated events count each. Open
starts and events that the watermark has not passed when the data end are in no outcome yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: The events of a bucket that wait and its open starts, as an Arrow table: run_id, at, is_end, node, opened.
STATE = "events binary"
BUCKETS = 1024
OUT = "run_id string, node string, outcome string, a bigint, b bigint"


def settle(waiting: list[tuple], opened: tuple | None, until: int, patience: int) -> tuple[list[tuple], list[tuple], tuple | None]:
    """(outcomes, still waiting, open start) of one run's events (at, is_end, node), of which those before `until` are settled; microseconds.

    Outcomes are (node, outcome, start, end).
    """
    out, later = [], [e for e in waiting if e[0] >= until]

    def expire(now: int) -> None:
        nonlocal opened
        if opened and opened[0] + patience < now:
            out.append((opened[1], "unfinished", opened[0], None))
            opened = None

    for at, is_end, node in sorted((e for e in waiting if e[0] < until), key=lambda e: (e[0], e[1], e[2] or "")):
        expire(at)
        if not is_end:
            if opened:
                out.append((opened[1], "restarted", opened[0], None))
            opened = (at, node)
        elif opened:
            out.append((opened[1], "paired", opened[0], at))
            opened = None
        else:
            out.append((node, "no start", None, at))
    expire(until)
    return out, later, opened


def _packed(runs: dict) -> bytes:
    """The runs {run_id: (waiting, open start)} of a bucket as bytes."""
    import pyarrow as pa

    rows = [(r, *e, False) for r, (waiting, _) in runs.items() for e in waiting] + [(r, opened[0], False, opened[1], True) for r, (_, opened) in runs.items() if opened]
    columns = zip(*rows, strict=True)
    types = {"run_id": pa.string(), "at": pa.int64(), "is_end": pa.bool_(), "node": pa.string(), "opened": pa.bool_()}
    table = pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> dict:
    import pyarrow as pa

    runs: dict[str, tuple] = {}
    for run, at, is_end, node, opened in zip(*(c.to_pylist() for c in pa.ipc.open_stream(packed).read_all().columns), strict=True):
        waiting, held = runs.get(run, ([], None))
        if opened:
            held = (at, node)
        else:
            waiting.append((at, is_end, node))
        runs[run] = waiting, held
    return runs


def paired(events: DataFrame, late: str = "1 hour", patience_ms: int = 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """(run_id, node, outcome, started, ended, ms) of a stream of events(run_id, node, kind, ts), kind start or end."""
    if patience_ms < 0:
        raise ValueError("the patience must not be negative")
    patience = patience_ms * 1000

    def step(key, batches, state):
        import pandas as pd

        runs = _unpacked(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for b in batches:
                for run, at, is_end, node in zip(b["run_id"].tolist(), b["at"].tolist(), b["is_end"].tolist(), b["node"].where(b["node"].notna(), None).tolist(), strict=True):
                    runs.setdefault(run, ([], None))[0].append((at, is_end, node))
        now, rows, kept = state.getCurrentWatermarkMs(), [], {}
        for run, (waiting, opened) in runs.items():
            out, waiting, opened = settle(waiting, opened, now * 1000, patience)
            rows += [(run, *o) for o in out]
            if waiting or opened:
                kept[run] = waiting, opened
        if kept:
            state.update((_packed(kept),))
            due = min(at for waiting, opened in kept.values() for at in [*(e[0] for e in waiting), *([opened[0] + patience] if opened else [])])
            state.setTimeoutTimestamp(max(due // 1000, now + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["run_id", "node", "outcome", "a", "b"]).astype({"a": "Int64", "b": "Int64"})

    known = events.where("run_id is not null and ts is not null and kind in ('start', 'end')").withWatermark("ts", late)
    rows = known.select(F.col("run_id").cast("string").alias("run_id"), F.col("node").cast("string").alias("node"), "ts", F.unix_micros("ts").alias("at"), (F.col("kind") == "end").alias("is_end"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)))
    out = dealt.groupBy("bucket").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    ms = F.floor((F.col("b") - F.col("a")) / 1000)
    return out.select("run_id", "node", "outcome", F.timestamp_micros("a").alias("started"), F.timestamp_micros("b").alias("ended"), ms.alias("ms"))
