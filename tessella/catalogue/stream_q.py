"""Event streams, run over all data there is."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.catalogue.base import Registry, read
from tessella.operators.layout import shared_folder
from tessella.streaming import events, pairing

query = Registry()


@query("select strftime(ts, '%Y-%m-%d') as \"day\", event_type, count(*) n, round(sum(value), 2) total from events group by all")
def stream_metrics(spark, sf):
    stream = events.read_events(spark, f"{sf}/events.parquet")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = events.run_to_table(events.window_metrics(stream), f"{folder}/table", f"{folder}/checkpoint", ["w", "event_type"])
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("select event_type, count(*) n, count(*) filter (value > 50) n_large from events group by 1")
def event_counts(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large"))


RUNS = """e as (select cast(user_id as varchar) run_id, event_type node, event_type in ('purchase', 'error') is_end, epoch_us(ts) t from events where event_type <> 'click'),
s as (select e.*, wm from e, (select (max(t) // 1000 - 3600000) * 1000 wm from e) where t < wm),
n as (select *, lead(t) over w nt, lead(is_end) over w ne, lag(t) over w pt, lag(is_end) over w pe from s window w as (partition by run_id order by t, is_end, node)),
o as (select run_id, node, case when is_end then 'no start' when coalesce(nt, wm) > t + 43200000000 then 'unfinished' when not ne then 'restarted' when ne then 'paired' end outcome, case when not is_end then t end started_us, case when is_end then t when ne and nt <= t + 43200000000 then nt end ended_us
 from n where not is_end or pe is null or pe or t > pt + 43200000000)"""


def run_events(spark, sf):
    """events as starts and ends of one run for each user: views and signups start, purchases and errors end."""
    kind = F.when(F.col("event_type").isin("purchase", "error"), "end").when(F.col("event_type").isin("view", "signup"), "start")
    return events.read_events(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("node"), kind.alias("kind"), "ts")


@query(f"with {RUNS} select *, (ended_us - started_us) // 1000 ms from o where outcome is not null")
def stream_pairs(spark, sf):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = events.appended(pairing.paired(run_events(spark, sf), "1 hour", 12 * 3_600_000), f"{folder}/table", f"{folder}/checkpoint")
    return out.select("run_id", "node", "outcome", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "ms")
