"""Registered queries: training history and monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from panescan.checks.derived import history, r6, table
from panescan.checks.registry import registry
from panescan.plans import history as h

QUERIES, SQL, query = registry()
C = F.col


@query("best_epoch", "history", "select run_id, arg_min(epoch, row(value, epoch))::bigint epoch, round(min(value),6) as value from history group by run_id")
def best_epoch(spark, sf_dir):
    return h.best_epoch(history(spark, sf_dir)).select("run_id", "epoch", r6("value", "value"))


@query("best_model_moments", "history", """select run_id, epoch::bigint epoch, round(value,6) as value from history
 qualify value < coalesce(min(value) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding), 'inf'::double)""")
def best_model_moments(spark, sf_dir):
    return h.improvements(history(spark, sf_dir)).select("run_id", "epoch", r6("value", "value"))


STOP = """, o as (select run_id, epoch, value, row_number() over (partition by run_id order by epoch) k from history),
 f as (select run_id, 1::bigint k, value best, 0::bigint c, null::bigint stop from o where k=1 union all
  select f.run_id, o.k, case when o.value < f.best-{d} then o.value else f.best end, case when o.value < f.best-{d} then 0 else f.c+1 end,
   coalesce(f.stop, case when (case when o.value < f.best-{d} then 0 else f.c+1 end)>={p} then o.epoch end) from f join o on o.run_id=f.run_id and o.k=f.k+1)
select run_id, max(stop)::bigint stop_epoch from f where stop is not null group by run_id"""


@query("early_stop_epoch", "history", STOP.format(d="0", p=10))
def early_stop_epoch(spark, sf_dir):
    return h.early_stop_epoch(history(spark, sf_dir), 10)


@query("early_stop_epoch_with_delta", "history", STOP.format(d="5.0e0", p=12))
def early_stop_epoch_with_delta(spark, sf_dir):
    return h.early_stop_epoch(history(spark, sf_dir), 12, 5.0)


for _name in ("early_stop_epoch", "early_stop_epoch_with_delta"):
    SQL[_name] = SQL[_name].replace("with ", "with recursive ", 1)


@query("checkpoints_to_drop", "history", "select run_id, epoch::bigint epoch from history qualify row_number() over (partition by run_id order by epoch desc)>3")
def checkpoints_to_drop(spark, sf_dir):
    return h.checkpoints_to_drop(history(spark, sf_dir), 3).select("run_id", "epoch")


@query("final_metrics", "history", "select run_id, split, round(arg_max(value,epoch),6) final_value, round(avg(case when epoch>0 then value end),6) mean_after_first from history group by all")
def final_metrics(spark, sf_dir):
    return h.final_metrics(history(spark, sf_dir)).select("run_id", "split", r6("final_value", "final_value"), r6("mean_after_first", "mean_after_first"))


def samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select(C("user_id").cast("bigint").alias("run_id"), "ts", C("event_id").cast("bigint").alias("event_id"), C("value").alias("mb"))


@query("memory_growth", None, """select user_id::bigint run_id, event_id::bigint event_id, round(value-first_value(value) over w,6) increase, round(max(value) over w,6) peak, value-first_value(value) over w > 20 alarm
 from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def memory_growth(spark, sf_dir):
    out = h.memory_growth(samples(spark, sf_dir), 20.0, order=["ts", "event_id"])
    return out.select("run_id", "event_id", r6("increase", "increase"), r6("peak", "peak"), "alarm")


@query("top_consumers", None, """select user_id::bigint run_id, event_id::bigint event_id, round(value,6) mb, row_number() over (partition by user_id order by value desc, event_id)::int rank from events
 qualify row_number() over (partition by user_id order by value desc, event_id)<=5""")
def top_consumers(spark, sf_dir):
    return h.top_consumers(samples(spark, sf_dir), 5, tie="event_id").select("run_id", "event_id", r6("mb", "mb"), "rank")


@query("epoch_metrics", None, """with b as (select user_id::bigint run_id, event_id%20 epoch, value m, value/2 l, case when event_id%13=0 then 'error' else 'ok' end s from events)
select run_id, epoch::bigint epoch, round(coalesce(avg(m) filter (s='ok'),0),6) metric, round(coalesce(sum(l) filter (s='ok'),0)/count(*),6) loss, count(*) filter (s='ok')::bigint num_batches from b group by all""")
def epoch_metrics(spark, sf_dir):
    e = C("event_id").cast("bigint")
    batches = table(spark, sf_dir, "events").select(
        C("user_id").cast("bigint").alias("run_id"), (e % 20).alias("epoch"), C("value").alias("metric"), (C("value") / 2).alias("loss"),
        F.when(e % 13 == 0, "error").otherwise("ok").alias("status"),
    )
    return h.epoch_metrics(batches).select("run_id", "epoch", r6("metric", "metric"), r6("loss", "loss"), "num_batches")
