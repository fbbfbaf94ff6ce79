"""Queries over event logs (events), pixels (lineitem) and orders: rates, runs, latencies, background models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import masks, stats
from ..operators import gates
from ..operators import telemetry as t
from ..params import DEFAULT
from ..sources.shared import stored, table
from ..streaming import governor, tracker
from ..streaming.run import run_available

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EV = "ev as (select event_id, user_id, event_type, value, epoch_ms(ts) as t_ms from events)"
#: The same with milliseconds cut off, not rounded.
EVENTS = "ev as (select event_id, user_id, event_type, value, epoch_us(ts) // 1000 as t_ms from events)"
CHANNELS = ("l_quantity", "l_discount", "l_extendedprice")


def events(spark: SparkSession, sf_dir: str, rounded: bool = False) -> DataFrame:
    """Milliseconds are cut off, as in EVENTS, or rounded, as in EV."""
    ms = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + (500 if rounded else 0)) / 1000)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", ms.alias("t_ms"))


@query(f"""with {EV}, last as (select * from (select *, row_number() over (partition by event_type order by t_ms desc, event_id desc) as k from ev where value is not null and isfinite(value)) where k <= 512)
select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(max(value), 6) as max from last group by event_type""")
def latency_last512(spark, sf_dir):
    out = t.latency_summary(events(spark, sf_dir, True), "event_type", "value", F.desc("t_ms"), F.desc("event_id"))
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "max")))


@query(f"with {EV} select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(median(value), 6) as median from ev group by event_type")
def stage_summary(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.round(F.median("value"), 6).alias("median"))


@query(f"with {EV}, m as (select event_type, median(value) as med from ev group by event_type) select event_type, round(med, 6) as median, round(1.4826 * median(abs(value - med)), 6) as sigma from ev join m using (event_type) group by event_type, med")
def robust_sigma(spark, sf_dir):
    return stats.with_mad(events(spark, sf_dir), "value", ["event_type"], counted=True).select("event_type", F.round("median", 6).alias("median"), F.round(DEFAULT.mad_scale * F.col("mad"), 6).alias("sigma"))


@query(f"with {EV} select event_id, count(*) over (partition by event_type order by t_ms range between 59999 preceding and current row)::double as rate from ev")
def parts_per_minute(spark, sf_dir):
    return t.per_minute(events(spark, sf_dir, True), "event_type").select("event_id", "rate")


@query(f"with {EV} select user_id, count(*) filter (event_type = 'purchase') as passes, count(*) filter (event_type = 'error') as defects, count(*) filter (event_type = 'click') as clicks, count(*) as n from ev group by user_id")
def line_counters(spark, sf_dir):
    count = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    return events(spark, sf_dir).groupBy("user_id").agg(count("purchase", "passes"), count("error", "defects"), count("click", "clicks"), F.count("*").alias("n"))


@query(f"""with {EV}, g as (select *, count(*) filter (event_type = 'purchase') over (partition by user_id order by t_ms, event_id) as grp from ev)
select event_id, cast(coalesce(count(*) filter (event_type = 'error') over (partition by user_id, grp order by t_ms, event_id), 0) as bigint) as run from g""")
def consecutive_rejects(spark, sf_dir):
    return t.runs(events(spark, sf_dir, True), "user_id", F.col("event_type") == "error", F.col("event_type") == "purchase", F.col("t_ms"), F.col("event_id")).select("event_id", "run")


@query(f"""with {EV}, l as (select *, coalesce(max(case when event_type <> 'view' then t_ms end) over w, min(t_ms) over w) as last from ev window w as (partition by user_id order by t_ms, event_id))
select event_id, event_type = 'view' and t_ms - last >= 3000 as idle from l""")
def idle_detector(spark, sf_dir):
    return t.idle(events(spark, sf_dir, True), "user_id", F.col("event_type") != "view", F.col("t_ms"), F.col("event_id")).select("event_id", "idle")


@query(f"""with {EV}, s as (select user_id, min(t_ms) as t0, max(t_ms) as t1 from ev group by user_id)
select event_id, cast(greatest(0, least(4, floor(5 * (t_ms - t0) / (t1 - t0 + 1e-9)))) as int) as seg from ev join s using (user_id)""")
def segments(spark, sf_dir):
    return t.segments(events(spark, sf_dir, True), "user_id").select("event_id", "seg")


@query(f"""with {EV}, s as (select user_id, min(t_ms) as t0, max(t_ms) as t1 from ev group by user_id)
select user_id, count(distinct cast(greatest(0, least(4, floor(5 * (t_ms - t0) / (t1 - t0 + 1e-9)))) as int)) as used from ev join s using (user_id) group by user_id""")
def segments_used(spark, sf_dir):
    return t.segments(events(spark, sf_dir, True), "user_id").groupBy("user_id").agg(F.countDistinct("seg").alias("used"))


@query(f"with {EV} select event_id, round(value - avg(value) over (partition by user_id order by t_ms, event_id rows between 5 preceding and 5 following), 6) as detrended from ev")
def detrend_rows(spark, sf_dir):
    return t.detrended(events(spark, sf_dir, True), "user_id", "value", 5, F.col("t_ms"), F.col("event_id")).select("event_id", F.round("detrended", 6).alias("detrended"))


@query(f"with {EV}, k as (select event_type, quantile_cont(value, 0.4) as cut from ev group by event_type) select event_id from ev join k using (event_type) where value >= cut")
def sharpness_filter(spark, sf_dir):
    """What reaches its group's 40th percentile."""
    e = events(spark, sf_dir)
    return e.join(stats.quantiles(e, "value", ["event_type"], [DEFAULT.keep_percentile], ["cut"]), "event_type").where("value >= cut").select("event_id")


@query(f"with {EV} select event_id, row_number() over (partition by user_id order by t_ms, event_id) as number from ev where event_type = 'error'")
def reject_numbers(spark, sf_dir):
    return t.numbered(events(spark, sf_dir, True).where("event_type = 'error'"), "user_id", "number", F.col("t_ms"), F.col("event_id")).select("event_id", "number")


@query(f"""with {EV} select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, t_ms, event_id) as k from ev) where k <= 3""")
def best_three(spark, sf_dir):
    return t.latest(events(spark, sf_dir, True), ["user_id"], 3, F.desc("value"), F.asc("t_ms"), F.asc("event_id")).select("user_id", "event_id", "value")


@query(f"with {EV} select user_id, round(1 - pow(0.05, 1.0 / count(*)), 9) as alpha from ev group by user_id")
def order_alpha(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("m")).select("user_id", F.round(stats.order_alpha(DEFAULT.confidence, F.col("m")), 9).alias("alpha"))


PIXEL = "pix as (select l_orderkey, l_linenumber, l_returnflag as g, l_quantity::double as l_quantity, l_discount::double as l_discount, l_extendedprice::double as l_extendedprice from lineitem)"
SHEET = f"""long as ({" union all ".join(f"select g, '{c}' as channel, {c} as v from pix" for c in CHANNELS)}), med as (select g, channel, median(v) as mu from long group by all),
sheet as (select g, channel, mu, greatest(1.4826 * median(abs(v - mu)), 3.0) as sigma from long join med using (g, channel) group by g, channel, mu)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g"), *(F.col(c).cast("double").alias(c) for c in CHANNELS))


@query(f"with {PIXEL}, {SHEET} select g, channel, round(mu, 6) as mu, round(sigma, 6) as sigma from sheet")
def sheet_model(spark, sf_dir):
    return masks.sheet_model(pixels(spark, sf_dir), "g", CHANNELS).select("g", "channel", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


WIDE = "wide as (select g, " + ", ".join(f"max(mu) filter (channel = '{c}') as {c}_mu, max(sigma) filter (channel = '{c}') as {c}_sigma" for c in CHANNELS) + " from sheet group by g)"


@query(f"with {PIXEL}, {SHEET}, {WIDE} select l_orderkey, l_linenumber, " + " + ".join(f"pow(({c} - {c}_mu) / {c}_sigma, 2)" for c in CHANNELS) + " > 2.25 as foreground from pix join wide using (g)")
def foreground_filter(spark, sf_dir):
    from dataclasses import replace

    px = pixels(spark, sf_dir)
    return masks.foreground(px, masks.sheet_model(px, "g", CHANNELS), "g", CHANNELS, replace(DEFAULT, k_sigma=1.5)).select("l_orderkey", "l_linenumber", "foreground")


SHAPES = "shape as (select l_orderkey, l_linenumber, l_returnflag as g, l_extendedprice::double as area, l_discount::double as fill, l_tax::double as aspect, l_quantity::double / 100 as hu1, 1 - l_tax::double as solidity from lineitem)"
MODEL = "model as (select g, avg(area) as mean_area, " + ", ".join(f"avg({c}) as {c}_m, greatest(stddev_pop({c}), {low}) as {c}_s" for c, low in (("fill", "0.04"), ("aspect", "0.04"), ("hu1", "0.04 * avg(hu1)"), ("solidity", "0.03"))) + " from shape group by g)"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("g"), d("l_extendedprice").alias("area"), d("l_discount").alias("fill"), d("l_tax").alias("aspect"), (d("l_quantity") / 100).alias("hu1"), (1 - d("l_tax")).alias("solidity"))


@query(f"with {SHAPES}, {MODEL} select g, round(mean_area, 4) as mean_area, " + ", ".join(f"round({c}_m, 6) as {c}_mean, round({c}_s, 6) as {c}_sigma" for c in ("fill", "aspect", "hu1", "solidity")) + " from model")
def geometry_model(spark, sf_dir):
    m = gates.geometry_model(shapes(spark, sf_dir), "g")
    return m.select("g", F.round("mean_area", 4).alias("mean_area"), *(F.round(c, 6).alias(c) for c in m.columns if c not in ("g", "mean_area")))


@query(f"""with {SHAPES}, {MODEL} select l_orderkey, l_linenumber, concat_ws(',', {", ".join(f"case when not abs({c} - {c}_m) <= 3 * {c}_s then '{c}' end" for c in ("fill", "aspect", "hu1", "solidity"))},
  case when not area between mean_area / 2.5 and mean_area * 2.5 then 'area' end) as failures from shape join model using (g)""")
def geometry_gate(spark, sf_dir):
    s = shapes(spark, sf_dir)
    out = gates.geometry_failures(s, gates.geometry_model(s, "g"), "g")
    return out.select("l_orderkey", "l_linenumber", F.array_join("failures", ",").alias("failures"))


@query("""with o as (select l_orderkey, list(l_quantity::int order by l_linenumber, l_quantity::int) as q from lineitem group by l_orderkey)
select l_orderkey, array_to_string(flatten(list_transform(q, lambda x, i : list_transform(range(x), lambda y : (i - 1) % 2))), '') as bits from o""")
def rle_decode(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))), lambda x: x["q"]).alias("q"))
    return q.select("l_orderkey", F.array_join(F.transform(masks.decoded(F.col("q")), lambda x: x.cast("string")), "").alias("bits"))


@query("""select l_orderkey, array_to_string(list(l_quantity::int order by l_linenumber, l_quantity::int), ',') as runs from lineitem group by l_orderkey""")
def rle_round_trip(spark, sf_dir):
    """Runs, decoded and encoded again."""
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))), lambda x: x["q"]).alias("q"))
    bits = q.select("l_orderkey", masks.decoded(F.col("q")).alias("bits"))
    return bits.select("l_orderkey", F.array_join(F.transform(masks.encoded(F.col("bits")), lambda x: x.cast("string")), ",").alias("runs"))


@query(f"""with {EV}, c as (select event_type, user_id, median(value) as med, min(value) as low from ev group by all)
select event_type, user_id, round(med, 6) as med from (select *, row_number() over (partition by event_type order by med, user_id) as k from c where low <= 0.9 * med) where k = 1""")
def best_candidate(spark, sf_dir):
    """The lowest median among the candidates that meet the constraint; of equal ones the first."""
    c = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.median("value").alias("med"), F.min("value").alias("low")).where("low <= 0.9 * med")
    return c.groupBy("event_type").agg(F.min(F.struct("med", "user_id")).alias("b")).select("event_type", "b.user_id", F.round("b.med", 6).alias("med"))


@query(f"""with recursive {EVENTS}, p as (select e.t_ms // 3600000 as k, e.event_id as e_id, a.event_id as a_id, abs(e.t_ms - a.t_ms) as dt from ev e join ev a on e.t_ms // 3600000 = a.t_ms // 3600000 and abs(e.t_ms - a.t_ms) <= 600000 where e.event_type = 'error' and a.event_type = 'click'),
o as (select *, row_number() over (partition by k order by dt, e_id, a_id) as i from p),
w as (select k, i, e_id, a_id, dt, true as taken, [e_id] as es, [a_id] as xs from o where i = 1
union all select o.k, o.i, o.e_id, o.a_id, o.dt, not list_contains(es, o.e_id) and not list_contains(xs, o.a_id),
  if(list_contains(es, o.e_id) or list_contains(xs, o.a_id), es, list_append(es, o.e_id)), if(list_contains(es, o.e_id) or list_contains(xs, o.a_id), xs, list_append(xs, o.a_id)) from w join o on o.k = w.k and o.i = w.i + 1)
select e_id, a_id, dt from w where taken""")
def replay_matches(spark, sf_dir):
    """Errors as expected, clicks as actual: one-to-one within the tolerance, the nearest first, in minutes of all users together."""
    e = events(spark, sf_dir).withColumn("key", F.floor(F.col("t_ms") / 3_600_000)).withColumnRenamed("event_id", "id")
    wide = t.matched(e.where("event_type = 'error'"), e.where("event_type = 'click'"), "key", DEFAULT.__class__(match_ms=600_000))
    return wide.select("e_id", "a_id", "dt")


@query(f"with {EV} select event_type, count(*) filter (value > 50) as n_pos, count(*) filter (value <= 50) as n_neg, round((sum(case when value > 50 then rk end) - count(*) filter (value > 50) * (count(*) filter (value > 50) + 1) / 2) / (count(*) filter (value > 50) * count(*) filter (value <= 50)), 6) as auroc from (select *, (rank() over (partition by event_type order by s)) + (count(*) over (partition by event_type, s) - 1) / 2.0 as rk from (select *, user_id % 97 as s from ev)) group by event_type")
def event_auroc(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", (F.col("user_id") % 97).cast("double")).withColumn("high", F.col("value") > 50)
    return stats.auroc(stored(e, "events"), "s", "high", ["event_type"]).select("event_type", "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("stream"), "t_ms", (F.col("event_id") % 7 % 4).cast("int").alias("status"), (F.col("value") / 100).alias("headroom"))


@query(f"""with recursive {EVENTS}, s as (select event_id as id, user_id as stream, t_ms, case when event_id % 7 % 4 >= 3 or value / 100 > 0.85 then 2 when event_id % 7 % 4 >= 2 or value / 100 >= 0.7 then 1 else 0 end as target, row_number() over (partition by user_id order by t_ms, event_id) as i from ev),
f as (select id, stream, t_ms, target, i, target as level, cast(null as bigint) as since from s where i = 1
union all select s.id, s.stream, s.t_ms, s.target, s.i, case when s.target > level or s.target < level and s.t_ms - coalesce(since, s.t_ms) >= 30000 then s.target else level end,
  case when s.target < level and s.t_ms - coalesce(since, s.t_ms) < 30000 then coalesce(since, s.t_ms) end from f join s on s.stream = f.stream and s.i = f.i + 1)
select id, stream, t_ms, target, level from f""")
def governor_levels(spark, sf_dir):
    """Levels of each user's stream of samples, by the streaming operator."""
    return run_available(samples(spark, sf_dir), governor.governed, "governor")


#: One row a frame and stream: the recursion carries the live tracks as a list of structs, as the written rules have them.
TRACKER = f"""
with recursive {EVENTS}, n as (
  select user_id % 8 as stream, row_number() over (partition by user_id % 8 order by t_ms, event_id) as k, event_id, abs(value) as v from ev
), det as materialized (
  select stream, k, k * 33 as t, k % 60 as c, k // 60 % 2 as odd, 5 + v - floor(v) as sharp, event_id % 97 = 0 as border,
    cast(case when odd = 0 then case when c <= 32 then c * 10 end when c <= 12 then c * 10 when c <= 44 then 120 else 120 + (c - 44) * 10 end as double) as x, cast(20 + 20 * stream as double) as y from n
), f as (
  select distinct stream, cast(0 as bigint) as k, cast(1 as bigint) as next_id, cast([] as struct(id bigint, x double, y double, sharp double, border boolean, t bigint, vx double, vy double, hits bigint, missed bigint, judged boolean, upstream int, seen boolean, down bigint, still bigint, top double, crops struct(q double, t bigint)[], event varchar)[]) as tracks,
    cast([] as struct(id bigint, event varchar, frames bigint[])[]) as told, cast(0 as bigint) as t from det
  union all
  select stream, k, next_id, list_transform(list_filter(fired, lambda a: a.missed <= 5), lambda a: struct_pack(id := a.id, x := a.x, y := a.y, sharp := a.sharp, border := a.border, t := a.t, vx := a.vx, vy := a.vy, hits := a.hits, missed := a.missed, judged := a.judged or a.event is not null, upstream := a.upstream, seen := a.seen, down := a.down, still := a.still, top := a.top, crops := a.crops, event := cast(null as varchar))),
    list_concat(list_transform(list_filter(fired, lambda a: a.missed > 5), lambda a: struct_pack(id := a.id, event := case when a.judged then 'EXITED_JUDGED' when a.hits >= 2 then 'EXITED' else 'EXITED_UNCONFIRMED' end, frames := cast([] as bigint[]))),
      list_transform(list_filter(fired, lambda a: a.event is not null), lambda a: struct_pack(id := a.id, event := a.event, frames := case when a.event = 'LINE' then list_transform(a.crops, lambda c: c.t) else list_slice(list_concat([a.t], list_filter(list_transform(a.crops, lambda c: c.t), lambda u: u <> a.t)), 1, 3) end))), t
  from (
    select *, list_transform(sided, lambda a: case when a.missed > 0 or a.hits < 2 or a.judged then a else struct_pack(id := a.id, x := a.x, y := a.y, sharp := a.sharp, border := a.border, t := a.t, vx := a.vx, vy := a.vy, hits := a.hits, missed := a.missed, judged := a.judged, upstream := a.upstream, seen := a.seen, down := a.down,
      still := case when a.event = 'LINE' then a.still when a.border or sqrt(a.vx * a.vx + a.vy * a.vy) >= 0.02 or a.sharp < 0.7 * a.top then null else coalesce(a.still, a.t) end, top := a.top, crops := a.crops,
      event := case when a.event = 'LINE' then 'LINE' when not a.border and sqrt(a.vx * a.vx + a.vy * a.vy) < 0.02 and a.sharp >= 0.7 * a.top and a.t - coalesce(a.still, a.t) >= 500 then 'STEADY' end) end) as fired
    from (
      select *, list_transform(moved, lambda a: case when a.missed > 0 or a.hits < 2 or a.judged then a else struct_pack(id := a.id, x := a.x, y := a.y, sharp := a.sharp, border := a.border, t := a.t, vx := a.vx, vy := a.vy, hits := a.hits, missed := a.missed, judged := a.judged,
        upstream := case when a.hits = 2 then case when a.x > 160 then 1 else -1 end else a.upstream end, seen := a.seen or a.hits = 2 or case when a.x > 160 then 1 else -1 end = a.upstream,
        down := case when a.hits = 2 or case when a.x > 160 then 1 else -1 end = a.upstream then 0 else a.down + cast(a.seen as int) end, still := a.still, top := a.top,
        crops := case when a.border then a.crops else list_transform(list_slice(list_sort(list_append(list_transform(a.crops, lambda c: struct_pack(q := -c.q, t := c.t)), struct_pack(q := -a.sharp * (1 - least(1.0, sqrt((a.x - 160) * (a.x - 160) + (a.y - 120) * (a.y - 120)) / sqrt(160.0 * 160.0 + 120.0 * 120.0))), t := a.t))), 1, 3), lambda c: struct_pack(q := -c.q, t := c.t)) end,
        event := case when a.hits > 2 and case when a.x > 160 then 1 else -1 end <> a.upstream and a.seen and a.down + 1 >= 2 then 'LINE' end) end) as sided
      from (
        select stream, k, t, case when x is not null and hit is null then next_id + 1 else next_id end as next_id,
          list_concat(list_transform(tracks, lambda a, i: case when i = hit then struct_pack(id := a.id, x := d.x, y := d.y, sharp := d.sharp, border := d.border, t := d.t, vx := case when a.hits = 1 then (d.x - a.x) / (d.t - a.t) else 0.5 * (d.x - a.x) / (d.t - a.t) + 0.5 * a.vx end, vy := case when a.hits = 1 then (d.y - a.y) / (d.t - a.t) else 0.5 * (d.y - a.y) / (d.t - a.t) + 0.5 * a.vy end,
              hits := a.hits + 1, missed := cast(0 as bigint), judged := a.judged, upstream := a.upstream, seen := a.seen, down := a.down, still := a.still, top := greatest(a.top, d.sharp), crops := a.crops, event := a.event)
            else struct_pack(id := a.id, x := a.x, y := a.y, sharp := a.sharp, border := a.border, t := a.t, vx := a.vx, vy := a.vy, hits := a.hits, missed := a.missed + 1, judged := a.judged, upstream := a.upstream, seen := a.seen, down := a.down, still := a.still, top := a.top, crops := a.crops, event := a.event) end),
            case when x is not null and hit is null then [struct_pack(id := next_id, x := x, y := y, sharp := sharp, border := border, t := t, vx := cast(0 as double), vy := cast(0 as double), hits := cast(1 as bigint), missed := cast(0 as bigint), judged := false, upstream := 0, seen := false, down := cast(0 as bigint), still := cast(null as bigint), top := sharp, crops := cast([] as struct(q double, t bigint)[]), event := cast(null as varchar))] else [] end) as moved
        from (
          select *, case when list_min(offs) is not null then list_position(offs, list_min(offs)) end as hit, struct_pack(x := x, y := y, sharp := sharp, border := border, t := t) as d
          from (
            select f.next_id, f.tracks, det.*, list_transform(f.tracks, lambda a: case when sqrt(pow(det.x - a.x - a.vx * (det.t - a.t), 2) + pow(det.y - a.y - a.vy * (det.t - a.t), 2)) <= 12 + 0.75 * sqrt(900.0) + 0.5 * sqrt(a.vx * a.vx + a.vy * a.vy) * (det.t - a.t)
              then sqrt(pow(det.x - a.x - a.vx * (det.t - a.t), 2) + pow(det.y - a.y - a.vy * (det.t - a.t), 2)) end) as offs
            from f join det on det.stream = f.stream and det.k = f.k + 1
          )
        )
      )
    )
  )
)
select stream, t as t_ms, cast(e.id as int) as track, e.event, e.frames[1] as crop_t_ms, array_to_string(e.frames, ',') as frames from (select stream, t, unnest(told) as e from f)
"""


@query(TRACKER)
def tracker_events(spark, sf_dir):
    """Eight streams of detections: parts that cross the line, parts that stop before it, gaps without any; triggers with the frames to
    judge, and exits, of the streaming tracker. Streams are read in slices of time."""
    order = F.struct("t_ms", "event_id")
    e = stats.positions(events(spark, sf_dir).withColumn("stream", F.col("user_id") % 8), ["stream"], order).withColumn("k", F.col("_at") + 1)
    c, odd = F.col("k") % 60, F.floor(F.col("k") / 60) % 2 == 1
    stops = F.when(c <= 12, c * 10).when(c <= 44, F.lit(120)).otherwise(120 + (c - 44) * 10)
    x = F.when(odd, stops).when(c <= 32, c * 10).cast("double")
    sharp = 5 + F.abs("value") - F.floor(F.abs("value"))
    shaped = e.select("stream", (F.col("k") * 33).cast("long").alias("t_ms"), x.alias("x"), (F.col("stream") * 20 + 20).cast("double").alias("y"), F.lit(900.0).alias("area"), sharp.alias("sharp"), (F.col("event_id") % 97 == 0).alias("border"))
    found = run_available(shaped, tracker.tracked, "tracker", order="t_ms", key="stream")
    return found.withColumn("frames", F.coalesce(F.array_join(F.transform("frames", lambda t: t.cast("string")), ","), F.lit("")))
