"""Queries over rules of records, crops and texts, each with DuckDB SQL. Images are rows of lineitem in order: 12 x 10 pixels each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import coreset, crops, knn, pixels, rules, telemetry
from ..params import DEFAULT
from ..sources.shared import table, tasks_for
from . import inspection as i
from .telemetry import EVENTS as EV
from .telemetry import events

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {EV} select event_id, event_type = 'error' and value / 50 > 1 and value / 50 <= 1.15 as votable, value / 60 is null or (1 + user_id % 3) * 0.9 >= value / 60 as valid from ev")
def votes_and_certificates(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("verdict", F.when(F.col("event_type") == "error", "DEFECT").otherwise("PASS"))
    return e.select("event_id", rules.votable(F.col("verdict"), F.col("value") / 50).alias("votable"), rules.certified(1 + F.col("user_id") % 3, F.lit(0.9), F.col("value") / 60).alias("valid"))


@query("select event_id, (event_id % 1600) // 40 between 4 and 35 and event_id % 40 between 4 and 35 as inside from events")
def legacy_border(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rules.inside_border(F.col("event_id") % 1600, 40, 40, 4).alias("inside"))


@query(f"""with {EV}, o as (select event_id, event_type, row_number() over (partition by event_type order by t_ms, event_id) - 1 as k, count(*) over (partition by event_type) as n from ev)
select event_type, event_id from o where n <= 40 or list_contains([(j * (n - 1)) // 39 for j in range(40)], k)""")
def even_subsample(spark, sf_dir):
    return rules.even_subsample(events(spark, sf_dir), "event_type", F.struct("t_ms", "event_id")).select("event_type", "event_id")


HOUR = replace(DEFAULT, downsample_ms=3_600_000)


@query(f"""with recursive {EV}, k as (select user_id, min(t_ms) as t_ms from ev group by user_id
union all select e.user_id, min(e.t_ms) from k join ev e on e.user_id = k.user_id and e.t_ms >= k.t_ms + 3600000 group by e.user_id, k.t_ms) select user_id, t_ms from k""")
def time_downsample(spark, sf_dir):
    return rules.downsampled(events(spark, sf_dir).select("user_id", "t_ms"), "user_id", HOUR).select("user_id", "t_ms")


@query(f"""with recursive {EV}, d as (select distinct user_id, t_ms from ev), k as (select user_id, min(t_ms) as t_ms, cast(null as bigint) as began from d group by user_id
union all select d.user_id, min(d.t_ms), k.t_ms from k join d on d.user_id = k.user_id and d.t_ms >= k.t_ms + 3600000 group by d.user_id, k.t_ms)
select user_id, t_ms, round(n * 1000.0 / (t_ms - began), 9) as fps from (select k.user_id, k.t_ms, k.began, count(*) as n from k join d on d.user_id = k.user_id and d.t_ms > k.began and d.t_ms <= k.t_ms where k.began is not null group by all)""")
def fps_blocks(spark, sf_dir):
    return rules.blocks_per_second(events(spark, sf_dir).select("user_id", "t_ms").distinct(), "user_id", 3_600_000).select("user_id", "t_ms", F.round("fps", 9).alias("fps"))


@query(f"""with {EV}, x as (select event_type as g, event_id, pow(value / 10, 4) as s from ev), m as (select g, median(s) as med, count(*) as n from x group by g),
d as (select g, med, n, 1.4826 * median(abs(s - med)) as sd from x join m using (g) group by g, med, n),
o as (select g, event_id, s, n, row_number() over (partition by g order by s desc, event_id) as place from x join d using (g) where n >= 6 and s > med + 3 * if(sd = 0, 1e-9, sd))
select g, event_id, round(s, 4) as s, place from o where place <= floor(0.2 * n)""")
def outlier_frames(spark, sf_dir):
    """A share of each group at most, the worst first."""
    x = events(spark, sf_dir).select(F.col("event_type").alias("g"), "event_id", F.pow(F.col("value") / 10, F.lit(4.0)).alias("s"))
    return rules.outliers(x, "g", "event_id", "s").select("g", "event_id", F.round("s", 4).alias("s"), F.col("place").cast("long").alias("place"))


@query(f"with {EV} select event_type, count(*) filter (value between 20 - 2 and 60 + 2 and user_id % 100 between 10 - 2 and 70 + 2) as hits, count(*) as n from ev group by event_type")
def localisation_rate(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", F.col("value").alias("peak_x"), (F.col("user_id") % 100).alias("peak_y"), F.lit(20).alias("x0"), F.lit(60).alias("x1"), F.lit(10).alias("y0"), F.lit(70).alias("y1"))
    return e.groupBy("event_type").agg(F.count_if(rules.localised(e, 2.0)).alias("hits"), F.count("*").alias("n"))


@query(f"""with {i.EMB}, {i.PATCH}, m as (select twin, r, c, avg(abs(f1)) as m from patch group by all), x as (select twin, median(m) as mid from m group by twin)
select twin, r, c, round(greatest(m, 0.9 * mid), 6) as norm from m join x using (twin)""")
def position_floor(spark, sf_dir):
    maps_ = i.maps.exploded(i.rows(spark, sf_dir).withColumnRenamed("id", "frame"), 4, 4, keep=("frame", "twin")).withColumn("sm", F.abs(F.get("f", F.lit(0))))
    return rules.position_floor(maps_, "twin", 0.9).select("twin", "r", "c", *i.r6("norm"))


@query(f"""with {i.EMB}, x as (select twin, if(vec_id % 50 = 7, 1e30, abs(f[1])) as a, if(vec_id % 50 = 7 and twin <> 3, 1e30, abs(f[1]) * (1 + (twin % 3) * 0.0006)) as b from emb)
select twin, round(max(case when a < 1e30 and b < 1e30 then abs(a - b) end) / max(case when a < 1e30 and b < 1e30 then a end), 9) as off,
  not bool_or((a >= 1e30) <> (b >= 1e30)) and max(case when a < 1e30 and b < 1e30 then abs(a - b) end) / max(case when a < 1e30 and b < 1e30 then a end) <= 1e-3 as agrees from x group by twin""")
def knn_agreement(spark, sf_dir):
    gone, v = F.col("id") % 50 == 7, F.abs(F.get("f", F.lit(0)))
    x = i.rows(spark, sf_dir).select("twin", F.when(gone, 1e30).otherwise(v).alias("a"), F.when(gone & (F.col("twin") != 3), 1e30).otherwise(v * (1 + (F.col("twin") % 3) * 0.0006)).alias("b"))
    return rules.agreement(x, "twin").select("twin", F.round("off", 9).alias("off"), "agrees")


@query(f"""with {EV}, t as (select event_type as g, 'c' || (user_id % 7) as name, value + if(user_id % 7 = 0, 60, 1 + user_id % 7) as ms, user_id % 7 <> 3 as accurate from ev),
r as (select g, name, median(ms) as med, min(ms) as low, bool_and(accurate) as accurate from t group by all), b as (select g, med as m0, low as l0 from r where name = 'c0')
select g, name, round(med, 6) as med from (select *, row_number() over (partition by g order by med, name <> 'c0', name) as k from r join b using (g) where name = 'c0' or accurate and med <= 0.9 * m0 and low <= 0.9 * l0) where k = 1""")
def accelerator_choice(spark, sf_dir):
    u = F.col("user_id") % 7
    t = events(spark, sf_dir).select(F.col("event_type").alias("g"), F.concat(F.lit("c"), u).alias("name"), (F.col("value") + F.when(u == 0, 60).otherwise(1 + u)).alias("ms"), (u != 3).alias("accurate"))
    return rules.best_candidate(t, "g", "name", "c0").select("g", "name", *i.r6("med"))


@query(f"""with {EV}, f as (select *, sum(if(value > 20, 0, 1)) over (partition by user_id % 50 order by t_ms, event_id) as run from ev)
select user_id % 50 as stream, min(t_ms) as first, max(t_ms) as last, count(*) as n from f where value > 20 group by user_id % 50, run having count(*) >= 5""")
def long_runs(spark, sf_dir):
    return rules.long_runs(events(spark, sf_dir).withColumn("stream", F.col("user_id") % 50), "stream", F.col("value") > 20, 5, "t_ms", "event_id")


@query(f"""with {EV} select event_id, round(greatest(0.0, least(1.0, (value / 40 - 0.6) / 0.6)), 9) as heat, round(abs(user_id - 50) * 1e-6 * value * 1e-3, 12) as watts,
  cast(greatest(0, least(255, floor(value * 3 - 20 + 0.5))) as int) as byte, round(value + 0.25 * 40, 6) as ahead from ev""")
def session_numbers(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", F.round(rules.heat(v, F.lit(40.0)), 9).alias("heat"), F.round(rules.watts(F.col("user_id") - 50, v), 12).alias("watts"), rules.clamped(v * 3 - 20).alias("byte"), F.round(rules.ahead(v, F.lit(0.25), F.lit(40)), 6).alias("ahead"))


@query("select event_type, least(count(*), least(2400, greatest(256, floor(0.1 * count(*)))))::bigint as rows from events group by event_type")
def bank_sizes(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", coreset.bank_rows(F.col("n")).alias("rows"))


RESULTS = f"""res as (select user_id % 3 as variant, case event_type when 'purchase' then 'good' when 'error' then 'defect' when 'click' then 'wrong' when 'view' then 'lookalike' else 'rotated' end as label,
  case when value < 20 then 'NOT_ENROLLED' when value < 60 then 'PASS' else 'DEFECT' end as verdict, value as s, user_id % 41 as sim from ev)"""
RATES = {"pass_good": ("good", "PASS"), "pass_rotated": ("rotated", "PASS"), "refused_wrong": ("wrong", "NOT_ENROLLED"), "refused_lookalike": ("lookalike", "NOT_ENROLLED"), "defect_found": ("defect", "DEFECT")}


def _auc(pos: str, neg: str, score: str) -> str:
    return f"(select round(avg(case when p.{score} > n.{score} then 1.0 when p.{score} = n.{score} then 0.5 else 0.0 end), 6) from res p, res n where p.variant = res.variant and n.variant = res.variant and p.label = '{pos}' and n.label = '{neg}')"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "purchase", "good").when(kind == "error", "defect").when(kind == "click", "wrong").when(kind == "view", "lookalike").otherwise("rotated")
    verdict = F.when(F.col("value") < 20, "NOT_ENROLLED").when(F.col("value") < 60, "PASS").otherwise("DEFECT")
    return events(spark, sf_dir).select((F.col("user_id") % 3).alias("variant"), label.alias("label"), verdict.alias("verdict"), F.col("value").alias("s"), (F.col("user_id") % 41).cast("double").alias("sim"), (F.col("user_id") % 4).alias("size"))


@query(f"with {EV}, {RESULTS} select variant, " + ", ".join(f"count(*) filter (label = '{lab}' and verdict = '{v}') as {n}_k, count(*) filter (label = '{lab}') as {n}_n" for n, (lab, v) in RATES.items()) + f", {_auc('defect', 'good', 's')} as auroc_defect, {_auc('good', 'wrong', 'sim')} as auroc_identity, {_auc('good', 'lookalike', 'sim')} as auroc_lookalike from res group by variant")
def eval_metrics(spark, sf_dir):
    """A row a variant, as an evaluation over several of them is reported."""
    out = rules.evaluated(results(spark, sf_dir), ["variant"])
    return out.select("variant", *(f"{n}_{x}" for n in RATES for x in "kn"), *i.r6("auroc_defect", "auroc_identity", "auroc_lookalike"))


@query(f"""with {EV}, {RESULTS.replace('as sim from ev', 'as sim, user_id % 4 as size from ev')} select coalesce(cast(size as varchar), 'ALL') as size, coalesce(label, 'ALL') as kind, sens::double as sens, count(*) as n, count(*) filter (s > 50 * sens) as flagged
from res, (values (1.0), (1.1)) v(sens) group by grouping sets ((size, label, sens), (size, sens), (label, sens), (sens))""")
def handheld_summary(spark, sf_dir):
    """Detections by size and kind, by each and over all, at two sensitivities."""
    r = results(spark, sf_dir).withColumn("sens", F.explode(F.array(F.lit(1.0), F.lit(1.1)))).withColumn("size", F.col("size").cast("string"))
    out = r.cube("size", "label", "sens").agg(F.count("*").alias("n"), F.count_if(F.col("s") > 50 * F.col("sens")).alias("flagged")).where("sens is not null")
    return out.select(F.coalesce("size", F.lit("ALL")).alias("size"), F.coalesce("label", F.lit("ALL")).alias("kind"), "sens", "n", "flagged")


@query(f"""with {EV}, {RESULTS}, a as (select variant, {_auc('defect', 'good', 's')} as d, {_auc('good', 'wrong', 'sim')} as w from res group by variant)
select 'all' as study, variant, row_number() over (order by d desc, w desc, variant % 2, variant) as place from a""")
def variant_winner(spark, sf_dir):
    from ..operators.twin import ranked_variants

    m = rules.evaluated(results(spark, sf_dir), ["variant"]).select(F.lit("all").alias("study"), "variant", *i.r6("auroc_defect", "auroc_identity"), (F.col("variant") % 2).alias("changes"))
    return ranked_variants(m).select("study", "variant", F.col("place").cast("long").alias("place"))


@query(f"""with {i.EMB}, {i.UNIT}, loo as (select a.twin, a.vec_id, min(1 - {i.DOT}) as d from unit a join unit b on a.twin = b.twin and a.vec_id <> b.vec_id group by all)
select twin, round(greatest(0.02, max(d) * 1.1), 6) as g_tau from loo group by twin""")
def globals_loo(spark, sf_dir):
    """The limit on how far a frame's descriptor lies from the nearest other one's."""
    u = i.unit(i.rows(spark, sf_dir))
    near = knn.nearest(u, u, "twin", how="dot", own=True)
    return near.groupBy(F.col("key").alias("twin")).agg(F.round(F.greatest(F.lit(0.02), F.max(1 - F.col("best")) * 1.1), 6).alias("g_tau"))


@query(f"with {i.EMB}, loo as (select a.twin, a.vec_id % 10 as frame, a.vec_id, sqrt(min({i.D2})) as d from emb a join emb b on a.twin = b.twin and a.vec_id % 10 % 3 <> b.vec_id % 10 % 3 group by all) select twin, round(max(d) * 1.2, 6) as tau from loo group by twin")
def legacy_folds(spark, sf_dir):
    """Frames held out by folds, and a margin on the largest distance."""
    df = i.rows(spark, sf_dir).withColumn("fold", F.col("id") % 10 % 3)
    return knn.nearest(df, df, "twin", mask="fold").groupBy(F.col("key").alias("twin")).agg(F.round(F.sqrt(F.max("best")) * 1.2, 6).alias("tau"))


@query(f"with {EV}, o as (select event_id // 2 as item, event_id % 2 as orient, if(event_id % 11 = 0, 'nan'::double, value) as fit, user_id as raw from ev) select item, orient::int as orient from (select *, row_number() over (partition by item order by isnan(fit), fit, orient) as k from o) where k = 1")
def best_orientation(spark, sf_dir):
    """The view that fits better; of equal ones the first."""
    from ..operators.twin import best_orientation as best

    o = events(spark, sf_dir).select(F.floor(F.col("event_id") / 2).alias("item"), (F.col("event_id") % 2).cast("int").alias("orientation"), F.when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value")).alias("fit"))
    return best(o, "item", "fit").select("item", F.col("orientation").alias("orient"))


@query(f"with {EV}, j as (select event_id, event_type as a, if(event_id % 9 = 0, 'view', event_type) as b, value as x, value * (1 + (event_id % 5) * 0.01) as y from ev) select count(*) as n, count(*) filter (a = b) as agree, round(median(abs(x - y)), 6) as med_off, round(max(abs(x - y)), 6) as max_off from j")
def two_runs_compared(spark, sf_dir):
    """Two judgements of the same items: agreement, and how far their scores are apart."""
    e = events(spark, sf_dir)
    other = e.select("event_id", F.when(F.col("event_id") % 9 == 0, "view").otherwise(F.col("event_type")).alias("b"), (F.col("value") * (1 + (F.col("event_id") % 5) * 0.01)).alias("y"))
    j = e.join(other, "event_id").select(F.lit(0).alias("g"), (F.col("event_type") == F.col("b")).alias("same"), F.abs(F.col("value") - F.col("y")).alias("off"))
    mid = rules.stats.quantiles(j, "off", ["g"], [0.5], ["med_off"])
    return j.groupBy("g").agg(F.count("*").alias("n"), F.count_if("same").alias("agree"), F.max("off").alias("max_off")).join(mid, "g").select("n", "agree", *i.r6("med_off", "max_off"))


@query(f"with {EV} select 'missing' as side, event_id from ev where event_type = 'error' and event_id % 4 = 0 union all select 'extra', event_id from ev where event_type = 'click' and event_id % 4 <> 0")
def missing_and_extra(spark, sf_dir):
    """What was expected and didn't come, and what came unasked."""
    e = events(spark, sf_dir)
    return telemetry.unmatched(e.where("event_type = 'error' or (event_type = 'click' and event_id % 4 = 0)").where("event_type = 'error' or event_id % 4 = 0"), e.where("(event_type = 'error' and event_id % 4 <> 0) or event_type = 'click'"), "event_id")


VERDICT = "case event_type when 'error' then 'DEFECT' when 'purchase' then 'PASS' when 'click' then 'NOT_ENROLLED' else 'REFRAME' end"
REASON = "case event_type when 'click' then ['identity', 'shape', 'fit', 'coverage', 'other'][cast(user_id % 5 as int) + 1] when 'error' then null when 'purchase' then null else ['NO_OBJECT', 'TOUCHES_BORDER', 'TOO_SMALL', 'TOO_LARGE', 'MULTIPLE', 'NO_CORE', 'SCORE_FAILED'][cast(user_id % 7 as int) + 1] end"
SAID = " ".join(f"when '{k}' then '{v}'" for k, v in text.SAID.items())


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, u = F.col("event_type"), F.col("user_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (u % len(names) + 1).cast("int"))
    reason = F.when(kind == "click", pick(["identity", "shape", "fit", "coverage", "other"])).when(~kind.isin("error", "purchase"), pick([*text.SAID, "SCORE_FAILED"]))
    e = events(spark, sf_dir).withColumn("verdict", F.when(kind == "error", "DEFECT").when(kind == "purchase", "PASS").when(kind == "click", "NOT_ENROLLED").otherwise("REFRAME")).withColumn("reason", reason)
    score = F.when(F.col("event_id") % 6 != 0, 1 + (F.col("event_id") % 50) / 4.0)
    return e.withColumns({"part": F.lit("gear"), "number": (F.col("event_id") % 1000).cast("int"), "area": F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 100) / 2.0), "region": text.region((F.col("event_id") % 40).cast("int"), (u % 40).cast("int"), 40, 40), "score": score, "row": (F.col("event_id") % 40).cast("int"), "col": (u % 40).cast("int")})


def _region() -> str:
    from .words import REGION

    return REGION


SPOKEN = f"""sp as (select event_id, {VERDICT} as v, {REASON} as reason, event_id % 1000 as number, if(event_id % 3 <> 0, (event_id % 100)::double / 2, null) as area, {_region()} as region, if(event_id % 6 <> 0, 1 + (event_id % 50)::double / 4, null) as score, r, c
  from (select *, event_id % 40 as r, user_id % 40 as c from events))"""


@query(f"""with {SPOKEN} select event_id, case v
  when 'DEFECT' then concat('Reject ', printf('%03d', number), ': anomaly', coalesce(' covering ' || printf('%.1f', area) || ' % of the part', ''), ' at the ', region, coalesce(', ' || printf('%.2f', score) || '× the learned limit', ''), '.')
  when 'PASS' then concat('Pass: within the learned limit', coalesce(' (' || printf('%.2f', score) || '×)', ''), '.')
  when 'NOT_ENROLLED' then concat('Not the enrolled part', case reason when 'identity' then ': it does not look like the taught gear.' when 'shape' then ': its shape does not match the taught gear.'
    when 'fit' then ': overall it looks different from the taught gear — a similar object, not this one.' when 'coverage' then concat(': most of its surface differs from the taught gear', coalesce(' (' || printf('%.1f', area) || ' % of the part)', ''), '.') else '.' end)
  else concat('Reframe: ', case reason {SAID} else 'show the part again.' end) end as sentence from sp""")
def verdict_sentences(spark, sf_dir):
    return spoken(spark, sf_dir).select("event_id", text.sentence(*(F.col(c) for c in ("verdict", "reason", "part", "number", "area", "region", "score"))).alias("sentence"))


@query(f"""with {SPOKEN} select event_id, concat_ws(' · ', 'gear', v, nullif(case v when 'DEFECT' then concat_ws(' · ', concat(region, ' (row ', r + 1, '/40, col ', c + 1, '/40)'), printf('%.1f', area) || ' % of part', printf('%.2f', score) || '× limit')
  when 'PASS' then printf('%.2f', score) || '× limit' when 'NOT_ENROLLED' then concat_ws(' · ', reason, if(reason = 'coverage', printf('%.1f', area) || ' % of part', null)) else reason end, '')) as facts from sp""")
def facts_lines(spark, sf_dir):
    s = spoken(spark, sf_dir)
    return s.select("event_id", text.facts_line(*(F.col(c) for c in ("verdict", "reason", "part", "area", "region", "row", "col")), 40, 40, F.col("score")).alias("facts"))


@query(f"""with {EV}, c as (select user_id, count(*) as n, count(*) filter (value > 20) as sane, count(*) filter (value > 90) as m, max(value) filter (value > 90) as top from ev group by user_id)
select user_id, printf('%d presentations, %d sane, %d valid', n, sane, m) || chr(10) || if(m >= 1, printf('false rejects at most %.2f', 100 * (1 - pow(0.05, 1.0 / m))) || ' % (95 % confidence)', 'no bound yet') || chr(10) || printf('limit %.4f', coalesce(greatest(top, 80.0), 80.0)) || ', largest good score ' || coalesce(printf('%.4f', top), 'none') as certificate from c""")
def certificate_text(spark, sf_dir):
    c = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("sane"), F.count_if(F.col("value") > 90).alias("m"), F.max(F.when(F.col("value") > 90, F.col("value"))).alias("top"))
    alpha = rules.stats.order_alpha(DEFAULT.confidence, F.col("m"))
    return c.select("user_id", text.certificate(F.col("n"), F.col("sane"), F.col("m"), alpha, F.col("top"), F.greatest("top", F.lit(80.0)), DEFAULT.confidence).alias("certificate"))


@query(f"with {EV} select event_id, strftime(make_timestamp(t_ms * 1000), '%Y%m%d-%H%M%S') || '-' || lower(lpad(to_hex(event_id % 65536), 4, '0')) as part_id, true as valid from ev")
def part_ids(spark, sf_dir):
    p = events(spark, sf_dir).withColumn("part_id", text.part_id(F.col("t_ms"), F.col("event_id")))
    return p.select("event_id", "part_id", text.valid_id(F.col("part_id")).alias("valid"))


@query("""with v as (select event_id, ['base', 'b2+mad+sm', 'p90+l2', 'b11+2nd+pn+noglob', 'pnm+aug', 'b+mad', 'sm+'][cast(event_id % 7 as int) + 1] as v from events), w as (select event_id, v, string_split(v, '+') as w from v)
select event_id, if(v in ('b+mad', 'sm+'), null, coalesce(cast(regexp_extract(v, 'b([0-9]+)', 1) as varchar), '')) as border, if(v in ('b+mad', 'sm+'), null, case when list_contains(w, '2nd') then '2nd' when list_contains(w, 'p90') then 'p90' when list_contains(w, 'mad') then 'mad' else 'max' end) as tau,
  if(v in ('b+mad', 'sm+'), null, list_contains(w, 'sm')) as smooth, if(v in ('b+mad', 'sm+'), null, not list_contains(w, 'noglob')) as globals from w""".replace("coalesce(cast(regexp_extract(v, 'b([0-9]+)', 1) as varchar), '')", "coalesce(try_cast(nullif(regexp_extract(v, 'b([0-9]+)', 1), '') as int), 0)"))
def variants(spark, sf_dir):
    names = F.array(*map(F.lit, ("base", "b2+mad+sm", "p90+l2", "b11+2nd+pn+noglob", "pnm+aug", "b+mad", "sm+")))
    v = table(spark, sf_dir, "events").select("event_id", text.variant(F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))).alias("v"))
    return v.select("event_id", "v.border", "v.tau", "v.smooth", "v.globals")


H, WD = 10, 12
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
PX = f"px as (select row_number() over (order by {', '.join(ORDER)}) - 1 as nth, floor(l_extendedprice)::bigint % 256 as v, l_quantity, l_discount, l_tax from lineitem)"
IMG = f"{PX}, img as (select nth // {H * WD} as img, nth % {H * WD} // {WD} as y, nth % {WD} as x, v from px)"


def pixel_rows(spark: SparkSession, sf_dir: str, height: int = H, width: int = WD, more: tuple[str, ...] = ("l_quantity", "l_discount", "l_tax")) -> DataFrame:
    """Images of height x width: the rows of lineitem in order, a pixel each, with v and what more is asked for."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(*ORDER, *more, F.lit(0).alias("all"), (F.floor("l_extendedprice") % 256).cast("double").alias("v"))
    at = stats.positions(rows, ["all"], F.struct(*ORDER), keep=["v", *more], tasks=tasks_for(spark, lines.count()))
    k, size = F.col("_at"), height * width
    return at.select(F.floor(k / size).alias("img"), F.floor(k % size / width).cast("int").alias("y"), (k % width).cast("int").alias("x"), "v", *more)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(spark, sf_dir, more=())


CROP = "crop as (select img, 1 + (k % 3)::double / 2 as x0, (k % 4)::double / 3 as y0, 5 + (k % 5)::double as side from (select img, count(*) filter (v > 200) as k from img group by img))"


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of each image, by how many of its pixels are bright."""
    k = F.col("k")
    bright = images(spark, sf_dir).groupBy("img").agg(F.count_if(F.col("v") > 200).alias("k"))
    return bright.select("img", (1 + (k % 3) / 2).alias("x0"), ((k % 4) / 3).alias("y0"), (5 + (k % 5)).cast("double").alias("side"))


#: Every pixel that is set reaches all of its component; the first one names it.
def reached(on: str, more: str = "") -> str:
    return f"""reach as (select img, y * 100000 + x as root, y, x from img where {on} union select r.img, r.root, i.y, i.x from reach r join img i on i.img = r.img and abs(i.y - r.y) <= 1 and abs(i.x - r.x) <= 1 where i.{on}),
rooted as (select img, y, x, min(root) as root from reach group by img, y, x), lab as (select img, y, x, dense_rank() over (partition by img order by root) as label from rooted{more})"""


def _tap(axis: str, n: int) -> str:
    return f"""t{axis} as (select img, o, greatest(0, least({n - 1}, floor(a) + d)) as p, if(d = 0, 1 - (a - floor(a)), a - floor(a)) as w from (select img, o, d, {axis}0 + (o + 0.5) * side / 6 - 0.5 as a from crop, (select unnest(range(6)) as o), (values (0), (1)) v(d)))"""


@query(f"with {IMG}, {CROP}, {_tap('x', WD)}, {_tap('y', H)} select m.img, ty.o::int as y, tx.o::int as x, round(sum(m.v * tx.w * ty.w), 6) as v from tx join ty using (img) join img m on m.img = tx.img and m.x = tx.p and m.y = ty.p group by all")
def crop_resize(spark, sf_dir):
    return crops.resized(images(spark, sf_dir), squares(spark, sf_dir), 6, H, WD, ("v",)).select("img", "y", "x", *i.r6("v"))


@query(f"with {IMG} select img, (11 - x)::int as y, y::int as x, v::double as v from img")
def quarter_turn(spark, sf_dir):
    return crops.turned(images(spark, sf_dir), 1, H, WD)


@query(f"""with {IMG}, {CROP}, on_ as (select img, y, x from img where v > 100), pt as (select img, r, c, floor((x0 + (c + (j + 0.5) / 4) * side / 3) / 1) as px, floor((y0 + (r + (i + 0.5) / 4) * side / 3) / 1) as py from crop, (select unnest(range(3)) as r), (select unnest(range(3)) as c), (select unnest(range(4)) as i), (select unnest(range(4)) as j))
select p.img, r::int as r, c::int as c, count(o.img) / 16.0 as cov from pt p left join on_ o on o.img = p.img and o.x = px and o.y = py group by p.img, r, c""")
def patch_coverage(spark, sf_dir):
    on = images(spark, sf_dir).where("v > 100").withColumn("label", F.lit(1))
    return crops.coverage(on, squares(spark, sf_dir).withColumn("label", F.lit(1)), 3, 3).select("img", "r", "c", "cov")


@query(f"with {IMG}, b as (select img, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from img where v > 200 group by img), s as (select *, least(greatest(4 * (x1 + 1 - x0), 4 * (y1 + 1 - y0)) * 1.2, 48.0, 40.0) as side from b) select img, round(side, 6) as side, round(greatest(0.0, least(2.0 * (x0 + x1 + 1) - side / 2, 48 - side)), 6) as x0, round(greatest(0.0, least(2.0 * (y0 + y1 + 1) - side / 2, 40 - side)), 6) as y0 from s")
def crop_squares(spark, sf_dir):
    b = images(spark, sf_dir).where("v > 200").groupBy("img").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return crops.full_square(b, 4, 4 * H, 4 * WD).select("img", *i.r6("side", "x0", "y0"))


@query(f"with {IMG} select img, y // 2 as y, x // 3 as x, floor(avg(v) + 0.5)::bigint as v from (select img, (y // 2 * 2) as yy, y, x, v from img) where y < 10 group by img, y // 2, x // 3".replace("x // 3", "x // 2"))
def box_downscale(spark, sf_dir):
    return pixels.shrunk(images(spark, sf_dir), 2, ("v",)).select("img", "y", "x", "v")


@query(f"""with recursive {IMG}, {reached('v > 150')} select img, label::int as label, count(*) as area, min(x)::int as min_x, max(y)::int as max_y, round(avg(x) + 0.5, 6) as cx, bool_or(x < 2 or y < 2 or x >= 10 or y >= 8) as border from lab group by img, label""")
def component_stats(spark, sf_dir):
    on = images(spark, sf_dir).where("v > 150")
    return pixels.component_stats(pixels.components(on, 1), H, WD).select("img", "label", "area", "min_x", "max_y", *i.r6("cx"), F.col("touches_border").alias("border"))


@query(f"""with {IMG}, l as (select a.img, sum(b.v) - 4 * a.v as l from img a join img b on a.img = b.img and abs(a.x - b.x) + abs(a.y - b.y) = 1 where a.x between 1 and 10 and a.y between 1 and 8 group by a.img, a.x, a.y, a.v)
select img, round(var_pop(l), 4) as sharpness from l group by img""")
def sharpness(spark, sf_dir):
    return pixels.sharpness(images(spark, sf_dir), H, WD).select("img", F.round("sharpness", 4).alias("sharpness"))


NEAR = "join img b on a.img = b.img and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1"


@query(f"with {IMG}, e as (select a.img, a.y, a.x from img a {NEAR} group by all having min(b.v) > 60), g as (select distinct a.img, a.y, a.x from img a join e b on a.img = b.img and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1) select img, y::int as y, x::int as x from g")
def opened_masks(spark, sf_dir):
    on = images(spark, sf_dir).where("v > 60")
    return pixels.dilated(pixels.eroded(on, H, WD), H, WD).select("img", F.col("y").cast("int"), F.col("x").cast("int"))


MOMENTS = """mom as (select img, label, n, sx, sy, (n * sxx - sx * sx) / n::double as a, (n * syy - sy * sy) / n::double as b, (n * sxy - sx * sy) / n::double as c from (select img, label, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(y * y) as syy, sum(x * y) as sxy from lab group by img, label)),
shp as (select img, label, n, (a + b) / (n * n) as hu1, if((a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 = 0, 1, sqrt(greatest(0, (a + b - sqrt((a - b) * (a - b) + 4 * c * c)) / 2) / ((a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2))) as aspect, 0.5 * atan2(2 * c, a - b) as theta from mom),
wide as (select s.img, s.label, (max(cos(theta) * x + sin(theta) * y) - min(cos(theta) * x + sin(theta) * y) + 1) * (max(cos(theta) * y - sin(theta) * x) - min(cos(theta) * y - sin(theta) * x) + 1) as box from shp s join lab l on l.img = s.img and l.label = s.label group by s.img, s.label)"""


@query(f"""with recursive {IMG}, {reached('v > 150')}, {MOMENTS}
select s.img, s.label::int as label, round(hu1, 6) as hu1, round(aspect, 6) as aspect, round(sin(2 * theta), 6) as axis, round(n / box, 6) as fill from shp s join wide w on w.img = s.img and w.label = s.label""")
def shape_moments(spark, sf_dir):
    """Every component's shape; its axis as an angle that a half turn doesn't change."""
    on = images(spark, sf_dir).where("v > 150")
    return pixels.shapes(pixels.components(on, 1)).select("img", "label", *i.r6("hu1", "aspect"), F.round(F.sin(2 * F.col("theta")), 6).alias("axis"), *i.r6("fill"))
