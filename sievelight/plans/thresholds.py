"""Thresholds that change after teaching, and verdicts by all rules: calibration, more negatives, votes, agreement of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import gates, twin
from ..params import DEFAULT
from ..sources.shared import stored
from .inspection import EMB, IDT, LSO, NEG, POS, TAU, UNIT, held_out, presented, r6, rows, sims
from .telemetry import shapes

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ALONE = "alone as (select p.twin, lo - greatest(0.02, 3 * 1.4826 * median(abs(sim - m))) as tau_id from pos p join (select twin, median(sim) as m, quantile_cont(sim, 0.05) as lo from pos group by twin) using (twin) group by p.twin, lo)"


@query(f"""with {EMB}, {UNIT}, {POS}, {NEG}, {IDT}, {ALONE}
select a.twin, round(a.tau_id, 6) as before, 'no-negatives' as rule_before, round(i.tau_id, 6) as tau_id, 'midpoint' as rule, round(margin, 6) as margin from alone a join idt i using (twin)""")
def add_negatives(spark, sf_dir):
    """The identity limit of each part as taught, and once the next part's rows are known as wrong objects."""
    df = rows(spark, sf_dir)
    pos, neg = stored(sims(df, df).select("twin", "sim"), "pos"), sims(presented(df), df).select("twin", "sim")
    first = gates.identity_threshold(pos, pos.where("false"), "twin").withColumnRenamed("rule", "tau_id_rule").withColumns({"cal_max": F.lit(1.0), "n": F.lit(5), "alpha": F.lit(0.1)})
    after = twin.with_negatives(first.withColumns({"before": F.col("tau_id"), "rule_before": F.col("tau_id_rule")}), pos, neg)
    assert not {"cal_max", "n", "alpha"} & set(after.columns)
    return after.select("twin", *r6("before"), "rule_before", *r6("tau_id"), F.col("tau_id_rule").alias("rule"), *r6("margin"))


SAMPLE = f"""{EMB}, {UNIT}, {LSO}, {POS}, {TAU}, {ALONE}, smp as (
  select p.twin, p.vec_id, case when p.vec_id % 7 = 0 then 'TOO_SMALL' else 'OK' end as sanity, p.sim, l.d * 1.5 as raw, p.sim >= a.tau_id as id_ok, p.vec_id % 5 <> 0 as geo_ok from pos p join lso l using (twin, vec_id) join alone a using (twin) where p.vec_id % 2 = 1)"""


@query(f"""with {SAMPLE}, pool as (select twin, sim from pos union all select twin, sim from smp where sanity = 'OK'), pm as (select twin, median(sim) as m, quantile_cont(sim, 0.05) as lo from pool group by twin),
again as (select p.twin, lo - greatest(0.02, 3 * 1.4826 * median(abs(sim - m))) as tau_id from pool p join pm using (twin) group by p.twin, lo),
s as (select twin, max(raw) filter (sanity = 'OK' and id_ok and geo_ok) as cal_max, count(*) filter (sanity = 'OK' and id_ok and geo_ok) as n, count(*) as n_seen, count(*) filter (sanity = 'OK') as n_sane, count(*) filter (sanity = 'OK' and id_ok) as n_id, count(*) filter (sanity = 'OK' and geo_ok) as n_geo from smp group by twin)
select twin, round(greatest(tau, cal_max), 6) as tau, round(cal_max, 6) as cal_max, n, n_seen, n_sane, n_id, n_geo, round(1 - pow(0.05, 1.0 / n), 6) as alpha, round(a.tau_id, 6) as tau_id, greatest(tau, cal_max) >= cal_max as certified from tau join s using (twin) join again a using (twin)""")
def calibrate(spark, sf_dir):
    """Every second row as a sample set aside: limits raised to it, gates counted, identity derived again."""
    df = rows(spark, sf_dir)
    pos, own = stored(sims(df, df), "pos"), held_out(df)
    tau = own.groupBy("twin").agg((DEFAULT.tau_factor * F.max("d")).alias("tau"))
    taught = tau.join(gates.identity_threshold(pos, pos.where("false"), "twin").withColumnRenamed("rule", "tau_id_rule"), "twin")
    odd = pos.join(own, ["twin", "vec_id"]).where("vec_id % 2 = 1").join(taught.select("twin", "tau_id"), "twin")
    samples = odd.select("twin", F.when(F.col("vec_id") % 7 == 0, "TOO_SMALL").otherwise("OK").alias("sanity"), "sim", (F.col("d") * 1.5).alias("raw"), (F.col("sim") >= F.col("tau_id")).alias("id_ok"), (F.col("vec_id") % 5 != 0).alias("geo_ok"))
    from ..operators.rules import certified

    out = twin.calibrated(taught, stored(samples, "samples"), DEFAULT, pos)
    return out.select("twin", *r6("tau", "cal_max"), "n", "n_seen", "n_sane", "n_id", "n_geo", *r6("alpha", "tau_id"), certified(F.col("tau"), F.lit(1.0), F.col("cal_max")).alias("certified"))


CROPS = f"""{EMB}, {LSO}, {TAU}, crop as (
  select twin, vec_id // 40 as track, row_number() over (partition by twin, vec_id // 40 order by vec_id) - 1 as ord, d / tau * 1.4 as s, d as fit, case when vec_id % 11 = 0 then 0.9 else 0.1 end as anomalous, 0.9 * tau / 1.4 as tau_fit from lso join tau using (twin)),
one as (select *, case when s <= 1 then 'PASS' when anomalous > 0.5 then 'NOT_ENROLLED' else 'DEFECT' end as verdict, case when s > 1 and anomalous > 0.5 then 'coverage' end as reason from crop where ord = 0),
ask as (select * from one where verdict = 'DEFECT' and s > 1 and s <= 1.15), few as (select c.* from crop c join ask a using (twin, track) where c.ord <= 2),
mid as (select twin, track, count(*) as votes, case when count(*) >= 2 then list_sort(list(s))[2] else min(s) end as s from few group by twin, track),
pick as (select m.twin, m.track, m.votes, m.s, min(f.ord) as chosen from mid m join few f on f.twin = m.twin and f.track = m.track and f.s = m.s group by all)"""


@query(f"""with {CROPS} select o.twin, o.track, coalesce(p.votes, 0) as votes, coalesce(p.chosen, 0) as chosen, round(coalesce(p.s, o.s), 6) as s,
  case when p.votes is null then o.verdict when p.chosen > 0 and f.fit > o.tau_fit then 'NOT_ENROLLED' when p.s <= 1 then 'PASS' when f.anomalous > 0.5 then 'NOT_ENROLLED' else 'DEFECT' end as verdict,
  case when p.votes is null then o.reason when p.chosen > 0 and f.fit > o.tau_fit then 'fit' when p.s > 1 and f.anomalous > 0.5 then 'coverage' end as reason
from one o left join pick p using (twin, track) left join few f on f.twin = p.twin and f.track = p.track and f.ord = p.chosen""")
def borderline_votes(spark, sf_dir):
    """Tracks whose first crop is a defect just over the limit are voted on, and the chosen crop is put to the gates again."""
    df = rows(spark, sf_dir)
    own = held_out(df)
    tau = own.groupBy("twin").agg((DEFAULT.tau_factor * F.max("d")).alias("tau"))
    d = own.join(tau, "twin").withColumn("track", F.floor(F.col("vec_id") / 40))
    at = stats.positions(d.withColumn("key", F.struct("twin", "track")), ["twin", "track"], F.col("vec_id"))
    crops = at.select(F.struct("twin", "track").alias("key"), F.col("_at").alias("order"), (F.col("d") / F.col("tau") * 1.4).alias("s"), F.col("d").alias("fit"), F.when(F.col("vec_id") % 11 == 0, 0.9).otherwise(0.1).alias("anomalous"), (0.9 * F.col("tau") / 1.4).alias("tau_fit"))
    said = F.split(gates.score_verdict(F.col("s"), F.col("anomalous")), ":")
    told = gates.revoted(stored(crops.withColumns({"verdict": said[0], "reason": F.nullif(said[1], F.lit(""))}), "crops"), "key")
    return told.select("key.twin", "key.track", F.col("votes").cast("long"), F.col("chosen").cast("long"), *r6("s"), "verdict", "reason")


RULED = """r as (select l_orderkey, l_linenumber, l_returnflag as g, case l_linenumber % 9 when 0 then 'NO_OBJECT' when 1 then 'MULTIPLE' else 'OK' end as sanity, 1 - l_discount::double as sim, 0.93::double as tau_id,
  l_extendedprice::double as area, l_discount::double as fill, l_tax::double as aspect, l_quantity::double / 100 as hu1, 1 - l_tax::double as solidity, l_quantity::double / 50 as fit, 0.9::double as tau_fit, l_extendedprice::double / 40000 as s, l_tax::double * 10 as anomalous from lineitem)"""


@query(f"""with {RULED}, m as (select g, avg(area) as ma, avg(fill) as fm, greatest(stddev_pop(fill), 0.04) as fs, avg(aspect) as am, greatest(stddev_pop(aspect), 0.04) as asd, avg(hu1) as hm, greatest(stddev_pop(hu1), 0.04 * avg(hu1)) as hs, avg(solidity) as sm, greatest(stddev_pop(solidity), 0.03) as ss from r group by g),
v as (select *, abs(fill - fm) <= 1.5 * fs and abs(aspect - am) <= 1.5 * asd and abs(hu1 - hm) <= 1.5 * hs and abs(solidity - sm) <= 1.5 * ss and area between ma / 2.5 and ma * 2.5 as shaped from r join m using (g))
select l_orderkey, l_linenumber, s, case when sanity <> 'OK' then 'REFRAME' when sim < tau_id then 'NOT_ENROLLED' when not shaped then 'NOT_ENROLLED' when fit > tau_fit then 'NOT_ENROLLED' when s <= 1 then 'PASS' when anomalous > 0.5 then 'NOT_ENROLLED' else 'DEFECT' end as verdict,
  case when sanity <> 'OK' then sanity when sim < tau_id then 'identity' when not shaped then 'shape' when fit > tau_fit then 'fit' when s <= 1 then null when anomalous > 0.5 then 'coverage' end as reason from v""")
def verdict_rules(spark, sf_dir):
    """Rows of lineitem as presentations: each rule speaks of some of them, and the first that does decides."""
    from dataclasses import replace

    from ..sources.shared import table

    shape = shapes(spark, sf_dir)
    c = lambda name: F.col(name).cast("double")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), "l_orderkey", "l_linenumber", c("l_extendedprice").alias("area"), c("l_discount").alias("fill"), c("l_tax").alias("aspect"), (c("l_quantity") / 100).alias("hu1"), (1 - c("l_tax")).alias("solidity"),
        F.when(F.col("l_linenumber") % 9 == 0, "NO_OBJECT").when(F.col("l_linenumber") % 9 == 1, "MULTIPLE").otherwise("OK").alias("sanity"), (1 - c("l_discount")).alias("sim"), F.lit(0.93).alias("tau_id"), (c("l_quantity") / 50).alias("fit"), F.lit(0.9).alias("tau_fit"), (c("l_extendedprice") / 40000).alias("s"), (c("l_tax") * 10).alias("anomalous"))
    ruled = gates.geometry_failures(facts, gates.geometry_model(shape, "g"), "g", replace(DEFAULT, k_geo=1.5)).withColumn("geometry_ok", F.size("failures") == 0)
    return gates.decided(ruled).select("l_orderkey", "l_linenumber", "s", "verdict", "reason")


@query("""with v as (select vec_id, label, unnest(embedding)::double as a, round(unnest(embedding)::double, 2) as b from embeddings),
one as (select vec_id, any_value(label) as label, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) as cosine, sqrt(sum((a - b) * (a - b))) / sqrt(sum(a * a)) as off, bool_and(isfinite(a) and isfinite(b)) as finite from v group by vec_id)
select label::bigint as twin, round(min(cosine), 6) as worst_cosine, round(avg(cosine), 6) as mean_cosine, round(max(off), 6) as worst_off, count(*) filter (not finite) as broken, count(*) as n from one group by label""")
def vector_parity(spark, sf_dir):
    """Each vector against the same to two decimals: the worst and the mean agreement of a part's vectors, and how many aren't finite."""
    x = rows(spark, sf_dir).select("twin", "id", F.explode("f").alias("a")).withColumn("b", F.round("a", 2))
    s = lambda p, q: F.sum(F.col(p) * F.col(q))
    one = x.groupBy("twin", "id").agg((s("a", "b") / F.sqrt(s("a", "a") * s("b", "b"))).alias("cosine"), (F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))) / F.sqrt(s("a", "a"))).alias("off"), F.min(gates.finite(F.col("a")) & gates.finite(F.col("b"))).alias("finite"))
    return one.groupBy("twin").agg(F.round(F.min("cosine"), 6).alias("worst_cosine"), F.round(F.avg("cosine"), 6).alias("mean_cosine"), F.round(F.max("off"), 6).alias("worst_off"), F.count_if(~F.col("finite")).alias("broken"), F.count("*").alias("n"))
