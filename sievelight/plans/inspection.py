"""Queries over feature vectors (embeddings): banks, thresholds, scores and verdicts. label is the part, vec_id % 5 the segment of time;
a vector of 64 is also a map of 4 x 4 patches of 4 numbers, whose inner four are covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats, vectors
from ..operators import coreset, gates, knn, maps, twin
from ..params import DEFAULT
from ..sources.shared import stored, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EMB = "emb as (select vec_id, label as twin, vec_id % 5 as seg, list_transform(embedding, lambda x : x::double) as f from embeddings)"
D2 = "list_reduce(list_transform(list_zip(a.f, b.f), lambda z : (z[1] - z[2]) * (z[1] - z[2])), lambda acc, v : acc + v, 0.0::double)"
DOT = "list_reduce(list_transform(list_zip(a.g, b.g), lambda z : z[1] * z[2]), lambda acc, v : acc + v, 0.0::double)"
UNIT = "unit as (select vec_id, twin, seg, list_transform(f, lambda x : x / n) as g from (select *, sqrt(list_reduce(list_transform(f, lambda x : x * x), lambda acc, v : acc + v, 0.0::double)) as n from emb))"
LSO = f"lso as (select a.twin, a.vec_id, sqrt(min({D2})) as d from emb a join emb b on a.twin = b.twin and a.seg <> b.seg group by a.twin, a.vec_id)"
POS = f"pos as (select a.twin, a.vec_id, max({DOT}) as sim from unit a join unit b on a.twin = b.twin and a.seg <> b.seg group by a.twin, a.vec_id)"
NEG = f"neg as (select b.twin, a.vec_id, max({DOT}) as sim from unit a join unit b on b.twin = (a.twin + 1) % 10 and a.seg <> b.seg group by b.twin, a.vec_id)"
WRONG = f"wrong as (select b.twin, a.vec_id, sqrt(min({D2})) as d from emb a join emb b on b.twin = (a.twin + 1) % 10 and a.seg <> b.seg group by b.twin, a.vec_id)"
PATCH = """patch as (select e.twin, e.vec_id as frame, t.p, t.p // 4 as r, t.p % 4 as c, f[t.p*4+1] as f1, f[t.p*4+2] as f2, f[t.p*4+3] as f3, f[t.p*4+4] as f4,
  t.p // 4 in (1, 2) and t.p % 4 in (1, 2) as in_core from emb e, (select unnest(range(16)) as p) t)"""
PD = """pd as (select a.frame, a.p, sqrt(min((a.f1-b.f1)*(a.f1-b.f1) + (a.f2-b.f2)*(a.f2-b.f2) + (a.f3-b.f3)*(a.f3-b.f3) + (a.f4-b.f4)*(a.f4-b.f4))) as d
  from patch a join patch b on a.twin = b.twin and a.frame <> b.frame group by a.frame, a.p),
dm as (select p.twin, p.frame, p.p, p.r, p.c, p.in_core, pd.d from patch p join pd using (frame, p)),
sm as (select x.twin, x.frame, x.p, x.r, x.c, x.in_core, x.d, avg(y.d) as sm from dm x join dm y on x.frame = y.frame and abs(x.r - y.r) <= 1 and abs(x.c - y.c) <= 1 group by all)"""
MAPS = f"with {EMB}, {PATCH}, {PD}"
TAU = "tau as (select twin, 1.4 * max(d) as tau from lso group by twin)"
IDT = "idt as (select p.twin, (p.lo + n.hi) / 2 as tau_id, p.lo - n.hi as margin from (select twin, quantile_cont(sim, 0.05) as lo from pos group by twin) p join (select twin, quantile_cont(sim, 0.99) as hi from neg group by twin) n using (twin))"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("twin"), (F.col("vec_id") % 5).alias("seg"), vectors.doubles(F.col("embedding")).alias("f"))


def presented(df: DataFrame) -> DataFrame:
    """Every row to the next part: a wrong object."""
    return df.withColumn("twin", (F.col("twin") + 1) % 10)


def unit(df: DataFrame) -> DataFrame:
    return df.withColumn("f", vectors.l2_normalized(F.col("f")))


def held_out(df: DataFrame) -> DataFrame:
    """twin, vec_id, d: distance of each row to the nearest of its part that isn't of its segment."""
    return knn.nearest(df, df, "twin", mask="seg").select(F.col("key").alias("twin"), F.col("id").alias("vec_id"), F.sqrt("best").alias("d"))


def sims(queries: DataFrame, bank: DataFrame) -> DataFrame:
    return knn.nearest(unit(queries), unit(bank), "twin", mask="seg", how="dot").select(F.col("key").alias("twin"), F.col("id").alias("vec_id"), F.col("best").alias("sim"))


def patch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with their sets and the distance to the nearest patch of another frame of their part."""
    frames = rows(spark, sf_dir).withColumnRenamed("id", "frame")
    patches = maps.exploded(frames, 4, 4, keep=("frame", "twin")).withColumn("id", F.col("frame") * 16 + F.col("p"))
    inner = F.col("r").isin(1, 2) & F.col("c").isin(1, 2)
    patches = stored(patches.withColumn("cov", F.when(inner, 1.0).otherwise(0.25)), "patches")
    near = knn.nearest(patches, patches, "twin", mask="frame").select("id", F.sqrt("best").alias("d"))
    return stored(maps.patch_sets(patches.join(near, "id")), "map")


def with_smooth(patches: DataFrame) -> DataFrame:
    return maps.with_smooth(patches)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"with {EMB} select a.vec_id, a.twin, round(sqrt(min({D2})), 6) as d from emb a join emb b on a.twin = b.twin and a.vec_id <> b.vec_id group by a.twin, a.vec_id")
def knn_min(spark, sf_dir):
    df = rows(spark, sf_dir)
    return knn.nearest(df, df, "twin", own=True).select(F.col("id").alias("vec_id"), F.col("key").alias("twin"), F.round(F.sqrt("best"), 6).alias("d"))


@query(f"with {EMB}, {LSO} select twin, vec_id, round(d, 6) as d from lso")
def knn_masked_lso(spark, sf_dir):
    return held_out(rows(spark, sf_dir)).select("twin", "vec_id", *r6("d"))


@query(f"with {EMB}, {LSO}, {TAU} select twin, round(tau, 6) as tau from tau")
def tau_teach(spark, sf_dir):
    return held_out(rows(spark, sf_dir)).groupBy("twin").agg(F.round(DEFAULT.tau_factor * F.max("d"), 6).alias("tau"))


@query(f"with {EMB}, {UNIT}, {POS} select twin, vec_id, round(sim, 6) as sim from pos")
def identity_positives(spark, sf_dir):
    df = rows(spark, sf_dir)
    return sims(df, df).select("twin", "vec_id", *r6("sim"))


@query(f"with {EMB}, {UNIT}, {POS}, {NEG}, {IDT} select twin, round(tau_id, 6) as tau_id, 'midpoint' as rule, round(margin, 6) as margin from idt")
def identity_threshold(spark, sf_dir):
    df = rows(spark, sf_dir)
    return gates.identity_threshold(sims(df, df), sims(presented(df), df), "twin").select("twin", *r6("tau_id"), "rule", *r6("margin"))


@query(f"""with {EMB}, {LSO}, {WRONG}, b as (select * from (select twin, max(d) as hi from lso group by twin) join (select twin, min(d) as lo from wrong group by twin) using (twin))
select twin, round(case when lo <= hi then 1.1 * hi else least(1.1 * hi, (hi + lo) / 2) end, 6) as tau_fit, case when lo <= hi then 'overlap' else 'midpoint' end as rule from b""")
def fit_threshold(spark, sf_dir):
    df = rows(spark, sf_dir)
    wrong = knn.nearest(presented(df), df, "twin", mask="seg").select(F.col("key").alias("twin"), F.sqrt("best").alias("fit"))
    return gates.fit_threshold(held_out(df).withColumnRenamed("d", "fit"), wrong, "twin").select("twin", *r6("tau_fit"), "rule")


@query(f"""with {EMB}, {UNIT}, {LSO}, {WRONG}, {POS}, {NEG}, {TAU}, {IDT}, shown as (
  select 'own' as shown, twin, vec_id, d, sim from lso join pos using (twin, vec_id) union all select 'wrong', twin, vec_id, d, sim from wrong join neg using (twin, vec_id))
select shown, twin, vec_id, round(d / tau, 6) as s, case when sim < tau_id then 'NOT_ENROLLED' when d / tau <= 1 then 'PASS' else 'DEFECT' end as verdict,
  case when sim < tau_id then 'identity' end as reason from shown join tau using (twin) join idt using (twin)""")
def verdicts(spark, sf_dir):
    """Every row shown to its own part and to a wrong one: PASS, DEFECT or NOT_ENROLLED, and how far above the limit."""
    df = rows(spark, sf_dir)
    own, wrong = held_out(df), knn.nearest(presented(df), df, "twin", mask="seg").select(F.col("key").alias("twin"), F.col("id").alias("vec_id"), F.sqrt("best").alias("d"))
    pos, neg = sims(df, df), sims(presented(df), df)
    tau = own.groupBy("twin").agg((DEFAULT.tau_factor * F.max("d")).alias("tau"))
    gate = gates.identity_threshold(pos, neg, "twin").select("twin", "tau_id")
    shown = own.join(pos, ["twin", "vec_id"]).withColumn("shown", F.lit("own")).unionByName(wrong.join(neg, ["twin", "vec_id"]).withColumn("shown", F.lit("wrong")))
    scored = shown.join(tau, "twin").join(gate, "twin").withColumns({"s": F.col("d") / F.col("tau"), "sanity": F.lit("OK"), "geometry_ok": F.lit(True), "fit": F.lit(None).cast("double"), "tau_fit": F.lit(None).cast("double"), "anomalous": F.lit(0.0)})
    return gates.decided(scored).select("shown", "twin", "vec_id", *r6("s"), "verdict", "reason")


@query(f"with {EMB}, {PATCH} select frame, p, r, c, [f1, f2, f3, f4] as f from patch")
def patch_explode(spark, sf_dir):
    return maps.exploded(rows(spark, sf_dir).withColumnRenamed("id", "frame"), 4, 4)


@query(f"with {EMB}, {PATCH} select frame, r, c, in_core, true as in_s, true as in_b from patch")
def patch_sets(spark, sf_dir):
    return patch_table(spark, sf_dir).select("frame", "r", "c", "in_core", "in_s", "in_b")


@query(f"""with {EMB}, {PATCH}, s as (select frame, sum(f1) as a, sum(f2) as b, sum(f3) as c, sum(f4) as d from patch where in_core group by frame)
select frame, round(a / sqrt(a*a+b*b+c*c+d*d), 6) as g1, round(b / sqrt(a*a+b*b+c*c+d*d), 6) as g2, round(c / sqrt(a*a+b*b+c*c+d*d), 6) as g3, round(d / sqrt(a*a+b*b+c*c+d*d), 6) as g4 from s""")
def global_descriptor(spark, sf_dir):
    frames = maps.exploded(rows(spark, sf_dir).withColumnRenamed("id", "frame"), 4, 4)
    core = frames.withColumn("in_core", F.col("r").isin(1, 2) & F.col("c").isin(1, 2))
    return maps.descriptors(core).select("frame", *(F.round(F.get("g", F.lit(k)), 6).alias(f"g{k + 1}") for k in range(4)))


@query(f"{MAPS} select frame, r, c, round(sm, 6) as sm from sm")
def smooth_masked(spark, sf_dir):
    return maps.smoothed(patch_table(spark, sf_dir)).select("frame", "r", "c", *r6("sm"))


CLAMP = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))


@query(f"{MAPS}, o(dr, dc) as (values {CLAMP}) select x.frame, x.r, x.c, round(avg(y.d), 6) as sm from dm x, o join dm y on x.frame = y.frame and y.r = least(3, greatest(0, x.r + dr)) and y.c = least(3, greatest(0, x.c + dc)) group by all")
def smooth_edge(spark, sf_dir):
    return maps.edge_mean(patch_table(spark, sf_dir), 4, 4).select("frame", "r", "c", *r6("sm"))


@query(f"""{MAPS} select frame, round(max(sm), 6) as raw, round(avg(d) filter (in_core), 6) as fit, cast(arg_min(p, (-sm, p)) // 4 as int) as peak_r, cast(arg_min(p, (-sm, p)) % 4 as int) as peak_c, count(*) filter (in_core) as n_core from sm group by frame""")
def frame_scores(spark, sf_dir):
    return maps.frame_scores(with_smooth(patch_table(spark, sf_dir))).select("frame", *r6("raw", "fit"), "peak_r", "peak_c", "n_core")


@query(f"{MAPS} select frame, round(max(d), 6) as raw from dm group by frame")
def frame_score_top1(spark, sf_dir):
    return maps.top_mean(with_smooth(patch_table(spark, sf_dir))).select("frame", *r6("raw"))


@query(f"{MAPS}, t as (select twin, quantile_cont(sm, 0.9) as tau from sm group by twin) select frame, round(count(*) filter (in_core and sm > tau) / count(*) filter (in_core), 6) as anomalous from sm join t using (twin) group by frame")
def anomalous_fraction(spark, sf_dir):
    patches = with_smooth(patch_table(spark, sf_dir))
    tau = patches.groupBy("twin").agg(F.percentile("sm", F.lit(0.9)).alias("tau"))
    return maps.frame_scores(patches.join(tau, "twin"), tau="tau").select("frame", *r6("anomalous"))


VOTE = """c as (select twin, vec_id // 30 as track, row_number() over (partition by twin, vec_id // 30 order by vec_id) - 1 as ord, d from lso),
top as (select * from c where ord <= 2), m as (select twin, track, count(*) as votes, case when count(*) >= 2 then list_sort(list(d))[2] else min(d) end as s from top group by all)"""


@query(f"with {EMB}, {LSO}, {VOTE} select m.twin, m.track, m.votes, round(m.s, 6) as s, min(ord) as chosen from m join top on m.twin = top.twin and m.track = top.track and m.s = top.d group by all")
def vote_median(spark, sf_dir):
    d = held_out(rows(spark, sf_dir)).withColumn("track", F.floor(F.col("vec_id") / 30))
    crops = d.withColumn("order", F.row_number().over(W.partitionBy("twin", "track").orderBy("vec_id")) - 1).withColumn("s", F.col("d")).withColumn("key", F.struct("twin", "track"))
    return gates.voted(crops, "key").select("key.twin", "key.track", F.col("votes").cast("long"), *r6("s"), F.col("chosen").cast("long"))


@query(f"""with {EMB}, {UNIT}, p as (select a.twin, a.vec_id, b.vec_id as view, {DOT} as sim from unit a join unit b on a.twin = b.twin and a.vec_id <> b.vec_id)
select twin, vec_id, k, view, round(sim, 6) as sim from (select *, row_number() over (partition by vec_id order by round(sim, 12) desc, view) as k from p) where k <= 3""")
def topk_views(spark, sf_dir):
    """The three views of its part most like each row."""
    u = unit(rows(spark, sf_dir))
    best = knn.most_alike(u, u, DEFAULT.top_k_views, "twin")
    return best.select(F.col("key").alias("twin"), F.col("id").alias("vec_id"), F.col("place").cast("long").alias("k"), F.col("other").alias("view"), F.round("sim", 6).alias("sim"))


def _coreset_sql(k: int) -> str:
    ctes = ["c0 as (select twin, min(vec_id) as id from emb group by twin)", f"m0 as (select b.twin, b.vec_id, {D2.replace('a.f', 'b.f').replace('list_zip(b.f, b.f)', 'list_zip(b.f, a.f)')} as gap from emb b join c0 using (twin) join emb a on a.vec_id = c0.id)"]
    out = ["select twin, 0 as step, id, cast(null as double) as gap from c0"]
    for i in range(1, k):
        ctes.append(f"c{i} as (select twin, arg_min(vec_id, (-gap, vec_id)) as id, max(gap) as gap from m{i - 1} group by twin)")
        ctes.append(f"m{i} as (select m.twin, m.vec_id, least(m.gap, {D2}) as gap from m{i - 1} m join emb a on a.vec_id = m.vec_id join c{i} c on c.twin = m.twin join emb b on b.vec_id = c.id)")
        out.append(f"select twin, {i}, id, round(gap, 6) from c{i}")
    return f"with {EMB}, " + ", ".join(ctes) + " " + " union all ".join(out)


@query(_coreset_sql(8))
def coreset_k8(spark, sf_dir):
    return coreset.k_centre(rows(spark, sf_dir), 8).select("twin", "step", "id", F.round("gap", 6).alias("gap"))


@query("""with x as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from embeddings), h as (select *, case when v = 0 then 1 else pow(2.0, greatest(floor(log2(abs(v))), -14) - 10) end as u from x)
select vec_id, i, round_even(v / u, 0) * u as h from h""")
def f16_round(spark, sf_dir):
    x = rows(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode("f").alias("i", "v"))
    return x.select("vec_id", F.col("i").cast("long"), vectors.half(F.col("v")).alias("h"))


@query(f"with {EMB}, {UNIT} select vec_id, i, round(x, 6) as x from (select vec_id, unnest(g) as x, unnest(range(len(g))) as i from unit)")
def l2_normalize(spark, sf_dir):
    return unit(rows(spark, sf_dir)).select(F.col("id").alias("vec_id"), F.posexplode("f").alias("i", "x")).select("vec_id", F.col("i").cast("long"), *r6("x"))


FRAME = f"loo as (select a.twin, a.vec_id % 10 as frame, a.vec_id, sqrt(min({D2})) as d from emb a join emb b on a.twin = b.twin and a.vec_id % 10 <> b.vec_id % 10 group by all), frame_max as (select twin, frame, max(d) as loo from loo group by all)"


def frame_loo(df: DataFrame) -> DataFrame:
    framed = df.withColumn("frame", F.col("id") % 10)
    near = knn.nearest(framed, framed, "twin", mask="frame")
    return near.groupBy(F.col("key").alias("twin"), (F.col("id") % 10).alias("frame")).agg(F.sqrt(F.max("best")).alias("loo"))


@query(f"with {EMB}, {FRAME} select twin, frame, round(loo, 6) as loo, round(max(loo) over (partition by twin), 6) as tau from frame_max")
def legacy_loo(spark, sf_dir):
    return frame_loo(rows(spark, sf_dir)).withColumn("tau", F.max("loo").over(W.partitionBy("twin"))).select("twin", "frame", *r6("loo", "tau"))


SHOWN = "shown as (select twin, vec_id, d, 0 as bad from lso union all select twin, vec_id, d, 1 from wrong)"
SWEEP = ", ".join(f"({round(0.7 + 0.05 * k, 2)})" for k in range(17))


def shown(df: DataFrame) -> DataFrame:
    wrong = knn.nearest(presented(df), df, "twin", mask="seg").select(F.col("key").alias("twin"), F.col("id").alias("vec_id"), F.sqrt("best").alias("d"))
    return held_out(df).withColumn("bad", F.lit(0)).unionByName(wrong.withColumn("bad", F.lit(1)))


@query(f"""with {EMB}, {LSO}, {WRONG}, {SHOWN} select twin, count(*) filter (bad = 1) as n_pos, count(*) filter (bad = 0) as n_neg,
  (select round(avg(case when p.d > n.d then 1.0 when p.d = n.d then 0.5 else 0.0 end), 6) from shown p, shown n where p.twin = s.twin and n.twin = s.twin and p.bad = 1 and n.bad = 0) as auroc from shown s group by twin""")
def auroc(spark, sf_dir):
    return stats.auroc(stored(shown(rows(spark, sf_dir)), "shown"), "d", "bad", ["twin"]).select("twin", "n_pos", "n_neg", *r6("auroc"))


@query(f"""with {EMB}, {LSO}, {WRONG}, {SHOWN}, base as (select twin, max(d) as hi from lso group by twin), m(margin) as (values {SWEEP})
select twin, margin::double as margin, count(*) filter (bad = 0 and d > hi * margin::double) as false_rejects, count(*) filter (bad = 1 and d <= hi * margin::double) as misses from shown join base using (twin), m group by all""")
def margin_sweep(spark, sf_dir):
    """False rejects and misses at each margin: what a margin counts is summed in one pass, margins being few and fixed."""
    known = stored(shown(rows(spark, sf_dir)), "shown")
    hi = known.where("bad = 0").groupBy("twin").agg(F.max("d").alias("hi"))
    margins = F.array(*(F.lit(round(0.7 + 0.05 * k, 2)) for k in range(17)))
    at = known.join(hi, "twin").select("twin", "bad", "d", "hi", F.explode(margins).alias("margin"))
    over = F.col("d") > F.col("hi") * F.col("margin")
    return at.groupBy("twin", "margin").agg(F.count_if((F.col("bad") == 0) & over).alias("false_rejects"), F.count_if((F.col("bad") == 1) & ~over).alias("misses"))


@query(f"""with {EMB}, {LSO}, {WRONG}, {SHOWN}, {TAU} select coalesce(cast(twin as varchar), 'ALL') as twin, count(*) filter (bad = 0) as n_good, count(*) filter (bad = 0 and d > tau) as rejected,
  count(*) filter (bad = 1) as n_wrong, count(*) filter (bad = 1 and d > tau) as caught from shown join tau using (twin) group by grouping sets ((twin), ())""")
def eval_rates(spark, sf_dir):
    """Rates of each part, and of all."""
    known = stored(shown(rows(spark, sf_dir)), "shown")
    tau = known.where("bad = 0").groupBy("twin").agg((DEFAULT.tau_factor * F.max("d")).alias("tau"))
    over = F.col("d") > F.col("tau")
    counts = [F.count_if(F.col("bad") == 0).alias("n_good"), F.count_if((F.col("bad") == 0) & over).alias("rejected"), F.count_if(F.col("bad") == 1).alias("n_wrong"), F.count_if((F.col("bad") == 1) & over).alias("caught")]
    return known.join(tau, "twin").rollup(F.col("twin").cast("string").alias("twin")).agg(*counts).withColumn("twin", F.coalesce("twin", F.lit("ALL")))


#: The bounds by halving intervals 50 times, the tails summed term by term.
TAIL = "(select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mid) + (n - i) * ln(1 - mid))) from (select unnest(range({a}, {b})) as i))"


@query(f"""with recursive {EMB}, {LSO}, {WRONG}, {SHOWN}, {TAU}, e as (select coalesce(cast(twin as varchar), 'ALL') as twin, count(*) filter (bad = 1) as n, count(*) filter (bad = 1 and d > tau) as k from shown join tau using (twin) group by grouping sets ((twin), ())),
lo as (select twin, n, k, 0.0::double as a, 1.0::double as b, 0 as step from e where k > 0 union all select twin, n, k, if(t < 0.025, mid, a), if(t < 0.025, b, mid), step + 1 from (select *, (a + b) / 2 as mid, {TAIL.format(a='k', b='n + 1').replace('mid', '((a + b) / 2)')} as t from lo where step < 50)),
hi as (select twin, n, k, 0.0::double as a, 1.0::double as b, 0 as step from e where k < n union all select twin, n, k, if(t > 0.025, mid, a), if(t > 0.025, b, mid), step + 1 from (select *, (a + b) / 2 as mid, {TAIL.format(a='0', b='k + 1').replace('mid', '((a + b) / 2)')} as t from hi where step < 50))
select e.twin, e.n as n_wrong, e.k as caught, coalesce(round((lo.a + lo.b) / 2, 9), 0) as low, coalesce(round((hi.a + hi.b) / 2, 9), 1) as high from e left join lo on lo.twin = e.twin and lo.step = 50 left join hi on hi.twin = e.twin and hi.step = 50""")
def rate_bounds(spark, sf_dir):
    """The exact 95 % interval of each part's rate of wrong objects caught."""
    e = eval_rates(spark, sf_dir)
    return e.select("twin", "n_wrong", "caught", stats.clopper_pearson(F.col("caught"), F.col("n_wrong"), DEFAULT.confidence).alias("ci")).select("twin", "n_wrong", "caught", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"))


@query(f"with {EMB}, {WRONG} select twin, round(min(d), 6) as nearest, count(*) as n from wrong group by twin")
def fit_negatives(spark, sf_dir):
    df = rows(spark, sf_dir)
    wrong = knn.nearest(presented(df), df, "twin", mask="seg")
    return wrong.groupBy(F.col("key").alias("twin")).agg(F.round(F.sqrt(F.min("best")), 6).alias("nearest"), F.count("*").alias("n"))


@query("select label::bigint as twin, round(corr_sum / sqrt(aa * bb), 6) as cosine, round(sqrt(dd) / sqrt(aa), 6) as relative from (select label, sum(a * b) as corr_sum, sum(a * a) as aa, sum(b * b) as bb, sum((a - b) * (a - b)) as dd from (select label, v as a, round(v, 2) as b from (select label, unnest(embedding)::double as v from embeddings)) group by label)")
def parity(spark, sf_dir):
    """Vectors against the same to two decimals: cosine and relative error."""
    x = rows(spark, sf_dir).select("twin", F.explode("f").alias("a")).withColumn("b", F.round("a", 2))
    s = x.groupBy("twin").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("dd"))
    return s.select("twin", F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 6).alias("cosine"), F.round(F.sqrt("dd") / F.sqrt("aa"), 6).alias("relative"))


def _half(x: str) -> str:
    return f"case when {x} = 0 then {x} else round_even({x} / pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10) end"


def _keyframes_sql(k: int) -> str:
    gap = "1 - (x.g1*y.g1 + x.g2*y.g2 + x.g3*y.g3 + x.g4*y.g4)"
    ctes = ["c0 as (select twin, arg_min(frame, (-sharp, frame)) as frame from desc_ group by twin)", f"m0 as (select x.twin, x.frame, {gap} as gap from desc_ x join c0 using (twin) join desc_ y on y.frame = c0.frame)"]
    for i in range(1, k):
        ctes.append(f"c{i} as (select twin, arg_min(frame, (-gap, frame)) as frame from m{i - 1} where {' and '.join(f'frame not in (select frame from c{j})' for j in range(i))} group by twin)")
        ctes.append(f"m{i} as (select x.twin, x.frame, least(m.gap, {gap}) as gap from m{i - 1} m join desc_ x using (twin, frame) join c{i} c on c.twin = m.twin join desc_ y on y.frame = c.frame)")
    return ", ".join(ctes) + ", kf as (" + " union all ".join(f"select twin, frame from c{i}" for i in range(k)) + ")"


def _map_sql(name: str, source: str, tau: str | None) -> str:
    """Smoothed distances of patches with d, and a frame's scores."""
    over = ", count(*) filter (in_core and sm > tau) / count(*) filter (in_core) as anomalous" if tau else ""
    return f"""{name}_sm as (select x.twin, x.frame, x.p, x.in_core, x.d, avg(y.d) as sm from {source} x join {source} y on x.frame = y.frame and abs(x.r - y.r) <= 1 and abs(x.c - y.c) <= 1 group by all),
{name} as (select twin, frame, max(sm) as raw, avg(d) filter (in_core) as fit, cast(arg_min(p, (-sm, p)) // 4 as int) as peak_r, cast(arg_min(p, (-sm, p)) % 4 as int) as peak_c{over} from {name}_sm {tau or ''} group by twin, frame)"""


NEAREST = "sqrt(min((a.f1-b.f1)*(a.f1-b.f1) + (a.f2-b.f2)*(a.f2-b.f2) + (a.f3-b.f3)*(a.f3-b.f3) + (a.f4-b.f4)*(a.f4-b.f4))) as d"
TEACH = f"""with {EMB}, {PATCH}, sharp as (select twin, vec_id as frame, list_reduce(list_transform(f, lambda x : x * x), lambda acc, v : acc + v, 0.0::double) as sharp from emb),
kept as (select s.twin, frame, sharp from sharp s join (select twin, quantile_cont(sharp, 0.4) as cut from sharp group by twin) using (twin) where sharp >= cut),
seg as (select twin, frame, sharp, greatest(0, least(4, floor(5 * (frame - t0) * 100 / ((t1 - t0) * 100 + 1e-9)))) as seg from kept join (select twin, min(frame) as t0, max(frame) as t1 from kept group by twin) using (twin)),
raw_ as (select twin, frame, sum(f1) as a, sum(f2) as b, sum(f3) as c, sum(f4) as d from patch where in_core group by twin, frame),
norm as (select twin, frame, a / n as g1, b / n as g2, c / n as g3, d / n as g4 from (select *, sqrt(a*a + b*b + c*c + d*d) as n from raw_)),
desc_ as (select n.*, seg, sharp from norm n join seg using (twin, frame)), {_keyframes_sql(8)},
globs as (select twin, frame, seg, {", ".join(f"{_half(f'g{k}')} as g{k}" for k in (1, 2, 3, 4))} from desc_ join kf using (twin, frame)),
bank as (select p.twin, p.frame, p.p, p.r, p.c, p.in_core, seg, {", ".join(f"{_half(f'f{k}')} as f{k}" for k in (1, 2, 3, 4))} from patch p join kf using (twin, frame) join seg using (twin, frame)),
ld as (select a.twin, a.frame, a.p, a.r, a.c, a.in_core, {NEAREST} from bank a join bank b on a.twin = b.twin and a.seg <> b.seg group by all), {_map_sql("lso_", "ld", None)},
pos as (select a.twin, a.frame, max(a.g1*b.g1 + a.g2*b.g2 + a.g3*b.g3 + a.g4*b.g4) as sim from globs a join globs b on a.twin = b.twin and a.seg <> b.seg group by all),
pm as (select twin, median(sim) as med, quantile_cont(sim, 0.05) as lo from pos group by twin), idt as (select twin, lo - greatest(0.02, 3 * 1.4826 * median(abs(sim - med))) as tau_id from pos join pm using (twin) group by twin, lo),
lim as (select twin, 1.4 * max(raw) as tau, 1.1 * max(fit) as tau_fit from lso_ group by twin),
seen_ as (select twin, frame as src, frame * 2 as frame from norm union all select (twin + 1) % 10, frame, frame * 2 + 1 from norm),
sp as (select s.twin, s.frame, p.p, p.r, p.c, p.in_core, f1, f2, f3, f4 from seen_ s join patch p on p.frame = s.src),
sd as (select a.twin, a.frame, a.p, a.r, a.c, a.in_core, {NEAREST} from sp a join bank b on a.twin = b.twin group by all), {_map_sql("sc", "sd", "join lim using (twin)")},
sim as (select s.twin, s.frame, max(a.g1*b.g1 + a.g2*b.g2 + a.g3*b.g3 + a.g4*b.g4) as sim from seen_ s join norm a on a.frame = s.src join globs b on b.twin = s.twin group by all),
j as (select *, raw / tau as s from sc join sim using (twin, frame) join lim using (twin) join idt using (twin))
select twin, frame, case when not sim >= tau_id then 'NOT_ENROLLED' when fit > tau_fit then 'NOT_ENROLLED' when s <= 1 then 'PASS' when anomalous > 0.5 then 'NOT_ENROLLED' else 'DEFECT' end as verdict,
  case when not sim >= tau_id then 'identity' when fit > tau_fit then 'fit' when s <= 1 then null when anomalous > 0.5 then 'coverage' end as reason,
  round(s, 5) as s, round(sim, 5) as sim, round(fit, 5) as fit, peak_r, peak_c, round(anomalous, 5) as anomalous from j"""


@query(TEACH)
def teach_and_judge(spark, sf_dir):
    """Each part taught from all its frames as maps, and all frames shown to their own part and to the next."""
    cov = F.array(*(F.lit(1.0 if r in (1, 2) and c in (1, 2) else 0.25) for r in range(4) for c in range(4)))
    frames = rows(spark, sf_dir).select("twin", F.col("id").alias("frame"), (F.col("id") * 100).alias("t_ms"), F.lit("OK").alias("sanity"), F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x).alias("sharpness"), "f", cov.alias("cov"))
    taught = twin.teach(frames, twin.Grid(4, 4, 4), 8)
    own, wrong = frames.withColumn("frame", F.col("frame") * 2), frames.withColumn("frame", F.col("frame") * 2 + 1).withColumn("twin", (F.col("twin") + 1) % 10)
    out = twin.judge(taught, own.unionByName(wrong), twin.Grid(4, 4, 4))
    return out.select("twin", "frame", "verdict", "reason", *(F.round(c, 5).alias(c) for c in ("s", "sim", "fit")), "peak_r", "peak_c", F.round("anomalous", 5).alias("anomalous"))
