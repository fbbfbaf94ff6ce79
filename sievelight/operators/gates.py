"""Gates, thresholds and verdicts. NaN never passes a gate: Spark orders it above all numbers, so every test names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantiles, with_mad
from ..params import DEFAULT, Params


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def fit_passes(fit: Column, tau_fit: Column, params: Params = DEFAULT) -> Column:
    """No gate (null or NaN) passes; with a gate, a fit that isn't a number doesn't."""
    gate = tau_fit.isNotNull() & ~F.isnan(tau_fit)
    return ~gate | (finite(fit) & (fit <= tau_fit * F.sqrt(F.lit(params.sensitivity))))


def score_verdict(s: Column, anomalous: Column, params: Params = DEFAULT) -> Column:
    """verdict and reason of a score alone, as "VERDICT:reason"."""
    return F.when(~finite(s), "REFRAME:SCORE_FAILED").when(s <= 1, "PASS:").when(anomalous > params.coverage_cut, "NOT_ENROLLED:coverage").otherwise("DEFECT:")


def decided(rows: DataFrame, params: Params = DEFAULT, fit_gate: bool = True) -> DataFrame:
    """rows (sanity, sim, tau_id, geometry_ok, fit, tau_fit, s, anomalous) with verdict and reason: the first rule that speaks decides.
    fit_gate False is the written specification, which has no such rule."""
    identity = ~F.isnan("sim") & (F.col("sim") >= F.col("tau_id"))
    rule = F.when(F.col("sanity") != "OK", F.concat(F.lit("REFRAME:"), F.col("sanity"))).when(~F.coalesce(identity, F.lit(False)), "NOT_ENROLLED:identity").when(~F.col("geometry_ok"), "NOT_ENROLLED:shape")
    if fit_gate:
        rule = rule.when(~fit_passes(F.col("fit"), F.col("tau_fit"), params), "NOT_ENROLLED:fit")
    said = F.split(rule.otherwise(score_verdict(F.col("s"), F.col("anomalous"), params)), ":")
    return rows.withColumn("verdict", said[0]).withColumn("reason", F.nullif(said[1], F.lit("")))


def voted(crops: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """by, votes, s and chosen: the median of the first three crops' scores (order 0, 1, 2; missing ones null or NaN): of two the
    higher, of equal ones the earlier."""
    there = crops.where(finite(F.col("s")) & (F.col("order") <= 2)).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("s", "order"))).alias("l"))
    values = F.transform("l", lambda x: x["s"])
    mid = F.element_at(values, F.when(F.size("l") >= 2, 2).otherwise(1))
    first = F.array_min(F.transform(F.filter("l", lambda x: x["s"] == mid), lambda x: x["order"]))
    return there.select(by, F.size("l").alias("votes"), mid.alias("s"), first.alias("chosen"))


def revoted(crops: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """by, votes, chosen, s, verdict and reason of tracks' crops (by, order from 0, verdict and reason of the first, s, fit, tau_fit,
    anomalous). Only a first crop that is a defect just over the limit is voted on: the median of up to three scores counts, with the fit
    gate and the score rules of the crop that it came from; the first crop's identity and shape stay. Others keep what they have."""
    first = crops.where("order = 0").select(by, F.col("verdict").alias("first_verdict"), F.col("reason").alias("first_reason"), F.col("s").alias("first_s"), F.col("tau_fit").alias("first_fit"))
    asked = first.withColumn("asked", F.coalesce((F.col("first_verdict") == "DEFECT") & (F.col("first_s") > params.vote_from) & (F.col("first_s") <= params.vote_to) & ~F.isnan("first_s"), F.lit(False)))
    vote = voted(crops.join(asked.where("asked").select(by), by, "left_semi"), by, params)
    own = crops.select(by, F.col("order").alias("chosen"), "fit", "anomalous")
    told = asked.join(vote.join(own, [by, "chosen"]), by, "left")
    badly = F.col("asked") & (F.col("chosen") > 0) & ~fit_passes(F.col("fit"), F.col("first_fit"), params)
    said = F.split(F.when(badly, "NOT_ENROLLED:fit").otherwise(score_verdict(F.col("s"), F.col("anomalous"), params)), ":")
    pick = lambda new, old: F.when(F.col("asked"), new).otherwise(old)
    return told.select(by, F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("chosen", F.lit(0)).alias("chosen"), pick(F.col("s"), F.col("first_s")).alias("s"), pick(said[0], F.col("first_verdict")).alias("verdict"), pick(F.nullif(said[1], F.lit("")), F.col("first_reason")).alias("reason"))


def geometry_model(samples: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """by, mean_area, and mean and sigma (population, no smaller than its floor) of fill, aspect, hu1 and solidity."""
    floors = {"fill": F.lit(params.floor_fill), "aspect": F.lit(params.floor_aspect), "hu1": params.floor_hu1 * F.avg("hu1"), "solidity": F.lit(params.floor_solidity)}
    return samples.groupBy(by).agg(F.avg("area").alias("mean_area"), *(x for c, low in floors.items() for x in (F.avg(c).alias(f"{c}_mean"), F.greatest(F.stddev_pop(c), low).alias(f"{c}_sigma"))))


def geometry_failures(rows: DataFrame, model: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """rows with failures: names of the features outside their band, in the order fill, aspect, hu1, solidity, area. The model, a row a
    part, goes to the rows, which would else meet in as many tasks as there are parts."""
    out = [F.when(~F.coalesce(F.abs(F.col(c) - F.col(f"{c}_mean")) <= params.k_geo * F.col(f"{c}_sigma"), F.lit(False)), c) for c in ("fill", "aspect", "hu1", "solidity")]
    inside = F.col("area").between(F.col("mean_area") / params.area_factor, F.col("mean_area") * params.area_factor)
    return rows.join(F.broadcast(model), by).withColumn("failures", F.array_compact(F.array(*out, F.when(~F.coalesce(inside, F.lit(False)), "area")))).drop(*(c for c in model.columns if c != by))


def identity_threshold(positives: DataFrame, negatives: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """by, tau_id, rule, margin from positives (by, sim) and negatives (by, sim): midway between the low positives and the high
    negatives; without negatives a gap below the positives."""
    low = quantiles(positives, "sim", [by], [params.id_low], ["lo"])
    gap = with_mad(positives, "sim", [by], counted=True).select(by, F.greatest(F.lit(params.id_min_gap), params.mad_k * params.mad_scale * F.col("mad")).alias("gap"))
    high = quantiles(negatives, "sim", [by], [params.id_high], ["hi"])
    both = low.join(gap, by).join(high, by, "left")
    tau = F.when(F.col("hi").isNull(), F.col("lo") - F.col("gap")).otherwise((F.col("lo") + F.col("hi")) / 2)
    return both.select(by, tau.alias("tau_id"), F.when(F.col("hi").isNull(), "no-negatives").otherwise("midpoint").alias("rule"), (F.col("lo") - F.col("hi")).alias("margin"))


def fit_threshold(same: DataFrame, wrong: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """by, tau_fit and rule from same-part and wrong-object fits (by, fit), NaN left out."""
    known = lambda df: df.where(~F.isnan("fit"))
    hi = known(same).groupBy(by).agg(F.max("fit").alias("hi"))
    lo = known(wrong).groupBy(by).agg(F.min("fit").alias("lo"))
    rule = F.when(F.col("lo").isNull(), "lso").when(F.col("lo") <= F.col("hi"), "overlap").otherwise("midpoint")
    wide = params.fit_factor * F.col("hi")
    both = hi.join(lo, by, "left").withColumn("rule", rule)
    return both.select(by, F.when(F.col("rule") == "midpoint", F.least(wide, (F.col("hi") + F.col("lo")) / 2)).otherwise(wide).alias("tau_fit"), "rule")
