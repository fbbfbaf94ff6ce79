"""Teaching a part from good frames, and judging presentations against it: whole queries made of the operators beside it.

Tables: frames (twin, frame, t_ms, sanity, sharpness, f: a row-major map of gh x gw patches of dim numbers, cov: as many, and where
shapes are known area, fill, aspect, hu1 and solidity). Everything is by twin, so many parts are taught in one go; one that can't be
taught has a status instead of thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats, vectors
from ..params import DEFAULT, Params
from ..sources.shared import stored
from . import coreset, gates, knn, maps, telemetry

SHAPE = ("area", "fill", "aspect", "hu1", "solidity")


@dataclass(frozen=True)
class Grid:
    gh: int
    gw: int
    dim: int


@dataclass(frozen=True)
class Taught:
    """bank (twin, id, frame, src, seg, f), globals (twin, frame, src, seg, g), views (the keyframes' patches), lso (twin, frame and
    scores of each view against what its segment left out), positives (twin, sim), negatives (twin, sim), limits (twin, status, tau,
    tau_id, tau_fit, and how many frames, keyframes and rows there were) and, where shapes are known, geometry. src is the frame that a
    view was taken from; it differs from frame only in turned views."""

    bank: DataFrame
    globals: DataFrame
    views: DataFrame
    positives: DataFrame
    limits: DataFrame
    geometry: DataFrame | None
    lso: DataFrame
    negatives: DataFrame


def patches_of(frames: DataFrame, grid: Grid, params: Params = DEFAULT) -> DataFrame:
    """Patches of frames (twin, frame, ...) with cov, their sets and an id."""
    out = maps.exploded(frames, grid.gw, grid.dim, keep=("twin", "frame", "cov")).withColumn("cov", F.element_at("cov", F.col("p") + 1))
    return maps.patch_sets(out.withColumn("id", F.col("frame") * (grid.gh * grid.gw) + F.col("p")), params)


def _rounded(patches: DataFrame) -> DataFrame:
    return patches.withColumn("f", F.transform("f", vectors.half))


def _cored(params: Params) -> object:
    return F.exists("cov", lambda c: c >= params.core_threshold)


def accepted(frames: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Sane frames that are sharp enough, with the segment of time that each lies in."""
    sane = frames.where("sanity = 'OK'").where(_cored(params))
    cut = stats.quantiles(sane, "sharpness", ["twin"], [params.keep_percentile], ["_cut"])
    sharp = sane.join(cut, "twin").where("sharpness >= _cut").drop("_cut")
    return telemetry.segments(sharp, "twin", params)


def scored(patches: DataFrame, bank: DataFrame, mask: str | None) -> DataFrame:
    """frame, raw, raw_top, fit and peaks of patches against their twin's bank: of those in S, which scores are made of."""
    return both_scores(stored(smoothed(patches, bank, "twin", mask), "smoothed"))


def smoothed(patches: DataFrame, bank: DataFrame, key: str, mask: str | None = None) -> DataFrame:
    """patches with d, of those in S to the bank rows of their key, and sm."""
    near = knn.nearest(patches.where("in_s"), bank, key, mask=mask).select("id", F.sqrt("best").alias("d"))
    return maps.with_smooth(patches.join(near, "id", "left"))


def both_scores(patches: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """frame_scores of patches (with d and sm), and raw_top, the score by the other rule."""
    top = maps.top_mean(patches, params).withColumnRenamed("raw", "raw_top")
    return maps.frame_scores(patches, params).join(top, "frame", "left")


def banked(pooled: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The rows of pooled (twin, id, f, ...) that banks keep: the farthest of each other, as many as their number asks for; the first is
    the one with the lowest id. Where all are kept nothing is compared."""
    sizes = pooled.groupBy("twin").agg(F.count("*").alias("_n")).withColumn("_k", coreset.bank_rows(F.col("_n"), params.bank_ratio, params.bank_min, params.bank_max))
    sized = pooled.join(sizes, "twin")
    thin = sized.where("_k < _n")
    if not thin.limit(1).count():
        return pooled
    chosen = coreset.k_centre(thin, "_k").select("twin", "id")
    return sized.where("_k >= _n").drop("_n", "_k").unionByName(thin.drop("_n", "_k").join(chosen, ["twin", "id"], "left_semi"))


def teach(frames: DataFrame, grid: Grid, keyframes: int | None = None, params: Params = DEFAULT, negatives: DataFrame | None = None, turned: DataFrame | None = None) -> Taught:
    """Teach every twin of frames; frame ids are unique over twins and in order of time. keyframes: at most so many (k_max otherwise).
    negatives (twin, id, g): descriptors of other objects. turned (frame, turn from 1 to 3, f, cov): further views of frames, of which
    those of keyframes join the bank (after the frame's own rows) and are held out with their frame; frames of a part that has none are
    taught as they are."""
    kept = stored(accepted(frames, params), "accepted")
    patches = stored(patches_of(kept, grid, params).join(kept.select("frame", "seg"), "frame"), "patches")
    described = maps.descriptors(patches, ("twin", "frame", "seg")).join(kept.select("frame", "sharpness"), "frame")
    rows = described.select("twin", F.col("frame").alias("id"), F.col("g").alias("f"), "sharpness")
    order = coreset.k_centre(rows, keyframes or params.k_max, how="dot", first=F.col("sharpness"), least=params.k_min, eps=params.kc_eps)
    chosen = stored(order.select(F.col("id").alias("frame"), "step"), "keyframes")
    described = described.withColumn("src", F.col("frame")).join(chosen, "frame")
    own = patches.withColumn("src", F.col("frame")).join(chosen, "frame").withColumn("turn", F.lit(0))
    if turned is not None:
        of = kept.select("twin", "frame", "seg").join(chosen, "frame").join(turned, "frame").withColumns({"src": F.col("frame"), "frame": F.col("frame") * 4 + F.col("turn")})
        more = stored(patches_of(of.select("twin", "frame", "f", "cov"), grid, params).join(of.select("frame", "src", "seg", "step", "turn"), "frame"), "turned")
        own = own.withColumn("frame", F.col("frame") * 4).unionByName(more, allowMissingColumns=True)
        described = described.withColumn("frame", F.col("frame") * 4).unionByName(maps.descriptors(more, ("twin", "frame", "seg", "src")), allowMissingColumns=True)
    globals_ = stored(described.select("twin", "frame", "src", "seg", F.transform("g", vectors.half).alias("g")), "globals")
    own = stored(own.withColumn("id", (F.col("step") * 4 + F.col("turn")) * (grid.gh * grid.gw) + F.col("p")), "own")
    pooled = stored(own.where("in_b").select("twin", "id", "frame", "src", "seg", "f"), "pooled")
    bank = stored(_rounded(banked(pooled, params)), "bank")
    # frames are told apart by id again: ids of rows only count within their twin
    views = stored(_rounded(own.withColumn("id", F.col("frame") * (grid.gh * grid.gw) + F.col("p"))), "views")
    used = globals_.groupBy("twin").agg(F.countDistinct("seg").alias("segments_used"), F.countDistinct("src").alias("keyframes"))
    held = used.select("twin", (F.col("segments_used") < 2).alias("_by_frame"))
    # where the keyframes lie in one segment only, each frame is held out instead
    masked = lambda df: df.join(held, "twin").withColumn("held", F.when(F.col("_by_frame"), F.col("src")).otherwise(F.col("seg")))
    reached = masked(bank).groupBy("twin").agg(F.countDistinct("held").alias("_kinds"), F.min("held").alias("_only"))
    lso = masked(views).select("twin", "frame", "held").distinct().join(reached, "twin").where("_kinds > 1 or _only <> held").select("twin", "frame")
    lso = stored(scored(masked(views), masked(bank), "held").join(lso, "frame"), "lso")
    g = masked(globals_).select("twin", F.col("frame").alias("id"), "held", F.col("g").alias("f"))
    pos = stored(knn.nearest(g, g, "twin", mask="held", how="dot").select(F.col("key").alias("twin"), F.col("best").alias("sim")), "positives")
    neg = pos.where("false")
    if negatives is not None:
        others = negatives.select("twin", F.col("id").cast("long"), F.transform("g", vectors.half).alias("f"))
        neg = knn.nearest(others, g.select("twin", "id", "f"), "twin", how="dot").select(F.col("key").alias("twin"), F.col("best").alias("sim"))
    tau_id = gates.identity_threshold(pos, neg, "twin", params).select("twin", "tau_id", F.col("rule").alias("tau_id_rule"), "margin")
    tau_fit = gates.fit_threshold(lso.select("twin", "fit"), lso.select("twin", "fit").limit(0), "twin", params).select("twin", "tau_fit")

    tau = lso.groupBy("twin").agg((params.tau_factor * F.when(F.min(gates.finite(F.col("raw"))), F.max("raw"))).alias("tau"))
    seen = frames.groupBy("twin").agg(F.count("*").alias("seen"), F.count_if((F.col("sanity") == "OK") & _cored(params)).alias("accepted"))
    counts = kept.groupBy("twin").agg(F.count("*").alias("kept"))
    sizes = pooled.groupBy("twin").agg(F.count("*").alias("pooled_rows")).join(bank.groupBy("twin").agg(F.count("*").alias("bank_rows")), "twin")
    status = F.when(F.coalesce("kept", F.lit(0)) < params.min_kept, "NOT_ENOUGH_FRAMES").when(F.coalesce("keyframes", F.lit(0)) < 2, "TOO_FEW_KEYFRAMES").when(~F.coalesce(F.col("tau") > 0, F.lit(False)), "NO_LSO").otherwise("OK")
    limits = seen
    for more in (counts, used, sizes, tau, tau_id, tau_fit):
        limits = limits.join(more, "twin", "left")
    geometry = stored(gates.geometry_model(kept, "twin", params), "geometry") if set(SHAPE) <= set(frames.columns) else None
    return Taught(bank, globals_, views, pos, stored(limits.withColumn("status", status), "limits"), geometry, lso, neg)


def similarity(taught: Taught, patches: DataFrame) -> DataFrame:
    """frame and sim: the largest similarity of each presentation's descriptor to its twin's."""
    g = maps.descriptors(patches, ("twin", "frame")).select("twin", F.col("frame").alias("id"), F.col("g").alias("f"))
    known = taught.globals.select("twin", F.col("frame").alias("id"), F.col("g").alias("f"))
    return knn.nearest(g, known, "twin", how="dot").select(F.col("id").alias("frame"), F.col("best").alias("sim"))


def most_alike_views(taught: Taught, patches: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """frame, place and view: the keyframes most like each presentation."""
    g = maps.descriptors(patches, ("twin", "frame")).select("twin", F.col("frame").alias("id"), F.col("g").alias("f"))
    known = taught.globals.select("twin", F.col("frame").alias("id"), F.col("g").alias("f"))
    return knn.most_alike(g, known, params.top_k_views, "twin", mask=None).select(F.col("id").alias("frame"), "place", F.col("other").alias("view"))


def compared(taught: Taught, patches: DataFrame, params: Params = DEFAULT, views_only: bool = False) -> DataFrame:
    """patches of presentations with d and sm: against the bank, or only against the keyframes most like each presentation."""
    if not views_only:
        return smoothed(patches, taught.bank, "twin")
    own = taught.views.where("in_b").select(F.col("frame").alias("view"), "id", "f")
    bank = most_alike_views(taught, patches, params).join(own, "view").select(F.col("frame").alias("key"), "id", "f")
    return smoothed(patches.withColumn("key", F.col("frame")), bank, "key").drop("key")


def judge(taught: Taught, shown: DataFrame, grid: Grid, params: Params = DEFAULT, fit_gate: bool = True, views_only: bool = False) -> DataFrame:
    """frame, twin, verdict, reason, s, raw, sim, fit, peaks and share of anomalous patches of presentations (twin, frame, sanity, f, cov,
    and shapes where these were taught). views_only compares each with the patches of the keyframes most like it, not with the bank."""
    shown = shown.withColumn("sanity", F.when((F.col("sanity") == "OK") & ~_cored(params), "NO_CORE").otherwise(F.col("sanity")))
    patches = stored(patches_of(shown, grid, params), "shown")
    scores = maps.frame_scores(compared(taught, patches, params, views_only).join(taught.limits.select("twin", "tau"), "twin"), params, tau="tau")
    shapes = ["frame", *SHAPE] if taught.geometry is not None else ["frame"]
    rows = shown.select("twin", "sanity", *shapes).join(taught.limits.where("status = 'OK'"), "twin").join(scores, "frame", "left").join(similarity(taught, patches), "frame", "left")
    rows = rows.withColumn("s", F.col("raw") / (F.col("tau") * params.sensitivity)).withColumn("area_pct", 100 * F.col("anomalous"))
    if taught.geometry is not None:
        rows = gates.geometry_failures(rows, taught.geometry, "twin", params).withColumn("geometry_ok", F.size("failures") == 0)
    else:
        rows = rows.withColumns({"geometry_ok": F.lit(True), "failures": F.array().cast("array<string>")})
    return gates.decided(rows, params, fit_gate).select("twin", "frame", "verdict", "reason", "s", "raw", "sim", "fit", "peak_r", "peak_c", "anomalous", "area_pct", "failures")


def calibrated(limits: DataFrame, samples: DataFrame, params: Params = DEFAULT, positives: DataFrame | None = None, negatives: DataFrame | None = None) -> DataFrame:
    """limits with tau raised to the largest raw of valid samples (twin, raw, id_ok), n of them, the largest (cal_max) and the rate that
    they bound (alpha).

    Where samples have sanity, sim and geo_ok too: valid ones are sane and pass both gates, counts and upper bounds of each gate are
    added, and with the taught positives tau_id is derived again from these and the sane samples' similarities.
    """
    whole = {"sanity", "sim", "geo_ok"} <= set(samples.columns)
    sane = (F.col("sanity") == "OK") if whole else F.lit(True)
    valid = sane & F.col("id_ok") & (F.col("geo_ok") if whole else F.lit(True)) & gates.finite(F.col("raw"))
    good = samples.groupBy("twin").agg(F.max(F.when(valid, F.col("raw"))).alias("cal_max"), F.count_if(valid).alias("n"), *([F.count("*").alias("n_seen"), F.count_if(sane).alias("n_sane"), F.count_if(sane & F.col("id_ok")).alias("n_id"), F.count_if(sane & F.col("geo_ok")).alias("n_geo")] if whole else []))
    out = limits.join(good, "twin", "left").withColumn("tau", F.greatest("tau", "cal_max")).withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("alpha", F.when(F.col("n") > 0, stats.order_alpha(params.confidence, F.col("n"))))
    if whole:
        for k, n in (("n_sane", "n_seen"), ("n_id", "n_sane"), ("n_geo", "n_sane")):
            out = out.withColumn(f"{k}_upper", stats.clopper_pearson_upper(F.coalesce(k, F.lit(0)), F.coalesce(n, F.lit(0)), params.confidence))
        if positives is not None:
            pooled = positives.select("twin", "sim").unionByName(samples.where(sane).select("twin", "sim"))
            again = gates.identity_threshold(pooled, pooled.limit(0) if negatives is None else negatives, "twin", params)
            out = out.drop("tau_id", "tau_id_rule", "margin").join(again.select("twin", "tau_id", F.col("rule").alias("tau_id_rule"), "margin"), "twin", "left")
    return out


def with_negatives(limits: DataFrame, positives: DataFrame, negatives: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """limits with tau_id from the taught positives and more negatives (twin, sim); a certificate no longer holds then."""
    again = gates.identity_threshold(positives, negatives, "twin", params).select("twin", "tau_id", F.col("rule").alias("tau_id_rule"), "margin")
    kept = [c for c in limits.columns if c not in ("tau_id", "tau_id_rule", "margin", "cal_max", "n", "alpha") and not c.startswith("n_")]
    return limits.select(*kept).join(again, "twin", "left")


def ranked_variants(results: DataFrame, last: str = "variant") -> DataFrame:
    """The variant that wins: by AUROC against defects, then against wrong objects, fewest settings that aren't defaults, first by last."""
    order = (F.desc("auroc_defect"), F.desc("auroc_identity"), F.asc("changes"), F.asc(last))
    return results.withColumn("place", F.row_number().over(W.partitionBy("study").orderBy(*order)))


def best_orientation(rows: DataFrame, by: str, metric: str) -> DataFrame:
    """Of each item's rows (by, orientation, metric) the one with the lowest metric; of equal ones the first orientation, NaN last."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.isnan(metric), metric, "orientation"))
    return rows.withColumn("_k", place).where("_k = 1").drop("_k")
