"""Rules over records: which frames and views are kept, how evaluations are summed up, and small numbers about a session."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats
from ..params import DEFAULT, Params
from .telemetry import folded


def votable(verdict: Column, s: Column, params: Params = DEFAULT) -> Column:
    """Whether more crops are asked for: a defect just over the limit."""
    return (verdict == "DEFECT") & ~F.isnan(s) & (s > params.vote_from) & (s <= params.vote_to)


def certified(tau: Column, sensitivity: Column, cal_max: Column) -> Column:
    """Whether a certificate still holds: no good sample lies above the limit in force."""
    return cal_max.isNull() | (tau * sensitivity >= cal_max)


def inside_border(p: Column, gh: int, gw: int, border: int) -> Column:
    """Whether a patch lies that far from the rim of its grid."""
    r, c = F.floor(p / gw), p % gw
    return r.between(border, gh - 1 - border) & c.between(border, gw - 1 - border)


def even_subsample(rows: DataFrame, by: str, order: Column, most: int = 40) -> DataFrame:
    """At most `most` rows of each group, evenly spaced in order, the first and the last among them. Positions are counted from ranges of
    the order, not from windows over whole groups."""
    at = stats.positions(rows, [by], order)
    n = at.groupBy(by).agg(F.count("*").alias("_n"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / (most - 1)))
    return at.join(n, by).where((F.col("_n") <= most) | F.array_contains(wanted, F.col("_at"))).drop("_n", "_at")


def downsampled(rows: DataFrame, by: str, params: Params = DEFAULT) -> DataFrame:
    """rows (by, t_ms, ...) that come downsample_ms or more after the last one kept."""

    def step(last: int | None, row) -> tuple[int | None, bool]:
        keep = last is None or row.t_ms - last >= params.downsample_ms
        return (row.t_ms if keep else last), keep

    return folded(rows, by, ["t_ms"], "_kept boolean", None, step, spread=True).where("_kept").drop("_kept")


def novel_views(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows (by, theta, size, area, ...) unlike all views kept before: fixed values, 15 degrees of an axis, 12 % size, 15 % area."""

    def step(views: tuple, row) -> tuple[tuple, bool]:
        def like(v: tuple) -> bool:
            off = abs(row.theta - v[0]) % np.pi
            return min(off, np.pi - off) <= np.radians(15) and abs(row.size - v[1]) <= 0.12 * v[1] and abs(row.area - v[2]) <= 0.15 * v[2]

        new = not any(map(like, views))
        return ((*views, (row.theta, row.size, row.area)) if new else views), new

    return folded(rows, by, order, "_new boolean", (), step).where("_new").drop("_new")


def outliers(scores: DataFrame, by: str, order: str, score: str, params: Params = DEFAULT, share: float = 0.2, least: int = 6) -> DataFrame:
    """scores (by, order, score) that lie over the robust limit, the worst first, a share of the group at most; none in small groups."""
    limits = stats.with_mad(scores, score, [by])
    n = scores.groupBy(by).agg(F.count("*").alias("_n"))
    spread = params.mad_scale * F.col("mad")
    over = scores.join(limits, by).join(n, by).where((F.col("_n") >= least) & (F.col(score) > F.col("median") + params.mad_k * F.when(spread == 0, 1e-9).otherwise(spread)))
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), order))
    return over.withColumn("place", place).where(F.col("place") <= F.floor(share * F.col("_n"))).select(by, order, score, "place")


def localised(rows: DataFrame, slack: float = 0.0) -> Column:
    """Whether a peak (peak_x, peak_y) lies in its defect's box (x0, y0, x1, y1), grown by slack on all sides."""
    return F.col("peak_x").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("peak_y").between(F.col("y0") - slack, F.col("y1") + slack)


def position_floor(maps: DataFrame, by: str, floor: float = 0.25) -> DataFrame:
    """by, r, c and norm: the mean of sm at a place over all frames, no smaller than floor times its group's median of means."""
    mean = maps.groupBy(by, "r", "c").agg(F.avg("sm").alias("m"))
    mid = mean.groupBy(by).agg(F.median("m").alias("_mid"))
    return mean.join(mid, by).select(by, "r", "c", F.greatest(F.col("m"), floor * F.col("_mid")).alias("norm"))


def agreement(pairs: DataFrame, by: str, most: float = 1e-3, sentinel: float = 1e30) -> DataFrame:
    """by, off (the largest difference of a and b over the largest a) and agrees: within most, and the same rows without a neighbour
    (sentinel or more) on both sides."""
    none = (F.col("a") >= sentinel) != (F.col("b") >= sentinel)
    known = (F.col("a") < sentinel) & (F.col("b") < sentinel)
    top = F.max(F.when(known, F.col("a")))
    off = F.coalesce(F.max(F.when(known, F.abs(F.col("a") - F.col("b")))) / F.when(top > 0, top), F.lit(0.0))
    return pairs.groupBy(by).agg(off.alias("off"), (~F.max(none) & (off <= most)).alias("agrees"))


def best_candidate(times: DataFrame, by: str, name: str, base: str, most: float = 0.9) -> DataFrame:
    """by, name and med of the candidate (by, name, ms, accurate) with the lowest median: of those that are accurate and at most `most`
    of the base's time, in the best and in the median run; the base where none is; ties to the base, then by name."""
    runs = times.groupBy(by, name).agg(F.median("ms").alias("med"), F.min("ms").alias("low"), F.min("accurate").alias("accurate"))
    own = runs.where(F.col(name) == base).select(by, F.col("med").alias("_med"), F.col("low").alias("_low"))
    fit = runs.join(own, by).where((F.col(name) == base) | (F.col("accurate") & (F.col("med") <= most * F.col("_med")) & (F.col("low") <= most * F.col("_low"))))
    best = fit.groupBy(by).agg(F.min(F.struct("med", (F.col(name) != base).alias("other"), F.col(name).alias("name"))).alias("b"))
    return best.select(by, F.col("b.name").alias(name), "b.med")


def blocks_per_second(rows: DataFrame, by: str, block_ms: int = 1000) -> DataFrame:
    """rows (by, t_ms, ...) that end a block of block_ms or more, with fps: frames since the block began, a second."""

    def step(state: tuple | None, row) -> tuple[tuple, float | None]:
        if state is None:
            return (row.t_ms, 0), None
        began, n = state[0], state[1] + 1
        if row.t_ms - began >= block_ms:
            return (row.t_ms, 0), n * 1000 / (row.t_ms - began)
        return (began, n), None

    return folded(rows, by, ["t_ms"], "fps double", None, step, spread=True).where("fps is not null and not isnan(fps)")


def long_runs(rows: DataFrame, by: str, on: Column, least: int, *order: str) -> DataFrame:
    """by, first, last and n of every stretch of `least` rows or more in a row where on holds; first and last are values of order[0].
    A row's stretch is numbered by the rows before it where on doesn't hold: those of its range, and those of the ranges before."""
    rows = stats.ranged(rows.withColumn("_off", (~F.coalesce(on, F.lit(False))).cast("int")), [by], F.struct(*order))
    before = rows.groupBy(by, "_part").agg(F.sum("_off").alias("_n")).select(by, "_part", (F.sum("_n").over(W.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before"))
    upto = W.partitionBy(by, "_part").orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
    islands = stats.alike(rows.withColumn("_in", F.sum("_off").over(upto)).where("_off = 0"), before, [by, "_part"])
    run = islands.groupBy(by, (F.col("_before") + F.col("_in")).alias("_run"))
    return run.agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")


def heat(v: Column, tau: Column) -> Column:
    """How hot a patch is drawn, 0 to 1. From 0.6 of the limit on, full at 1.2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v / tau - 0.6) / 0.6))


def watts(microamps: Column, millivolts: Column) -> Column:
    return F.abs(microamps) * 1e-6 * millivolts * 1e-3


def clamped(v: Column) -> Column:
    """Half up, within a byte."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + 0.5))).cast("int")


def ahead(at: Column, speed: Column, latency_ms: Column) -> Column:
    """Where a track is drawn: as far on as it has moved since its frame."""
    return at + speed * latency_ms


def evaluated(results: DataFrame, by: list[str], params: Params = DEFAULT) -> DataFrame:
    """results (by, label, verdict, s, sim) as a row a variant: three AUROCs, and passes, refusals and defects of each label with exact
    intervals."""
    def auc(positive: str, negative: str, score: str, name: str) -> DataFrame:
        two = results.where(F.col("label").isin(positive, negative)).withColumn("_p", F.col("label") == positive)
        return stats.auroc(two, score, "_p", by).select(*by, F.col("auroc").alias(name))

    rates = {"pass_good": ("good", "PASS"), "pass_rotated": ("rotated", "PASS"), "refused_wrong": ("wrong", "NOT_ENROLLED"), "refused_lookalike": ("lookalike", "NOT_ENROLLED"), "defect_found": ("defect", "DEFECT")}
    hit = lambda label, verdict: F.count_if((F.col("label") == label) & (F.col("verdict") == verdict))
    counts = results.groupBy(*by).agg(*(x for n, (lab, v) in rates.items() for x in (hit(lab, v).alias(f"{n}_k"), F.count_if(F.col("label") == lab).alias(f"{n}_n"))))
    out = counts
    for name, pos, neg, score in (("auroc_defect", "defect", "good", "s"), ("auroc_identity", "good", "wrong", "sim"), ("auroc_lookalike", "good", "lookalike", "sim")):
        out = out.join(auc(pos, neg, score, name), by, "left")
    for n in rates:
        out = out.withColumn(f"{n}_ci", stats.clopper_pearson(F.col(f"{n}_k"), F.col(f"{n}_n"), params.confidence))
    return out
