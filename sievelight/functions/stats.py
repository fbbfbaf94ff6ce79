"""Robust statistics, exact binomial bounds and AUROC."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from ..sources.shared import stored

#: Ranges that a group's values are ranked in.
RANGES = 64


def alike(df: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """df with the columns of few's row of equal values; nulls are equal, too."""
    right = few.withColumnsRenamed({c: f"_{c}_" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in on]
    return df.join(right, same).drop(*(f"_{c}_" for c in on))


def ranged(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """df with _o, its order, and _part: rows are range-partitioned by group and order, so that a large group spreads over parts that
    follow each other. What a window over (by, _part) finds is carried on from part to part over one row a group and part."""
    return stored(df.withColumn("_o", order).repartitionByRange(*by, "_o").withColumn("_part", F.spark_partition_id()), "ranged")


def positions(df: DataFrame, by: list[str], order: Column, keep: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """df (of its columns beside by those of keep, where given) with _at: each row's place (from 0) in its group's order. Rows are
    range-partitioned (to tasks partitions, where given) by group and order, so that a large group spreads; how many of a group lie in
    the partitions before is a sum over one row a group and partition."""
    rows = df.withColumn("_o", order) if keep is None else df.select(*by, *keep, order.alias("_o"))
    dealt = rows.repartitionByRange(*([] if tasks is None else [tasks]), *by, "_o").sortWithinPartitions(*by, "_o")
    kept = stored(dealt.withColumn("_id", F.monotonically_increasing_id()).drop("_o"), "positions").withColumn("_part", F.shiftright("_id", 33))
    parts = kept.groupBy(*by, "_part").agg(F.count("*").alias("_k"), F.min("_id").alias("_first"))
    before = F.sum("_k").over(W.partitionBy(*by).orderBy("_part")) - F.col("_k")
    starts = parts.select(*by, "_part", "_first", before.alias("_before"))
    return alike(kept, starts, [*by, "_part"]).withColumn("_at", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_first", "_before")


def quantiles(df: DataFrame, value: str, by: list[str], at: list[float], names: list[str]) -> DataFrame:
    """by and exact quantiles (linear between ranks) of value, nulls left out, under names.

    Equal values are counted first, so that what is ranked are different values; ranks are sums of counts over ranges between approximate
    quantiles, then within a range, so that no task sees a whole group.
    """
    return counted_quantiles(counted_values(df, value, by), by, at, names)


def counted_values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, _v and _n: how often each value that isn't null comes."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))


def counted_quantiles(same: DataFrame, by: list[str], at: list[float], names: list[str]) -> DataFrame:
    """quantiles of values that are counted already (by, _v, _n); only these are read, ranges hold about as many different values each.
    Approximate quantiles depend on the order in which parts arrive, so what lies in which range is settled once, for both that read it."""
    cuts = same.groupBy(*by).agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 1000).alias("_cuts"), F.sum("_n").alias("_all"))
    ranged = stored(same.join(cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts"), "ranged")
    under = F.sum("_n").over(W.partitionBy(*by).orderBy("_range")) - F.col("_n")
    below = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_n")).select(*by, "_range", under.alias("_below"))
    upto = ranged.join(below, [*by, "_range"]).withColumn("_to", F.col("_below") + F.sum("_n").over(W.partitionBy(*by, "_range").orderBy("_v")))
    low = lambda q: F.floor(q * (F.col("_all") - 1))
    first, last = F.col("_to") - F.col("_n"), F.col("_to") - 1  # the ranks, from 0, that a value takes
    at_rank = lambda k: F.max(F.when((first <= k) & (k <= last), F.col("_v")))
    ends = upto.groupBy(*by).agg(*(x for q, n in zip(at, names, strict=True) for x in (at_rank(low(q)).alias(f"_{n}0"), at_rank(F.least(low(q) + 1, F.col("_all") - 1)).alias(f"_{n}1"))), F.max("_all").alias("_all"))
    part = lambda q: q * (F.col("_all") - 1) - low(q)
    return ends.select(*by, *((F.col(f"_{n}0") * (1 - part(q)) + F.col(f"_{n}1") * part(q)).alias(n) for q, n in zip(at, names, strict=True)))


def with_mad(df: DataFrame, value: str, by: list[str], counted: bool = False) -> DataFrame:
    """by, median and mad (unscaled) of value. counted is for groups too large for one task: values are counted once, and both are read
    from the counts, the deviations by adding up those of the values on either side."""
    if counted:
        same = stored(counted_values(df, value, by), "counted")
        mid = counted_quantiles(same, by, [0.5], ["median"])
        away = same.join(mid, by).groupBy(*by, "median", F.abs(F.col("_v") - F.col("median")).alias("_v")).agg(F.sum("_n").alias("_n"))
        return counted_quantiles(away, [*by, "median"], [0.5], ["mad"])
    off = df.join(df.groupBy(*by).agg(F.median(value).alias("median")), by).select(*by, "median", F.abs(F.col(value) - F.col("median")).alias("_off"))
    return off.groupBy(*by, "median").agg(F.median("_off").alias("mad"))


@F.pandas_udf(DoubleType())
def cosine(angle: pd.Series) -> pd.Series:
    """By the C library, as databases take it; the JVM's differs in the last bit, which decides for points on an edge."""
    return pd.Series([math.cos(a) if math.isfinite(a) else math.nan for a in angle], dtype=float)


@F.pandas_udf(DoubleType())
def sine(angle: pd.Series) -> pd.Series:
    return pd.Series([math.sin(a) if math.isfinite(a) else math.nan for a in angle], dtype=float)


@F.pandas_udf(DoubleType())
def arc_tangent(y: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series([math.atan2(a, b) for a, b in zip(y, x, strict=True)], dtype=float)


def order_alpha(confidence: float, m: Column) -> Column:
    """The rate that a maximum of m clean samples bounds at this confidence."""
    return 1 - F.pow(F.lit(1 - confidence), 1 / m)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated from the front until it stands still."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for k in range(1, 20_000):
        for t in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / (1 + t * d or tiny)
            c = 1 + t / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            return f
    raise ArithmeticError(f"the incomplete beta function of {a}, {b} at {x} did not settle")


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    while hi - lo > 1e-13:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def _bounds(k: pd.Series, n: pd.Series, low: float, high: float) -> pd.DataFrame:
    rows = [(0.0 if x == 0 else beta_quantile(low, x, m - x + 1), 1.0 if x == m else beta_quantile(high, x + 1, m - x)) if m > 0 else (0.0, 1.0) for x, m in zip(k.tolist(), n.tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["low", "high"])


def clopper_pearson(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """A struct (low, high): the exact two-sided interval of a rate seen k times in n."""
    tail = (1 - confidence) / 2

    @F.pandas_udf("low double, high double")
    def bounds(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return _bounds(ks, ns, tail, 1 - tail)

    return bounds(k, n)


def clopper_pearson_upper(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """The exact one-sided upper bound."""

    @F.pandas_udf("low double, high double")
    def bounds(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return _bounds(ks, ns, 0.0, confidence)

    return bounds(k, n)["high"]


def auroc(df: DataFrame, score: str, positive: str, by: list[str], splits: int = 128) -> DataFrame:
    """by, n_pos, n_neg and auroc: how often a positive scores above a negative, ties counting half. NaN if a side is empty.

    Equal scores are counted first. Ranges between approximate quantiles are then ranked apart, and the negatives below a range are a
    sum over few ranges, so that no task sees a whole group.
    """
    known = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(*by, F.col(score).alias("_s"), F.col(positive).cast("boolean").alias("_p"))
    cuts = known.groupBy(*by).agg(F.percentile_approx("_s", [k / splits for k in range(1, splits)], 1000).alias("_cuts"))
    same = known.groupBy(*by, "_s").agg(F.count_if("_p").alias("_pos"), F.count_if(~F.col("_p")).alias("_neg")).join(cuts, by)
    ranged = same.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_s")))).drop("_cuts")
    w = W.partitionBy(*by, "_range").orderBy("_s")
    inside = ranged.withColumn("_below", F.sum("_neg").over(w) - F.col("_neg"))
    part = inside.groupBy(*by, "_range").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_wins"))
    under = F.sum("_neg").over(W.partitionBy(*by).orderBy("_range")) - F.col("_neg")
    whole = part.withColumn("_wins", F.col("_wins") + F.col("_pos") * under).groupBy(*by).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum("_wins").alias("_wins"))
    rate = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_wins") / (F.col("n_pos") * F.col("n_neg"))).otherwise(F.lit(float("nan")))
    return whole.select(*by, "n_pos", "n_neg", rate.alias("auroc"))
