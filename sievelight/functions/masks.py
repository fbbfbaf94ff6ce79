"""Run-length masks and pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def decoded(rle: Column) -> Column:
    """Bits of alternating runs, zeros first."""
    return F.flatten(F.transform(rle, lambda n, i: F.array_repeat((i % 2).cast("int"), n.cast("int"))))


def encoded(bits: Column) -> Column:
    """Alternating runs of an array of bits, zeros first (a run of none if it begins with a one): lengths between changes."""
    n = F.size(bits)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.element_at(bits, F.least(i + 1, n)) != F.element_at(bits, i)))
    runs = F.filter(F.zip_with(ends, F.concat(F.array(F.lit(0)), ends), lambda e, before: e - before), lambda r: r.isNotNull())
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.concat(F.when(F.element_at(bits, F.greatest(F.lit(1), F.least(n, F.lit(1)))) == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), runs))


def sheet_model(pixels: DataFrame, by: str, channels: tuple[str, ...], params: Params = DEFAULT) -> DataFrame:
    """by, channel, mu (median) and sigma (robust, no smaller than its floor) of each channel."""
    from .stats import with_mad

    long = pixels.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in channels))).alias("x")).select(by, "x.*")
    return with_mad(long, "v", [by, "channel"], counted=True).select(by, "channel", F.col("median").alias("mu"), F.greatest(params.mad_scale * F.col("mad"), F.lit(params.sigma_min)).alias("sigma"))


def foreground(pixels: DataFrame, sheet: DataFrame, by: str, channels: tuple[str, ...], params: Params = DEFAULT) -> DataFrame:
    """pixels with foreground: further from the background than k_sigma, over all channels."""
    wide = sheet.groupBy(by).pivot("channel", list(channels)).agg(F.first("mu").alias("mu"), F.first("sigma").alias("sigma"))
    far = sum((F.pow((F.col(c).cast("double") - F.col(f"{c}_mu")) / F.col(f"{c}_sigma"), F.lit(2.0)) for c in channels[1:]), F.pow((F.col(channels[0]).cast("double") - F.col(f"{channels[0]}_mu")) / F.col(f"{channels[0]}_sigma"), F.lit(2.0)))
    return pixels.join(wide, by).withColumn("foreground", far > params.k_sigma**2).drop(*(f"{c}_{x}" for c in channels for x in ("mu", "sigma")))
