"""Features of patches without a model: colour, texture and edge directions of each patch's surroundings, spread over more dimensions.

Sums are taken once a cell; a patch adds up those of its nine cells, so that no pixel is read nine times and no image lies in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .pixels import grey

#: The seed of the projection, directions, numbers of a patch before it, and their order: means, deviations, directions, edges.
SEED, BINS, RAW = 0x2545F4914F6CDD1D, 8, 15


def xorshift(seed: int, n: int) -> np.ndarray:
    """n numbers in [-1, 1), as half precision would not keep them: a 64-bit word shifted left 13, right 7, left 17, its top 53 bits."""
    out, s, mask = np.empty(n, np.float32), seed, (1 << 64) - 1
    for k in range(n):
        s ^= s << 13 & mask
        s ^= s >> 7
        s ^= s << 17 & mask
        out[k] = (s >> 11) / 2**53 * 2 - 1
    return out


def projection(dim: int, seed: int = SEED) -> list[list[float]]:
    """Weights of each of dim numbers."""
    return xorshift(seed, dim * RAW).reshape(dim, RAW).astype(float).tolist()


def _with_gradients(pixels: DataFrame, side: int) -> DataFrame:
    """pixels (img, y, x, g) with bin, mag and lap, null where one of the four neighbours is missing. A pixel meets those of its row and
    those of its column, so that it is sent twice, and no image lies in one task."""
    beside = lambda c, way, step: F.when(way(c).over(W.partitionBy("img", "y" if c == "x" else "x").orderBy(c)) == F.col(c) + step, way("g").over(W.partitionBy("img", "y" if c == "x" else "x").orderBy(c)))
    met = pixels.withColumns({"_left": beside("x", F.lag, -1), "_right": beside("x", F.lead, 1)}).withColumns({"_above": beside("y", F.lag, -1), "_below": beside("y", F.lead, 1)})
    gx, gy = F.col("_right") - F.col("_left"), F.col("_below") - F.col("_above")
    lap = (F.col("_left") + F.col("_right") + F.col("_above") + F.col("_below") - 4 * F.col("g")) / 255
    inner = (F.col("y") > 0) & (F.col("y") < side - 1) & (F.col("x") > 0) & (F.col("x") < side - 1) & lap.isNotNull()
    turn = F.floor((F.atan2(gy, gx) + math.pi) / (2 * math.pi) * BINS).cast("int")
    added = {"bin": F.greatest(F.lit(0), F.least(F.lit(BINS - 1), turn)), "mag": F.sqrt(gx * gx + gy * gy) / 255, "lap": lap * lap}
    return met.withColumns({k: F.when(inner, v) for k, v in added.items()}).drop("_left", "_right", "_above", "_below")


def raw_features(pixels: DataFrame, side: int, grid: int) -> DataFrame:
    """img, r, c and raw (RAW numbers) of grid x grid patches of square images of pixels (img, y, x, red, green, blue: 0 to 255)."""
    cell = side // grid
    named = pixels.withColumn("g", grey(F.col("red"), F.col("green"), F.col("blue")))
    both = _with_gradients(named, side)
    ch = [F.col(c) / 255 for c in ("red", "green", "blue")]
    sums = [F.count("*").alias("n"), *(F.sum(c).alias(f"s{k}") for k, c in enumerate(ch)), *(F.sum(c * c).alias(f"q{k}") for k, c in enumerate(ch)), *(F.sum(F.when(F.col("bin") == b, F.col("mag")).otherwise(0.0)).alias(f"b{b}") for b in range(BINS)), F.sum(F.coalesce("lap", F.lit(0.0))).alias("e")]
    cells = both.groupBy("img", F.floor(F.col("y") / cell).cast("int").alias("r"), F.floor(F.col("x") / cell).cast("int").alias("c")).agg(*sums)
    names = [c for c in cells.columns if c not in ("img", "r", "c")]
    near = cells  # sums over three rows, then over three columns, so that a cell is sent twice and not to nine places
    for along, over in (("r", "c"), ("c", "r")):
        three = W.partitionBy("img", over).orderBy(along).rangeBetween(-1, 1)
        near = near.select("img", "r", "c", *(F.sum(c).over(three).alias(c) for c in names))
    near = near.where((F.col("r") >= 0) & (F.col("r") < grid) & (F.col("c") >= 0) & (F.col("c") < grid))
    mean = lambda k: F.col(f"s{k}") / F.col("n")
    dev = lambda k: F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{k}") / F.col("n") - mean(k) * mean(k)))
    raw = [*(mean(k) for k in range(3)), *(dev(k) for k in range(3)), *(F.col(f"b{b}") / F.col("n") * 4 for b in range(BINS)), F.sqrt(F.col("e") / F.col("n"))]
    return near.select("img", "r", "c", F.array(*raw).alias("raw"))


def projected(raw: Column, dim: int, seed: int = SEED) -> Column:
    """raw spread over dim numbers by the seeded projection; distances are kept roughly."""
    rows = F.array(*(F.array(*map(F.lit, w)) for w in projection(dim, seed)))
    return F.transform(rows, lambda w: F.aggregate(F.zip_with(raw, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))


def patch_features(pixels: DataFrame, side: int, grid: int, dim: int, seed: int = SEED) -> DataFrame:
    """img, r, c and f (dim numbers) of every patch: what takes a model's place where features of images are asked for."""
    return raw_features(pixels, side, grid).select("img", "r", "c", projected(F.col("raw"), dim, seed).alias("f"))
