"""Crops of images as pixel tables (img, y, x, ...): resizing, turning, coverage of patches, split parts.

Resampling is separable: a crop says which source rows and columns its own ones take from, and with which weights, in a few rows a
crop; pixels meet these by equality and sums combine partially, so no image has to lie in one task. What squares and crops spread into is joined by sorting: it is many times what
Spark takes it for, and must not be broadcast.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.stats import cosine, sine
from ..sources.shared import dealt, tasks_for
from .pixels import MARGIN

SAMPLES = 4  # fixed value: sample points along each side of a patch
# Reach between pieces as a share of the object's longer side, and the areas, as shares of the largest piece's, of pieces.
GAP, LEAST_PIECE, MOST_PIECE = 0.35, 0.03, 0.5
#: Fixed value: from this aspect on an object has no axis.
ROUND = 0.85


def taps(crops: DataFrame, axis: str, size: int, full: int) -> DataFrame:
    """img, to (0 to size - 1), source and weight along one axis of crops (img, x0, y0, side): two neighbours, the rim repeated."""
    at = F.col(f"{axis}0") + (F.col("to") + 0.5) * F.col("side") / size - 0.5
    low, part = F.floor(at), at - F.floor(at)
    held = lambda i: F.greatest(F.lit(0), F.least(F.lit(full - 1), i)).cast("int")
    two = F.array(F.struct(held(low).alias("source"), (1 - part).alias("weight")), F.struct(held(low + 1).alias("source"), part.alias("weight")))
    spread = crops.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).select("img", "to", F.explode(two).alias("t"))
    return spread.select("img", "to", "t.source", "t.weight").where("weight > 0")


def resized(pixels: DataFrame, crops: DataFrame, size: int, height: int, width: int, channels: tuple[str, ...]) -> DataFrame:
    """img, y, x and channels of each image's square crop, size x size, by bilinear samples at the centres of the new pixels.
    Tasks are as many as the pixels ask for."""
    tasks = tasks_for(pixels.sparkSession, pixels.count())
    xs = taps(crops, "x", size, width).select("img", F.col("to").alias("_x"), F.col("source").alias("x"), F.col("weight").alias("_wx"))
    ys = taps(crops, "y", size, height).select("img", F.col("to").alias("_y"), F.col("source").alias("y"), F.col("weight").alias("_wy"))
    across = dealt(pixels.select("img", "y", "x", *channels), tasks, "img", "x").join(dealt(xs, tasks, "img", "x").hint("merge"), ["img", "x"])
    met = dealt(across, tasks, "img", "y").join(dealt(ys, tasks, "img", "y").hint("merge"), ["img", "y"])
    rows = met.groupBy("img", "y", "_y", "_x").agg(*(F.sum(F.col(c) * F.col("_wx") * F.col("_wy")).alias(c) for c in channels))
    return dealt(rows, tasks, "img", "_y").groupBy("img", F.col("_y").alias("y"), F.col("_x").alias("x")).agg(*(F.sum(c).alias(c) for c in channels))


def turned(pixels: DataFrame, quarters: int, height: int, width: int) -> DataFrame:
    """pixels of images turned counter-clockwise by quarters."""
    k = quarters % 4
    y, x = F.col("y"), F.col("x")
    new = {0: (y, x), 1: (width - 1 - x, y), 2: (height - 1 - y, width - 1 - x), 3: (x, height - 1 - y)}[k]
    return pixels.withColumns({"y": new[0].cast("int"), "x": new[1].cast("int")})


def full_square(df: DataFrame, factor: int, height: float, width: float) -> DataFrame:
    """df (min_x ... max_y in analysis pixels) with x0, y0 and side in full ones: the box, a margin wider, within the image."""
    lo, hi = {c: factor * F.col(f"min_{c}") for c in "xy"}, {c: factor * (F.col(f"max_{c}") + 1) for c in "xy"}
    side = F.least(F.greatest(hi["x"] - lo["x"], hi["y"] - lo["y"]) * (1 + 2 * MARGIN), F.lit(float(width)), F.lit(float(height)))
    at = lambda c, n: F.greatest(F.lit(0.0), F.least((lo[c] + hi[c]) / 2 - F.col("side") / 2, F.lit(float(n)) - F.col("side")))
    return df.withColumn("side", side).withColumns({"x0": at("x", width), "y0": at("y", height)})


def coverage(labelled: DataFrame, crops: DataFrame, gh: int, gw: int, factor: int = 1) -> DataFrame:
    """img, label, r, c and cov of every patch of crops (img, label, x0, y0, side): the share of its 4 x 4 sample points that lie on the
    object's pixels (img, y, x, label), analysis pixels of factor full ones. Points outside count as not covered."""

    def points(axis: str, n: int, cell: str, source: str, count: str) -> DataFrame:
        k = F.col("k")
        at = F.floor((F.col(f"{axis}0") + (k + 0.5) / SAMPLES * F.col("side") / n) / factor).cast("int")
        spread = crops.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n * SAMPLES - 1))))
        return spread.groupBy("img", "label", F.floor(k / SAMPLES).cast("int").alias(cell), at.alias(source)).agg(F.count("*").alias(count))

    hits = labelled.select("img", "label", "y", "x").join(points("x", gw, "c", "x", "nx").hint("merge"), ["img", "label", "x"]).join(points("y", gh, "r", "y", "ny").hint("merge"), ["img", "label", "y"])
    cells = crops.select("img", "label", F.explode(F.sequence(F.lit(0), F.lit(gh * gw - 1))).alias("p"))
    sums = hits.groupBy("img", "label", "r", "c").agg((F.sum(F.col("nx") * F.col("ny")) / SAMPLES**2).alias("cov"))
    grid = cells.select("img", "label", F.floor(F.col("p") / gw).cast("int").alias("r"), (F.col("p") % gw).alias("c"))
    return grid.hint("merge").join(sums, ["img", "label", "r", "c"], "left").withColumn("cov", F.coalesce("cov", F.lit(0.0)))


def canonical_square(labelled: DataFrame, angles: DataFrame, factor: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """img, label, theta, cx, cy and side of the square along each object's axis (angles: img, label, theta): the extent of its pixels'
    corners along and across, a margin wider, about its middle; no wider than the image (height x width analysis pixels) where given."""
    corners = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1))))
    pts = labelled.join(angles.withColumns({"_cos": cosine(F.col("theta")), "_sin": sine(F.col("theta"))}), ["img", "label"]).withColumn("d", corners)
    px, py = factor * (F.col("x") + F.col("d.dx")), factor * (F.col("y") + F.col("d.dy"))
    c, s = F.col("_cos"), F.col("_sin")
    a, b = px * c + py * s, -px * s + py * c
    ends = pts.groupBy("img", "label", "theta", "_cos", "_sin").agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1"))
    am, bm = (F.col("a0") + F.col("a1")) / 2, (F.col("b0") + F.col("b1")) / 2
    side = F.greatest(F.greatest(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")) * (1 + 2 * MARGIN), F.lit(2.0 * factor))
    if height is not None and width is not None:
        side = F.least(side, F.lit(float(factor * min(height, width))))
    return ends.select("img", "label", "theta", (am * c - bm * s).alias("cx"), (am * s + bm * c).alias("cy"), side.alias("side"))


def axis_angle(theta: Column, aspect: Column) -> Column:
    """The angle to crop at: an object nearly as wide as long has no axis to go by."""
    return F.when(aspect < ROUND, folded_angle(theta)).otherwise(F.lit(0.0))


def _square_points(squares: DataFrame, by: list[str], rows: int, columns: int, turned: float) -> DataFrame:
    """by, i, j, u and v: the middles of rows x columns cells of squares (by, cx, cy, side, theta), in the image."""
    at = squares.select(*by, "cx", "cy", "side", (F.col("theta") + turned).alias("t")).select("*", cosine(F.col("t")).alias("_cos"), sine(F.col("t")).alias("_sin"))
    spread = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"))
    a, b = (F.col("j") + 0.5) * F.col("side") / columns - F.col("side") / 2, (F.col("i") + 0.5) * F.col("side") / rows - F.col("side") / 2
    return spread.select(*by, "i", "j", (F.col("cx") + a * F.col("_cos") - b * F.col("_sin")).alias("u"), (F.col("cy") + a * F.col("_sin") + b * F.col("_cos")).alias("v"))


def rotated(pixels: DataFrame, squares: DataFrame, size: int, height: int, width: int, channels: tuple[str, ...], turned: float = 0.0, factor: int = 1) -> DataFrame:
    """img, label, y, x and channels of the content of squares (img, label, cx, cy, side, theta), size x size, by bilinear samples at the
    centres of the new pixels; turned by half a circle they show it the other way round. A pixel stands for factor x factor of the
    height x width ones that squares are in; it is not sent as often.

    A sample takes from four pixels, the rim repeated: squares become a table of (pixel, weight), pixels meet it by equality and sums
    combine partially, so that no image lies in one task."""
    at = _square_points(squares, ["img", "label"], size, size, turned)
    fx, fy = F.floor(F.col("u") - 0.5), F.floor(F.col("v") - 0.5)
    held = lambda k, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), k)).cast("int")
    at_pixel = lambda k, n: F.floor(held(k, n) / factor).cast("int")
    wx, wy = F.col("u") - 0.5 - fx, F.col("v") - 0.5 - fy
    taps_ = F.array(*(F.struct(at_pixel(fy + dy, height).alias("y"), at_pixel(fx + dx, width).alias("x"), ((wx if dx else 1 - wx) * (wy if dy else 1 - wy)).alias("w")) for dy in (0, 1) for dx in (0, 1)))
    asked = at.select("img", "label", "i", "j", F.explode(taps_).alias("t")).select("img", "label", "i", "j", "t.*").where("w > 0")
    met = pixels.select("img", "y", "x", *channels).hint("merge").join(asked, ["img", "y", "x"])
    return met.groupBy("img", "label", F.col("i").alias("y"), F.col("j").alias("x")).agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in channels))


def rotated_coverage(labelled: DataFrame, squares: DataFrame, gh: int, gw: int, factor: int = 1, turned: float = 0.0) -> DataFrame:
    """img, label, r, c and cov of every patch of squares (img, label, cx, cy, side, theta): the share of its 4 x 4 sample points that
    lie on the object's pixels."""
    at = _square_points(squares, ["img", "label"], gh * SAMPLES, gw * SAMPLES, turned)
    cell = lambda c: F.floor(F.col(c) / SAMPLES).cast("int")
    asked = at.select("img", "label", cell("i").alias("r"), cell("j").alias("c"), F.floor(F.col("v") / factor).cast("int").alias("y"), F.floor(F.col("u") / factor).cast("int").alias("x"))
    counts = asked.groupBy("img", "label", "r", "c", "y", "x").agg(F.count("*").alias("n"))
    hits = counts.hint("merge").join(labelled.select("img", "label", "y", "x", F.lit(1).alias("on")), ["img", "label", "y", "x"], "left")
    return hits.groupBy("img", "label", "r", "c").agg((F.sum(F.when(F.col("on") == 1, F.col("n")).otherwise(0)) / SAMPLES**2).alias("cov"))


def inside_square(x: Column, y: Column, near: bool = True, cos: Column | None = None, sin: Column | None = None) -> Column:
    """Whether a point lies in the square (columns cx, cy, side, theta) that its row has; the far sides are outside, without near all are.
    cos and sin: those of theta, where they are there already."""
    dx, dy, half = x - F.col("cx"), y - F.col("cy"), F.col("side") / 2
    c, s = F.cos("theta") if cos is None else cos, F.sin("theta") if sin is None else sin
    a, b = dx * c + dy * s, -dx * s + dy * c
    if not near:
        return (F.abs(a) < half) & (F.abs(b) < half)
    return (a >= -half) & (a < half) & (b >= -half) & (b < half)


def cell_corners(gh: int, gw: int, r: Column, c: Column) -> Column:
    """The corners (x and y each, from the first one around) of a patch of the square (cx, cy, side, theta), in the image."""
    def corner(rr: Column, cc: Column) -> Column:
        a, b = cc * F.col("side") / gw - F.col("side") / 2, rr * F.col("side") / gh - F.col("side") / 2
        return F.struct((F.col("cx") + a * F.cos("theta") - b * F.sin("theta")).alias("x"), (F.col("cy") + a * F.sin("theta") + b * F.cos("theta")).alias("y"))

    return F.array(corner(r, c), corner(r, c + 1), corner(r + 1, c + 1), corner(r + 1, c))


def folded_angle(theta: Column) -> Column:
    """An axis's angle in (-pi/2, pi/2]."""
    t = F.pmod(theta, F.lit(math.pi))
    return F.when(t > math.pi / 2, t - math.pi).otherwise(t)


def gathered(pieces: list[tuple[int, ...]]) -> list[int]:
    """The label of the object that each of one image's components (label, area, min_x, min_y, max_x, max_y) belongs to. The largest grows
    by pieces near its box until none is near enough; pieces that are too small, or nearly as large, stay apart."""
    main = min(pieces, key=lambda p: (-p[1], p[0]))
    left = sorted(p for p in pieces if p[0] != main[0] and LEAST_PIECE * main[1] <= p[1] <= MOST_PIECE * main[1])
    x0, y0, x1, y1 = main[2:]
    got, grew = set(), True
    while grew:
        grew, rest, reach = False, [], GAP * max(x1 - x0 + 1, y1 - y0 + 1)
        for p in left:
            if max(p[2] - x1, x0 - p[4]) <= reach and max(p[3] - y1, y0 - p[5]) <= reach:
                got.add(p[0])
                x0, y0, x1, y1 = min(x0, p[2]), min(y0, p[3]), max(x1, p[4]), max(y1, p[5])
                grew = True
            else:
                rest.append(p)
        left = rest
    return [main[0] if p[0] in got else p[0] for p in pieces]


def merged(stats: DataFrame) -> DataFrame:
    """Component stats (img, label, area, box, cx, cy, touches_border) with the pieces of split objects put together. A group is one
    image's components, which are few; a task takes many images one after the other."""
    names, box = [f.name for f in stats.schema], ("label", "area", "min_x", "min_y", "max_x", "max_y")
    grouped = stats.groupBy("img").agg(F.collect_list(F.struct(*names)).alias("m")).select("m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cuts = b.column(0).flatten(), b.column(0).offsets.to_numpy() - b.column(0).offsets[0].as_py()
            pieces = list(zip(*(rows.field(c).to_pylist() for c in box), strict=True))
            into = [k for s, e in itertools.pairwise(cuts.tolist()) for k in gathered(pieces[s:e])]
            yield pa.record_batch([*(rows.field(c) for c in names), pa.array(into, pa.int64())], [*names, "into"])

    told = grouped.mapInArrow(run, StructType([*stats.schema.fields, StructField("into", LongType())]))
    mean = lambda c: (F.sum(F.col(c) * F.col("area")) / F.sum("area")).alias(c)
    out = told.groupBy("img", F.col("into").alias("label")).agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), mean("cx"), mean("cy"), F.max("touches_border").alias("touches_border"), F.sum("area").alias("area"))
    return out.select("img", "label", "area", "min_x", "max_x", "min_y", "max_y", "cx", "cy", "touches_border")
