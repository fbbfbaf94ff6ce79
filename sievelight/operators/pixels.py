"""Images as pixel tables (img, y, x, ...): morphology, components, shapes, sharpness, flicker, sanity.

Neighbourhoods are exploded offsets and grouped aggregates, so that images spread over tasks; labelling sees a tile at a time, and hulls
the ends of a component's rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.stats import arc_tangent, cosine, positions, sine
from ..params import DEFAULT, Params
from ..sources.shared import stored
from . import links
from .telemetry import folded

#: Pixels along a side of a tile that is labelled as one.
TILE = 1024
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
MIN_BLOB, RIM, MIN_FRACTION, MAX_FRACTION, SECOND, MARGIN = 30, 2, 0.01, 0.80, 0.25, 0.10  # fixed values


def _moved(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Each pixel at all places of its 3x3 neighbourhood that lie in the image."""
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in EIGHT)))
    out = pixels.select("img", "y", "x", at.alias("d")).select("img", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    return out.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def dilated(on: DataFrame, height: int, width: int) -> DataFrame:
    """img, y, x of the pixels with one of on (the pixels that are set) around them."""
    return _moved(on, height, width).distinct()


def eroded(on: DataFrame, height: int, width: int) -> DataFrame:
    """img, y, x of those of on whose neighbours in the image are all set: as many are sent to them as there are."""
    span = lambda c, n: F.lit(1) + (F.col(c) > 0).cast("int") + (F.col(c) < n - 1).cast("int")
    counts = _moved(on, height, width).groupBy("img", "y", "x").count()
    return counts.where(F.col("count") == span("y", height) * span("x", width)).select("img", "y", "x")


def cleaned(on: DataFrame, height: int, width: int) -> DataFrame:
    """Opened, then closed."""
    opened = dilated(eroded(on, height, width), height, width)
    return eroded(dilated(opened, height, width), height, width)


def label(image: pd.DataFrame, min_area: int = MIN_BLOB) -> pd.DataFrame:
    """One image's set pixels with the label of their 8-connected component, numbered from 1 by first pixel; small ones left out.

    Every pixel takes the smallest place among its neighbours', and then that of the place it has taken, until nothing changes.
    """
    image = image.sort_values(["y", "x"], ignore_index=True)
    y, x = image["y"].to_numpy(), image["x"].to_numpy()
    key = y.astype(np.int64) << 32 | x.astype(np.int64)
    top = np.arange(len(key))
    links = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = (y + dy).astype(np.int64) << 32 | (x + dx).astype(np.int64)
        at = np.minimum(np.searchsorted(key, other), len(key) - 1)
        there = (key[at] == other) & (x + dx >= 0)
        links.append((np.flatnonzero(there), at[there]))
    u, v = (np.concatenate(c) for c in zip(*links, strict=True))
    while True:
        low = np.minimum(top[u], top[v])
        new = top.copy()
        np.minimum.at(new, top[u], low)
        np.minimum.at(new, top[v], low)
        new = new[new]
        if np.array_equal(new, top):
            break
        top = new
    roots, which, sizes = np.unique(top, return_inverse=True, return_counts=True)
    kept = sizes >= min_area
    image["label"] = np.where(kept, np.cumsum(kept), 0)[which].astype(np.int32)
    return image[image["label"] > 0]


def _roots(key: np.ndarray, width: int) -> np.ndarray:
    """The place of the first pixel of each pixel's 8-connected component, of places in order on tiles that lie width apart, rims empty."""
    u, v = [], []
    for step in (1, width - 1, width, width + 1):
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        there = np.flatnonzero(key[at] == key + step)
        u.append(there)
        v.append(at[there])
    u, v = np.concatenate(u), np.concatenate(v)
    top = np.arange(len(key))
    while True:
        low = np.minimum(top[u], top[v])
        new = top.copy()
        np.minimum.at(new, top[u], low)
        np.minimum.at(new, top[v], low)
        new = new[new]
        if np.array_equal(new, top):
            return top
        top = new


def _tiled(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Pixels (img, y, x) in order of tiles, and within them of rows, once each, with node: the place of the first pixel of their component
    within the tile. Tiles of a batch are labelled together; the last one waits until it is whole."""
    width, held = tile + 2, [np.empty(0, np.int64)] * 3

    def labelled(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        ty, tx = y // tile, x // tile
        first = np.ones(len(img), bool)
        first[1:] = (np.diff(img) != 0) | (np.diff(ty) != 0) | (np.diff(tx) != 0)
        key = ((np.cumsum(first) - 1) * width + y - ty * tile + 1) * width + x - tx * tile + 1
        once = np.concatenate([[True], np.diff(key) != 0])
        img, y, x, key = img[once], y[once], x[once], key[once]
        top = _roots(key, width)
        node = (y << 32) + x
        return pa.record_batch([pa.array(img), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(node[top])], ["img", "y", "x", "node"])

    for b in batches:
        img, y, x = held = [np.concatenate([h, b.column(k).to_numpy().astype(np.int64)]) for k, h in enumerate(held)]
        if len(img):
            last = (img == img[-1]) & (y // tile == y[-1] // tile) & (x // tile == x[-1] // tile)
            cut = len(img) - int(last.sum())
            if cut:
                yield labelled(img[:cut], y[:cut], x[:cut])
                held = [h[cut:] for h in held]
    if len(held[0]):
        yield labelled(*held)


def components(on: DataFrame, min_area: int = MIN_BLOB, tile: int = TILE) -> DataFrame:
    """img, y, x and label of the pixels that belong to components of min_area pixels or more, numbered from 1 by first pixel.

    Tiles are labelled each for itself, many in one go. Pixels at the edge of a tile that touch one of another link the two components, and
    what such links connect is one component; so an image of any size spreads over tasks, and what is joined is seams. Sizes and numbers
    are taken over rows of components; pixels are dealt once by tile, and once to their component's number.
    """
    pixels = on.select(F.col("img").cast("long").alias("img"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    tiles = [F.col("img"), F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)]
    dealt = pixels.repartition(*tiles).sortWithinPartitions(*tiles, "y", "x")
    parts = stored(dealt.mapInArrow(lambda batches: _tiled(batches, tile), "img long, y int, x int, node long"), "tiles")
    placed = lambda c: F.floor(F.col(c) / tile)
    edge = parts.where(F.expr(f"pmod(y, {tile}) in (0, {tile - 1}) or pmod(x, {tile}) in (0, {tile - 1})"))
    next_to = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    there = edge.select("img", F.col("node").alias("u"), placed("y").alias("uy"), placed("x").alias("ux"), "y", "x", next_to.alias("d")).select("img", "u", "uy", "ux", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    asked = there.where((F.col("x") >= 0) & ((F.col("uy") != placed("y")) | (F.col("ux") != placed("x")))).drop("uy", "ux")
    seams = asked.join(edge, ["img", "y", "x"]).select(F.col("img").alias("space"), "u", F.col("node").alias("v")).distinct()
    joined = links.connected(seams).withColumnRenamed("space", "img")
    nodes = parts.groupBy("img", "node").count()
    rooted = stored(nodes.join(joined, ["img", "node"], "left").select("img", "node", "count", F.coalesce("root", "node").alias("root")), "rooted")
    sizes = rooted.groupBy("img", "root").agg(F.sum("count").alias("count")).where(F.col("count") >= min_area)
    numbers = positions(sizes.select("img", "root"), ["img"], F.col("root")).select("img", "root", (F.col("_at") + 1).cast("int").alias("label"))
    named = rooted.join(numbers, ["img", "root"]).select("img", "node", "label")
    return parts.join(named, ["img", "node"]).select("img", "y", "x", "label")


def component_stats(labelled: DataFrame, height: int, width: int) -> DataFrame:
    """img, label, area, box, centre (half a pixel on) and whether it comes near the border."""
    near = (F.col("x") < RIM) | (F.col("y") < RIM) | (F.col("x") >= width - RIM) | (F.col("y") >= height - RIM)
    ends = [f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))]
    return labelled.groupBy("img", "label").agg(F.count("*").alias("area"), *ends, (F.avg("x") + 0.5).alias("cx"), (F.avg("y") + 0.5).alias("cy"), F.max(near).alias("touches_border"))


def main_objects(stats: DataFrame) -> DataFrame:
    """The largest component of each image that keeps off the border, of equal ones the first."""
    return stats.where(~F.col("touches_border")).withColumn("_k", F.row_number().over(W.partitionBy("img").orderBy(F.desc("area"), "label"))).where("_k = 1").drop("_k")


def crop_square(df: DataFrame, height: float, width: float) -> DataFrame:
    """df (min_x ... max_y) with x0, y0 and side of the square around the box, a margin wider, within the image."""
    longer = F.greatest(F.col("max_x") + 1 - F.col("min_x"), F.col("max_y") + 1 - F.col("min_y"))
    tenths = F.least(longer * round(10 + 20 * MARGIN), F.lit(10.0 * width), F.lit(10.0 * height))  # whole numbers, rounded once
    start = lambda c, n: F.greatest(F.lit(0.0), F.least((F.col(f"min_{c}") + F.col(f"max_{c}") + 1) / 2 - F.col("side") / 2, (10.0 * n - tenths) / 10))
    return df.withColumn("side", tenths / 10).withColumn("x0", start("x", width)).withColumn("y0", start("y", height))


def sanity(stats: DataFrame, images: DataFrame, height: int, width: int, params: Params = DEFAULT, chosen: DataFrame | None = None) -> DataFrame:
    """img and sanity of every image (img, and cov where its coverage is known) for its main object, or the component chosen otherwise
    (rows of stats), which may touch the border: the first rule that speaks."""
    main = crop_square(main_objects(stats) if chosen is None else chosen, height, width)
    others = stats.select("img", F.col("label").alias("l2"), F.col("area").alias("a2"), F.col("cx").alias("cx2"), F.col("cy").alias("cy2"))
    inside = (F.col("cx2") >= F.col("x0")) & (F.col("cx2") < F.col("x0") + F.col("side")) & (F.col("cy2") >= F.col("y0")) & (F.col("cy2") < F.col("y0") + F.col("side"))
    crowded = main.join(others, "img").where((F.col("l2") != F.col("label")) & (F.col("a2") >= SECOND * F.col("area")) & inside).select("img").distinct().withColumn("crowded", F.lit(True))
    share = F.col("area") / (height * width)
    rule = F.when(F.col("area").isNull(), "NO_OBJECT").when(F.col("touches_border"), "TOUCHES_BORDER").when(share < MIN_FRACTION, "TOO_SMALL").when(share > MAX_FRACTION, "TOO_LARGE").when(F.col("crowded"), "MULTIPLE")
    if "cov" in images.columns:
        rule = rule.when(~F.exists("cov", lambda c: c >= params.core_threshold), "NO_CORE")
    rule = rule.otherwise("OK")
    return images.select("img", *(["cov"] if "cov" in images.columns else [])).dropDuplicates(["img"]).join(main, "img", "left").join(crowded, "img", "left").select("img", rule.alias("sanity"))


def shapes(labelled: DataFrame) -> DataFrame:
    """img, label, area, hu1, aspect, theta and fill: moments in one pass (of whole numbers, exact),
    the extents along the axes in a second."""
    by = ["img", "label"]
    x, y = (F.col(c).cast("long") for c in ("x", "y"))
    sums = labelled.groupBy(*by).agg(F.count("*").alias("area"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    central = lambda p, q, r: ((whole("area") * whole(p) - whole(q) * whole(r)).cast("double") / F.col("area"))
    s = sums.select(*by, "area", central("sxx", "sx", "sx").alias("m20"), central("syy", "sy", "sy").alias("m02"), central("sxy", "sx", "sy").alias("m11"))
    root = F.sqrt(F.pow(F.col("m20") - F.col("m02"), F.lit(2.0)) + 4 * F.col("m11") * F.col("m11"))
    high, low = (F.col("m20") + F.col("m02") + root) / 2, F.greatest(F.lit(0.0), (F.col("m20") + F.col("m02") - root) / 2)
    s = s.select(*by, "area", ((F.col("m20") + F.col("m02")) / (F.col("area") * F.col("area"))).alias("hu1"), F.when(high == 0, 1.0).otherwise(F.sqrt(low / high)).alias("aspect"), (0.5 * arc_tangent(2 * F.col("m11"), F.col("m20") - F.col("m02"))).alias("theta"))
    along = F.col("_cos") * F.col("x") + F.col("_sin") * F.col("y")
    across = F.col("_cos") * F.col("y") - F.col("_sin") * F.col("x")
    wide = labelled.join(s.select(*by, cosine(F.col("theta")).alias("_cos"), sine(F.col("theta")).alias("_sin")).hint("merge"), by).groupBy(*by).agg(((F.max(along) - F.min(along) + 1) * (F.max(across) - F.min(across) + 1)).alias("_box"))
    return s.join(wide.hint("merge"), by).withColumn("fill", F.col("area") / F.col("_box")).drop("_box")


def hull_area(points: Iterable[tuple[int, int]]) -> float:
    """Area of the convex hull: its lower and upper chains over the points from left to right, by the cross products of its edges."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return 0.0

    def side(ps: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for x, y in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out

    ring = side(pts)[:-1] + side(pts[::-1])[:-1]
    return abs(sum(a * d - b * c for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """img, label and area as they are, and the hull of each component's rows (y, first and last x)."""
    for batch in batches:
        y, low, high = (batch.column("rows").flatten().field(c).to_pylist() for c in ("y", "a", "b"))
        cuts = batch.column("rows").offsets.to_numpy() - batch.column("rows").offsets[0].as_py()
        hulls = [hull_area((x, yy) for k in range(s, e) for x in (low[k], high[k] + 1) for yy in (y[k], y[k] + 1)) for s, e in itertools.pairwise(cuts.tolist())]
        yield pa.record_batch([*(batch.column(c) for c in ("img", "label", "area")), pa.array(hulls, pa.float64())], ["img", "label", "area", "hull"])


def solidity(labelled: DataFrame) -> DataFrame:
    """img, label, hull and solidity. Only the ends of each row of a component can be on its hull, so few points reach a task."""
    ends = labelled.groupBy("img", "label", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n"))
    rows = ends.groupBy("img", "label").agg(F.sum("n").alias("area"), F.collect_list(F.struct("y", "a", "b")).alias("rows"))
    shape = StructType([*(rows.schema[c] for c in ("img", "label", "area")), StructField("hull", DoubleType())])
    return rows.mapInArrow(_hulls, shape).withColumn("solidity", F.col("area") / F.col("hull"))


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b  # fixed values


def sharpness(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """img and sharpness (variance of the Laplacian of v over inner pixels; 0 if there are fewer than 9) of pixels (img, y, x, v)."""
    cross = [(0, 0, -4.0), (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)]
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(k).alias("k")) for a, b, k in cross)))
    sent = pixels.select("img", "y", "x", "v", at.alias("d")).select("img", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), (F.col("v") * F.col("d.k")).alias("v"))
    inner = sent.where((F.col("y") >= 1) & (F.col("y") < height - 1) & (F.col("x") >= 1) & (F.col("x") < width - 1))
    lap = inner.groupBy("img", "y", "x").agg(F.sum("v").alias("l"))
    return lap.groupBy("img").agg(F.when(F.count("*") < 9, 0.0).otherwise(F.var_pop("l")).alias("sharpness"))


def flicker(pixels: DataFrame, height: int, by: str = "clip", uniform: bool = True) -> DataFrame:
    """by, banding, drift, pumping (%) and flicker of clips of pixels (by, frame, y, x, v): stripes within frames, their wander over
    frames, and the swing of frames' means. Fixed values: limits 1.5, 1.0 and 2 %, window a twelfth of the height, 5 at least."""
    half = max(5, height // 12) // 2
    rows = pixels.groupBy(by, "frame", "y").agg(F.avg("v").alias("row"), F.sum("v").alias("s"), F.count("*").alias("n"))
    trend = F.avg("row").over(W.partitionBy(by, "frame").orderBy("y").rowsBetween(-half, half))
    flat = rows.withColumn("d", F.col("row") - trend)
    frames = flat.groupBy(by, "frame").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), (F.sum("s") / F.sum("n")).alias("mean"))
    whole = frames.groupBy(by).agg(F.avg("rms").alias("banding"), F.when(F.avg("mean") > 1e-9, F.stddev_pop("mean") / F.avg("mean") * 100).otherwise(0.0).alias("pumping"))
    drift = flat.groupBy(by, "y").agg(F.stddev_pop("d").alias("std")).groupBy(by).agg(F.avg("std").alias("drift"))
    over = (F.col("drift") > 1.0) | (F.col("pumping") > 2.0) | (F.lit(uniform) & (F.col("banding") > 1.5))
    return whole.join(drift, by).withColumn("flicker", over)


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]], grow: float = 1.0) -> Column:
    """Even-odd rule, for a polygon grown about the mean of its corners."""
    mx, my = (sum(p[k] for p in polygon) / len(polygon) for k in (0, 1))
    pts = [(mx + (a - mx) * grow, my + (b - my) * grow) for a, b in polygon]
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(pts, [*pts[1:], pts[0]], strict=True):
        if ay != by:
            crossings = crossings + (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).cast("int")
    return crossings % 2 == 1


def angle_between(a: Column, b: Column) -> Column:
    """Of axes, so modulo half a turn."""
    off = F.pmod(a - b, F.lit(math.pi))
    return F.least(off, math.pi - off)


def shrunk(pixels: DataFrame, factor: int, channels: tuple[str, ...]) -> DataFrame:
    """img, y, x and channels of boxes of factor x factor pixels: means, half up."""
    return pixels.groupBy("img", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(*(F.floor(F.avg(c) + 0.5).alias(c) for c in channels))


def adapted(medians: DataFrame, by: str, mu: str, params: Params = DEFAULT) -> DataFrame:
    """by, t, and mu after each empty frame's median m in order of t: a slow average that starts from column mu."""
    rows = medians.select(by, "t", F.col("m").cast("double"), F.col(mu).cast("double").alias("start"))

    def step(last: float | None, row) -> tuple[float, float]:
        now = (1 - params.beta) * (row.start if last is None else last) + params.beta * row.m
        return now, now

    return folded(rows, by, ["t"], "mu double", None, step, spread=True).select(by, "t", "mu")
