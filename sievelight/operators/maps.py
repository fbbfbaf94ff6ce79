"""Feature maps as patch tables: one row a patch, with its frame, row and column on the grid."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions.vectors import doubles, l2_normalized
from ..params import DEFAULT, Params

#: Frames that are laid out at once.
FRAMES = 256


def exploded(frames: DataFrame, gw: int, dim: int, vector: str = "f", keep: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keep, p, r, c and f of every patch of row-major maps."""
    patches = F.size(vector) / dim
    return frames.select(*keep, F.col(vector).alias("_v"), F.explode(F.sequence(F.lit(0), F.floor(patches).cast("int") - 1)).alias("p")).select(*keep, "p", F.floor(F.col("p") / gw).cast("int").alias("r"), (F.col("p") % gw).alias("c"), doubles(F.slice("_v", F.col("p") * dim + 1, F.lit(dim))).alias("f"))


def _framed(patches: DataFrame, by: str, added: str, run: Callable[[_Grid, pa.StructArray], list[pa.Array]]) -> DataFrame:
    """patches with the columns that run adds. The patches of a frame meet once; frames are laid out side by side on a padded grid, many
    at a time, so that neighbours are shifted views of arrays."""
    names = [f.name for f in patches.schema]
    grouped = patches.groupBy(by).agg(F.collect_list(F.struct(*(F.col(c) for c in names))).alias("m")).select("m")
    extra = [x.split()[0] for x in added.split(", ")]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, FRAMES):
                m = b.column(0).slice(i, FRAMES)
                rows = m.flatten()
                if len(rows):
                    at = np.repeat(np.arange(len(m)), np.diff(m.offsets.to_numpy()))
                    grid = _Grid(at, *(rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("r", "c")))
                    yield pa.record_batch([*(rows.field(c) for c in names), *run(grid, rows)], [*names, *extra])

    schema = StructType([*patches.schema.fields, *StructType.fromDDL(added).fields])
    return grouped.mapInArrow(batches_of, schema)


class _Grid:
    """Places of patches of several frames, with a rim of empty places around each frame."""

    def __init__(self, frame: np.ndarray, r: np.ndarray, c: np.ndarray, rim: int = 2) -> None:
        self.low_r, self.low_c = r.min(), c.min()
        self.h, self.w = int(r.max() - self.low_r) + 1 + 2 * rim, int(c.max() - self.low_c) + 1 + 2 * rim
        self.at = (frame * self.h + r - self.low_r + rim) * self.w + c - self.low_c + rim
        self.size = (int(frame.max()) + 1) * self.h * self.w

    def laid(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, values.dtype)
        out[self.at] = values
        return out

    def around(self, laid: np.ndarray, reach: int) -> Iterator[np.ndarray]:
        """The value at each place of the neighbourhood of every patch."""
        for dr in range(-reach, reach + 1):
            for dc in range(-reach, reach + 1):
                yield laid[self.at + dr * self.w + dc]


def _flags(rows: pa.StructArray, name: str) -> np.ndarray:
    return np.array(rows.field(name).fill_null(False).to_numpy(zero_copy_only=False), bool)


def _numbers(rows: pa.StructArray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for nulls), and which there are."""
    col = rows.field(name)
    return col.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float), ~col.is_null().to_numpy(zero_copy_only=False)


def patch_sets(patches: DataFrame, params: Params = DEFAULT, by: str = "frame") -> DataFrame:
    """patches with in_core (enough covered), in_s and in_b (within one and two patches of the core; the grid's rim is outside)."""

    def run(grid: _Grid, rows: pa.StructArray) -> list[pa.Array]:
        cov, there = _numbers(rows, "cov")
        core = there & (cov >= params.core_threshold)
        laid = grid.laid(core)
        near = (np.logical_or.reduce(list(grid.around(laid, reach))) for reach in (1, 2))
        return [pa.array(x) for x in (core, *near)]

    return _framed(patches.drop("in_core", "in_s", "in_b"), by, "in_core boolean, in_s boolean, in_b boolean", run)


def with_smooth(patches: DataFrame, by: str = "frame") -> DataFrame:
    """patches with sm: mean of d over the 3x3 neighbourhood within S; null outside S and where no d is known."""

    def run(grid: _Grid, rows: pa.StructArray) -> list[pa.Array]:
        (d, there), inside = _numbers(rows, "d"), _flags(rows, "in_s")
        known = inside & there
        n = sum(x.astype(int) for x in grid.around(grid.laid(known), 1))
        total = sum(grid.around(grid.laid(np.where(known, d, 0.0)), 1))
        return [pa.array(total / np.maximum(n, 1), mask=~inside | (n == 0))]

    return _framed(patches.drop("sm"), by, "sm double", run)


def smoothed(patches: DataFrame, by: str = "frame") -> DataFrame:
    """by, r, c and sm of the patches in S."""
    return with_smooth(patches, by).where("in_s").select(by, "r", "c", "sm")


def edge_mean(patches: DataFrame, gh: int, gw: int, by: str = "frame") -> DataFrame:
    """by, r, c and sm: 3x3 mean of d, the rim repeated."""

    def run(grid: _Grid, rows: pa.StructArray) -> list[pa.Array]:
        d, _ = _numbers(rows, "d")
        r, c = (rows.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("r", "c"))
        laid, total = grid.laid(d), np.zeros(len(d))
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                step = (np.clip(r + dr, 0, gh - 1) - r) * grid.w + np.clip(c + dc, 0, gw - 1) - c
                total = total + laid[grid.at + step]
        return [pa.array(total / 9)]

    return _framed(patches.drop("sm"), by, "sm double", run).select(by, "r", "c", "sm")


def descriptors(patches: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """by and g: the sum of f over the core (over all if the core is empty) with length 1. Sums by element, so that it combines partially."""
    has = F.max("in_core")
    flat = patches.select(*by, "in_core", F.posexplode("f").alias("t", "x"))
    sums = flat.groupBy(*by, "t").agg(F.sum(F.when(F.col("in_core"), F.col("x"))).alias("core"), F.sum("x").alias("all"), has.alias("has"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", F.when(F.col("has"), F.col("core")).otherwise(F.col("all")).alias("x")))), lambda s: s["x"]).alias("v")).select(*by, l2_normalized(F.col("v")).alias("g"))


def _sound(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()


def frame_scores(patches: DataFrame, params: Params = DEFAULT, by: str = "frame", tau: str | None = None) -> DataFrame:
    """by, raw (largest sm over S; NaN if any isn't finite), fit (mean d over the core; NaN likewise), peak_r, peak_c (first of the
    largest over S), n_core, and with a column tau the share of the core above it."""
    bad_s, bad_core = F.max(F.when(F.col("in_s"), _sound(F.col("sm")))), F.max(F.when(F.col("in_core"), _sound(F.col("d"))))
    nan = F.lit(float("nan"))
    peak = F.max(F.when(F.col("in_s"), F.struct("sm", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))))
    aggs = [
        F.when(F.coalesce(bad_s, F.lit(True)), nan).otherwise(F.max(F.when(F.col("in_s"), F.col("sm")))).alias("raw"),
        F.when(F.coalesce(bad_core, F.lit(True)), nan).otherwise(F.sum(F.when(F.col("in_core"), F.col("d"))) / F.count_if("in_core")).alias("fit"),
        (-peak["r"]).alias("peak_r"),
        (-peak["c"]).alias("peak_c"),
        F.count_if("in_core").alias("n_core"),
    ]
    if tau:
        over = F.col("in_core") & (F.col("sm") > F.col(tau) * params.sensitivity)
        aggs.append((F.count_if(over) / F.greatest(F.count_if("in_core"), F.lit(1))).alias("anomalous"))
    return patches.groupBy(by).agg(*aggs)


def top_mean(patches: DataFrame, params: Params = DEFAULT, by: str = "frame") -> DataFrame:
    """by and raw: mean of the largest hundredth (one at least) of d over S; NaN if any of them isn't finite."""
    inside = patches.where("in_s").withColumns({"n": F.greatest(F.lit(1), F.ceil(F.count("*").over(W.partitionBy(by)) * params.top_fraction)), "bad": F.max(_sound(F.col("d"))).over(W.partitionBy(by))})
    ranked = inside.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.desc("d"), "r", "c")))
    return ranked.where("k <= n").groupBy(by).agg(F.when(F.max("bad"), F.lit(float("nan"))).otherwise(F.sum("d") / F.count("*")).alias("raw"))
