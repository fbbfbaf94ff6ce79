"""A region drawn by hand that follows the object in it: one polygon a stream, moved by each frame's pick.

Of a frame's components those whose centre lies in the (slightly grown) region are its pieces, and of a tap also the one under its
middle; the largest grows by pieces near it into the object. Where that keeps off the border, the region moves with its centre, and a
tap becomes a box around it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from .tracker import keyed_state

#: How much wider the region is for the test; pieces by share of the largest, and their reach by share of the longer side;
#: a box around a tapped object; a stroke shorter than TAP of the diagonal is a tap, a circle of RADIUS of the shorter side with CORNERS.
GROW, LEAST, REACH, BOX, TAP, RADIUS, CORNERS = 1.15, 0.03, 0.35, 1.5, 0.04, 0.06, 16
PIECES = ["label", "area", "cx", "cy", "min_x", "min_y", "max_x", "max_y", "border", "rle"]
STATE = "xs array<double>, ys array<double>, tap boolean, last_x double, last_y double"
PICKS = "stream long, t_ms long, found boolean, pieces array<long>, area long, cx double, cy double, border boolean, xs array<double>, ys array<double>"


@dataclass
class Region:
    xs: list[float]
    ys: list[float]
    tap: bool = False

    @classmethod
    def drawn(cls, px: list[float], py: list[float], width: int, height: int) -> Region | None:
        """The region of a stroke; None of no points."""
        if not len(px):
            return None
        if len(px) >= 3 and math.hypot(max(px) - min(px), max(py) - min(py)) >= TAP * math.hypot(width, height):
            return cls(list(px), list(py))
        x, y, r = sum(px) / len(px), sum(py) / len(py), RADIUS * min(width, height)
        turns = [2 * math.pi * k / CORNERS for k in range(CORNERS)]
        return cls([x + r * math.cos(a) for a in turns], [y + r * math.sin(a) for a in turns], True)

    def middle(self) -> tuple[float, float]:
        return sum(self.xs) / len(self.xs), sum(self.ys) / len(self.ys)

    def holds(self, x: float, y: float, grow: float = 1.0) -> bool:
        mx, my = self.middle()
        x, y = mx + (x - mx) / grow, my + (y - my) / grow
        edges = zip(self.xs, self.ys, [*self.xs[-1:], *self.xs[:-1]], [*self.ys[-1:], *self.ys[:-1]], strict=True)
        return sum((b > y) != (d > y) and x < a + (y - b) * (c - a) / (d - b) for a, b, c, d in edges) % 2 == 1

    def moved(self, dx: float, dy: float) -> Region:
        return Region([x + dx for x in self.xs], [y + dy for y in self.ys], self.tap)


def _under(p: dict, x: float, y: float) -> bool:
    """Whether the pixel at x, y is one of the piece's, by its mask (runs over its box, zeros first)."""
    x, y = int(x), int(y)
    if p["rle"] is None or not (p["min_x"] <= x <= p["max_x"] and p["min_y"] <= y <= p["max_y"]):
        return False
    at, bit = (y - p["min_y"]) * (p["max_x"] - p["min_x"] + 1) + x - p["min_x"], 0
    for run in p["rle"]:
        if at < run:
            return bit == 1
        at, bit = at - run, 1 - bit
    return False


def picked(region: Region, pieces: list[dict], min_area: int) -> dict | None:
    """The object in the region: the largest piece and what lies near it, and near what they make of it."""
    x, y = region.middle()
    inside = [p for p in pieces if p["area"] >= min_area and (region.holds(p["cx"], p["cy"], GROW) or region.tap and _under(p, x, y))]
    if not inside:
        return None
    main = max(inside, key=lambda p: (p["area"], -p["label"]))
    own, rest = [main], sorted((p for p in inside if p is not main and p["area"] >= LEAST * main["area"]), key=lambda p: p["label"])
    x0, y0, x1, y1 = (main[c] for c in ("min_x", "min_y", "max_x", "max_y"))
    while True:
        reach = REACH * max(x1 - x0 + 1, y1 - y0 + 1)
        near = [p for p in rest if max(0, p["min_x"] - x1, x0 - p["max_x"]) <= reach and max(0, p["min_y"] - y1, y0 - p["max_y"]) <= reach]
        if not near:
            break
        own += near
        rest = [p for p in rest if p not in near]
        x0, y0, x1, y1 = min(p["min_x"] for p in own), min(p["min_y"] for p in own), max(p["max_x"] for p in own), max(p["max_y"] for p in own)
    area = sum(p["area"] for p in own)
    mean = lambda c: sum(p[c] * p["area"] for p in own) / area
    return {"labels": sorted(p["label"] for p in own), "area": area, "cx": mean("cx"), "cy": mean("cy"), "box": (x0, y0, x1, y1), "border": any(p["border"] for p in own)}


def followed(region: Region, last: tuple[float, float] | None, found: dict | None) -> tuple[Region, tuple[float, float] | None]:
    """The region and the last centre after a frame."""
    if found is None or found["border"]:
        return region, last
    if region.tap:
        x0, y0, x1, y1 = found["box"]
        mx, my, hw, hh = (x0 + x1 + 1) / 2, (y0 + y1 + 1) / 2, (x1 - x0 + 1) * BOX / 2, (y1 - y0 + 1) * BOX / 2
        region = Region([mx - hw, mx + hw, mx + hw, mx - hw], [my - hh, my - hh, my + hh, my + hh])
    elif last is not None:
        region = region.moved(found["cx"] - last[0], found["cy"] - last[1])
    return region, (found["cx"], found["cy"])


class Following(StatefulProcessor):
    def __init__(self, width: int, height: int, min_area: int):
        self.width, self.height, self.min_area = width, height, min_area

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.region = handle.getValueState("region", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        region = last = None
        if self.region.exists():
            xs, ys, tap, x, y = self.region.get()
            region, last = Region(list(xs), list(ys), tap), None if x is None else (x, y)
        out = []
        batch = pd.concat(list(rows)).sort_values(["t_ms", "label"], kind="stable")
        for t, frame in batch.groupby("t_ms", sort=True):
            for stroke in frame[frame["px"].notna()].to_dict("records"):
                region, last = Region.drawn(list(stroke["px"]), list(stroke["py"]), self.width, self.height) or region, None
            if region is None:
                continue
            pieces = [{**p, "label": int(p["label"]), "area": int(p["area"])} for p in frame[frame["label"].notna()][PIECES].to_dict("records")]
            found = picked(region, pieces, self.min_area)
            region, last = followed(region, last, found)
            told = (True, found["labels"], found["area"], found["cx"], found["cy"], found["border"]) if found else (False, None, None, None, None, None)
            out.append((int(key[0]), int(t), *told, region.xs, region.ys))
        if region is not None:
            self.region.update((region.xs, region.ys, region.tap, *(last or (None, None))))
        yield pd.DataFrame(out, columns=["stream", "t_ms", "found", "pieces", "area", "cx", "cy", "border", "xs", "ys"]).astype({"area": "Int64", "border": "boolean"})

    def close(self) -> None:
        pass


def follow(rows: DataFrame, width: int, height: int, min_area: int = 30) -> DataFrame:
    """The pick and the region after each frame of a streaming DataFrame of components (stream, t_ms, label, area, cx, cy, min_x, min_y,
    max_x, max_y, border, rle: the mask over the box, or null) and strokes (stream, t_ms, px, py); a frame without components is a row of
    nulls. Frames before a stream's first stroke say nothing. Rows should come in order of time (run_available has slices)."""
    keyed_state(rows.sparkSession)
    whole = rows.select(F.col("stream").cast("long"), F.col("t_ms").cast("long"), *(F.col(c).cast("long") for c in ("label", "area")), *(F.col(c).cast("double") for c in ("cx", "cy")), *(F.col(c).cast("int") for c in ("min_x", "min_y", "max_x", "max_y")), F.col("border").cast("boolean"), F.col("rle").cast("array<int>"), *(F.col(c).cast("array<double>") for c in ("px", "py")))
    return whole.groupBy("stream").transformWithStateInPandas(Following(width, height, min_area), PICKS, "Append", "None")
