"""Power levels with hysteresis: a level rises at once and falls after a time that the target has stayed lower."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.telemetry import folded
from ..params import DEFAULT

# Status and headroom from which on a level is due, and frames a second of each level and when idle.
L2_STATUS, L2_OVER, L1_STATUS, L1_FROM = 3, 0.85, 2, 0.70
FPS, IDLE_FPS = (30, 24, 15), 2


def target(status: Column, headroom: Column) -> Column:
    known = headroom.isNotNull() & ~F.isnan(headroom)
    return F.when((status >= L2_STATUS) | (known & (headroom > L2_OVER)), 2).when((status >= L1_STATUS) | (known & (headroom >= L1_FROM)), 1).otherwise(0)


def fps(level: Column, idle: Column) -> Column:
    return F.when(idle, IDLE_FPS).otherwise(F.element_at(F.array(*map(F.lit, FPS)), level + 1))


def fall(rows: list[tuple[int, int]], level: int, since: int | None, cooldown: int) -> tuple[list[int], int, int | None]:
    """Levels after each (t, target) in turn, and the state to go on from: the level and since when the target has been lower."""
    out = []
    for t, due in rows:
        since = (t if since is None else since) if due < level else None
        if due > level or since is not None and t - since >= cooldown:
            level, since = due, None
        out.append(level)
    return out, level, since


def governed(samples: DataFrame, cooldown_ms: int = DEFAULT.cooldown_ms) -> DataFrame:
    """id, stream, t_ms, target and level of a streaming DataFrame of samples (id, stream, t_ms, status, headroom)."""
    due = samples.select(F.col("id").cast("long"), F.col("stream").cast("long"), F.col("t_ms").cast("long"), target(F.col("status"), F.col("headroom")).alias("target"))

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, since = state.get if state.exists else (0, None)
        rows = pd.concat(list(chunks)).sort_values(["t_ms", "id"], kind="stable")
        rows["level"], level, since = fall(list(zip(rows["t_ms"].tolist(), rows["target"].tolist(), strict=True)), level, since, cooldown_ms)
        state.update((level, since))
        yield rows[["id", "stream", "t_ms", "target", "level"]]

    return due.groupBy("stream").applyInPandasWithState(run, "id long, stream long, t_ms long, target int, level int", "level int, since long", "append", "NoTimeout")


def levels(samples: DataFrame, cooldown_ms: int = DEFAULT.cooldown_ms) -> DataFrame:
    """The same over stored samples: each stream's samples in order of time, as they flow through a task."""
    due = samples.select(F.col("id").cast("long"), F.col("stream").cast("long"), F.col("t_ms").cast("long"), target(F.col("status"), F.col("headroom")).alias("target"))

    def step(state: tuple, row) -> tuple[tuple, int]:
        (level,), at, since = fall([(row.t_ms, row.target)], *state, cooldown_ms)
        return (at, since), level

    return folded(due, "stream", ["t_ms", "id"], "level int", (0, None), step, spread=True)
