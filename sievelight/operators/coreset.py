"""Greedy k-centre sampling: the row farthest from those chosen, again and again, many steps a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, stored
from .telemetry import latest

#: Rows in a tile, candidates that a tile offers in a round, and that a group takes.
TILE, OFFERED, TAKEN = 1024, 64, 1024


def bank_rows(pooled: Column, ratio: float = 0.10, least: int = 256, most: int = 2400) -> Column:
    """How many of the pooled rows a bank keeps."""
    return F.least(pooled, F.least(F.lit(most), F.greatest(F.lit(least), F.floor(ratio * pooled)))).cast("long")


def _gaps(f: np.ndarray, c: np.ndarray, how: str) -> np.ndarray:
    return ((f - c) ** 2).sum(1) if how == "distance" else 1 - (f * c).sum(1)


def _greedy(rows: pd.DataFrame, how: str, most: int, least: int | None, eps: float | None) -> list[tuple]:
    """(step, id, gap, f) chosen among candidates, as long as each is surely the farthest of its whole group: all rows that are not
    candidates come after the bound (gap, id) of every row here."""
    rows = rows.sort_values(["gap", "id"], ascending=[False, True], ignore_index=True)
    bounds = list(zip(-rows["bound_gap"], rows["bound_id"], strict=True))
    bound = min((b for b in bounds if b[0] == b[0]), default=(np.inf, 0))
    if len(rows) > TAKEN:
        bound = min(bound, (-rows["gap"][TAKEN], rows["id"][TAKEN]))
    rows = rows[:TAKEN]
    ids, gap, f = rows["id"].to_numpy(), rows["gap"].to_numpy(copy=True), np.stack(rows["f"].to_list())
    step, k, out = int(rows["step"][0]), int(min(rows["k"][0], most)), []
    while step < k:
        at = np.lexsort([ids, -gap])[0]
        if gap[at] < 0 or not (-gap[at], ids[at]) < bound:
            break
        if eps is not None and step >= (least or 0) and gap[at] < eps:
            break
        out.append((step, int(ids[at]), float(gap[at]), f[at].tolist()))
        gap = np.where(gap < 0, gap, np.minimum(gap, _gaps(f, f[at], how)))
        gap[at] = -1.0
        step += 1
    return out


def k_centre(rows: DataFrame, k: int | str, by: str = "twin", id_col: str = "id", vector: str = "f", how: str = "distance", first: Column | None = None, least: int | None = None, eps: float | None = None) -> DataFrame:
    """by, step (from 0), id and gap of the chosen rows: the first row (of the largest `first`; then the lowest id), then each time the
    row farthest from those chosen; of equal ones the lowest id. k is a number or a column that says how many a group gives; smaller
    groups give all of theirs. how: "distance" (squared) or "dot" (1 less the inner product). With eps, a group that has `least` rows
    stops where the farthest is nearer than eps.

    Tiles keep their rows' gaps. In a round each offers its farthest rows and says how far any other can be; a group chooses from what
    is offered until that bound might hide a farther row, which is exact, and the tiles learn of the new rows. So a step costs a round
    at worst, and many steps share one as a rule; no group's rows meet in one task.
    """
    base = rows.select(F.col(by).alias("by"), F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("f"), (F.lit(k) if isinstance(k, int) else F.col(k)).cast("long").alias("k"), (F.lit(0) if first is None else first).alias("first"))
    base = stored(base, "centre-rows")
    start = base.groupBy("by").agg(F.max_by(F.struct("id", "f"), F.struct("first", (-F.col("id")).alias("minus"))).alias("b"), F.max("k").alias("k"))
    new = stored(start.where("k > 0").select("by", F.lit(0).cast("long").alias("step"), "b.id", F.lit(None).cast("double").alias("gap"), "b.f"), "centres")
    sizes = base.groupBy("by").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.max("k").alias("k"))
    packed = base.join(sizes.select("by", "tiles"), "by").groupBy("by", F.pmod(F.xxhash64("id"), F.col("tiles")).alias("tile")).agg(F.collect_list(F.struct("id", "f", F.lit(float("inf")).alias("gap"))).alias("rows"))
    kind, chosen, last = base.schema["by"].dataType.simpleString(), [new], None
    row = "struct<id:bigint,f:array<double>,gap:double>"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids, f, gap = np.array([x["id"] for x in r["rows"]], np.int64), np.array([x["f"] for x in r["rows"]], float), np.array([x["gap"] for x in r["rows"]])
                for c in r["chosen"]:
                    gap = np.where(gap < 0, gap, np.minimum(gap, _gaps(f, np.array(c["f"]), how)))
                    gap[ids == c["id"]] = -1.0
                gap[np.isnan(gap)] = -1.0  # never farthest
                order = np.lexsort([ids, -gap])
                order = order[gap[order] >= 0]
                told = lambda at: [{"id": int(ids[i]), "f": f[i].tolist(), "gap": float(gap[i])} for i in at]
                rest = order[OFFERED] if len(order) > OFFERED else None
                out.append((r["by"], r["tile"], told(range(len(ids))), told(order[:OFFERED]), None if rest is None else float(gap[rest]), None if rest is None else int(ids[rest])))
            if out:
                item = pa.list_(pa.struct([("id", pa.int64()), ("f", pa.list_(pa.float64())), ("gap", pa.float64())]))
                types = (b.schema.field("by").type, pa.int64(), item, item, pa.float64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["by", "tile", "rows", "offered", "bound_gap", "bound_id"])

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        found = _greedy(group, how, 1 << 60, least, eps)
        return pd.DataFrame([(group["by"].iloc[0], *x) for x in found], columns=["by", "step", "id", "gap", "f"])

    while True:
        added = new.groupBy("by").agg(F.collect_list(F.struct("id", "f")).alias("chosen"), (F.max("step") + 1).alias("step"))
        # a group that chose nothing is done and drops out
        tiles = stored(packed.join(added.select("by", "chosen"), "by").select("by", "tile", "rows", "chosen").mapInArrow(learn, f"by {kind}, tile long, rows array<{row}>, offered array<{row}>, bound_gap double, bound_id long"), "tiles")
        dropped(last)
        last, packed = tiles, tiles.select("by", "tile", "rows")
        bounds = tiles.where("bound_gap is not null").groupBy("by").agg(F.max(F.struct("bound_gap", (-F.col("bound_id")).alias("minus"))).alias("m"))
        steps = added.select("by", "step").join(sizes.select("by", "k"), "by").where("step < k").join(bounds, "by", "left")
        offered = latest(tiles.select("by", F.explode("offered").alias("o")).select("by", "o.id", "o.gap", "o.f"), ["by"], TAKEN + 1, F.desc("gap"), F.asc("id"))
        asked = offered.join(steps, "by").select("by", "id", "gap", "f", "step", "k", F.col("m.bound_gap").alias("bound_gap"), (-F.col("m.minus")).alias("bound_id"))
        new = stored(asked.groupBy("by").applyInPandas(pick, f"by {kind}, step long, id long, gap double, f array<double>"), "centres")
        if not new.limit(1).count():
            break
        chosen.append(new)
    out = chosen[0]
    for x in chosen[1:]:
        out = out.unionByName(x)
    dropped(last, base)
    return out.select(F.col("by").alias(by), F.col("step").cast("int").alias("step"), "id", "gap")
