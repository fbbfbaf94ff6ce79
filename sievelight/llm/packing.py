"""Best-fit packing with bounds: a group of pieces is done when its bins are as few as a dual-feasible function allows.

Documents become pieces of at most capacity tokens. Pieces are dealt to groups and packed by best-fit decreasing. Every dual-feasible
function f (sizes of any one bin sum to 1 at most under f) bounds the bins from below by the sum of f; a group that meets its bound is
certified and final. Groups with a gap keep their full bins, hand the documents of the others on, and what is handed on is dealt to
new groups and packed again. A new group keeps the bins that it was handed unless repacking needs fewer.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import WordIds

GROUP = 20_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and uid of every piece of every row: only documents over capacity are cut, the last piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer)
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(words.encode(t).astype("<u4"), np.uint32(end_id))
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    rows.append((d, k // capacity, k, len(part), zlib.crc32(part.tobytes()), at))
                    at += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{PIECE}, uid long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: largest first, each into the fullest bin that it fits."""
    bins = np.empty(len(sizes), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free in them
    free, made = 0, 0  # bit r of free: a bin has r tokens free
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = free >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            at = open_at[room].pop()
            if not open_at[room]:
                free &= ~(1 << room)
        else:
            room, at, made = capacity, made, made + 1
        bins[i] = at
        open_at[room - s].append(at)
        free |= 1 << (room - s)
    return bins


def bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of three families of dual-feasible functions over the histogram of sizes."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    s = np.flatnonzero(n)
    n = n[s]
    least = -(-int((s * n).sum()) // capacity)
    for cut in np.unique(np.concatenate([[0], s[2 * s <= capacity], capacity - s[2 * s > capacity]])).tolist():
        f = np.where(s > capacity - cut, capacity, np.where(s < cut, 0, s))  # large ones fill a bin, small ones count nothing
        least = max(least, -(-int((f * n).sum()) // capacity))
    for k in range(1, 21):  # thresholds at multiples of capacity / (k + 1): between them a size counts as its rank of k
        x = s * (k + 1)
        f = np.where(x % capacity == 0, s * k, (x // capacity) * capacity)
        least = max(least, -(-int((f * n).sum()) // (k * capacity)))
    return least


def repack(group: pd.DataFrame, capacity: int, first: bool) -> pd.DataFrame:
    """One group's bins, final where certified, full, or this group is handed on for the last time."""
    sizes = group["length"].to_numpy()
    bins = best_fit(sizes, capacity)
    made = int(bins.max(initial=-1)) + 1
    if not first:
        old, held = np.unique(group["sequence_id"].to_numpy(), return_inverse=True)
        if len(old) <= made:
            bins, made = held, len(old)
    fill = np.bincount(bins, weights=sizes, minlength=made)
    done = made <= bound(sizes, capacity)
    order = np.lexsort([group["uid"].to_numpy(), bins])
    out = group.iloc[order].copy()
    b, n = bins[order], sizes[order]
    ends = np.cumsum(n)
    opens = np.flatnonzero(np.diff(b, prepend=-1))
    out["offset"] = ends - n - np.repeat((ends - n)[opens], np.diff(np.append(opens, len(b))))
    out["sequence_id"] = out["uid"].to_numpy()[opens][np.searchsorted(b[opens], b)]  # a bin is named after its first piece
    out["certified"] = done
    out["final"] = done | (fill[b] == capacity)
    return out


def _repacker(capacity: int, first: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda group: repack(group.drop(columns="g"), capacity, first)


def pack(parts: DataFrame, capacity: int, group: int = GROUP, most_rounds: int = 4) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for all of parts (as pieces() gives them); certified tells that the
    bins of a piece's last group are as few as its bound allows."""
    spark, kept = parts.sparkSession, []
    schema = f"{PIECE}, uid long, sequence_id long, offset long, certified boolean, final boolean"
    left = stored(parts, "pieces").withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long"), "certified": F.lit(False), "final": F.lit(False)})
    before = None
    for k in range(most_rounds):
        n = left.count()
        groups = max(1, n // group)
        if not n or groups == 1 and before == 1:
            break
        before = groups
        dealt = left.withColumn("g", F.pmod(F.xxhash64("sequence_id", F.lit(k)), F.lit(groups)))
        packed = stored(dealt.groupBy("g").applyInPandas(_repacker(capacity, k == 0), schema), "packed")
        kept.append(packed.where("final"))
        left = packed.where("not final")
    kept.append(left)
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Pack all documents. A null text counts as empty (its end id alone); repeated rows are packed as often as they come; equal
    sizes go in the order of rows; very long texts become as many pieces as they need; an empty table gives no rows; columns besides
    doc_id and text are not read."""
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity)
