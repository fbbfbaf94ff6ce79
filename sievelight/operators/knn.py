"""Exact nearest-neighbour joins against memory banks.

Queries and banks are packed into tiles of rows that share a key, as many rows as TILE_BYTES hold. Tiles of one key meet in pairs, dealt by
key and both tiles, so a hot key's work spreads over all tasks, each with one pair at a time. Of long vectors a matrix product finds the
nearest row of each pair, whose distance is then computed exactly; of short ones boxes around neighbouring rows leave most of the bank
out. The best over all pairs is a grouped minimum. Every tile is sent once a tile that it meets, so what is shuffled falls with the size
of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import squared_distance

#: Bytes of a tile's rows (of each: ROW_BYTES and 8 a number), and numbers of a block of distances.
TILE_BYTES, ROW_BYTES, BLOCK = 16 << 20, 56, 1 << 22
#: Rows in a box, and the longest vectors that are looked for by boxes.
LEAF, SHORT = 64, 8


def _tiles(df: DataFrame, key: str, id_col: str, mask: str | None, vector: str, tile: int | None) -> tuple[DataFrame, DataFrame]:
    """(key, tile, ids, masks and vectors of the rows), (key, tiles: as many as its rows ask for)."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), (F.lit(0) if mask is None else F.col(mask)).cast("long").alias("mask"), F.col(vector).cast("array<double>").alias("f"))
    held = F.greatest(F.lit(1), F.floor(TILE_BYTES / (ROW_BYTES + 8 * F.max(F.size("f"))))) if tile is None else F.lit(tile)
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / held).alias("tiles"))
    dealt = rows.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    return dealt.groupBy("key", "tile").agg(F.collect_list(F.struct("id", "mask", "f")).alias("rows")), sizes


def paired(queries: tuple[DataFrame, DataFrame], banks: tuple[DataFrame, DataFrame], parts: int) -> DataFrame:
    """key, rows and bank of every pair of tiles of a key, in that many partitions."""
    (q, q_sizes), (b, b_sizes) = queries, banks
    upto = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    left = q.join(b_sizes, "key").select("key", "tile", upto.alias("other"), "rows")
    right = b.join(q_sizes, "key").select("key", F.col("tile").alias("other"), upto.alias("tile"), F.col("rows").alias("bank"))
    dealt = lambda df: df.repartition(parts, "key", "tile", "other")
    return dealt(left).hint("merge").join(dealt(right), ["key", "tile", "other"]).select("key", "rows", "bank")


def _exact(q: np.ndarray, b: np.ndarray, how: str) -> np.ndarray:
    """Squared distances or inner products of rows, summed in index order."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], b.shape[:-1]))
    for k in range(q.shape[-1]):
        d = q[..., k] - b[..., k] if how == "distance" else q[..., k]
        out += d * (d if how == "distance" else b[..., k])
    return out


def _boxes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows in which LEAF at most that lie close together follow each other, where these begin, and the corners of their boxes."""
    leaves, stack = [], [np.arange(len(f))]
    while stack:
        at = stack.pop()
        if len(at) <= LEAF:
            leaves.append(at)
        else:
            x = f[at, np.argmax(np.ptp(f[at], axis=0))]
            half = np.argpartition(x, len(at) // 2)
            stack += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    starts = np.cumsum([0, *map(len, leaves)])
    order = np.concatenate(leaves)
    return order, starts, np.minimum.reduceat(f[order], starts[:-1]), np.maximum.reduceat(f[order], starts[:-1])


def _near_short(q: tuple, b: tuple, masked: bool, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries that have one, and distance and id of the nearest. Boxes are taken from the nearest on, until none can hold better."""
    (qi, qm, qf), (bi, bm, bf) = q, b
    there, known = np.flatnonzero(np.isfinite(qf).all(1)), np.isfinite(bf).all(1)
    bi, bm, bf = bi[known], bm[known], bf[known]
    best, other = np.full(len(qi), np.inf), np.full(len(qi), np.iinfo(np.int64).max)
    if len(there) and len(bi):
        b_order, b_starts, low, high = _boxes(bf)
        bi, bm, bf = bi[b_order], bm[b_order], bf[b_order]
        q_order, q_starts, q_low, q_high = _boxes(qf[there])
        for leaf in range(len(q_low)):
            at = there[q_order[q_starts[leaf] : q_starts[leaf + 1]]]
            apart = _exact(np.maximum(0, np.maximum(low - q_high[leaf], q_low[leaf] - high)), np.zeros_like(low), "distance")
            nearest_first, done, take = np.argsort(apart, kind="stable"), 0, 4
            while done < len(nearest_first):
                some = nearest_first[done : done + take]
                some = some[apart[some] <= best[at].max()]
                if not len(some):
                    break
                c = np.concatenate([np.arange(b_starts[k], b_starts[k + 1]) for k in some])
                d = _exact(qf[at][:, None], bf[c][None], "distance")
                if masked:
                    d[qm[at][:, None] == bm[c][None]] = np.inf
                if own:
                    d[qi[at][:, None] == bi[c][None]] = np.inf
                least = d.min(1)
                who = np.where((d == least[:, None]) & np.isfinite(d), bi[c][None], np.iinfo(np.int64).max).min(1)
                other[at] = np.where(least < best[at], who, np.where(least == best[at], np.minimum(who, other[at]), other[at]))
                best[at] = np.minimum(best[at], least)
                done, take = done + take, min(2 * take, 64)
    r = np.flatnonzero(np.isfinite(best))
    return r, best[r], other[r]


def _near_long(q: tuple, b: tuple, masked: bool, own: bool, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by blocks of a matrix product."""
    (qi, qm, qf), (bi, bm, bf) = q, b
    step, found = max(1, BLOCK // max(1, len(bi))), []
    for i in range(0, len(qi), step):
        s = slice(i, i + step)
        values = -2 * qf[s] @ bf.T + (bf * bf).sum(1) if how == "distance" else -(qf[s] @ bf.T)
        values[np.isnan(values)] = np.inf
        if masked:
            values[qm[s, None] == bm[None, :]] = np.inf
        if own:
            values[qi[s, None] == bi[None, :]] = np.inf
        low = values.min(1)
        near = low + 1e-9 * (1 + np.abs(low))  # what rounding could hide is compared exactly
        r, c = np.nonzero((values <= near[:, None]) & np.isfinite(values))
        exact = _exact(qf[s][r], bf[c], how)
        order = np.lexsort([bi[c], exact if how == "distance" else -exact, r])
        first = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
        found.append((r[first] + i, exact[first], bi[c[first]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(queries: DataFrame, bank: DataFrame, key: str | tuple[str, str], query_id: str = "id", bank_id: str = "id", mask: str | None = None, vector: str = "f", how: str = "distance", own: bool = False, tile: int | None = None) -> DataFrame:
    """key, id, best and other: the nearest bank row of each query with its key.

    how: "distance" (least squared Euclidean distance) or "dot" (largest inner product). mask: rows with an equal mask are passed over
    (leave-group-out); own: the row with the query's own id is. Queries left without a bank row are absent. Vectors with a NaN are
    never the nearest and have none. tile: rows of a tile, where their bytes are not to decide.
    """
    qk, bk = (key, key) if isinstance(key, str) else key
    q = _tiles(queries, qk, query_id, mask, vector, tile)
    b = _tiles(bank, bk, bank_id, mask, vector, tile)
    masked = mask is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                qs, bs = _matrix(one.column(1)), _matrix(one.column(2))
                short = how == "distance" and qs[2].shape[1] <= SHORT
                at, exact, other = _near_short(qs, bs, masked, own) if short else _near_long(qs, bs, masked, own, how)
                key_col = one.column(0).take(pa.array(np.zeros(len(at), np.int64)))
                yield pa.record_batch([key_col, pa.array(qs[0][at]), pa.array(exact), pa.array(other)], ["key", "id", "best", "other"])

    kind = q[1].schema["key"].dataType.simpleString()
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = paired(q, b, parts).mapInArrow(run, f"key {kind}, id long, best double, other long")
    best = F.min(F.struct("best", "other")) if how == "distance" else F.max(F.struct("best", (-F.col("other")).alias("other")))
    out = found.groupBy("key", "id").agg(best.alias("b"))
    return out.select("key", "id", F.col("b.best").alias("best"), (F.col("b.other") if how == "distance" else -F.col("b.other")).alias("other"))


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = col.flatten()
    f = rows.field("f")
    n = len(rows)
    return rows.field("id").to_numpy(), rows.field("mask").to_numpy(), f.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def nearest_sql(queries: DataFrame, bank: DataFrame, key: str, query_id: str = "id", bank_id: str = "id", mask: str | None = None, vector: str = "f") -> DataFrame:
    """The same by a join and a grouped minimum alone: for small banks, and one of the two backends that a caller may choose from."""
    q = queries.select(F.col(key).alias("key"), F.col(query_id).alias("id"), F.col(vector).cast("array<double>").alias("q"), (F.lit(0) if mask is None else F.col(mask)).alias("qm"))
    b = bank.select(F.col(key).alias("key"), F.col(bank_id).alias("other"), F.col(vector).cast("array<double>").alias("b"), (F.lit(1) if mask is None else F.col(mask)).alias("bm"))
    pairs = q.join(b, "key").where("qm <> bm").select("key", "id", "other", squared_distance(F.col("q"), F.col("b")).alias("best"))
    return pairs.groupBy("key", "id").agg(F.min(F.struct("best", "other")).alias("b")).select("key", "id", "b.best", "b.other")


def most_alike(queries: DataFrame, bank: DataFrame, k: int, key: str, mask: str | None = "id", vector: str = "f", tile: int | None = None) -> DataFrame:
    """key, id, place (from 1), other and sim of the k bank rows with the largest inner product with each query of their key; of equal
    ones (to 12 decimals) the lower id first. Rows with an equal mask are passed over. The best k of each pair of tiles are merged by query."""
    q, b = (_tiles(df, key, "id", mask, vector, tile) for df in (queries, bank))
    masked = mask is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                (qi, qm, qf), (bi, bm, bf) = _matrix(one.column(1)), _matrix(one.column(2))
                step = max(1, BLOCK // len(bi))
                for j in range(0, len(qi), step):
                    s = slice(j, j + step)
                    sims = qf[s] @ bf.T
                    sims[np.isnan(sims)] = -np.inf
                    if masked:
                        sims[qm[s, None] == bm[None, :]] = -np.inf
                    least = np.partition(sims, max(0, len(bi) - k), axis=1)[:, max(0, len(bi) - k)]
                    r, c = np.nonzero((sims >= least[:, None] - 1e-9) & np.isfinite(sims))  # ties to 12 decimals among them
                    exact = _exact(qf[s][r], bf[c], "dot")
                    order = np.lexsort([bi[c], -np.round(exact, 12), r])
                    place = np.arange(len(r)) - np.searchsorted(r[order], r[order])
                    kept = order[place < k]
                    r, c = r[kept], c[kept]
                    key_col = one.column(0).take(pa.array(np.zeros(len(r), np.int64)))
                    yield pa.record_batch([key_col, pa.array(qi[s][r]), pa.array(bi[c]), pa.array(exact[kept])], ["key", "id", "other", "sim"])

    kind = q[1].schema["key"].dataType.simpleString()
    found = paired(q, b, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, f"key {kind}, id long, other long, sim double")
    place = F.row_number().over(W.partitionBy("key", "id").orderBy(F.desc(F.round("sim", 12)), "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)
