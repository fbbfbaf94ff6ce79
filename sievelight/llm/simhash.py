"""SimHash near-duplicates: tiled exact comparison of fingerprints; near copies by Jaccard similarity, searched by bands of least hashes.

Fingerprints are compared in tiles. Tiles are sorted by population counts (of the whole fingerprint, then of its
16-bit parts); two tiles meet only if the least difference of their population counts, which no pair can undercut, is within the
radius. What meets is compared by numpy exclusive-or and bit counts, exactly. A task keeps only as many links as connect the same
fingerprints, so a large group of near copies costs one row a fingerprint, never one a pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import components, forest, met, mix64, numbered, stored

#: Fingerprints in a tile: what pairs of tiles move is the square of all over this. They are compared in parts, which are skipped alike.
TILE, PART = 32768, 512
#: Sets of LEAST to FEW shingles differ in one from what is 0.8 similar, if one holds the other, or not at all.
LEAST, FEW = 5, 9
#: Bytes of shingles, and sets, that are compared with as many at once, and the columns of such a row.
BUNDLE_BYTES, MOST_SETS = 2 << 20, 4096
#: Bands of least hashes, and hashes a band: sets of Jaccard similarity 0.8 share a band but for 5 in 10 million, of 0.1 in 5 of 100,000.
BANDS, ROWS = 48, 6
BUNDLE = ["tile", "lo", "hi", "component", "n", "node", "fps", "hashes"]


def shingles(text: bytes | None, shingle: int = 4, repeats: bool = True) -> np.ndarray:
    """XXH64 (seed 42) of each run of shingle words; without repeats, each different one once, in ascending order."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, n)
    xx = xxhash.xxh64_intdigest
    h = np.fromiter((xx(joined[a:b], 42) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)
    return h if repeats else np.unique(h)


def fingerprint(text: bytes | None, shingle: int = 4, lanes: int = 1, repeats: bool = True) -> np.ndarray:
    """lanes 64-bit words: bit set if it is in over half of the shingles' hashes. Lane 0 has XXH64 with seed 42; others scramble it.
    Without repeats each different shingle counts once."""
    return majority(shingles(text, shingle, repeats), lanes)


def majority(h: np.ndarray, lanes: int) -> np.ndarray:
    """The fingerprint of the shingles' hashes; zero where there are none."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(h) else 0):
        own = mix64(h + np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)) if lane else h
        ones = np.zeros(64, np.int64)
        for i in range(0, len(own), 1 << 16):
            bits = np.unpackbits(own[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int32)
        out[lane] = np.packbits(2 * ones > len(own), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, repeats: bool = True) -> DataFrame:
    """doc_id and fp (binary, 8 bytes a lane, big-endian) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle, lanes, repeats).astype(">u8").tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def _counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the 16-bit parts of each row, in as many int16 columns."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(len(fps), -1)).astype(np.int16)


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> int:
    """No fingerprint of one box differs from one of the other in fewer bits."""
    return int(np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a)).sum())


def near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j of a and b (lanes in columns) that differ in at most radius bits."""
    d = np.zeros((len(a), len(b)), np.uint16)
    for lane in range(a.shape[1]):
        d += np.bitwise_count(a[:, lane, None] ^ b[None, :, lane])
        if lane and lane + 1 < a.shape[1] and 32 * (lane + 1) - 8 * (lane + 1) ** 0.5 > radius:  # few random pairs are left
            i, j = np.nonzero(d <= radius)
            d = d[i, j] + np.bitwise_count(a[i, lane + 1 :] ^ b[j, lane + 1 :]).sum(1, dtype=np.uint16)
            return i[d <= radius], j[d <= radius]
    return np.nonzero(d <= radius)


def _tiles(distinct: DataFrame, lanes: int, tile: int) -> DataFrame:
    """Rows of up to tile fingerprints: their range of population counts, box (lowest, highest of the parts), and packed content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int]] = []
        number = itertools.count(TaskContext.get().partitionId() << 33)

        def rows(part: list[tuple[bytes, int]]) -> pa.RecordBatch:
            fps = np.frombuffer(b"".join(x for x, _ in part), ">u8").astype(np.uint64).reshape(-1, lanes)
            nodes = np.array([x for _, x in part], np.int64)
            c = _counts(fps)
            order = np.lexsort([*c.T[::-1], c.sum(1)])
            fps, nodes, c = fps[order], nodes[order], c[order]
            total = c.sum(1)
            return pa.record_batch([pa.array(x) for x in ([next(number)], [int(total.min())], [int(total.max())], [np.concatenate([c.min(0), c.max(0)]).astype(np.int16).tobytes()], [fps.tobytes()], [nodes.tobytes()])], ["tile", "lo", "hi", "box", "fps", "nodes"])

        for b in batches:
            held += zip(b.column("fp").to_pylist(), b.column("node").to_pylist(), strict=True)
            while len(held) >= tile:
                yield rows(held[:tile])
                held = held[tile:]
        if held:
            yield rows(held)

    n = max(1, -(-distinct.count() // tile))
    ones = sum((F.bit_count(F.conv(F.substring(F.hex("fp"), 8 * i + 1, 8), 16, 10).cast("long")) for i in range(1, 2 * lanes)), F.bit_count(F.conv(F.substring(F.hex("fp"), 1, 8), 16, 10).cast("long")))
    first = [F.bit_count(F.conv(F.substring(F.hex("fp"), 4 * i + 1, 4), 16, 10).cast("long")) for i in range(3)]
    keyed = distinct.withColumn("ones", ones).withColumns({f"c{i}": x for i, x in enumerate(first)})
    dealt = keyed.repartitionByRange(n, "ones", "c0", "c1", "c2", "fp").sortWithinPartitions("ones", "c0", "c1", "c2", "fp")
    return dealt.select("fp", "node").mapInArrow(run, "tile long, lo long, hi long, box binary, fps binary, nodes binary")


def links(distinct: DataFrame, radius: int, lanes: int = 1, tile: int = TILE) -> DataFrame:
    """Links (u, v) between nodes of distinct (fp, node) that connect what fingerprints at most radius bits apart connect.

    Which tiles meet is settled by their boxes alone; the fingerprints of a pair then travel once each to the task that compares them.
    """
    tiles = stored(_tiles(distinct, lanes, tile), "tiles")
    # a's range, widened by the radius, meets b's: an equality of population counts, taken once a pair at the first that both have
    left = tiles.select("tile", "lo", "box", F.explode(F.sequence(F.col("lo") - radius, F.col("hi") + radius)).alias("ones"))
    right = tiles.select(F.col("tile").alias("other"), F.col("lo").alias("other_lo"), F.col("box").alias("box2"), F.explode(F.sequence("lo", "hi")).alias("ones"))
    close = left.join(right, "ones").where(f"tile <= other and ones = greatest(lo - {radius}, other_lo)").select("tile", "other", "box", "box2")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            box, box2 = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int16).reshape(b.num_rows, 2, -1) for c in ("box", "box2"))
            gap = np.maximum(0, np.maximum(box[:, 0] - box2[:, 1], box2[:, 0] - box[:, 1])).sum(1)
            yield b.select(["tile", "other"]).filter(pa.array(gap <= radius))

    return met(stored(close.mapInArrow(apart, "tile long, other long"), "pairs"), tiles.select("tile", "fps", "nodes"), -(-distinct.count() // tile), lambda x, y: _compare(x, y, radius, lanes))


def _compare(x: dict, y: dict, radius: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    one = x is y
    none = np.empty(0, np.int64)
    a, b = (np.frombuffer(r["fps"], np.uint64).reshape(-1, lanes) for r in (x, y))
    na, nb = (np.frombuffer(r["nodes"], np.int64) for r in (x, y))
    ca, cb = _counts(a), _counts(b)
    boxes = lambda c: [(c[i : i + PART].min(0), c[i : i + PART].max(0)) for i in range(0, len(c), PART)]
    ba, bb = boxes(ca), boxes(cb)
    us, vs, held = [], [], 0
    for i, p_box in enumerate(ba):
        for j, q_box in enumerate(bb):
            if one and j < i or _gap(*p_box, *q_box) > radius:
                continue
            p, q = near(a[i * PART : (i + 1) * PART], b[j * PART : (j + 1) * PART], radius)
            if one and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                us.append(na[p + i * PART])
                vs.append(nb[q + j * PART])
                held += len(p)
                if held > 500_000:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], len(u)
    return forest(np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, lanes: int = 1, repeats: bool = True) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row: the smallest doc_id that links of at most radius bits reach.

    Null and word-less texts have fingerprint zero and are linked like any other; repeated rows come back as often as they came;
    a null doc_id has a fingerprint, a null component_id and links nothing. An empty table gives no rows. Other columns are not read.
    """
    fps = stored(fingerprints(docs, shingle, lanes, repeats), "simhash")
    distinct = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    found = components(links(distinct, radius, lanes))
    of = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(of, "fp", "left")
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _sets(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """Of every row: doc_id, its set of different shingles (by a 128-bit digest), their number n, fingerprint and bands; of sets of
    LEAST to FEW shingles also less, the digests of the sets without one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(h), _digest(h), majority(h, lanes).astype(">u8").tobytes(), [_digest(np.delete(h, i)) for i in range(len(h))] if LEAST <= len(h) <= FEW else None, least_hashes(h)) for h in (shingles(t, shingle, False) for t in b.column("text").to_pylist())]
            ns, digests, fps, less, lows = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            keys = bands(np.array(lows, np.uint32).reshape(-1, BANDS, ROWS)).ravel()
            own = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.record_batch([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(less, pa.list_(pa.binary())), own], ["doc_id", "set", "n", "fp", "less", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, set binary, n long, fp binary, less array<binary>, bands array<bigint>")


_MIX = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_FLIP, _TIMES = (_MIX >> np.uint64(32)).astype(np.uint32), _MIX.astype(np.uint32) | np.uint32(1)


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The least of the shingles' hashes by each of BANDS * ROWS ways to hash them again: of two sets, each is the same with a
    probability of their Jaccard similarity."""
    short, out = (h ^ h >> np.uint64(32)).astype(np.uint32), np.full(len(_TIMES), 2**32 - 1, np.uint32)
    for i in range(0, len(short), 512):
        np.minimum(out, ((short[i : i + 512, None] ^ _FLIP) * _TIMES).min(0), out=out)
    return out


def bands(lows: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of sets' least hashes (sets x BANDS x ROWS)."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), lows.shape[:2])
    for k in range(ROWS):
        keys = mix64((keys << np.uint64(1)) ^ (keys >> np.uint64(63)) ^ lows[:, :, k].astype(np.uint64))
    return np.ascontiguousarray(keys)


def candidates(sets: DataFrame) -> DataFrame:
    """Links (u, v) that connect the nodes of sets (node, bands) that share a band: each to the smallest that has it. Rows grow with the
    sets alone."""
    keyed = sets.select("node", F.explode("bands").alias("band"))
    first = F.first("node").over(W.partitionBy("band").orderBy("node").rowsBetween(W.unboundedPreceding, 0))
    return keyed.select(F.col("node").alias("u"), first.alias("v")).where("u <> v")


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.astype("<u8").tobytes())


def _bundles(docs: DataFrame, members: DataFrame, shingle: int, most_bytes: int) -> DataFrame:
    """The sets of members (set, n, fp, least, node, component) in rows of up to most_bytes of shingles (or one set) and MOST_SETS sets, by component and n."""
    cut = max(1, int((members.agg(F.sum("n")).first()[0] or 0) * 8 // (4 * most_bytes)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, shingle, False) for t in b.column("text").to_pylist()]
            own = pa.array([_digest(h) == d for h, d in zip(sets, b.column("set").to_pylist(), strict=True)], pa.bool_())
            yield pa.record_batch([*(b.column(c) for c in ("component", "n", "node", "fp")), pa.array([h.tobytes() for h in sets], pa.binary())], ["component", "n", "node", "fp", "hashes"]).filter(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        number = itertools.count(TaskContext.get().partitionId() << 33)

        def row() -> pa.RecordBatch:
            component, n, node, fp, hashes = zip(*held, strict=True)
            return pa.record_batch([pa.array([x]) for x in (next(number), component[0], component[-1], *(np.array(x, np.int64).tobytes() for x in (component, n, node)), np.frombuffer(b"".join(fp), ">u8").astype(np.uint64).tobytes(), b"".join(hashes))], BUNDLE)

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("component", "n", "node", "fp", "hashes")), strict=True):
                if held and (size + len(r[4]) > most_bytes or len(held) == MOST_SETS):
                    yield row()
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield row()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    of = members.select(F.col("least").alias("doc_id"), "set", "n", "fp", "node", "component")
    # one row a node: a doc_id may come back with the same text
    kept = texts.join(of.hint("merge"), "doc_id").select("text", "set", "component", "n", "node", "fp").mapInArrow(hashed, "component long, n long, node long, fp binary, hashes binary").dropDuplicates(["node"])
    dealt = kept.repartitionByRange(cut, "component", "n", "node").sortWithinPartitions("component", "n", "node")
    return dealt.mapInArrow(run, "tile long, lo long, hi long, component binary, n binary, node binary, fps binary, hashes binary")


def similar_links(bundles: DataFrame, radius: int, lanes: int, ratio: tuple[int, int]) -> DataFrame:
    """Links (u, v) that connect what pairs of bundled sets connect: of one component, at most radius bits apart, with a Jaccard
    similarity of ratio (as numerator, denominator) at least. Each pair is compared exactly, or its ends are connected already."""
    ends = bundles.select("tile", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("c"))
    # two bundles share at most the component at which one ends and the other begins
    pairs = ends.join(ends.withColumnRenamed("tile", "other"), "c").where("tile < other").select("tile", "other").union(bundles.select("tile", F.col("tile").alias("other"))).distinct()
    full = -(-(bundles.agg(F.sum(F.length("hashes"))).first()[0] or 0) // BUNDLE_BYTES)
    return met(stored(pairs, "pairs"), bundles.drop("lo", "hi"), full, lambda x, y: _similar(x, y, radius, lanes, ratio))


def _similar(x: dict, y: dict, radius: int, lanes: int, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    one = x is y
    (ca, na, ida, ha, fa), (cb, nb, idb, hb, fb) = ((*(np.frombuffer(r[k], np.int64) for k in ("component", "n", "node")), np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["fps"], np.uint64).reshape(-1, lanes)) for r in (x, y))
    words, at = np.unique(np.concatenate([ha, hb]), return_inverse=True)
    wa, wb = at[: len(ha)], at[len(ha) :]
    ea, eb = np.concatenate([[0], np.cumsum(na)]), np.concatenate([[0], np.cumsum(nb)])
    inside, (p, q), us, vs = np.zeros(len(words), bool), ratio, [], []
    for c in np.intersect1d(ca, cb):
        a, b = np.flatnonzero(ca == c), np.flatnonzero(cb == c)
        # connected[x] are labels of a's sets, then b's; one table where both are the same sets
        label = np.arange(len(a) if one else len(a) + len(b))
        shift = 0 if one else len(a)
        for start in range(0, len(a), PART):
            near_a, near_b = near(fa[a[start : start + PART]], fb[b], radius)
            cuts = np.searchsorted(near_a, np.arange(min(PART, len(a) - start) + 1))
            for i in range(start, min(start + PART, len(a))):
                j = near_b[cuts[i - start] : cuts[i - start + 1]]
                j = j[(label[shift + j] != label[i]) & (q * np.minimum(na[a[i]], nb[b[j]]) >= p * np.maximum(na[a[i]], nb[b[j]]))]
                if one:
                    j = j[j > i]
                if not len(j):
                    continue
                own, sizes = wa[ea[a[i]] : ea[a[i] + 1]], nb[b[j]]
                inside[own] = True
                common = np.add.reduceat(inside[np.concatenate([wb[eb[k] : eb[k + 1]] for k in b[j]])], np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
                inside[own] = False
                j = j[(p + q) * common >= p * (len(own) + sizes)]
                if len(j):
                    joined = np.unique(label[shift + j])
                    us.append(np.full(len(joined), ida[a[i]]))
                    vs.append(idb[b[j[np.unique(label[shift + j], return_index=True)[1]]]])
                    label[np.isin(label, joined)] = label[i]
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64), np.empty(0, np.int64))


def groups(docs: DataFrame, shingle: int = 5, radius: int = 60, lanes: int = 4, ratio: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, set (digest of its different shingles), top (number of the component) and component_id of every row of docs with a doc_id:
    the smallest doc_id that links reach, which components share where a doc_id has several texts. A link is a Jaccard similarity of ratio at least, of exact sets.

    Bands of least hashes only search: sets that share one, and what they connect, meet again in _similar, which compares the shingles of
    those whose fingerprints are within radius.
    Sets of LEAST to FEW shingles that are one more or one less than another's don't need the search: they are joined by digests.
    """
    rows = stored(_sets(docs, shingle, lanes).where("doc_id is not null"), "sets")
    distinct = numbered(rows.groupBy("set", "n", "fp").agg(F.min("doc_id").alias("least"), F.first("less").alias("less"), F.first("bands").alias("bands")), "distinct", "set").withColumnRenamed("at", "node")
    search = components(candidates(distinct.where("n > 0").select("node", "bands")))
    distinct = stored(distinct.drop("bands"), "numbered")
    members = stored(distinct.drop("less").join(search.hint("merge"), "node"), "members")
    bundles = stored(_bundles(docs, members, shingle, BUNDLE_BYTES), "bundles")
    less = distinct.where("less is not null").select(F.col("node").alias("v"), F.explode("less").alias("set"))
    few = less.join(distinct.select("set", F.col("node").alias("u")), "set").select("u", "v")
    found = components(similar_links(bundles, radius, lanes, ratio).union(few))
    of = stored(distinct.select("set", "least", "node").join(found.hint("merge"), "node", "left").select("set", "least", F.coalesce("component", "node").alias("top")), "tops")
    tops = of.groupBy("top").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "set").join(of.join(tops.hint("merge"), "top").select("set", "top", "component_id").hint("merge"), "set")


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 60, lanes: int = 4) -> DataFrame:
    """docs without those that link to a smaller doc_id, in the same columns: links are Jaccard similarities of 0.8 at least.

    Over different shingles of five words, 60 of 256 bits are the angle between sets of Jaccard similarity 0.8 (39 bits) and over three
    times the spread of its estimate, so that what is that similar is found; what is found and less similar doesn't link. Of rows with one doc_id, the one whose text comes first
    stays (null as empty) of those that don't link to a smaller doc_id that stays; null doc_ids all stay.
    """
    found = stored(groups(docs, shingle, radius, lanes), "groups")
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        gone = found.where("doc_id <> component_id").select("doc_id")
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)  # it grows with docs: one plan for every size
    # a doc_id that comes again: its rows go by their own text, and what it doesn't keep doesn't stand for others' copies
    digest = F.pandas_udf(lambda texts: texts.map(lambda t: _digest(shingles(t, shingle, False))), "binary")
    own = docs.join(again.hint("merge"), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("first"))
    own = stored(own.withColumn("set", digest(F.col("first").cast("binary"))), "again")
    alive = found.select("doc_id", "set", "top").distinct()
    while True:
        least = alive.groupBy("top").agg(F.min("doc_id").alias("doc_id"))
        kept = stored(alive.join(least.hint("merge"), ["top", "doc_id"]).select("doc_id", "set"), "kept")
        firsts = own.join(kept.withColumnRenamed("doc_id", "id").hint("merge"), ["id", "set"]).groupBy("id").agg(F.min_by(F.struct("row", "set"), "first").alias("x"))
        firsts = stored(firsts.select(F.col("id").alias("doc_id"), "x.set", "x.row"), "firsts")
        others = kept.join(firsts.select("doc_id"), "doc_id", "left_semi").join(firsts.select("doc_id", "set"), ["doc_id", "set"], "left_anti")
        if not others.limit(1).count():
            break
        alive = stored(alive.join(others.hint("merge"), ["doc_id", "set"], "left_anti"), "alive")
    single = docs.join(kept.join(again, "doc_id", "left_anti").select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    return single.unionByName(docs.where("doc_id is null")).unionByName(firsts.select("row.*"))
