"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j the walk emits the character that it stands on, and a random bit of (j, character) says
whether it moves on. Texts a few edits apart fall into step again, so the edit distance of texts turns into the Hamming distance of
what they emit. A fingerprint has SAMPLES bytes, each a hash of the three characters from the one emitted at a sampled step. Steps are
sampled from those that the walk of a text has (a text's own length of it), consistently: texts of lengths p < q share a sampled step
with probability p/q. Equal bytes estimate likeness.

Near duplicates are found by bands: each samples WIDTH of the bytes, and texts that agree in all of a band's are verified by all
bytes. There are as many bands as find RECALL of the pairs that are just alike enough, and more of those that are more alike.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, met, mix64, stored

SAMPLES = 128
#: Random bits repeat after PERIOD steps; characters share them in CLASSES classes.
PERIOD, CLASSES, SEED = 4096, 64, 20260711
#: Bytes in a band, the share of pairs at the threshold that bands find, and members of a bucket that are compared at once.
WIDTH, RECALL, TILE = 4, 0.985, 1024


def _bits() -> np.ndarray:
    """The walk's random bits by class and step (modulo the period): True moves on."""
    return np.random.default_rng(SEED).random((CLASSES, PERIOD)) < 0.5


def _arrivals() -> list[list[int]]:
    """By class and step: the step (modulo the period) at which the next character is reached."""
    out = np.empty((CLASSES, PERIOD), np.int64)
    for c, bits in enumerate(_bits()):
        ones = np.flatnonzero(bits)
        at = np.searchsorted(ones, np.arange(PERIOD))
        out[c] = (np.append(ones, ones[0] + PERIOD)[at] + 1) % PERIOD
    return out.tolist()


def _records() -> np.ndarray:
    """For each sample the steps at which a running minimum over random numbers of all steps changes: the last before a length is the
    sampled step of that length, and is uniform over it. From one such step p the next is floor(p' / u) with p' = p + 1 for a uniform u."""
    rng = np.random.default_rng(SEED + 1)
    out = np.full((SAMPLES, 96), np.iinfo(np.int64).max)
    for row in out:
        p = 0
        for k in range(96):
            row[k] = p
            p = int((p + 1) / rng.random())
            if p > 1 << 44:
                break
    return out


_TABLES: list = []


def _tables() -> tuple[list[list[int]], np.ndarray]:
    if not _TABLES:
        _TABLES.extend([_arrivals(), _records()])
    return _TABLES[0], _TABLES[1]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(cs: np.ndarray) -> np.ndarray:
    return (mix64(cs.astype(np.uint64)) % np.uint64(CLASSES)).astype(np.uint8)


def walk(cs: np.ndarray, at: int = 0) -> np.ndarray:
    """The step (modulo the period) at which the walk leaves each character, from step at on."""
    table = _tables()[0]
    return np.array([at := table[c][at] for c in classes(cs).tobytes()], np.int64)


def fingerprint(cs: np.ndarray, left: np.ndarray) -> bytes:
    """SAMPLES bytes from a text's characters and the steps that its walk leaves them at (zeros if it has none)."""
    if not len(cs):
        return bytes(SAMPLES)
    spent = np.diff(left, prepend=0) % PERIOD
    spent[spent == 0] = PERIOD
    ends = np.cumsum(spent)
    records = _tables()[1]
    step = records[np.arange(SAMPLES), (records < ends[-1]).sum(1) - 1]
    at = np.searchsorted(ends, step, side="right")
    padded = np.append(cs, np.zeros(2, np.uint32)).astype(np.uint64)
    h = mix64(step.astype(np.uint64) + np.uint64(1))
    for k in range(3):
        h = mix64(h ^ padded[at + k])
    return (h >> np.uint64(56)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bytes, without those that are equal by chance; 1 only for equal fingerprints."""
    same = sum(x == y for x, y in zip(a, b, strict=True)) / SAMPLES
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


class _Print:
    """A text with its walk."""

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.cs = codes(self.text)
        self.left = walk(self.cs)
        self.fp = fingerprint(self.cs, self.left)

    def edited(self, other: _Print) -> tuple[str, bytes]:
        """The last third replaced by as much of other's start, and that text's fingerprint; the walk goes on where the edit begins."""
        n = len(self.cs)
        keep, more = n - n // 3, other.cs[: n // 3]
        rest = walk(more, int(self.left[keep - 1]) if keep else 0)
        text = self.text[:keep] + other.text[: n // 3]
        return text, fingerprint(np.concatenate([self.cs[:keep], more]), np.concatenate([self.left[:keep], rest]))


#: What edits() returns, the digests and fingerprints as bytes until its last step.
OUT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _row(one: _Print, other: _Print) -> tuple:
    text, fp = one.edited(other)
    return one.doc_id, len(one.cs), hashlib.sha256(text.encode(errors="surrogatepass")).digest(), one.fp, fp, likeness(one.fp, fp), likeness(one.fp, other.fp)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.binary()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_ENDS = pa.schema([*_ARROW, ("part", pa.int64()), ("head", pa.bool_()), ("text", pa.string())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (binary) of every row of docs; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_Print(None, t).fp for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp binary")


def _edits(docs: DataFrame) -> DataFrame:
    """Every row of docs with its fingerprint, and against its edited text and the next document (columns of OUT).

    The next document is the one with the next smaller doc_id (null last; equal ones by text), after the last the first. Rows are
    range-partitioned and each task walks through its own in order; the last of one partition meets the first of the next in a second
    step over two rows a partition. Null texts count as empty; a table of one row has itself as next; an empty table gives no rows.
    """
    spark = docs.sparkSession
    order = (F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(order[0], F.asc_nulls_first(F.substring("text", 1, 32))).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, none = TaskContext.get().partitionId(), None, (None,) * len(_ARROW)
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                now = _Print(d, t)
                rows.append((*none, part, True, now.text) if held is None else (*_row(held, now), None, None, None))
                if held is None:
                    rows[-1] = (d, *rows[-1][1:])
                held = now
            if rows:
                yield _batch(rows, _ENDS)
        if held is not None:
            yield _batch([(held.doc_id, *none[1:], part, False, held.text)], _ENDS)

    first = stored(dealt.mapInArrow(run, OUT + ", part long, head boolean, text string"), "edits")
    ends = first.where("part is not null")
    parts = [r["part"] for r in ends.select("part").distinct().orderBy("part").collect()]  # a row a partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, then long")
    tails = ends.where("not head").join(F.broadcast(after), "part").select("doc_id", "text", "then")
    heads = ends.where("head").select(F.col("part").alias("then"), F.col("text").alias("other"))
    pairs = tails.join(heads, "then").select("doc_id", "text", "other")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(_Print(d, t), _Print(None, o)) for d, t, o in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if rows:
                yield _batch(rows, _ARROW)

    return first.where("part is null").drop("part", "head", "text").unionByName(pairs.mapInArrow(finish, OUT))


def _told(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def edits(docs: DataFrame) -> DataFrame:
    """What _edits gives, digests and fingerprints as lowercase hex."""
    return _told(_edits(docs))


def judged(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """edits() with component_id: of the documents whose fingerprints links of likeness of least or more connect, the smallest doc_id.

    A null doc_id links nothing and has a null component_id; all else as in _edits.
    """
    rows = stored(_edits(docs), "edited")
    of = grouped(rows.select("doc_id", F.col("fingerprint").alias("fp")), least).withColumnRenamed("fp", "fingerprint")
    out = _told(rows.join(of, "fingerprint", "left").select(*rows.columns, "component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def bands_of(least: float, width: int = WIDTH, recall: float = RECALL) -> list[list[int]]:
    """The bytes that each band samples: as many bands as a pair of likeness least meets in one of them with the given probability."""
    same = (least + (1 - least) / 256) ** width
    n = 1 if same >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))
    rng, order = np.random.default_rng(SEED + 2), []
    while len(order) < n * width:  # every byte once before any comes again
        order += rng.permutation(SAMPLES).tolist()
    return [order[k * width : (k + 1) * width] for k in range(n)]


def _like(a: np.ndarray, na: np.ndarray, c: np.ndarray, nc: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what rows of a and c with a likeness of least or more do."""
    us, vs = [], []
    for i in range(len(a)):
        same = (a[i] == c).mean(1)
        near = nc[(same - 1 / 256) / (1 - 1 / 256) >= least]
        near = near[near != na[i]]
        us.append(np.full(len(near), na[i]))
        vs.append(near)
    return forest(np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64), np.empty(0, np.int64))


def grouped(fps: DataFrame, least: float = 0.5, tile: int = TILE) -> DataFrame:
    """fp and component_id of the different fingerprints of fps (doc_id, fp): the smallest doc_id that links reach.

    Keys of bands that several share make buckets; a bucket over tile members is cut into tiles that meet in pairs, each pair in a
    task of its own, so that no bucket, however large, lands in one task. Rows without a doc_id are left out.
    """
    nodes = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    keys = [F.xxhash64(F.lit(k), F.concat(*(F.substring("fp", p + 1, 1) for p in at))) for k, at in enumerate(bands_of(least))]
    banded = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / tile).alias("tiles"))
    # the second exchange of the few keys lets Spark split a hot key's rows on the other side
    members = banded.join(shared.repartition("key").hint("merge"), "key").select("key", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("part"), "node")
    tiled = members.join(nodes.hint("merge"), "node").groupBy("key", "tiles", "part").agg(F.collect_list(F.struct("node", "fp")).alias("m"))
    tiled = stored(tiled.withColumn("tile", F.monotonically_increasing_id()), "buckets")

    def body(m: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(x["fp"] for x in m), np.uint8).reshape(-1, SAMPLES), np.array([x["node"] for x in m], np.int64)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_like(*body(m), *body(m), least) for m in b.column("m").to_pylist()]
            if found:
                yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    large = tiled.where("tiles > 1")
    pairs = large.select("key", "tile").join(large.select("key", F.col("tile").alias("other")), "key").where("tile <= other").select("tile", "other")
    links = tiled.where("tiles = 1").select("m").mapInArrow(alone, "u long, v long").union(met(stored(pairs, "pairs"), large.select("tile", "m"), large.count(), lambda x, y: _like(*body(x["m"]), *body(y["m"]), least)))
    return nodes.join(components(links).hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(docs: DataFrame, least: float = 0.5, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row: the smallest doc_id that links of likeness of least or more reach.

    Equal fingerprints are one; of different ones, what shares a band's bytes is verified by all bytes. Null and empty texts share a
    fingerprint and are linked like any other, repeated rows come back as often as they came; texts are read whole. A null doc_id links
    nothing; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs), "prints")
    out = fps.join(grouped(fps, least, tile), "fp", "left")
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
