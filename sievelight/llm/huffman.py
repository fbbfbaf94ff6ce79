"""Token ids as files: canonical, length-limited Huffman codes from global counts, in blocks that decode by themselves.

A folder holds codes (id, bits), blocks and starts, each a Parquet table, so Spark's commit protocol and readers serve any store.
A block row has the bits of whole documents, their ids and lengths, and the bit offset of every 64th token. From these checkpoints
all stretches of a block are decoded side by side, one table look-up a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .tokens import WordIds

STEP = 64
BLOCK_TOKENS = 1 << 17
PART_TOKENS = 4_000_000


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most limit bits for positive counts (package-merge; equal counts in the order given)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    lists, row = [], weights
    lists.append(np.ones(n, bool))
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        lists.append(by < n)
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(lists):
        singles = int(leaf[:take].sum())
        out[:singles] += 1
        take = 2 * (take - singles)
    lengths = np.empty(n, np.int64)
    lengths[order] = out
    return lengths


class Codes:
    """Canonical codes of ids from their lengths: shorter first, then smaller ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        by = np.lexsort([ids, lengths])
        self.ids, self.lengths = ids[by].astype(np.int64), lengths[by].astype(np.int64)
        self.limit = int(self.lengths.max(initial=1))
        span = np.int64(1) << (self.limit - self.lengths)
        first = np.cumsum(span) - span
        size = int(self.ids.max(initial=0)) + 1
        self.code, self.bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids] = (first >> (self.limit - self.lengths)).astype(np.uint64)
        self.bits[self.ids] = self.lengths
        rest = (1 << self.limit) - int(span.sum())
        self.table_id = np.concatenate([np.repeat(self.ids, span), np.zeros(rest, np.int64)]).astype(np.uint32)
        self.table_bits = np.concatenate([np.repeat(self.lengths, span), np.ones(rest, np.int64)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits, and how many bits each stretch of 64 tokens takes (16-bit numbers)."""
        if not len(ids):
            return b"", b""
        code, bits = self.code[ids], self.bits[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        word, room = starts >> 6, 64 - (starts & 63) - bits
        up, down = np.maximum(room, 0).astype(np.uint64), np.maximum(-room, 0).astype(np.uint64)
        out = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat((code << up) >> down, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        marks = np.append(starts[::STEP], ends[-1])
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], np.diff(marks).astype("<u2").tobytes()

    def decode(self, bits: bytes, steps: bytes, n: int) -> np.ndarray:
        """n ids: all stretches between checkpoints at once."""
        if not n:
            return np.empty(0, np.uint32)
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        near = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        took = np.frombuffer(steps, "<u2").astype(np.int64)
        at = np.cumsum(took) - took
        out = np.empty((len(at), STEP), np.uint32)
        mask, last = np.uint32((1 << self.limit) - 1), len(near) - 1
        for k in range(STEP):
            byte = np.minimum(at >> 3, last)
            seen = (near[byte] >> (32 - self.limit - (at & 7)).astype(np.uint32)) & mask
            out[:, k] = self.table_id[seen]
            at = at + self.table_bits[seen]
        return out.reshape(-1)[:n]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n, ids (little-endian, of the vocabulary's width) of every row, the end id last; stored once, so that each text is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer)
        end = np.array([end_id], words.dtype).tobytes()
        for b in batches:
            ids = [words.encode(t).tobytes() + end for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) // words.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, ids binary"), "ids")


def _width(n: int, raw: bytes) -> str:
    return f"<u{len(raw) // n}"


def id_counts(ids: DataFrame) -> DataFrame:
    """id, n over all documents: each task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for n, raw in zip(b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                own = np.bincount(np.frombuffer(raw, _width(n, raw)))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], ["id", "n"])

    return ids.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, extra_bits: int = 2) -> None:
    """Write the ids of all documents to path in ascending doc_id order (null first; equal doc_ids by length, then content).

    Codes take at most extra_bits more than the least that the number of different ids needs, 16 or more. What is collected are the
    counts, one number for each entry of the vocabulary. Null texts count as empty: only the end id. Repeated rows are written as
    often as they come. An empty table gives tables without rows.
    """
    spark = docs.sparkSession
    ids = token_ids(docs, tokenizer, end_id)
    counted = np.array([(r["id"], r["n"]) for r in id_counts(ids).orderBy("id").collect()], np.int64).reshape(-1, 2)
    limit = max(16, int(len(counted)).bit_length() + extra_bits)
    lengths = code_lengths(counted[:, 1], limit)
    spark.createDataFrame(list(zip(counted[:, 0].tolist(), lengths.tolist(), strict=True)), "id long, bits long").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((counted[:, 0], lengths))  # two numbers for each entry of the vocabulary at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*shared.value)
        part, inside, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate([x for _, x in held])
            bits, steps = codes.encode(flat)
            cols = [[part], [inside], [len(flat)], [[d for d, _ in held]], [[len(x) for _, x in held]], [bits], [steps]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], ["part", "inside", "n", "doc_ids", "lengths", "bits", "steps"])

        for b in batches:
            for d, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                held.append((d, np.frombuffer(raw, _width(n, raw))))
                size += n
                if size >= BLOCK_TOKENS:
                    yield block()
                    inside, held, size = inside + size, [], 0
        if held:
            yield block()

    parts = max(1, int(counted[:, 1].sum()) // PART_TOKENS)
    order = ("doc_id", "n", F.xxhash64("ids"), "ids")
    dealt = ids.repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    dealt.mapInArrow(run, "part long, inside long, n long, doc_ids array<long>, lengths array<long>, bits binary, steps binary").write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row a partition
    before, rows = 0, []
    for r in sizes:
        rows.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(rows, "part long, before long").coalesce(1).write.parquet(f"{path}/starts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the files at path.

    A row for each that was written, null doc_ids and repeated rows included; files of an empty table give no rows. A block in memory
    holds whole documents, so at least its longest.
    """
    coded = np.array([tuple(r) for r in spark.read.parquet(f"{path}/codes").select("id", "bits").collect()], np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((coded[:, 0], coded[:, 1]))  # bounded by the vocabulary
    blocks = spark.read.parquet(f"{path}/blocks")
    placed = blocks.join(spark.read.parquet(f"{path}/starts"), "part").withColumn("start", F.col("inside") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = codes.decode(r["bits"], r["steps"], r["n"]).astype("<u4")
                n = np.array(r["lengths"], np.int64)
                ends = np.cumsum(n)
                raw, at = ids.tobytes(), (ends - n).tolist()
                yield pa.record_batch([pa.array(r["doc_ids"], pa.int64()), pa.array(ends - n + r["start"]), pa.array(n), pa.array([raw[4 * a : 4 * b] for a, b in zip(at, ends.tolist(), strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.select("start", "n", "doc_ids", "lengths", "bits", "steps").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
