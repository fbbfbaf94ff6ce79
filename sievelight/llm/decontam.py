"""Benchmark decontamination: Wu-Manber search for many word windows at once.

The texts' letters are words, so blocks are two neighbouring words. A shift table says how far a search may move on after reading a
block without passing a window's end; where it may not move, the last words of the windows pick a bucket (by hash) of windows, which
are compared word by word. Most words of a clean document are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: [0-9a-z] and every byte from 0x80 on belong to words, upper case is lowered, all else separates.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Benchmark text that one automaton holds; a larger benchmark is dealt to more of them, each with a pass of its own.
BENCHMARK_BYTES = 32_000_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Windows:
    """The search tables for all windows of size words of the items (shorter items: all their words)."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int) -> None:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            w = words(text)
            for i in range(max(1, len(w) - size + 1) if w else 0):
                found.setdefault(tuple(w[i : i + size]), set()).add(name)
        self.one = {k[0]: v for k, v in found.items() if len(k) == 1}
        self.by_length = [self._tables(m, {k: v for k, v in found.items() if len(k) == m}) for m in sorted({len(k) for k in found} - {1})]

    @staticmethod
    def _tables(m: int, windows: dict) -> tuple:
        shift: dict[tuple[bytes, bytes], int] = {}
        buckets: dict[tuple[bytes, bytes], list] = {}
        for w, names in windows.items():
            for i in range(1, m):
                block = (w[i - 1], w[i])
                shift[block] = min(shift.get(block, m - 1), m - 1 - i)
            buckets.setdefault((w[-2], w[-1]), []).append((list(w), names))
        return m, shift, buckets

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches (start, end) of text that windows occur in, joined where they touch, and the items that have these windows."""
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.one:
            for i in [i for i, w in enumerate(text) if w in self.one]:
                hits.append((i, i + 1))
                items |= self.one[text[i]]
        n = len(text)
        for m, shift, buckets in self.by_length:
            at, most, get = m - 1, m - 1, shift.get
            while at < n:
                block = (text[at - 1], text[at])
                move = get(block, most)
                if move:
                    at += move
                    continue
                here = text[at - m + 1 : at + 1]
                for window, names in buckets[block]:
                    if window == here:
                        hits.append((at - m + 1, at + 1))
                        items |= names
                at += 1
        return joined(hits), items


def joined(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _items(benchmark: DataFrame, size: int, most_bytes: int) -> list[DataFrame]:
    """The benchmark in parts that one automaton holds each: its items, or if they are over most_bytes, their different windows, dealt
    by hash of the words, so that an item_id's share of the benchmark says nothing about a part's size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    bytes_of = lambda df: df.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + F.length("item_id"))).first()[0] or 0
    if bytes_of(items) <= most_bytes:
        return [items]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(name, x) for name, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) for x in _windows(words(t), size)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], ["item_id", "text"])

    windows = stored(items.mapInArrow(cut, "item_id string, text binary").distinct(), "windows")
    groups = -(-bytes_of(windows) // (most_bytes // 2))
    return [windows.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g) for g in range(groups)]


def _windows(w: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1) if w else 0)]


def _held(items: DataFrame) -> list[tuple[str, bytes | None]]:
    return [(r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in items.collect()]


def _searched(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """docs with n_words, hits and items (sorted names) added; items fit one automaton, so they may be collected and sent out."""
    shared = docs.sparkSession.sparkContext.broadcast(_held(items))
    tables: list[Windows] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(Windows(shared.value, size))
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                w = words(t)
                hits, names = tables[0].search(w)
                rows.append((len(w), hits, sorted(names)))
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([[x for h in r[1] for x in h] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
            kept = [i for i, name in enumerate(b.schema.names) if name != "text"]
            yield pa.record_batch([*(b.column(i) for i in kept), *cols], [*(b.schema.names[i] for i in kept), "n_words", "hits", "items"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, n_words long, hits array<long>, items array<string>")


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """doc_id, n_words, hits (starts and ends of stretches of hit words in turn) and items (sorted) of every row of docs.

    Null texts have no words, items without words no windows. Items that share an item_id count as one; a null item_id counts as "".
    Repeated rows come back as often as they came; empty tables give no rows (docs) or no hits (benchmark). A benchmark over most_bytes
    is dealt to several automata by window; the hits of their passes are put together a row. Texts are searched whole, however long.
    """
    parts = _items(benchmark, size, most_bytes)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    if len(parts) == 1:
        return _searched(texts, parts[0], size)
    texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    passes = [_searched(texts, part, size) for part in parts]
    found = stored(passes[0], "found")
    for x in passes[1:]:
        found = found.unionByName(stored(x.where("size(items) > 0"), "found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [[x for h in joined([p for a in arrays for p in zip(a[::2], a[1::2], strict=True)]) for x in h] for arrays in b.column("hits").to_pylist()]
            yield b.set_column(b.schema.get_field_index("hits"), "hits", pa.array(flat, pa.list_(pa.int64())))

    per_row = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return per_row.mapInArrow(run, "row long, doc_id long, n_words long, hits array<long>, items array<string>").drop("row")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, in the same columns: one pass an automaton, without a shuffle.

    Null and empty texts have no words and stay; rows with a null doc_id and repeated rows are judged like any other; texts are searched
    whole. An empty benchmark lets every row stay, an empty table gives no rows. Other columns, of whatever name, pass through.
    """
    out = docs
    for part in _items(benchmark, size, most_bytes):
        out = out.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(_held(part)), size), docs.schema)
    return out


def _cleaner(shared, size: int):
    tables: list[Windows] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(Windows(shared.value, size))
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([not tables[0].search(words((t or "").encode(errors="surrogatepass")))[1] for t in texts], pa.bool_()))

    return run


def judged(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size("hits")), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i % 2 == 0, F.element_at("hits", i)).otherwise(-F.element_at("hits", i)))
    n_hit = F.when(F.size("hits") == 0, 0).otherwise(n_hit).cast("long")
    out = find_windows(docs, benchmark, size).withColumn("n_hit", n_hit)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def item_digest(names: list[str]) -> str:
    """What items_sha256 holds for these items."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def is_hit(hits: np.ndarray, word: int) -> bool:
    """Whether a word lies in one of the stretches of a row of find_windows."""
    return bool(np.searchsorted(hits, word, side="right") % 2)
