"""URL filters: a sorted array of 64-bit digests in a memory-mapped file, probed by vectorised binary search.

The listed strings are hosts with the start of a path (example.net/en/). A file holds the sorted XXH64 digests of its strings, then the
strings themselves: a digest that is found is confirmed against the stored string, so a collision never decides. Spark ships the files
to the executors (addFile), where all workers of a machine map the same pages. A list over MOST strings is dealt to several files by
digest, and each is one more pass over the batches, without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, shared_dir

#: Strings in one file; as many are collected at once to write it.
MOST = 1_000_000
RULE, BLOCK = 1, 2
_OPEN: dict[str, DigestArray] = {}


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, A-Z lower-cased; empty for a null or another url."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def pack(entries: list[tuple[str, int]]) -> bytes:
    """The file of the entries (string, flags): counts, digests in order, offsets, flags, host and path lengths, strings."""
    raw = [(s.encode(), f) for s, f in entries]
    keys = np.array([xxhash.xxh64_intdigest(s) for s, _ in raw], np.uint64)
    order = np.argsort(keys, kind="stable")
    raw = [raw[i] for i in order]
    ends = np.cumsum([0] + [len(s) for s, _ in raw]).astype("<u8")
    hosts = np.unique([len(s.split("/", 1)[0]) for s, _ in entries]).astype("<u8")
    paths = np.unique([len(s) - len(s.split("/", 1)[0]) for s, _ in entries]).astype("<u8")
    head = np.array([len(raw), len(hosts), len(paths)], "<u8")
    return b"".join([head.tobytes(), keys[order].astype("<u8").tobytes(), ends.tobytes(), hosts.tobytes(), paths.tobytes(), bytes(f for _, f in raw), *(s for s, _ in raw)])


class DigestArray:
    def __init__(self, file: str) -> None:
        mapped = np.memmap(file, np.uint8, "r")
        n, h, p = (int(x) for x in mapped[:24].view("<u8"))
        at = 24 + 8 * np.cumsum([0, n, n + 1, h, p])
        self.keys, self.ends, self.hosts, self.paths = (mapped[a:b].view("<u8") for a, b in zip(at[:-1], at[1:], strict=True))
        self.flags, self.text = mapped[at[-1] : at[-1] + n], mapped[at[-1] + n :]
        self.longest, self.starts = int(self.hosts.max(initial=0)), [int(x) for x in self.paths]

    @classmethod
    def of(cls, name: str) -> DigestArray:
        if name not in _OPEN:
            _OPEN[name] = cls(SparkFiles.get(name))
        return _OPEN[name]

    def candidates(self, host: str, path: str) -> list[str]:
        """The host and the domains above it, no longer than any listed host, with each listed length of the path's start."""
        if not host:
            return []
        tails, at = [], 0
        if len(host) > self.longest:
            at = host.find(".", len(host) - self.longest - 1) + 1
            if not at:
                return []
        while True:
            tails.append(host[at:])
            at = host.find(".", at) + 1
            if not at:
                break
        return [t + path[:k] for t in tails for k in self.starts if k <= len(path)]

    def probe(self, strings: list[str]) -> np.ndarray:
        """The entry that each string is, or -1."""
        raw = [s.encode(errors="surrogatepass") for s in strings]
        keys = np.fromiter((xxhash.xxh64_intdigest(s) for s in raw), np.uint64, len(raw))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(raw), -1, np.int64)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist() if len(self.keys) else []:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:  # equal digests stand together
                if self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == raw[i]:
                    out[i] = k
                k += 1
        return out


def _ship(spark: SparkSession, data: bytes) -> str:
    """The name under which all executors have the file; written once to the shared folder, by whatever file system that is on."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(system.makeQualified(path).toString())
    return name


def _normal(entries: DataFrame) -> DataFrame:
    """entry, flags: hosts lower-cased; an entry that is both a rule and listed is a rule; of a rule said twice, block wins."""
    slash = F.instr("entry", "/")
    host = F.when(slash > 0, F.substring("entry", 1, slash - 1)).otherwise(F.col("entry"))
    lowered = F.concat(F.translate(host, UPPER, LOWER), F.when(slash > 0, F.col("entry").substr(slash, F.length("entry"))).otherwise(""))
    known = entries.where("entry is not null").select(lowered.alias("entry"), F.coalesce("rule", F.lit(False)).alias("rule"), (F.col("verdict") == "block").alias("block"))
    best = known.groupBy("entry").agg(F.max(F.struct("rule", "block")).alias("b"))
    return best.select("entry", (F.col("b.rule").cast("int") * RULE + F.coalesce("b.block", F.lit(False)).cast("int") * BLOCK).alias("flags"))


def judge(pages: DataFrame, entries: DataFrame, most: int = MOST) -> DataFrame:
    """pages with host, path, rule, listed and verdict added (columns of these names are replaced).

    entries: entry (host and path start), verdict (allow or block), rule (boolean). The longest rule that fits decides (of host and
    path together; two that fit are never equally long). Without a rule the longest listed entry does; without that, allow. Null and
    odd urls have an empty host and path, fit nothing and are allowed. Null entries say nothing. Empty tables: no rows, all allowed.
    """
    spark = pages.sparkSession
    known = _normal(entries)
    files = -(-known.count() // (most // 2)) if known.count() > most else 1
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    out = pages.select(*own, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), *(F.lit(None).cast("string").alias(c) for c in ("rule", "listed")), F.lit("allow").alias("verdict"))
    for k in range(files):
        part = known.where(F.pmod(F.xxhash64("entry"), F.lit(files)) == k) if files > 1 else known
        name = _ship(spark, pack([(r["entry"], r["flags"]) for r in part.collect()]))
        out = out.mapInArrow(_pass(name), out.schema)
    return out


def _pass(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.of(name)
        for b in batches:
            col = lambda c, b=b: b.column(b.schema.get_field_index(c)).to_pylist()
            rules, listed, verdicts = col("rule"), col("listed"), col("verdict")
            asked, owner = [], []
            for i, (host, path) in enumerate(zip(col("host"), col("path"), strict=True)):
                own = array.candidates(host, path)
                asked += own
                owner += [i] * len(own)
            found = array.probe(asked)
            for j in np.flatnonzero(found >= 0).tolist():
                i, s, flags = owner[j], asked[j], int(array.flags[found[j]])
                held = rules if flags & RULE else listed
                if held[i] is None or len(held[i]) < len(s):
                    held[i] = s
                    if flags & RULE or rules[i] is None:
                        verdicts[i] = "block" if flags & BLOCK else "allow"
            for c, x in (("rule", rules), ("listed", listed), ("verdict", verdicts)):
                b = b.set_column(b.schema.get_field_index(c), c, pa.array(x, pa.string()))
            yield b

    return run
