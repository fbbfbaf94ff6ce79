"""What the training-data operators share: numbering, hashing helpers and connected components, and the core's stored tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import dropped, new_path, shared_dir, stored, table  # noqa: F401

#: ASCII upper case to lower case; bytes.lower() does the same and leaves bytes from 0x80 on alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Parts that the links of a node are dealt to, tasks that pairs of bodies are dealt to at most, and blocks of bodies at least.
SALTS, MOST_TASKS, BLOCKS = 32, 20_000, 16

#: Rows that a Python worker gets at once where each is a body of megabytes; Spark's own number would be all of a task.
BODIES = 4


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with `at`: 0, 1, ... in the given order, over all rows; stored once.

    Rows are range-partitioned and sorted, so that no key's rows need to fit one task; what is collected is a row a partition.
    """
    spark = df.sparkSession
    kept = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, rows = 0, []
    for r in kept.groupBy(part.alias("part")).count().orderBy("part").collect():
        rows.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(rows, "_part long, _before long"))
    return kept.withColumn("_part", part).join(starts, "_part").withColumn("at", inside + F.col("_before")).drop("_at", "_part", "_before")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands Python workers as many rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(columns: list[str], name: str) -> str:
    """name, lengthened until none of columns is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(text: bytes, stop: re.Pattern[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """text in pieces of about size bytes, each of which begins where stop matches, so that what lies between matches stays whole."""
    at = 0
    while at < len(text):
        cut = stop.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor-shift-multiply rounds), for hashes derived from a hash."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for each node of the links a-b that isn't its component's smallest: as few links as connect the same nodes."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[u], top[v])
        new = top.copy()
        np.minimum.at(new, top[u], low)
        np.minimum.at(new, top[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, top):
            break
        top = new
    rest = top != np.arange(len(nodes))
    return nodes[top[rest]], nodes[rest]


def met(pairs: DataFrame, bodies: DataFrame, full: int, compare: Callable[[dict, dict], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Links (u, v) that compare finds for pairs (tile, other; tile <= other) of bodies (tile, ...). A tile is numbered by its partition,
    shifted by 33 bits, and its place there.

    Comparing is what takes time, so there are as many blocks of neighbouring partitions as full bodies (`full`), and a task a pair of
    blocks: many small bodies share tasks. A body travels once a pair. What a task links is thinned to a forest over all its pairs, so
    that a node that is near to a whole group is named a few times a block, not once a pair. The links are stored, as bodies reach a
    worker a few at a time only while they are.
    """
    n, last = pairs.agg(F.count("*"), F.max(F.shiftright("other", 33))).first()
    parts = (last or 0) + 1
    blocks = min(parts, max(full, BLOCKS))
    block = lambda c: F.floor(F.shiftright(c, 33) * blocks / parts)
    ends = pairs.select("tile", "other", block("tile").alias("a"), block("other").alias("b"), F.explode(F.array_distinct(F.array("tile", "other"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the first body of the pair at hand; one that meets itself comes alone
        us, vs, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # one pair in memory at a time
                r = batch.slice(i, 1).to_pylist()[0]
                if r["own"] == r["tile"] != r["other"]:
                    held = r
                    continue
                u, v = compare(r if r["tile"] == r["other"] else held, r)
                held = None
                us.append(u)
                vs.append(v)
                size += len(u)
                if size > 500_000:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, size = [u], [v], 0
        if us:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    tasks = max(1, min(MOST_TASKS, n, blocks * (blocks + 1) // 2))
    dealt = ends.join(bodies.withColumnRenamed("tile", "own"), "own").repartition(tasks, "a", "b")
    links = dealt.sortWithinPartitions("a", "b", "tile", "other", F.col("own") != F.col("tile")).mapInArrow(run, "u long, v long")
    with batches_of(pairs.sparkSession, BODIES):
        return stored(links, "met")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over links (u > v). A node's links are dealt to SALTS parts; its smallest neighbour is found by
    parts and sent back to each, so that a hub's links never meet in one task."""
    around = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    around = around.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = around.groupBy("u", "salt").agg(F.min("v").alias("m"))
    low = parts.groupBy("u").agg(F.least("u", F.min("m")).alias("m"), F.collect_list("salt").alias("salts"))
    moved = around.join(low.select("u", "m", F.explode("salts").alias("salt")).hint("merge"), ["u", "salt"])
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _stars(links: DataFrame) -> bool:
    """Every node names one other that names none: the links are what components() is after."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.count_if(F.expr("up > 1 or up > 0 and down > 0"))).first()[0]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (u, v of type long): component is the smallest node that it reaches.

    Alternates large-star and small-star steps until all links form stars. Each step is stored by itself, so that no plan holds two of
    them, and the one before it deleted. Links with a null end or from a node to itself say nothing and are left out; no links give no
    rows.
    """
    links = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links")
    for _ in range(most_rounds):
        if _stars(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        for large in (True, False):
            last, links = links, stored(_star(links, large), "links")
            dropped(last)
    raise RuntimeError("connected components did not settle")
