"""N-gram Jaccard join: sets of n-grams in one global order, joined by prefix trees.

N-grams are ordered by how many sets have them, the most frequent first, so that sets that are alike share long paths of a tree from its
root. Two sets that are alike enough must share one of the rarest n-grams of each (its prefix, read from the rare end), which tells which
sets have to meet. Sets that meet are packed into bundles; of a pair of bundles, one is read as a tree, and the sets of the other walk down
it together: what a path has in common with each of them is counted once for all sets below it, and a subtree is left as soon as no set
below can reach the overlap that it needs, by the n-grams that are left on both sides.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, forest, met, mix64, numbered, pieces, stored

SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words whose hashes a task remembers.
WORDS = 500_000
#: Bytes of n-grams, and sets, that a bundle has at most (or it is one set).
BUNDLE_BYTES, MOST_SETS = 2 << 20, 4096
GOLDEN = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def ngrams(text: bytes | None, size: int = 3, known: dict | None = None) -> np.ndarray:
    """64-bit hashes of the different runs of size words of text (of all of them, if there are fewer), in ascending order."""
    known = _Hashes() if known is None else known
    parts = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for p in pieces(text or b"", SPACE) if (words := p.lower().split())]
    if not parts:
        return np.empty(0, np.uint64)
    w = np.concatenate(parts)
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.full(n, GOLDEN * k % 2**64, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix64(h + w[i : i + n])
    return np.unique(h)


def prefix_length(n: int, ratio: tuple[int, int]) -> int:
    """A set of n that lacks all of as many n-grams has less than ratio in common with what is as large."""
    return n + ratio[0] * n // -ratio[1] + 1 if n else 0


def _long_prefix(n: int, ratio: tuple[int, int]) -> int:
    return min(n, 2 * prefix_length(n, ratio))


def _least_shared(n: int, ratio: tuple[int, int]) -> int:
    """Long prefixes of a set of n and of whatever is alike enough share as many n-grams: those of the smallest such partner tell."""
    m = -(ratio[0] * n // -ratio[1])
    return _long_prefix(m, ratio) - prefix_length(m, ratio) + 1


def sets(docs: DataFrame, size: int, ratio: tuple[int, int]) -> DataFrame:
    """doc_id, set (a 128-bit digest), n (n-grams), need and first (the long prefix by ascending hash) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            found = [ngrams(t, size, known) for t in b.column("text").to_pylist()]
            ns = [len(h) for h in found]
            need = [_least_shared(n, ratio) if n else 0 for n in ns]
            first = [h[: _long_prefix(len(h), ratio)].view(np.int64) for h in found]
            yield pa.record_batch([b.column("doc_id"), pa.array([_digest(h) for h in found], pa.binary()), pa.array(ns, pa.int64()), pa.array(need, pa.int64()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "set", "n", "need", "first"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, set binary, n long, need long, first array<long>")


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.astype("<u8").tobytes())


def possible(distinct: DataFrame) -> DataFrame:
    """The nodes of distinct (node, need, first) whose long prefix shares enough with other sets' to have a partner at all. Hashes are
    the order here, so that only prefixes travel."""
    tokens = distinct.select("node", "need", F.explode("first").alias("hash"))
    again = tokens.groupBy("hash").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("hash")
    return tokens.join(again.hint("merge"), "hash").groupBy("node").agg(F.count("*").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("node")


def _hashed(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """node, n and hashes of members (least, set, n, node), from the text of the document that each names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            found = [ngrams(t, size, known) for t in b.column("text").to_pylist()]
            own = pa.array([_digest(h) == d for h, d in zip(found, b.column("set").to_pylist(), strict=True)], pa.bool_())  # a doc_id may have several texts
            yield pa.record_batch([b.column("node"), b.column("n"), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["node", "n", "hashes"]).filter(own)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    asked = members.select(F.col("least").alias("doc_id"), "set", "n", "node")
    return texts.join(asked, "doc_id").select("text", "set", "n", "node").mapInArrow(run, "node long, n long, hashes array<long>")


def ordered(hashed: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """node, n, hashes and counts (packed; only n-grams that several sets have, the most frequent first, then by hash) and prefix (the
    rarest ones, of which a partner has one at least) of the sets in hashed that may have a partner."""
    tokens = hashed.select("node", "n", F.explode("hashes").alias("hash"))
    count = tokens.groupBy("hash").agg(F.count("*").alias("count")).where("count > 1")
    known = tokens.join(count.hint("merge"), "hash").groupBy("node", "n").agg(F.collect_list(F.struct("count", "hash")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ends = b.column("x").flatten(), np.cumsum([0, *pc.list_value_length(b.column("x")).to_pylist()])
            hashes, counts = (x.field(c).to_numpy(zero_copy_only=False) for c in ("hash", "count"))
            out = []
            for i, (node, n) in enumerate(zip(b.column("node").to_pylist(), b.column("n").to_pylist(), strict=True)):
                h, at = np.unique(hashes[ends[i] : ends[i + 1]], return_index=True)
                c = counts[ends[i] : ends[i + 1]][at]
                order = np.lexsort([h, -c])
                left = prefix_length(n, ratio) - (n - len(h))  # n-grams of its own come first in the prefix
                if left > 0:
                    out.append((node, n, h[order].tobytes(), c[order].tobytes(), h[order][-left:]))
            node, n, h, c, prefix = zip(*out, strict=True) if out else ((),) * 5
            yield pa.record_batch([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(c, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["node", "n", "hashes", "counts", "prefix"])

    return known.mapInArrow(run, "node long, n long, hashes binary, counts binary, prefix array<long>")


def _bundles(members: DataFrame, most_bytes: int) -> DataFrame:
    """Sets in rows of up to most_bytes of n-grams (or one set) and MOST_SETS sets, by leader and n."""
    cut = max(1, int((members.agg(F.sum(F.length("hashes"))).first()[0] or 0) * 2 // (4 * most_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        number = itertools.count(TaskContext.get().partitionId() << 33)

        def row() -> pa.RecordBatch:
            node, n, h, c = zip(*held, strict=True)
            sizes = np.array([len(x) // 8 for x in h], np.int64)
            return pa.record_batch([pa.array([next(number)]), pa.array([list(node)], pa.list_(pa.int64())), pa.array([np.array(n, np.int64).tobytes()]), pa.array([sizes.tobytes()]), pa.array([b"".join(h)]), pa.array([b"".join(c)])], ["tile", "nodes", "n", "sizes", "hashes", "counts"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("node", "n", "hashes", "counts")), strict=True):
                if held and (size + 2 * len(r[2]) > most_bytes or len(held) == MOST_SETS):
                    yield row()
                    held, size = [], 0
                held.append(r)
                size += 2 * len(r[2])
        if held:
            yield row()

    dealt = members.repartitionByRange(cut, "leader", "n", "node").sortWithinPartitions("leader", "n", "node")
    return dealt.select("node", "n", "hashes", "counts").mapInArrow(run, "tile long, nodes array<long>, n binary, sizes binary, hashes binary, counts binary")


def _led(tokens: DataFrame) -> DataFrame:
    """node and leader: the smallest node within two steps over shared n-grams. It only tells which sets lie side by side."""
    first = tokens.groupBy("hash").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    once = stored(tokens.join(first.hint("merge"), "hash").groupBy("node").agg(F.min("lo").alias("leader")), "leaders")
    second = tokens.join(once.hint("merge"), "node").groupBy("hash").agg(F.min("leader").alias("lo"))
    return tokens.join(second.hint("merge"), "hash").groupBy("node").agg(F.min("lo").alias("leader"))


def links(members: DataFrame, ratio: tuple[int, int], most_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Links (u, v) that connect what pairs of members (as ordered gives them) with a Jaccard similarity of ratio at least connect."""
    p, q = ratio
    tokens = stored(members.select("node", "n", F.explode("prefix").alias("hash")), "prefixes")
    bundles = stored(_bundles(members.join(_led(tokens).hint("merge"), "node"), most_bytes), "bundles")
    # pairs are of bundles: one that has an n-gram in the prefix of many sets is named once for it
    of = bundles.select("tile", F.explode("nodes").alias("node"))
    ends = stored(tokens.join(of.hint("merge"), "node").groupBy("hash", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m")), "ends")
    other = ends.select("hash", F.col("tile").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    fit = f"(tile < other or tile = other and m > 1) and {q} * hi >= {p} * lo2 and {q} * hi2 >= {p} * lo"
    pairs = stored(ends.join(other.hint("merge"), "hash").where(fit).select("tile", "other").distinct(), "pairs")
    full = -(-(bundles.agg(F.sum(F.length("hashes"))).first()[0] or 0) * 2 // most_bytes)
    found = met(pairs, bundles.select("tile", "nodes", "n", "sizes", "hashes", "counts"), full, lambda x, y: compare(x, y, ratio))
    dropped(tokens, ends, pairs, bundles)
    return found


def compare(x: dict, y: dict, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of x and of y (bundles; the same one is met with itself, each pair once), thinned to a forest."""
    one, (p, q) = x is y, ratio
    read = lambda r: (np.array(r["nodes"], np.int64), *(np.frombuffer(r[c], np.int64) for c in ("n", "sizes", "hashes", "counts")))
    (nodes, m, sx, hx, cx), (others, n, sy, hy, cy) = read(x), read(y)
    words, at = np.unique(np.concatenate([hx, hy]), return_inverse=True)
    count = np.empty(len(words), np.int64)
    count[at] = np.concatenate([cx, cy])
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort([words, -count])] = np.arange(len(words))
    wx, wy = at[: len(hx)], at[len(hx) :]
    # an n-gram that only one side has (or one set, in one bundle) overlaps with nothing
    shared = np.bincount(wx, minlength=len(words)) > 1 if one else (np.bincount(wx, minlength=len(words)) > 0) & (np.bincount(wy, minlength=len(words)) > 0)
    (rx, ox), (ry, oy) = ((rank[w[shared[w]]], np.repeat(np.arange(len(s)), s)[shared[w]]) for w, s in ((wx, sx), (wy, sy)))
    sx, sy = np.bincount(ox, minlength=len(m)), np.bincount(oy, minlength=len(n))
    wide = len(words) + 1
    flat = ox * wide + rx  # ascending: sets come one after the other, each in the global order
    start = np.concatenate([[0], np.cumsum(sx)])
    by_word = np.argsort(rx, kind="stable")
    having, ptr = ox[by_word], np.searchsorted(rx[by_word], np.arange(wide))
    rows = np.split(ry, np.cumsum(sy)[:-1])
    order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">u4").tobytes())
    rows, n, own, length = [rows[i] for i in order], n[order], np.array(order), sy[order]
    lcp = np.zeros(len(rows) + 1, np.int64)  # with the row before
    for i in range(1, len(rows)):
        k = min(length[i - 1], length[i])
        apart = np.flatnonzero(rows[i - 1][:k] != rows[i][:k])
        lcp[i] = apart[0] if len(apart) else k
    us, vs, held = [], [], 0
    # rows lo to hi share the first `depth` n-grams; `overlap` of them are in each set of `alive`
    stack = [(0, len(rows), 0, np.arange(len(m)), np.zeros(len(m), np.int64))] if len(rows) else []
    while stack:
        lo, hi, depth, alive, overlap = stack.pop()
        end = int(length[lo]) if hi - lo == 1 else int(lcp[lo + 1 : hi].min())
        path = rows[lo][depth:end]
        if len(path):
            many = ptr[path + 1] - ptr[path]
            places = np.repeat(ptr[path] - np.cumsum(many) + many, many) + np.arange(many.sum())
            overlap = overlap + np.bincount(having[places], minlength=len(m))[alive]
        last = rows[lo][end - 1] if end else -1
        left = start[alive + 1] - np.searchsorted(flat, alive * wide + last, "right")
        most = overlap + np.minimum(left, length[lo:hi].max() - end)
        low, high, size = int(n[lo:hi].min()), int(n[lo:hi].max()), m[alive]
        alive_now = ((p + q) * most >= p * (size + np.maximum(low, -(-p * size // q)))) & (q * size >= p * low) & (q * high >= p * size)
        alive, overlap = alive[alive_now], overlap[alive_now]
        if one and len(alive) and hi - lo == 1:
            before = alive < own[lo]
            alive, overlap = alive[before], overlap[before]
        if not len(alive):
            continue
        if hi - lo == 1:
            found = alive[(p + q) * overlap >= p * (m[alive] + n[lo])]
            us.append(nodes[found])
            vs.append(np.full(len(found), others[own[lo]]))
            held += len(found)
            if held > 500_000:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], len(u)
            continue
        cuts = [lo, *(np.flatnonzero(lcp[lo + 1 : hi] == end) + lo + 1).tolist(), hi]
        stack += [(a, b, end, alive, overlap) for a, b in itertools.pairwise(cuts)]
    none = np.empty(0, np.int64)
    return forest(np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def joined(docs: DataFrame, size: int = 3, ratio: tuple[int, int] = (9, 10)) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs: how many different runs of size words its text has (the whole sequence of
    words is the only one, if there are fewer), and the smallest doc_id that links of a Jaccard similarity of ratio at least reach.

    Null and word-less texts have none and link to nothing, each other included. Equal sets are one set. Repeated rows come back as often
    as they came; of one doc_id with several texts each row goes by its own; a null doc_id links nothing and has a null component_id. Texts
    are read whole; an empty table gives no rows. Columns besides doc_id and text are not read. No candidate is left out: prefixes are as
    long as the similarity asks for, and each pair that meets is compared by its n-grams (as 64-bit hashes) or seen to be out of reach.
    """
    rows = stored(sets(docs, size, ratio), "sets")
    some = rows.where("doc_id is not null and n > 0").groupBy("set").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("need").alias("need"), F.first("first").alias("first"))
    distinct = stored(numbered(some, "distinct", "set").withColumnRenamed("at", "node"), "numbered")
    alive = stored(possible(distinct), "possible")
    asked = distinct.select("least", "set", "n", "node").join(alive.hint("merge"), "node")
    hashed = stored(_hashed(docs, asked, size), "hashed")
    members = stored(ordered(hashed, ratio), "ordered")
    dropped(alive, hashed)
    linked = links(members, ratio)
    found = components(linked)
    dropped(members, linked)
    of = stored(distinct.select("set", "least", "node").join(found.hint("merge"), "node", "left").select("set", "least", F.coalesce("component", "node").alias("top")), "tops")
    tops = of.groupBy("top").agg(F.min("least").alias("component_id"))
    named = of.join(tops.hint("merge"), "top").select("set", "component_id")
    out = rows.select("doc_id", "set", "n").join(named.hint("merge"), "set", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
