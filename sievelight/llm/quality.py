"""Quality by pairwise ranking (Bradley-Terry): a document's strength is a weighted sum of features of its text.

A pair of a preferred and another document says that the strength of the first is larger; the weights maximise the logistic likelihood
of such pairs, which depends on differences of features only. The cut is a quantile of the strengths of all documents: the share of
fitted documents below the strength that separates them best. Features come from whole texts alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from .common import LOWER, UPPER, free_name, stored

#: Character classes of ASCII; all else is one more class.
GROUPS = (LOWER, UPPER, "0123456789", " \t", "\n\r", ".,;:?", "!", "|", "$%#&*@^~", "()[]{}<>/\\=_+-", "\"'`")
_CLASS = np.full(128, len(GROUPS), np.int64)
for _k, _g in enumerate(GROUPS):
    _CLASS[[ord(x) for x in _g]] = _k
#: Labelled documents of each side that weights are fitted on at most, taken by hash, and pairs of them.
MOST_LABELLED, PAIRS = 20_000, 200_000
#: The score at the cut.
CUT = 0.3


def features(text: str | None) -> list[float]:
    t = text or ""
    n = max(1, len(t))
    cs = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    share = np.bincount(np.where(cs < 128, _CLASS[np.minimum(cs, 127)], len(GROUPS) + 1), minlength=len(GROUPS) + 2) / n
    words = t.split()
    k = max(1, len(words))
    lower = t.lower().split()
    seen = Counter(lower)
    lines = [x for x in t.split("\n") if x.strip()]
    m = max(1, len(lines))
    return [
        *share.tolist(),
        np.log1p(len(t)) / 10,
        sum(map(len, words)) / k / 10,
        len(seen) / k,
        max(seen.values(), default=0) / k,
        sum(map(str.__eq__, lower[1:], lower)) / k,
        sum(not w[-1].isalnum() for w in words) / k,
        sum(map(str.isupper, words)) / k,
        (m - len(set(lines))) / m if lines else 0.0,
        np.log1p(len(t) / m) / 10,
        sum(len(w) <= 3 for w in words) / k,
        sum(len(w) > 15 for w in words) / k,
    ]


def featured(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id and x (array of features) of every row of docs; whole keeps all columns instead, and the features come last, by a name that
    no other has."""
    own, name = (docs, free_name(docs.columns, "x")) if whole else (docs.select(F.col("doc_id").cast("long"), "text"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.list_(pa.float32()))
            yield pa.record_batch([*b.columns, x], [*b.schema.names, name]) if whole else pa.record_batch([b.column("doc_id"), x], ["doc_id", name])

    return own.mapInArrow(run, StructType([*own.schema.fields, StructField(name, ArrayType(FloatType()))]) if whole else "doc_id long, x array<float>")


@dataclass(frozen=True)
class Ranking:
    """strength = (clipped (x - mean) / spread) . weights; share: of the fitted documents below the best cut, cut: that strength."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    share: float
    cut: float


def standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -5, 5)


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3) -> Ranking | None:
    """Weights by Newton steps on the logistic loss of pairs drawn from the rows of better and worse; None if there is no pair."""
    if not len(better) or not len(worse):
        return None
    both = np.concatenate([better, worse])
    mean, spread = both.mean(0), both.std(0) + 1e-6
    b, w = standard(better, mean, spread), standard(worse, mean, spread)
    rng = np.random.default_rng(0)
    n = min(pairs, len(b) * len(w))
    d = b[rng.integers(0, len(b), n)] - w[rng.integers(0, len(w), n)]
    at = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ at, -50, 50)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(at)), d.T @ (p - 1) / n + ridge * at)
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return Ranking(tuple(mean.tolist()), tuple(spread.tolist()), tuple(at.tolist()), *best_cut(b @ at, w @ at))


def best_cut(better: np.ndarray, worse: np.ndarray, cost: float = 3.0) -> tuple[float, float]:
    """(share of all below, strength) of the cut with the lowest sum of error rates; turning away a better one costs cost times as much."""
    s = np.concatenate([better, worse])
    good = np.concatenate([np.ones(len(better)), np.zeros(len(worse))])
    order = np.argsort(s, kind="stable")
    s, good = s[order], good[order]
    loss = cost * np.append(0, np.cumsum(good)) / len(better) + (len(worse) - np.append(0, np.cumsum(1 - good))) / len(worse)
    k = int(loss.argmin())  # the k lowest are below
    edge = s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2
    return k / len(s), float(edge)


def learn(feats: DataFrame, labels: DataFrame, usable: Column, most: int = MOST_LABELLED) -> tuple[Ranking | None, float]:
    """The ranking, and the true share of documents below its cut, from labelled (doc_id, quality) rows of feats that are usable.

    At most `most` documents of each label are collected, those with the lowest hashes, so the sides' sizes are bounded; the share is
    then weighted by how many there are of each label. Repeated labels of a document are averaged (0.5 counts as 1); null labels are none.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).alias("good"))
    rows = feats.where(usable).join(known, "doc_id").select("good", "x", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    n = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    sides = [np.array([r["x"] for r in rows.where(F.col("good") == good).orderBy("h", "x").limit(most).collect()], float) for good in (True, False)]
    found = fit_pairs(*sides)
    if found is None:
        return None, 0.0
    better, worse = (standard(x, np.array(found.mean), np.array(found.spread)) @ np.array(found.weights) for x in sides)
    low = (better < found.cut).mean() * n[True] + (worse < found.cut).mean() * n[False]
    return found, float(low / (n[True] + n[False]))


def strength(x: Column, ranking: Ranking) -> Column:
    """The strength of features x, summed in index order: equal texts have equal ones, wherever and however often they are computed."""
    terms = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(w).alias("w")) for m, s, w in zip(ranking.mean, ranking.spread, ranking.weights, strict=True)))
    parts = F.zip_with(x.cast("array<double>"), terms, lambda v, t: F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (v - t["m"]) / t["s"])) * t["w"])
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


def _judge(feats: DataFrame, labels: DataFrame, usable: Column | None, most: int) -> tuple[Ranking | None, float]:
    """The ranking, and the strength at the quantile over all of feats (doc_id, x)."""
    ranking, share = learn(feats, labels, F.lit(True) if usable is None else usable, most)
    if ranking is None:
        return None, 0.0
    edge = feats.select(strength(F.col("x"), ranking).alias("s")).agg(F.percentile_approx("s", F.lit(share), F.lit(100_000))).first()[0]
    return ranking, float(edge or 0.0)


def scored(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, score and predicted of every row of docs. usable (a condition on doc_id) says whose labels may be learned from.

    The score is the logistic function of the strength, moved so that the strength at the quantile is CUT. Null texts count as empty and
    are scored like any other; equal texts have equal scores; repeated rows come back as often as they came. Without labels of both
    sides all strengths are equal, every score is CUT and every document is kept. An empty table gives no rows.
    """
    feats = stored(featured(docs), "quality")
    ranking, edge = _judge(feats, labels, usable, most)
    over = F.lit(0.0) if ranking is None else strength(F.col("x"), ranking) - F.lit(edge)
    raw = feats.select("doc_id", over.alias("over"))
    over = F.col("over")
    good = (over >= 0).cast("int")
    score = 1 / (1 + F.exp(-(over + F.lit(float(np.log(CUT / (1 - CUT)))))))
    return raw.select("doc_id", F.when(good == 1, F.greatest(score, F.lit(CUT))).otherwise(F.least(score, F.lit(CUT - 1e-9))).alias("score"), good.alias("predicted"))


def fold(doc_id: str, folds: int) -> Column:
    """The remainder of crc32(doc_id as text); null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: fold 0 of 5 is held out. A null doc_id is in no fold, and not held out."""
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    out = scored(docs, labels, ~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def kept(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of docs that are not rejected, in the same columns; no text is shuffled and each is read once.

    Null texts count as empty and are judged like any other, rows with a null doc_id too; repeated rows go or stay together. Without
    labels of both sides every row stays; an empty table gives no rows. Texts are read whole, however long.
    """
    held = stored(featured(docs, whole=True), "quality")
    x = F.col(f"`{held.columns[-1]}`")
    ranking, edge = _judge(held.select(F.col("doc_id").cast("long"), x.alias("x")), labels, None, most)
    return (held if ranking is None else held.where(strength(x, ranking) >= F.lit(edge))).select(*docs.columns)
