"""Language by a string kernel: which n-grams of characters two texts share.

The blended-spectrum kernel counts the different n-grams (1 to 4 characters) present in both texts, over the geometric mean of how many
each has. Landmarks (Nystroem) stand for the training texts: a text becomes its kernel values with them, times the inverse root of
their own kernel matrix. Ridge regression of one against the rest gives a column of weights a language. N-grams are 64-bit ids that
are never folded together, so the kernel of a text of any length is exact; what a task holds are the landmarks' own n-grams. Scoring a
batch is a product of matrices: its presence of these n-grams, with the landmarks' (times the weights, multiplied out beforehand).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import mix64, stored
from .quality import fold

LONGEST = 4
#: Training texts of each language, on average, and landmarks of all of them; different n-grams that a landmark has at most.
PER_LANGUAGE, LANDMARKS, MOST_GRAMS = 600, 256, 20_000
RIDGE = 1e-3
#: Characters of a text whose n-grams are taken at once.
STRETCH = 1 << 16
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)]))
    return _LETTERS[0]


def presence(text: str | None) -> np.ndarray | None:
    """The different n-grams that a text has, as ascending 64-bit ids, lower-cased, every stretch of other characters one space; None
    for a text without a letter. Memory goes with a stretch and with how many different ones there are, not with the text's n-grams."""
    cs = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cs]
    if not letter.any():
        return None
    cs = np.where(letter, cs, np.uint32(32))
    blank = cs == 32
    cs = cs[~(blank & np.append(False, blank[:-1]))]
    cs = np.concatenate([[np.uint32(32)], cs, [np.uint32(32)]])
    out = np.empty(0, np.uint64)
    for k in range(0, len(cs), STRETCH):
        part = cs[k : k + STRETCH + LONGEST - 1].astype(np.uint64)
        own, h = [out], np.zeros(len(part), np.uint64)
        for n in range(1, min(LONGEST, len(part)) + 1):
            h = mix64(h[: len(part) - n + 1] * np.uint64(31) + part[n - 1 :] + np.uint64(n))
            own.append(h)
        out = np.unique(np.concatenate(own))
    return out


@dataclass(frozen=True)
class Landmarks:
    """The n-grams of the landmarks: ids in ascending order, which landmarks have each (bits, a row an id), and how many each has."""

    ids: np.ndarray
    bits: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, present: list[np.ndarray]) -> Landmarks:
        ids = np.unique(np.concatenate(present)) if present else np.empty(0, np.uint64)
        there = np.zeros((len(ids), len(present)), bool)
        for k, x in enumerate(present):
            there[np.searchsorted(ids, x), k] = True
        return cls(ids, np.packbits(there, axis=1), np.array([len(x) for x in present], float))

    def dense(self) -> np.ndarray:
        return np.unpackbits(self.bits, axis=1, count=len(self.sizes))

    def shared(self, present: list[np.ndarray], each: np.ndarray) -> np.ndarray:
        """The presence matrix of the texts times each (a row an id of the landmarks')."""
        out = np.zeros((len(present), each.shape[1]))
        for k, x in enumerate(present):
            at = np.minimum(np.searchsorted(self.ids, x), max(0, len(self.ids) - 1))
            out[k] = each[at[self.ids[at] == x] if len(self.ids) else []].sum(0, dtype=float)
        return out

    def kernel(self, present: list[np.ndarray]) -> np.ndarray:
        """Shared n-grams of each text with each landmark, over the geometric mean of how many they have."""
        return self.shared(present, self.dense()) / np.sqrt(np.outer([len(x) for x in present], self.sizes))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    landmarks: Landmarks
    weights: np.ndarray  # landmarks x languages: the inverse root of the landmarks' kernel is multiplied in

    def each(self) -> np.ndarray:
        """What an n-gram of the landmarks adds to each language's value: their presence and sizes times the weights."""
        scaled = self.weights / np.sqrt(self.landmarks.sizes)[:, None]
        dense = self.landmarks.dense()
        return np.concatenate([dense[i : i + 8192] @ scaled for i in range(0, len(dense), 8192)])

    def scores(self, present: list[np.ndarray], each: np.ndarray | None = None) -> np.ndarray:
        return self.landmarks.shared(present, self.each() if each is None else each) / np.sqrt([len(x) for x in present])[:, None]


def fit(kernels: np.ndarray, langs: list[str], landmarks: Landmarks, ridge: float = RIDGE) -> Model | None:
    """Ridge regression on the Nystroem features of texts by their kernel values with the landmarks. None without texts."""
    names = sorted(set(langs))
    if not names:
        return None
    which = np.array([names.index(x) for x in langs])
    dense = landmarks.dense().astype(np.float32)
    own = sum((dense[i : i + 8192].T @ dense[i : i + 8192]).astype(float) for i in range(0, len(dense), 8192)) / np.sqrt(np.outer(landmarks.sizes, landmarks.sizes))
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = kernels @ root
    balance = (len(which) / (len(names) * np.bincount(which)))[which]  # each language counts alike
    y = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = np.linalg.solve((x * balance[:, None]).T @ x + ridge * len(x) * np.eye(x.shape[1]), (x * balance[:, None]).T @ y)
    return Model(tuple(names), landmarks, root @ w)


def learn(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """A model from usable rows with a language: about per_language texts of each are taken by the hash of their doc_id and text, and at
    most twice as many of all. Landmarks are dealt evenly to languages among those of MOST_GRAMS n-grams at most. What is collected
    are the landmarks' n-grams and, of each text, a number a landmark."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1e6
    names = known.groupBy("lang").count().collect()  # a row a language
    if not names:
        return None
    rate = F.create_map(*(x for r in names for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))))
    taken = known.where(h < F.element_at(rate, F.col("lang"))).withColumn("turn", F.xxhash64("doc_id", F.lit(4)))
    taken = stored(taken.orderBy("turn", F.xxhash64("text")).limit(2 * per_language * len(names)), "taken")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(g, t, p.tobytes()) for g, t, p in zip(b.column("lang").to_pylist(), b.column("turn").to_pylist(), map(presence, b.column("text").to_pylist()), strict=True) if p is not None and len(p) <= MOST_GRAMS]
            if kept:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "turn", "ids"])

    own = taken.mapInArrow(grams, "lang string, turn long, ids binary")
    place = F.row_number().over(W.partitionBy("lang").orderBy("turn", "ids"))  # of the bounded sample
    marks = own.withColumn("place", place).orderBy("place", "lang").limit(landmarks).collect()
    if not marks:
        return None
    held = Landmarks.of([np.frombuffer(bytes(r["ids"]), np.uint64) for r in marks])
    shared = docs.sparkSession.sparkContext.broadcast(held)  # MOST_GRAMS ids a landmark at most

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(g, t, p) for g, t, p in zip(b.column("lang").to_pylist(), b.column("turn").to_pylist(), map(presence, b.column("text").to_pylist()), strict=True) if p is not None]
            if found:
                k = shared.value.kernel([p for *_, p in found])
                yield pa.record_batch([pa.array([g for g, *_ in found], pa.string()), pa.array([t for _, t, _ in found], pa.int64()), pa.array([x.tobytes() for x in k], pa.binary())], ["lang", "turn", "k"])

    rows = taken.mapInArrow(values, "lang string, turn long, k binary").orderBy("turn", "lang", "k").collect()
    return fit(np.frombuffer(b"".join(bytes(r["k"]) for r in rows)).reshape(len(rows), -1), [r["lang"] for r in rows], held)


def identify(docs: DataFrame, usable: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row of docs; usable (a condition on doc_id) says which rows may be learned from.

    The language with the highest regression value wins, of equal ones the first by name; the score is that value, from -1..1 to 0..1.
    Null texts, texts without a letter, and all texts if there is nothing to learn from, are `und` with score 0. Repeated rows come
    back as often as they came; an empty table gives no rows. Texts are read whole, however long.
    """
    model = learn(docs, F.lit(True) if usable is None else usable, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model, model.each()))  # a row of numbers for each n-gram of the landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, each = shared.value or (None, None)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [None if model is None else presence(t) for t in part.column("text").to_pylist()]
                langs, scores = [UNKNOWN] * len(found), [0.0] * len(found)
                there = [j for j, p in enumerate(found) if p is not None]
                if there:
                    values = model.scores([found[j] for j in there], each)
                    for j, k, s in zip(there, values.argmax(1).tolist(), values.max(1).tolist(), strict=True):
                        langs[j], scores[j] = model.languages[k], min(1.0, max(0.0, (s + 1) / 2))
                yield pa.record_batch([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fold 2 of 4 is held out. A null doc_id is in no fold, and not held out."""
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")
