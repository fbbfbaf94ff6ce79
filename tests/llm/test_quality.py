import random
import zlib

import numpy as np

from sievelight.llm import quality

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ["n", "r", "st", "lling"]]


def _good(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 200))) + "."


def _bad(rng):
    kind = rng.randrange(3)
    w = [rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
    return " ".join(x + "$$$" for x in w) if kind == 0 else " ".join(w).upper() + "!!" if kind == 1 else (w[0] + " ") * 50


def _rows(n=600):
    rng = random.Random(12)
    return [(i, _bad(rng) if i % 7 == 0 else _good(rng), int(i % 7 != 0)) for i in range(n)]


def test_held_out_and_edges(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, "one", "x"), (903, "x" * 300000, "x"), (5, rows[5][1], "x"), (None, "no id", "x")], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(d, q) for d, _, q in rows if d % 2 == 0] + [(0, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == len(rows) + 6
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(by[d].score, by[d].predicted, q) for d, _, q in rows if by[d].held_out]
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.99
    assert np.mean([p == q for _, p, q in held]) > 0.95
    assert by[900].score == by[901].score


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.predicted for r in quality.judged(docs, labels).collect()] == [1, 1]
    assert quality.judged(docs.limit(0), labels).count() == 0
    assert quality.kept(docs, labels.limit(0)).count() == 2


def test_filter_keeps_columns_and_clean_rows(spark):
    rows = _rows(300)
    docs = spark.createDataFrame([(t, d) for d, t, _ in rows] + [("no id", None)], "text string, doc_id long")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    out = quality.kept(docs, labels)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and None in ids
    clean = {d for d, _, q in rows if q}
    assert len(clean & ids) >= 0.99 * len(clean) and len(ids - clean) <= 3


def test_pair_weights_are_a_maximum():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0.5, 1, (200, 3)), rng.normal(0, 1, (100, 3))
    r = quality.fit_pairs(a, b, 5000)
    x, y = (quality.standard(v, np.array(r.mean), np.array(r.spread)) for v in (a, b))
    g = np.random.default_rng(0)
    d = x[g.integers(0, 200, 5000)] - y[g.integers(0, 100, 5000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 5e-4 * w @ w
    w = np.array(r.weights)
    assert all(loss(w) <= loss(w + e) for e in 1e-3 * rng.normal(size=(50, 3)))
    share, cut = quality.best_cut(np.array([1.0, 2, 3]), np.array([0.0, 0.5]))
    assert share == 0.4 and 0.5 < cut < 1


def test_kept_takes_columns_of_any_name(spark):
    rows = [(i, f"Plain words make a whole sentence here, number {i}." if i % 2 else "$$$ ### zz " * (i + 1), "x", "y", "z") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, X_ string, __x string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    out, plain = quality.kept(docs, labels), quality.kept(docs.select("doc_id", "text"), labels)
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()))
    assert [r[:2] for r in got] == sorted(map(tuple, plain.collect())) and {r[2:] for r in got} == {("x", "y", "z")}
