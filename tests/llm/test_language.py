import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sievelight.llm import language

PARTS = {"aa": ["tion", "the", "ing", "and", "wh"], "bb": ["ung", "sch", "ver", "ß", "keit"], "cc": ["ción", "que", "ñ", "ado", "ll"]}


def _rows(n=400):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        out.append((i, " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 60))), lang))
    return out


def test_held_out_and_edges(spark):
    rows = _rows()
    extra = [(900, None, "aa"), (901, "", None), (902, "123 !?", "bb"), (903, "the " * 100000, None), (5, rows[5][1], None), (None, "sch ver", "bb")]
    docs = spark.createDataFrame([(t, g, d, "x") for d, t, g in rows + extra], "text string, lang string, doc_id long, score string").repartition(4)
    got = language.judged(docs).collect()
    assert len(got) == len(rows) + 6
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([by[d].lang_pred == g for d, _, g in rows if by[d].held_out]) > 0.97
    assert [by[k].lang_pred for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.judged(docs).collect()} == {"und"}
    assert language.judged(docs.limit(0)).count() == 0


def _grams(text):
    """Different n-grams as strings, by hand."""
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    s = f" {re.sub(' +', ' ', s)} "
    return {s[i : i + n] for n in range(1, 5) for i in range(len(s) - n + 1)}


def _id(gram):
    h = np.zeros(1, np.uint64)
    for k, c in enumerate(gram):
        h = language.mix64(h * np.uint64(31) + np.uint64(ord(c)) + np.uint64(k + 1))
    return int(h[0])


def test_presence_and_kernel_by_hand(monkeypatch):
    a, b = "Ab, 1b", "b"
    assert _grams(a) == {x for n in range(1, 5) for i in range(6 - n + 1) for x in [" ab b "[i : i + n]]}
    p, q = language.presence(a), language.presence(b)
    assert set(p.tolist()) == {_id(g) for g in _grams(a)} and (np.diff(p.astype(object)) > 0).all()
    assert np.isclose(language.Landmarks.of([q]).kernel([p])[0, 0], len(_grams(a) & _grams(b)) / np.sqrt(len(_grams(a)) * len(_grams(b))))
    long = " ".join(t for _, t, _ in _rows(50))
    whole = language.presence(long)
    monkeypatch.setattr(language, "STRETCH", 37)
    assert np.array_equal(language.presence(long), whole) and len(whole) == len(_grams(long))


def test_fit_is_ridge_on_the_kernel_if_all_rows_are_landmarks():
    texts, langs = [t for _, t, _ in _rows(60)], [g for _, _, g in _rows(60)]
    present = [language.presence(t) for t in texts]
    marks = language.Landmarks.of(present)
    m = language.fit(marks.kernel(present), langs, marks, ridge=1e-2)
    sets = [_grams(t) for t in texts]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.allclose(marks.kernel(present), k)
    names = sorted(set(langs))
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    c = np.diag([60 / (3 * langs.count(g)) for g in langs])
    dual = k @ np.linalg.solve(c @ k + 0.6 * np.eye(60), c @ y)
    assert np.allclose(m.scores(present), dual, atol=1e-6)
    assert np.allclose(m.scores(present), marks.kernel(present) @ m.weights)


def test_query_matches_a_dense_kernel(spark):
    """The whole query against the kernel from n-grams as strings, over the same landmarks and weights."""
    rows = _rows(200)
    rng = random.Random(8)
    long = " ".join("".join(rng.choice(PARTS["bb"]) + chr(97 + rng.randrange(26)) for _ in range(rng.randint(1, 5))) for _ in range(200_000))
    docs = spark.createDataFrame(rows + [(900, long, None), (901, "a", None), (902, "a", None)], "doc_id long, text string, lang string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.learn(docs, ~held)
    train = [(d, t, g) for d, t, g in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    kinds = {np.array(sorted(_id(g) for g in _grams(t)), np.uint64).tobytes(): _grams(t) for _, t, _ in train}
    dense = model.landmarks.dense().astype(bool)
    marks = [kinds[model.landmarks.ids[dense[:, k]].tobytes()] for k in range(dense.shape[1])]
    assert len(marks) == len(train)
    got = {r.doc_id: r for r in language.judged(docs).collect()}
    for d, t, _ in [*rows[:60], (900, long, None), (901, "a", None)]:
        own = _grams(t)
        values = np.array([len(own & m) / np.sqrt(len(own) * len(m)) for m in marks]) @ model.weights
        assert np.isclose(got[d].score, min(1, max(0, (values.max() + 1) / 2))) and got[d].lang_pred == model.languages[int(values.argmax())]
    assert got[900].lang_pred == "bb" and got[901].score == got[902].score
