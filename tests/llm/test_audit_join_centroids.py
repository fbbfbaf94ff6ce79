"""The divergence audit, the n-gram join and Yinyang clustering against plain versions of the same definitions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sievelight.llm import centroids, divergence, ngram_join, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", ["op11_divergence", "op13_yinyang"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def _audit(docs, least, scale, top):
    docs = [(t or "", g or "", s or "") for t, g, s in docs]
    out = []
    for lang in {g for _, g, _ in docs}:
        own = [(TERM.findall(lower(t)), s) for t, g, s in docs if g == lang]
        has = {}
        for w, _ in own:
            for t in set(w):
                has[t] = has.get(t, 0) + 1
        kept = sorted((t for t, n in has.items() if n >= least), key=lambda t: t.encode())
        count = lambda s: [sum(w.count(t) for w, x in own if s is None or x == s) for t in kept]  # noqa: B023, E731
        share = lambda c: [1 + scale * (n + 1) // (sum(c) + len(kept)) for n in c]  # noqa: B023, E731
        sources = sorted({s for _, s in own})
        q0 = share(count(None))
        for s in sources:
            c = count(s)
            p = share(c)
            pair = [(o, sum((a - b) ** 2 // b for a, b in zip(p, share(count(o)), strict=True))) for o in sources if o != s]
            term = [(t, (a - b) ** 2 // b) for t, n, a, b in zip(kept, c, p, q0, strict=True) if n and a > b]
            for part, rows, most in (("pair", pair, None), ("term", term, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(rows[:most])]
    return sorted(out)


def test_audit_matches_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    rng = random.Random(3)
    words = ["a", "B", "b", "Ça", "É", "zz", "q-q", "x1y", "ß", "İ"]
    docs = [(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(["de", "en", None]), rng.choice(["s1", "s2", "", None, "ü"])) for _ in range(80)]
    docs += [("rare once", "en", "s1"), (None, "xx", "s1"), ("", "xx", "s2"), ("1 2 3", "yy", None), docs[0], docs[0], ("b " * 5000, "en", "s2")]
    df = spark.createDataFrame([(i, *d, 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, n long")
    df = df.withColumnsRenamed({"doc_id": "term"}).withColumn("total", df["n"])  # further columns of the names used inside
    for scale, top in ((1_000_000_000, 200), (10**6, 3)):
        assert sorted(map(tuple, divergence.audit(df, 3, scale, top).collect())) == _audit(docs, 3, scale, top)
    assert divergence.audit(df.limit(0)).count() == 0


def test_terms_held_are_bounded_within_a_batch():
    """One batch with many times as many terms as are held: they go on row by row, and nothing is lost."""
    rows = [("en", "web" if k % 2 else "news", " ".join(f"w{_letters(k * 5 + j)}" for j in range(10)).encode()) for k in range(400)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    got = list(divergence.tallied(iter([batch]), 100))
    assert max(b.num_rows for b in got) <= 110 and len(got) > 20
    n, docs = Counter(), Counter()
    for r in (r for b in got for r in b.to_pylist()):
        n[r["source"], r["term"]] += r["n"]
        docs[r["source"], r["term"]] += r["docs"]
    want = Counter((s, t) for _, s, text in rows for t in text.split())
    assert n == docs == want


def _letters(k):
    return "".join(chr(97 + int(d)) for d in str(k))


def test_long_texts_are_cut_between_terms():
    text = ("wörd," * 40_000).encode()
    cut = list(divergence.pieces(text, divergence.BREAK, 1000))
    assert b"".join(cut) == text and len(cut) > 100
    assert sum(len(divergence.TERM.findall(x)) for x in cut) == 40_000


def _grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def _joined(docs, k, p, q):
    g = [_grams(t, k) for _, t in docs]
    top = list(range(len(docs)))
    find = lambda i: i if top[i] == i else find(top[i])
    for i, j in itertools.combinations(range(len(docs)), 2):
        if g[i] and g[j] and docs[i][0] is not None and docs[j][0] is not None and q * len(g[i] & g[j]) >= p * len(g[i] | g[j]):
            a, b = find(i), find(j)
            top[a] = b
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(g[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("ratio", [(9, 10), (1, 2)])
def test_join_matches_all_pairs(spark, monkeypatch, ratio):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß"]
    docs = []
    for base in range(14):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 40, 150]))]
        shared = [f"p{i}" for i in range(30)] if base % 3 == 0 else []
        for _ in range(14):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            if rng.random() < 0.3:
                own = own[: -rng.randrange(1, 4)] or own
            docs.append((len(docs) * 7 % 1009, " ".join(own + shared)))
    docs += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "A B"), (4999, "a  b\x0b"), (5004, "a b c"), (None, docs[3][1]), (5005, docs[40][1]), (5005, docs[80][1]), (5005, docs[80][1]), (6000, "x\x1fy x\x1fy x\x1fy")]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, n long, node string").repartition(5)
    if ratio == (1, 2):
        assert sorted(map(tuple, ngram_join.joined(df, 3, ratio).collect()), key=str) == _joined(docs, 3, *ratio)
        return
    monkeypatch.setattr(ngram_join.links, "__defaults__", (600,))  # many bundles
    assert sorted(map(tuple, ngram_join.joined(df, 3, ratio).collect()), key=str) == _joined(docs, 3, *ratio)
    assert ngram_join.joined(df.limit(0)).count() == 0
    assert ngram_join.joined(df.where("doc_id in (5000, 5001)")).count() == 2


def test_grams_of_long_texts_are_whole():
    words = [f"w{i % 977}" for i in range(300_000)]
    text = " ".join(words).encode()
    assert len(ngram_join.ngrams(text)) == len(_grams(text.decode(), 3))
    assert np.array_equal(ngram_join.ngrams(b"A b\tC"), ngram_join.ngrams(b" a  B c"))
    assert len(ngram_join.ngrams(b"a b")) == len(ngram_join.ngrams(b"a")) == 1 and len(ngram_join.ngrams(None)) == 0


def _clustered(rows, k, rounds):
    kept = [(v, [int(np.floor(64 * float(x))) for x in e]) for v, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    c = [f for _, f in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for t in range(rounds + 1):
        near = [min((far(f, x), i) for i, x in enumerate(c)) for _, f in kept]
        if t < rounds:
            c = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [f for (_, f), (_, n) in zip(kept, near, strict=True) if n == i]) else x for i, x in enumerate(c)]
    of = [sum(d for d, n in near if n == i) for i in range(len(c))]
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((v, n, d, of[n], sum(of), name[n]) for (v, _), (d, n) in zip(kept, near, strict=True)), key=str)


def test_clustering_matches_plain_rounds(spark):
    rng = np.random.default_rng(5)
    mid = rng.normal(size=(6, 64))
    rows = [(i, [float(np.float32(x)) for x in mid[i % 6] + rng.normal(size=64) * (0.2 if i % 2 else 1)]) for i in range(150)]
    rows += [(3, rows[3][1])] * 20 + [(None, rows[5][1]), (900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [0.0] * 64), (906, [-0.0] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, f string").repartition(4)
    assert sorted(map(tuple, centroids.report(df).collect()), key=str) == _clustered(rows, 16, 3)
    few = df.where("vec_id < 5")
    assert sorted(map(tuple, centroids.report(few).collect()), key=str) == _clustered([r for r in rows if r[0] is not None and r[0] < 5], 16, 3)
    assert centroids.report(df.limit(0)).count() == 0


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, k, size = rng.integers(1, 300), int(rng.integers(1, 20)), int(rng.integers(1, 6))
        x = rng.integers(-5, 6, (n, size))
        c, before = x[rng.integers(0, n, k)].astype(np.int64), None
        of = centroids.grouped(c, int(rng.integers(1, 6)))
        for _ in range(5):
            near, best, low = centroids.first_assignment(x, c, of) if before is None else centroids.next_assignment(x, near, low, c, before, of)[:3]
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            assert (near == d.argmin(1)).all() and (best == d.min(1)).all()
            d = np.sqrt(d.astype(float))
            d[np.arange(n), near] = np.inf
            assert all((low[:, g] <= d[:, of == g].min(1) + 1e-12).all() for g in range(of.max() + 1))
            before, c = c, np.array([x[near == j].sum(0) // (near == j).sum() if (near == j).any() else c[j] for j in range(k)], np.int64)
    x = np.concatenate([m + rng.integers(-9, 10, (300, 8)) for m in rng.integers(-900, 900, (12, 8))])
    c = x[rng.permutation(len(x))[:12]]
    of = centroids.grouped(c, 4)
    near, _, low = centroids.first_assignment(x, c, of)
    after = np.array([x[near == j].sum(0) // max(1, (near == j).sum()) for j in range(12)])
    assert centroids.next_assignment(x, near, low, after, c, of)[3] < len(x) * 12 * 0.6
