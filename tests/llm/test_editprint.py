import hashlib
import random

import numpy as np

from sievelight.llm import editprint as ep


def _slow(text):
    """The walk step by step, one emitted character at a time."""
    bits, records = ep._bits(), ep._records()
    cs = [ord(c) for c in text]
    emitted, i, j = [], 0, 0
    kinds = ep.classes(np.array(cs, np.uint32)) if cs else []
    while i < len(cs):
        emitted.append(i)
        i += int(bits[kinds[i], j % ep.PERIOD])
        j += 1
    if not cs:
        return bytes(ep.SAMPLES)
    out = bytearray()
    for row in records:
        step = max(int(r) for r in row if r < len(emitted))
        h = ep.mix64(np.array([step + 1], np.uint64))
        for k in range(3):
            at = emitted[step] + k
            h = ep.mix64(h ^ np.uint64(cs[at] if at < len(cs) else 0))
        out.append(int(h[0]) >> 56)
    return bytes(out)


def _text(rng, n):
    return "".join(rng.choice("abcdefgh éü\n😀") for _ in range(n))


def _likeness(a, b):
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / ep.SAMPLES - 1 / 256) / (1 - 1 / 256))


def test_edits_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, _text(rng, rng.choice([0, 1, 2, 3, 30, 700, 3000]))) for i in range(60)] + [(70, None), (71, ""), (72, "x" * 20000), (5, "again"), (5, "again"), (None, "no id")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, fingerprint string").repartition(4)
    got = sorted((tuple(r) for r in ep.edits(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for k, (d, t) in enumerate(order):
        t, o = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + o[: len(t) // 3]
        a, b, c = _slow(t), _slow(e), _slow(o)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), _likeness(a, b), _likeness(a, c)))
    assert got == sorted(want, key=str)
    assert ep.edits(df.limit(0)).count() == 0
    one = ep.edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_likeness_follows_edits():
    rng = random.Random(10)
    fp = lambda t: ep._Print(None, t).fp
    apart, near, far = [], [], []
    for _ in range(40):
        t = _text(rng, 3000)
        e = list(t)
        for _ in range(10):
            e[rng.randrange(len(e))] = rng.choice(["", "zz", "q"])
        near.append(ep.likeness(fp(t), fp("".join(e))))
        apart.append(ep.likeness(fp(t), fp(t[:2000] + _text(rng, 1000))))
        far.append(ep.likeness(fp(t), fp(_text(rng, 3000))))
    assert np.mean(near) > 0.6 and 0.55 < np.mean(apart) < 0.8 and np.mean(far) < 0.05


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(11)
    rows = [(i, _text(rng, 400)) for i in range(40)]
    for i in range(40, 110):
        t = rows[rng.randrange(20)][1]
        k = rng.randrange(len(t))
        rows.append((i, t[:k] + rng.choice(["", "edit"]) + t[k + 2 :] if i % 5 else t))
    rows += [(200, None), (201, ""), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ep.near_duplicates(df, tile=8).collect()}
    fps = {d: ep._Print(None, t).fp for d, t in rows if d is not None}
    top = {d: d for d in fps}
    for _ in range(8):
        for a in fps:
            for b in fps:
                if ep.likeness(fps[a], fps[b]) >= 0.5:
                    top[a] = top[b] = min(top[a], top[b])
    assert got.pop(None) is None
    assert got == top
    assert ep.near_duplicates(df.limit(0)).count() == 0


def test_bands_find_what_is_alike(spark):
    """Links of the query against all pairs of every twentieth document with all, and buckets that are cut into tiles."""
    rng = random.Random(12)
    rows = [(i, _text(rng, 600)) for i in range(60)]
    for i in range(60, 400):
        t = list(rows[rng.randrange(60)][1])
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice(["", "zz", "q"])
        rows.append((i, "".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = {d: ep._Print(None, t).fp for d, t in rows}
    for least in (0.8, 0.5):
        for tile in (ep.TILE, 4):
            of = {r.doc_id: r.component_id for r in ep.near_duplicates(df, least, tile).collect()}
            alike = [(a, b) for a in fps if a % 20 == 0 for b in fps if a != b and fps[a] != fps[b] and ep.likeness(fps[a], fps[b]) >= least]
            assert len(alike) > 20 and np.mean([of[a] == of[b] for a, b in alike]) >= 0.97
            near = {a: {b for b in fps if ep.likeness(fps[a], fps[b]) >= least} for a in fps}
            assert all(of[d] == d or of[d] < d for d in fps) and {d for d in fps if of[d] == of[0]} <= _reach(near, 0)
    assert [len(ep.bands_of(x)) for x in (0.5, 0.8, 1.0)] == [65, 8, 1]
    pairs = [(a, b) for a in fps for b in fps if a < b and 0.78 <= ep.likeness(fps[a], fps[b]) < 0.84]
    met = lambda a, b: any(all(fps[a][p] == fps[b][p] for p in at) for at in ep.bands_of(0.8))
    assert len(pairs) > 20 and np.mean([met(a, b) for a, b in pairs]) >= 0.9
    q = {r.doc_id: r for r in ep.judged(df).collect()}
    assert len(q) == 400 and q[0].component_id == 0 and q[0].fingerprint == fps[0].hex()


def _reach(near, a):
    out, todo = {a}, [a]
    while todo:
        new = near[todo.pop()] - out
        out |= new
        todo += new
    return out
