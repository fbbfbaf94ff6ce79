import random

import xxhash

from sievelight.llm import simhash


def _fp(text, k=4):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _brute(rows, radius=4):
    fps = [_fp(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and bin(fps[i] ^ fps[j]).count("1") <= radius:
                top[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", None if d is None else ids[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    for i in range(150, 260):
        t = rows[rng.randrange(150)][1].split()
        if t and rng.random() < 0.7:
            t[rng.randrange(len(t))] = "Changed"
        rows.append((i, " ".join(t)))
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "One\x0btwo"), (403, "One\x0btwo"), (None, rows[0][1]), (404, "ÀB  c d é")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == _brute(rows)


def test_small_tiles_and_empty(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = [base]
    for _ in range(300):
        fps.append(fps[-1] ^ (1 << rng.randrange(64)) if rng.random() < 0.7 else rng.getrandbits(64))
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f.to_bytes(8, "big"), i) for i, f in enumerate(fps)], "fp binary, node long")
    from sievelight.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(df, 4, tile=32)).collect()}
    top = list(range(len(fps)))
    for _ in range(len(fps)):
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    top[i] = top[j] = min(top[i], top[j])
        if all(top[top[i]] == top[i] for i in range(len(fps))):
            break
    assert all(got.get(i, i) == top[i] for i in range(len(fps)))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0


def _pairs(rng):
    """Texts in families: words changed at one end of a text give a known Jaccard similarity of different five-word shingles."""
    word = lambda: f"v{rng.randrange(10**9)}"
    rows = []
    for shared, own in [(60, 20), (70, 15), (78, 11), (80, 10), (85, 7), (90, 5)]:  # shared / (shared + 2 own): 0.6, 0.7, 0.78, 0.8, 0.86, 0.9
        for _ in range(30):
            base = [word() for _ in range(shared + 4)]
            rows += [" ".join(base + [word() for _ in range(own)]) for _ in range(2)]
    for n in range(1, 22):  # very short: n words against n and one or two more, and with another word at the end
        for _ in range(8):
            base = [word() for _ in range(n)]
            rows += [" ".join(base), " ".join([*base, word()]), " ".join([*base, word(), word()]), " ".join([*base[:-1], word()])]
    return rows


def _similar_groups(texts):
    sets = [set(simhash.shingles(t.encode(), 5, False).tolist()) for t in texts]
    holders, top = {}, list(range(len(texts)))
    for i, s in enumerate(sets):
        for h in s:
            holders.setdefault(h, []).append(i)

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for near in holders.values():
        for i in near:
            for j in near:
                if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    top[b] = a
    return [find(i) for i in range(len(texts))]


def test_only_what_is_similar_enough_links(spark):
    texts = _pairs(random.Random(8))
    random.Random(9).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = _similar_groups(texts)
    assert {r.doc_id: r.component_id for r in simhash.groups(df).collect()} == dict(enumerate(want))
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [i for i, x in enumerate(want) if i == x]


def test_one_group_over_many_bundles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUNDLE_BYTES", 8 * 400)
    rng = random.Random(10)
    base = [f"v{i}" for i in range(100)]
    texts = []
    for _ in range(60):  # from one base: some pairs are similar enough, others near by fingerprint alone
        t = list(base)
        for k in rng.sample(range(100), rng.randint(0, 3)):
            t[k] = f"x{rng.randrange(50)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.groups(df).collect()} == dict(enumerate(_similar_groups(texts)))


def test_rows_of_one_doc_id_go_by_their_own_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (3, a), (3, b), (3, b), (5, c), (5, d), (7, d), (8, c), (None, a)]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, lang string").repartition(3)
    out = simhash.one_of_each(df)
    # 3 loses its copy of 1, not b; 5 keeps c alone, so 7 is the one that holds d
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a), (3, b), (5, c), (7, d), (None, a)], key=str)


def test_near_copies_are_searched_by_bands(spark, monkeypatch):
    """Sets that have little in common never meet, so that no tiles of all fingerprints are compared with each other; similar ones share a band."""
    import numpy as np

    monkeypatch.setattr(simhash, "links", None)
    rng = random.Random(12)
    word = lambda: f"v{rng.randrange(10**9)}"
    base = [[word() for _ in range(60)] for _ in range(200)]
    texts = [" ".join(x) for x in base] + [" ".join([*x[:55], word()]) for x in base[:100]]  # 51 shingles of 57 in common
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.groups(df).collect()} == {i: i if i < 200 else i - 200 for i in range(300)}
    sets = [simhash.shingles(t.encode(), 5, False) for t in texts]
    lows = np.array([simhash.least_hashes(h) for h in sets])
    keys = simhash.bands(lows.reshape(-1, simhash.BANDS, simhash.ROWS)).view(np.int64).tolist()
    got = {(r.u, r.v) for r in simhash.candidates(spark.createDataFrame(list(enumerate(keys)), "node long, bands array<long>")).collect()}
    assert got == {(i + 200, i) for i in range(100)}
    assert len(simhash.least_hashes(sets[0][:0])) == simhash.BANDS * simhash.ROWS
