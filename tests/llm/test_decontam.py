import hashlib
import random
import re

from sievelight.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def _brute(docs, items, size):
    out = []
    for d, t in docs:
        w, hit, names = _words(t), set(), set()
        for name, x in items:
            v = _words(x)
            k = min(size, len(v))
            for i in range(len(v) - k + 1 if v else 0):
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == v[i : i + k]:
                        hit |= set(range(j, j + k))
                        names.add("" if name is None else name)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    vocab = ["a", "b", "Ça", "d2", "É"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", ".-", "\x00"]) for _ in range(n))
    items = [(f"i{i}", text(rng.choice([1, 2, 3, 4, 5, 8, 12]))) for i in range(25)] + [("empty", ""), ("null", None), (None, "z Z z"), ("i3", "dup dup dup dup")]
    docs = [(i, text(rng.choice([0, 1, 5, 60]))) for i in range(60)] + [(3, "zz"), (3, "zz"), (None, "dup Dup dup dup dup"), (70, None), (71, "z z z z")]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id string, text string")
    want = _brute(docs, items, 4)
    for most in (decontam.BENCHMARK_BYTES, 60):
        data = decontam.judged(d, b, 4) if most > 60 else None
        if data is None:
            found = decontam.find_windows(d, b, 4, most_bytes=most).collect()
            got = sorted(((r.doc_id, r.n_words, sum(r.hits[1::2]) - sum(r.hits[::2]), len(r["items"]), decontam.item_digest(r["items"]), bool(r.hits)) for r in found), key=str)
        else:
            got = sorted((tuple(r) for r in data.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
        assert got == want
    assert decontam.judged(d.limit(0), b).count() == 0
    assert decontam.judged(d, b.limit(0)).where("contaminated or n_items > 0").count() == 0
