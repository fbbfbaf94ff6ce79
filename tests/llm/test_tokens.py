import random
import zlib

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from sievelight.llm import huffman, packing
from sievelight.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n", "The the THE.", "it's don't I'LL we've 's 't", "a1b22 3.14 x_y", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>",
    "éÉ eÌ\x81 café ́x ẞß ÀÿÜ İı Ǆ Kelvin K ſ ﬁ", "日本語 テスト １２ ½ ²", "a b c\u0085d\x1ce", "!!! ,., %%% $$$ *** a!!b", "naïve—dash “quotes” …",
    "A" * 5000, "x " * 3000, "emoji 😀👍🏽 z‍w", "|a| <|a| a|>b", "\x00\x01 \x7f", "ΣΑΣ ΟΔΟΣ. ΑΣ,",
]


def test_word_ids_equal_the_whole_tokenizer():
    whole, mine = Tokenizer.from_file(PATH), WordIds(PATH, most=50)
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCéèçüößñÀÉ.,!'|%1<>- \n\t"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(2000)]
    for _ in range(2):
        for t in texts:
            assert mine.encode(None if t is None else t.encode()).tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("limit", [4, 6, 16])
def test_code_lengths(limit):
    rng = np.random.default_rng(limit)
    counts = rng.geometric(0.001, 16) ** 3
    n = huffman.code_lengths(counts, limit)
    assert n.max() <= limit and (2.0**-n).sum() == 1
    if limit == 16:
        import heapq

        heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        best = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            best += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], a[1], []))
        assert best == (n * counts).sum()


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 10_001) - 1, 40_000)
    there, counts = np.unique(ids, return_counts=True)
    codes = huffman.Codes(there, huffman.code_lengths(counts, 16))
    for n in (0, 1, 63, 64, 65, 10_001):
        assert codes.decode(*codes.encode(ids[:n]), n).tolist() == ids[:n].tolist()
    one = huffman.Codes(np.array([7]), huffman.code_lengths(np.array([3]), 16))
    assert one.decode(*one.encode(np.array([7, 7, 7])), 3).tolist() == [7, 7, 7]


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string").repartition(3)


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "PART_TOKENS", 2000)
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(i, " ".join(rng.choice(["the", "thing", "Éau", "42"]) for _ in range(rng.randint(0, 400)))) for i in range(100, 140)]
    rows += [(3, "twice"), (None, "no id"), (7, "twice"), (7, "twice")]
    path = str(tmp_path / "t")
    huffman.write_tokens(_docs(spark, rows), path, PATH, 2)
    got = sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in huffman.read_tokens(spark, path).collect()))
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [d for _, d, _, _ in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert sorted((str(d), np.frombuffer(x, "<u4").tolist()) for _, d, _, x in got) == sorted((str(d), ids(t)) for d, t in rows)
    none = str(tmp_path / "none")
    huffman.write_tokens(_docs(spark, []), none, PATH, 2)
    assert huffman.read_tokens(spark, none).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(1, 21, rng.integers(1, 60))
        bins = packing.best_fit(sizes, 20)
        assert (np.bincount(bins, weights=sizes) <= 20).all()
        assert packing.bound(sizes, 20) <= bins.max() + 1
    assert packing.bound(np.array([11] * 5), 20) == 5 and packing.bound(np.array([7] * 6), 20) == 3 and packing.bound(np.array([5, 5, 5, 5]), 20) == 1
    frame = pd.DataFrame({"doc_id": range(4), "length": [12, 8, 15, 5], "uid": range(4), "sequence_id": range(4)})
    assert packing.repack(frame, 20, True).sequence_id.nunique() == 2


@pytest.mark.parametrize("group", [10, 10_000])
def test_pack_documents(spark, group):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "x"]) for _ in range(rng.choice([0, 3, 11, 30, 61, 200])))) for i in range(120)]
    rows += [(5, "again"), (5, "again"), (None, None)]
    got = packing.pack(packing.pieces(_docs(spark, rows), PATH, 0, 64), 64, group).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(str(d), k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 64
    least = packing.bound(np.array([r.length for r in got]), 64)
    assert len(bins) <= (least + 2 if group > 10 else 1.15 * least)  # groups of ten pieces can't be packed as well
    assert packing.pack_documents(_docs(spark, []), PATH).count() == 0


def _fewest(sizes, capacity):
    """Bins of an optimal packing, by trying every bin for every size, largest first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= sizes[k]}):
            rest = list(bins)
            rest.remove(room)
            put(k + 1, [*rest, room - sizes[k]])
        put(k + 1, [*bins, capacity - sizes[k]])

    put(0, [])
    return best[0]


def test_bounds_and_packings_against_the_fewest_bins():
    rng = np.random.default_rng(9)
    met = 0
    for _ in range(150):
        sizes = rng.integers(1, 13, rng.integers(1, 10))
        fewest = _fewest(sizes.tolist(), 12)
        frame = pd.DataFrame({"doc_id": 0, "length": sizes, "uid": range(len(sizes)), "sequence_id": range(len(sizes))})
        out = packing.repack(frame, 12, True)
        bins = out.sequence_id.nunique()
        assert packing.bound(sizes, 12) <= fewest <= bins
        assert not out.certified.any() or bins == fewest
        met += bins == fewest
    assert met >= 145


def test_memo_keeps_short_chunks_only():
    words = WordIds(PATH, most=100)
    whole = Tokenizer.from_file(PATH)
    for t in ("ab" * 5000, "日本" * 4000, "a" * 64, "!" * 300 + " " + "b" * 70 + "!"):
        assert words.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids
    assert max(map(len, words.memo)) <= 64 and all(len(m) <= 64 for m in words.marks)
