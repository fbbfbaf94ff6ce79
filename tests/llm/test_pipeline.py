import random

import corpus_pipeline
import public_tokenizers
from sievelight.llm import decontam, simhash
from sievelight.llm.tokens import WordIds

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ["n", "r", "st", "lling"]]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def _corpus(tmp_path, spark):
    rng = random.Random(21)
    good = [(i, _text(rng, rng.randint(60, 300))) for i in range(200)]
    bad = [(i, " ".join(w + "$$$" for w in _text(rng, 80).split())) for i in range(200, 240)]
    bench = [("b1", _text(rng, 30)), ("b2", _text(rng, 12)), (None, None)]
    leaks = [(300 + k, _text(rng, 100) + " " + bench[k % 2][1] + " " + _text(rng, 100)) for k in range(6)]
    copies = [(400 + k, good[k][1] if k % 2 else good[k][1].replace(good[k][1].split()[30], "changed", 1)) for k in range(40)]
    secret = [(500, _text(rng, 50) + ' token = "abcdefgh12345678" ' + _text(rng, 50))]
    long = [(600, _text(rng, 20000))]
    docs = good + bad + leaks + copies + secret + long
    rows = [(d, t, "en", "s", len(t)) for d, t in docs] + [(None, _text(rng, 100), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 200 or d >= 300), 0) for d, _ in docs], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return dict(docs), rows


def test_pipeline_on_planted_cases(spark, tmp_path):
    texts, rows = _corpus(tmp_path, spark)
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        columns = columns or docs.columns
        if name != "packing":
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{name}")
            out = docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept.append({r.doc_id: r.text for r in out.collect()})
    quality, dedup, clean, redacted = kept
    assert not set(range(200, 240)) & set(quality) and {d for d in texts if not 200 <= d < 240} <= set(quality)
    assert not set(range(400, 440)) & set(dedup) and {d for d in quality if d is None or d < 400 or d >= 500} == set(dedup)
    assert set(dedup) - set(clean) == set(range(300, 306))
    assert set(redacted) == set(clean) and "[assign]" in redacted[500] and "abcdefgh12345678" not in redacted[500]
    assert all(redacted[d] == clean[d] for d in clean if d != 500)
    pieces = out.collect()
    ids = WordIds.of(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {d: len(ids.encode(None if t is None else t.encode())) + 1 for d, t in redacted.items()}
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == sizes
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("length").collect()) == sorted((p.length,) for p in pieces)


def test_stages_take_empty_tables_and_odd_rows(spark, tmp_path):
    _corpus(tmp_path, spark)
    shape = "n_words long, text string, doc_id long, hits string"
    odd = spark.createDataFrame([(1, None, 1, "x"), (1, "", 2, "x"), (1, "same text", 3, "x"), (1, "other text", 3, "x"), (1, None, None, "x"), (1, None, None, "x")], shape)
    for docs, n in ((odd.limit(0), 0), (odd, None)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() == n or n is None
            assert name == "packing" or out.columns == docs.columns
    left = simhash.one_of_each(odd).collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id is not None) == [(1, None), (3, "other text")] and len(left) == 4
    assert decontam.clean(odd, spark.createDataFrame([], "item_id string, text string")).count() == 6
    many = spark.createDataFrame([(f"i{k}", f"w{k} x{k} y{k}") for k in range(9)], "item_id string, text string")
    hit = spark.createDataFrame([(1, "a w3 x3 y3 b"), (2, "a w3 x3 b")], "doc_id long, text string")
    assert [r.doc_id for r in decontam.clean(hit, many, 10, most_bytes=40).collect()] == [2]
