import math
import random

import numpy as np
from pyspark.sql import functions as F

from sievelight.functions import masks, stats, text, vectors


def _tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_bounds_meet_their_tails(spark):
    cases = [(0, 10), (3, 10), (10, 10), (1, 500), (250, 500), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", stats.clopper_pearson(F.col("k"), F.col("n"), 0.95).alias("b"), stats.clopper_pearson_upper(F.col("k"), F.col("n"), 0.95).alias("u")).collect():
        if r.n == 0:
            assert (r.b.low, r.b.high) == (0.0, 1.0)
            continue
        assert r.k == r.n or math.isclose(_tail(r.k, r.n, r.b.high), 0.025, rel_tol=1e-6)
        assert r.k == 0 or math.isclose(1 - _tail(r.k - 1, r.n, r.b.low), 0.025, rel_tol=1e-6)
        assert r.k == r.n or math.isclose(_tail(r.k, r.n, r.u), 0.05, rel_tol=1e-6)
    for a, b, x in [(2, 3, 0.4), (0.5, 0.5, 0.1), (30, 40, 0.5)]:
        grid = (np.arange(400_000) + 0.5) / 400_000 * x
        area = (grid ** (a - 1) * (1 - grid) ** (b - 1)).sum() * x / 400_000
        assert math.isclose(stats.incomplete_beta(a, b, x), area * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)), rel_tol=2e-3)


def test_auroc_counts_pairs(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randint(0, 40)) if g else rng.random(), rng.random() < 0.4) for g in (0, 1) for _ in range(400)] + [(2, 1.0, True), (3, float("nan"), False), (3, 1.0, True)]
    got = {r.g: r.auroc for r in stats.auroc(spark.createDataFrame(rows, "g int, s double, p boolean"), "s", "p", ["g"], 16).collect()}
    for g in (0, 1):
        pos, neg = [s for h, s, p in rows if h == g and p], [s for h, s, p in rows if h == g and not p]
        assert math.isclose(got[g], sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
    assert math.isnan(got[2]) and math.isnan(got[3])


def test_half_floats(spark):
    rng = np.random.default_rng(2)
    xs = [0.0, -0.0, 1.0, 65519.0, 65520.0, -1e9, 6e-8, 2.9e-8, 3.1e-8, 1 / 3, float("nan"), float("inf"), *rng.normal(0, 1, 500), *(rng.normal(0, 1, 200) * 1e-6), *(rng.normal(0, 1, 200) * 1e4)]
    got = [r.h for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").select("i", vectors.half(F.col("x")).alias("h")).orderBy("i").collect()]
    with np.errstate(over="ignore"):
        want = np.array(xs).astype(np.float16).astype(float)
    assert np.array_equal(np.array(got), want, equal_nan=True)


def test_runs_of_masks(spark):
    rng = random.Random(3)
    rows = [([],), ([0],), ([1],), ([1, 1, 0],)] + [([rng.randint(0, 1) for _ in range(rng.randint(1, 40))],) for _ in range(50)]
    for r in spark.createDataFrame(rows, "b array<int>").select("b", masks.encoded(F.col("b")).alias("e"), masks.decoded(masks.encoded(F.col("b"))).alias("d")).collect():
        runs, last = [], 0
        for x in r.b:
            if x == last and runs:
                runs[-1] += 1
            else:
                runs += [0, 1] if not runs and x else [1]
            last = x
        assert r.e == runs and r.d == r.b


def test_location_guard_and_clip(spark):
    cases = [("a scratch", "top", None), ("top scratch", None, "top"), ("upper-left mark", "upper-left", None), ("the lower left", "upper-left", "lower"), ("centre", "centre", None), ("centre", "top", "centre"), ("top centre", "top", None), ("top middle", "upper-left", "middle"), ("LEFTMOST", "left", None), ("right", "left", "right"), ("", "top", None)]
    df = spark.createDataFrame(cases, "t string, r string, w string").select("w", text.guarded(F.col("t"), F.col("r")).alias("g"))
    assert all(x.w == x.g for x in df.collect())
    long = " ".join(f"w{i}" for i in range(24)) + " end, more words here"
    out = spark.createDataFrame([(" One.  Two.",), (long,), ("",), ("no stop",)], "t string").select(text.clipped(F.col("t")).alias("c")).collect()
    assert [r.c for r in out] == ["One.", " ".join(f"w{i}" for i in range(24)) + " end.", "", "no stop"]


def test_sheet_and_foreground(spark):
    rng = np.random.default_rng(4)
    px = rng.normal(100, 5, (300, 2))
    px[:10] += 200
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(px)], "img int, i int, r double, g double")
    sheet = masks.sheet_model(df, "img", ("r", "g"))
    got = {r.channel: (r.mu, r.sigma) for r in sheet.collect()}
    med = np.median(px, 0)
    sigma = np.maximum(1.4826 * np.median(np.abs(px - med), 0), 3)
    assert np.allclose([got["r"], got["g"]], list(zip(med, sigma)))
    fg = {r.i for r in masks.foreground(df, sheet, "img", ("r", "g")).where("foreground").collect()}
    assert fg == set(np.flatnonzero((((px - med) / sigma) ** 2).sum(1) > 16).tolist())


def test_quantiles_are_weighted_means_of_their_ends(spark):
    from sievelight.functions import stats

    at = 0.4  # low + at * (high - low) is rounded otherwise
    some = [(low, high, n) for n in range(2, 200) for low, high in [(0.1 * n, 0.7 * n * n)]]
    df = spark.createDataFrame([(n, x) for low, high, n in some for x in (low, high)], "g long, v double")
    got = {r.g: r.q for r in stats.quantiles(df, "v", ["g"], [at], ["q"]).collect()}
    assert got == {n: low * (1 - at) + high * at for low, high, n in some}


def test_quantiles_do_not_hang_on_the_order_of_parts(spark, monkeypatch):
    """Approximate quantiles that come out otherwise each time they are asked for, as those of parts that arrive in another order may."""
    some = F.udf(lambda v: sorted(random.SystemRandom().sample(v, 9)), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda c, at, accuracy: some(F.collect_list(c)))
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("v"))
    want = {g: np.median([k * 7919 % 3001 for k in range(g, 3000, 3)]) for g in range(3)}
    for _ in range(3):
        assert {r.g: r.q for r in stats.quantiles(df, "v", ["g"], [0.5], ["q"]).collect()} == want
