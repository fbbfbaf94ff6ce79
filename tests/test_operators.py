import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.operators import coreset, gates, knn, maps, pixels, rules, telemetry, twin


@pytest.mark.parametrize(("how", "tile"), [("distance", 1024), ("distance", 7), ("dot", 7)])
def test_nearest_is_brute_force(spark, how, tile):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (120, 5)).astype(float)  # many ties
    rows = [(i, i % 3, i % 4, v[i].tolist()) for i in range(120)] + [(200, 9, 0, [1.0] * 5), (201, 0, 1, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "id long, twin long, seg long, f array<double>")
    got = {r.id: (r.best, r.other) for r in knn.nearest(df, df, "twin", mask="seg", how=how, tile=tile).collect()}
    for i in range(120):
        allowed = [j for j in range(120) if j % 3 == i % 3 and j % 4 != i % 4]
        value = (lambda j: ((v[i] - v[j]) ** 2).sum()) if how == "distance" else (lambda j: -(v[i] * v[j]).sum())
        best = min(allowed, key=lambda j: (value(j), j))
        assert got[i] == (abs(value(best)) if how == "distance" else -value(best), best)
    assert 200 not in got and 201 not in got
    if how == "distance":
        sql = {r.id: (r.best, r.other) for r in knn.nearest_sql(df.where("id < 200"), df.where("id < 200"), "twin", mask="seg").collect()}
        assert sql == {k: x for k, x in got.items()}


def test_k_centre_is_greedy(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(60)] + [(90, 5, [0.0] * 3)], "id long, twin long, f array<double>")
    got = {}
    for r in coreset.k_centre(df, 6).orderBy("twin", "step").collect():
        got.setdefault(r.twin, []).append(r.id)
    for t in (0, 1):
        ids = [i for i in range(60) if i % 2 == t]
        chosen = [ids[0]]
        while len(chosen) < 6:
            gap = {i: min(((v[i] - v[c]) ** 2).sum() for c in chosen) for i in ids if i not in chosen}
            chosen.append(max(gap, key=lambda i: (gap[i], -i)))
        assert got[t] == chosen
    assert got[5] == [90]


def test_patch_sets_and_smoothing_on_a_larger_grid(spark):
    rng = np.random.default_rng(3)
    cov, d = np.zeros((7, 6)), rng.random((7, 6))
    cov[3, 2:4] = 0.5
    df = spark.createDataFrame([(0, r, c, float(cov[r, c]), float(d[r, c])) for r in range(7) for c in range(6)], "frame long, r int, c int, cov double, d double")
    sets = {(x.r, x.c): x for x in maps.patch_sets(df).collect()}
    core = {(3, 2), (3, 3)}
    near = lambda reach: {(r, c) for r in range(7) for c in range(6) if any(abs(r - a) <= reach and abs(c - b) <= reach for a, b in core)}
    assert all((x.in_core, x.in_s, x.in_b) == (k in core, k in near(1), k in near(2)) for k, x in sets.items())
    sm = {(x.r, x.c): x.sm for x in maps.smoothed(maps.patch_sets(df)).collect()}
    s = near(1)
    assert set(sm) == s and all(math.isclose(sm[r, c], np.mean([d[p] for p in s if abs(p[0] - r) <= 1 and abs(p[1] - c) <= 1])) for r, c in s)
    edge = {(x.r, x.c): x.sm for x in maps.edge_mean(df, 7, 6).collect()}
    pad = np.pad(d, 1, mode="edge")
    assert all(math.isclose(edge[r, c], pad[r : r + 3, c : c + 3].mean()) for r in range(7) for c in range(6))


def test_scores_poison_on_numbers_that_are_not_finite(spark):
    rows = [(f, p, 0, True, True, {1: float("nan"), 2: float("inf")}.get(f, 1.0) if p == 1 else 0.5, 1.0) for f in range(3) for p in range(3)]
    df = spark.createDataFrame(rows, "frame long, r int, c int, in_core boolean, in_s boolean, sm double, d double")
    got = {r.frame: r for r in maps.frame_scores(df).collect()}
    assert got[0].raw == 1.0 and (got[0].peak_r, got[0].fit) == (1, 1.0) and math.isnan(got[1].raw) and math.isnan(got[2].raw)


def test_verdict_rules_in_order(spark):
    nan = float("nan")
    ok = dict(sanity="OK", sim=0.9, tau_id=0.5, geometry_ok=True, fit=1.0, tau_fit=2.0, s=0.5, anomalous=0.1)
    cases = [({}, "PASS", None), ({"sanity": "TOO_SMALL", "sim": 0.1}, "REFRAME", "TOO_SMALL"), ({"sim": 0.4, "geometry_ok": False}, "NOT_ENROLLED", "identity"), ({"sim": nan}, "NOT_ENROLLED", "identity"), ({"geometry_ok": False, "fit": 9.0}, "NOT_ENROLLED", "shape"), ({"fit": 9.0}, "NOT_ENROLLED", "fit"), ({"fit": nan}, "NOT_ENROLLED", "fit"), ({"fit": nan, "tau_fit": None}, "PASS", None), ({"fit": nan, "tau_fit": nan}, "PASS", None), ({"s": nan}, "REFRAME", "SCORE_FAILED"), ({"s": float("inf"), "anomalous": 0.9}, "REFRAME", "SCORE_FAILED"), ({"s": 1.0}, "PASS", None), ({"s": 1.2, "anomalous": 0.6}, "NOT_ENROLLED", "coverage"), ({"s": 1.2, "anomalous": 0.5}, "DEFECT", None)]
    df = spark.createDataFrame([(i, *{**ok, **c}.values()) for i, (c, _, _) in enumerate(cases)], "i int, sanity string, sim double, tau_id double, geometry_ok boolean, fit double, tau_fit double, s double, anomalous double")
    got = {r.i: (r.verdict, r.reason) for r in gates.decided(df).collect()}
    assert got == {i: (v, r) for i, (_, v, r) in enumerate(cases)}
    spec = {r.i: r.verdict for r in gates.decided(df, fit_gate=False).collect()}
    assert spec[5] == "PASS"


def test_votes(spark):
    cases = {1: [1.1], 2: [1.1, 1.05], 3: [1.1, 0.9, 1.0], 4: [1.0, 1.0, 2.0], 5: [1.1, None, float("nan")], 6: [1.0, 1.2], 7: [1.0, 1.1, 1.2, 9.0]}
    df = spark.createDataFrame([(k, o, s) for k, ss in cases.items() for o, s in enumerate(ss)], "t int, order int, s double")
    got = {r.t: (r.votes, r.s, r.chosen) for r in gates.voted(df, "t").collect()}
    assert got == {1: (1, 1.1, 0), 2: (2, 1.1, 0), 3: (3, 1.0, 2), 4: (3, 1.0, 0), 5: (1, 1.1, 0), 6: (2, 1.2, 1), 7: (3, 1.1, 1)}


def test_matching_is_greedy_in_time(spark):
    rng = random.Random(5)
    e, a = [(i, rng.randint(0, 3000)) for i in range(60)], [(i, rng.randint(0, 3000)) for i in range(70)]
    df = lambda rows: spark.createDataFrame([(0, *r) for r in rows], "k int, id long, t_ms long")
    got = sorted((r.e_id, r.a_id, r.dt) for r in telemetry.matched(df(e), df(a), "k").collect())
    want, used_e, used_a = [], set(), set()
    for dt, i, j in sorted((abs(s - t), i, j) for i, s in e for j, t in a if abs(s - t) <= 150):
        if i not in used_e and j not in used_a:
            used_e.add(i), used_a.add(j)
            want.append((i, j, dt))
    assert got == sorted(want)


def test_matching_keeps_points_not_pairs(spark, monkeypatch):
    """Many at one time, ids that come again, two as near: as the greedy order has it, in tables no longer than the points."""
    rng, sizes = random.Random(8), []
    real = telemetry.stored
    monkeypatch.setattr(telemetry, "stored", lambda df, name: [t := real(df, name), sizes.append(t.count())][0])
    df = lambda rows: spark.createDataFrame(rows, "k int, id long, t_ms long")
    for unique, spread in ((True, 30), (True, 900), (False, 60)):
        sizes.clear()
        some = lambda: [(i % 2, i if unique else rng.randrange(60), rng.randrange(spread)) for i in range(150)]  # noqa: B023, E731
        e, a = some(), some()
        got = sorted(map(tuple, telemetry.matched(df(e + e[:5]), df(a), "k").select("k", "e_id", "a_id", "dt").collect()))
        pairs, us, vs, want = sorted({(abs(t - u), i, j, k) for k, i, t in e for q, j, u in a if k == q and abs(t - u) <= 150}), set(), set(), []
        for dt, i, j, k in pairs:
            if (k, i) not in us and (k, j) not in vs:
                us.add((k, i))
                vs.add((k, j))
                want.append((k, i, j, dt))
        assert got == sorted(want) and max(sizes) <= len(e) + len(a) + 5 < len(pairs)


def _image(rng, h=40, w=50, p=0.45):
    return rng.random((h, w)) < p


def _table(spark, img):
    return spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(img))], "img long, y int, x int")


def test_components_are_flood_fills(spark):
    img = _image(np.random.default_rng(6))
    seen, want, n = np.zeros(img.shape, int), {}, 0
    for y, x in zip(*np.nonzero(img)):
        if not seen[y, x]:
            stack, cells = [(y, x)], []
            seen[y, x] = -1
            while stack:
                a, b = stack.pop()
                cells.append((a, b))
                for c in range(max(0, a - 1), min(img.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(img.shape[1], b + 2)):
                        if img[c, d] and not seen[c, d]:
                            seen[c, d] = -1
                            stack.append((c, d))
            if len(cells) >= 5:
                n += 1
                want |= dict.fromkeys(map(lambda c: (int(c[0]), int(c[1])), cells), n)
    got = {(r.y, r.x): r.label for r in pixels.components(_table(spark, img), 5).collect()}
    assert got == want and n > 1


def test_morphology(spark):
    img = _image(np.random.default_rng(7), 20, 25, 0.7)
    around = lambda m, y, x: m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
    grow = lambda m: np.array([[around(m, y, x).any() for x in range(m.shape[1])] for y in range(m.shape[0])])
    cut = lambda m: np.array([[around(m, y, x).all() for x in range(m.shape[1])] for y in range(m.shape[0])])
    got = {(r.y, r.x) for r in pixels.cleaned(_table(spark, img), 20, 25).collect()}
    want = cut(grow(grow(cut(img))))
    assert got == {(int(y), int(x)) for y, x in zip(*np.nonzero(want))}


def test_shapes_of_known_figures(spark):
    y, x = np.mgrid[0:60, 0:80]
    disc = (y - 30) ** 2 + (x - 40) ** 2 <= 400
    box = (y >= 10) & (y < 20) & (x >= 5) & (x < 65)
    rows = [(k, int(a), int(b), 1) for k, m in ((0, disc), (1, box)) for a, b in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "img long, y int, x int, label int")
    s = {r.img: r for r in pixels.shapes(df).collect()}
    assert abs(s[0].hu1 - 1 / (2 * math.pi)) < 1e-3 and s[0].aspect > 0.99
    assert math.isclose(s[1].aspect, math.sqrt((10**2 - 1) / (60**2 - 1))) and math.isclose(s[1].fill, 1.0) and abs(s[1].theta) < 1e-9
    sol = {r.img: r for r in pixels.solidity(df).collect()}
    assert math.isclose(sol[1].solidity, 1.0) and 0.9 < sol[0].solidity < 1
    st = {r.img: r for r in pixels.component_stats(df, 60, 80).collect()}
    assert (st[1].min_x, st[1].max_y, st[1].cx, st[1].touches_border) == (5, 19, 35.0, False)
    images = spark.createDataFrame([(0,), (1,), (2,)], "img long")
    assert {r.img: r.sanity for r in pixels.sanity(pixels.component_stats(df, 60, 80), images, 60, 80).collect()} == {0: "OK", 1: "OK", 2: "NO_OBJECT"}


def test_sharpness_flicker_polygon(spark):
    rng = np.random.default_rng(8)
    g = rng.random((9, 8)) * 255
    df = spark.createDataFrame([(0, y, x, float(g[y, x])) for y in range(9) for x in range(8)], "img long, y int, x int, v double")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    assert math.isclose(pixels.sharpness(df, 9, 8).first().sharpness, lap.var())
    clip = rng.random((4, 24, 3)) * 9 + 100
    fd = spark.createDataFrame([(0, f, y, x, float(clip[f, y, x])) for f in range(4) for y in range(24) for x in range(3)], "clip int, frame int, y int, x int, v double")
    rows = clip.mean(2)
    flat = np.array([[r[i] - r[max(0, i - 2) : i + 3].mean() for i in range(24)] for r in rows])
    got = pixels.flicker(fd, 24).first()
    assert np.allclose([got.banding, got.drift, got.pumping], [np.sqrt((flat**2).mean(1)).mean(), flat.std(0).mean(), clip.mean((1, 2)).std() / clip.mean() * 100])
    pts = spark.createDataFrame([(0.5, 0.5), (2.0, 0.5), (1.05, 0.5)], "x double, y double")
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert [r[0] for r in pts.select(pixels.in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, False, False]
    assert [r[0] for r in pts.select(pixels.in_polygon(F.col("x"), F.col("y"), square, 1.2)).collect()] == [True, False, True]
    a = spark.createDataFrame([(0.1, 3.1)], "a double, b double").select(pixels.angle_between(F.col("a"), F.col("b"))).first()[0]
    assert math.isclose(a, math.pi - 3.0)


def test_windows_by_hand(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, rng.randint(0, 300_000), rng.choice(["e", "p", "v"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, t_ms long, kind string")
    rate = {r.id: r.rate for r in telemetry.per_minute(df, "g").collect()}
    assert all(rate[i] == sum(h == g and t - 60_000 < u <= t for _, h, u, _ in rows) for i, g, t, _ in rows)
    run = {r.id: r.run for r in telemetry.runs(df, "g", F.col("kind") == "e", F.col("kind") == "p", F.col("t_ms"), F.col("id")).collect()}
    for g in (0, 1):
        n = 0
        for i, _, _, k in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            n = 0 if k == "p" else n + (k == "e")
            assert run[i] == n


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_stream_is_taken_in_ranges(spark, monkeypatch, many_ranges):
    """One hot stream, one of no name and one row alone: as a walk over each sorted stream has it, over several ranges."""
    rng = random.Random(19)
    rows = [(i, None if i % 7 == 0 else 1, rng.randint(0, 40_000), rng.choice(["e", "v", "v", "v", None] + ["p"] * (i % 50 == 1))) for i in range(600)] + [(600, 2, 5, "v")]
    df = spark.createDataFrame(rows, "id long, g int, t_ms long, kind string")
    order = (F.col("t_ms"), F.col("id"))
    held = telemetry.stats.ranged(df, ["g"], F.struct(*order))
    assert held.where("g = 1").select("_part").distinct().count() > 1
    run = {r.id: r.run for r in telemetry.runs(df, "g", F.col("kind") == "e", F.col("kind") == "p", *order).collect()}
    idle = {r.id: r.idle for r in telemetry.idle(df, "g", F.col("kind") == "e", *order).collect()}
    place = {r.id: r.number for r in telemetry.numbered(df, "g", "number", *order).collect()}
    monkeypatch.setattr(telemetry, "STRETCH", 16)
    flat = {r.id: r.detrended for r in telemetry.detrended(df, "g", "t_ms", 5, *order).collect()}
    found = sorted(((r.g, r.first, r.last, r.n) for r in rules.long_runs(df, "g", F.col("kind") == "v", 3, "t_ms", "id").collect()), key=str)
    want = []
    for g in (None, 1, 2):
        own, n, last, island = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 0, None, []
        for k, (i, _, t, kind) in enumerate(own):
            n, last = 0 if kind == "p" else n + (kind == "e"), t if kind == "e" else last
            near = [r[2] for r in own[max(0, k - 5) : k + 6]]
            assert run[i] == n and place[i] == k + 1 and math.isclose(flat[i], t - sum(near) / len(near), abs_tol=1e-6)
            assert idle[i] == (kind != "e" and t - (own[0][2] if last is None else last) >= 3000)
            island = [*island, t] if kind == "v" else []
            if len(island) >= 3 and (k + 1 == len(own) or own[k + 1][3] != "v"):
                want.append((g, island[0], island[-1], len(island)))
    assert len(run) == len(rows) and found == sorted(want, key=str)
    assert telemetry.runs(df.limit(0), "g", F.col("kind") == "e", F.col("kind") == "p", *order).count() == 0


def test_teaching_reports_what_it_cannot_teach(spark):
    rng = np.random.default_rng(10)
    cov = [1.0 if 1 <= r <= 2 and 1 <= c <= 2 else 0.0 for r in range(4) for c in range(4)]
    rows = [(0, i, i * 100, "OK", 1.0, (rng.normal(0, 0.1, 32) + 1).tolist(), cov) for i in range(20)] + [(1, 100 + i, i, "OK", 1.0, rng.random(32).tolist(), cov) for i in range(3)]
    frames = spark.createDataFrame(rows, "twin long, frame long, t_ms long, sanity string, sharpness double, f array<double>, cov array<double>")
    taught = twin.teach(frames, twin.Grid(4, 4, 2), 12)
    status = {r.twin: r.status for r in taught.limits.collect()}
    assert status == {0: "OK", 1: "NOT_ENOUGH_FRAMES"}
    bad = np.array(rows[0][5])
    bad[10:12] += 5
    shown = spark.createDataFrame([(0, 1, "OK", rows[0][5], cov), (0, 2, "OK", bad.tolist(), cov), (0, 3, "TOO_SMALL", rows[1][5], cov), (0, 4, "OK", (-np.array(rows[0][5])).tolist(), cov)], "twin long, frame long, sanity string, f array<double>, cov array<double>")
    got = {r.frame: (r.verdict, r.reason) for r in twin.judge(taught, shown, twin.Grid(4, 4, 2), fit_gate=False).collect()}
    assert got[1][0] == "PASS" and got[3] == ("REFRAME", "TOO_SMALL") and got[4] == ("NOT_ENROLLED", "identity") and got[2][0] in ("DEFECT", "NOT_ENROLLED")
    cal = twin.calibrated(taught.limits, spark.createDataFrame([(0, 99.0, True), (0, float("nan"), True), (0, 500.0, False)], "twin long, raw double, id_ok boolean"))
    assert {r.twin: (r.tau, r.n) for r in cal.where("twin = 0").collect()} == {0: (99.0, 1)}


def test_a_hot_key_is_spread_over_partitions(spark):
    """Pairs of tiles of one key lie in many partitions, none with far more than its share."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i, 1, rng.random(3).tolist()) for i in range(640)], "id long, twin long, f array<double>")
    tiles = knn._tiles(df, "twin", "id", None, "f", 32)
    pairs = knn.paired(tiles, tiles, 16).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert sum(r["count"] for r in pairs) == 400 and len(pairs) >= 12 and max(r["count"] for r in pairs) <= 60


def test_quantiles_of_counted_values(spark):
    rng = random.Random(12)
    rows = [(g, float(rng.choice([rng.randint(0, 9), rng.random() * 100]))) for g in range(3) for _ in range(rng.choice([1, 2, 500]))] + [(7, None)]
    from sievelight.functions import stats

    got = {r.g: (r.a, r.b, r.c) for r in stats.quantiles(spark.createDataFrame(rows, "g int, v double"), "v", ["g"], [0.05, 0.5, 0.99], ["a", "b", "c"]).collect()}
    for g in range(3):
        assert np.allclose(got[g], np.quantile([v for h, v in rows if h == g], [0.05, 0.5, 0.99]))


def test_split_parts_and_novel_views(spark):
    from sievelight.operators import crops, rules

    stats_ = [(0, 1, 100, 0, 9, 0, 9, 5.0, 5.0, False), (0, 2, 40, 12, 15, 0, 9, 14.0, 5.0, True), (0, 3, 30, 18, 20, 0, 9, 19.0, 5.0, False), (0, 4, 2, 10, 10, 0, 0, 10.0, 0.0, False), (0, 5, 90, 0, 9, 40, 49, 5.0, 45.0, False)]
    df = spark.createDataFrame(stats_, "img long, label long, area long, min_x int, max_x int, min_y int, max_y int, cx double, cy double, touches_border boolean")
    got = {r.label: (r.area, r.max_x, r.touches_border) for r in crops.merged(df).collect()}
    assert got == {1: (170, 20, True), 4: (2, 10, False), 5: (90, 9, False)}
    views = spark.createDataFrame([(0, i, th, 10.0, 50.0) for i, th in enumerate((0.0, 0.1, 0.5, 3.1, 1.5))] + [(0, 9, 0.0, 12.0, 50.0)], "s long, i long, theta double, size double, area double")
    assert [r.i for r in rules.novel_views(views, "s", ["i"]).orderBy("i").collect()] == [0, 2, 4, 9]


def test_folds_over_ranges_equal_one_fold(spark):
    from sievelight.operators import telemetry

    rng = random.Random(12)
    rows, t = [], 0
    for i in range(6000):
        t += rng.choice([1, 20, 60, 200])
        rows.append((0 if i % 6 else i % 3, i, t, float(rng.randrange(100))))
    df = spark.createDataFrame(rows, "g long, id long, t long, v double").repartition(5)
    keep = lambda last, r: (r.t if last is None or r.t - last >= 125 else last, last is None or r.t - last >= 125)
    slow = lambda last, r: (x := 0.9 * (5.0 if last is None else last) + 0.1 * r.v, x)
    count = lambda n, r: (n + 1, n)  # noqa: E731  # never meets: one fold in the end
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        ranges = telemetry.stats.ranged(df, ["g"], telemetry.F.struct("t", "id"))
        found = telemetry._entries(ranges, "g", ["t", "id"], None, keep)
        assert found.count() > 3 and telemetry._entries(ranges, "g", ["t", "id"], 0, count) is None or found.count() <= telemetry.ROUNDS
        for step, start, added in ((keep, None, "x boolean"), (slow, None, "x double"), (count, 0, "x long")):
            one, many = ({r.id: r.x for r in telemetry.folded(df, "g", ["t", "id"], added, start, step, spread).collect()} for spread in (False, True))
            assert one == many and len(one) == 6000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert telemetry.folded(df.limit(0), "g", ["t"], "x boolean", None, keep, True).count() == 0


def test_nearest_is_summed_in_index_order_and_found_by_boxes(spark):
    rng = np.random.default_rng(5)
    for dim in (64, 4):
        f = np.round(rng.normal(size=(700, dim)), 1 if dim == 4 else 9)
        df = spark.createDataFrame([(i, 0, i % 3, [float(x) for x in v]) for i, v in enumerate(f)], "id long, twin long, seg long, f array<double>")
        got = {r.id: (r.best, r.other) for r in knn.nearest(df, df, "twin", mask="seg", tile=300 if dim == 4 else None).collect()}
        all_ = np.zeros((700, 700))
        for k in range(dim):  # one number after the other, as SQL sums them
            all_ += (f[:, None, k] - f[None, :, k]) ** 2
        all_[np.arange(700)[:, None] % 3 == np.arange(700)[None] % 3] = np.inf
        assert got == {i: (all_[i].min(), int(all_[i].argmin())) for i in range(700)}
    assert [r.tiles for r in knn._tiles(df.crossJoin(spark.range(5).toDF("copy")), "twin", "id", None, "f", None)[1].collect()] == [1]
