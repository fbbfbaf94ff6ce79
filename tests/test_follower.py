"""A region follows what it holds, keeps to it over micro-batches, and logs reach their files."""

import json
import random

from pyspark.sql import functions as F

from sievelight.operators import pixels
from sievelight.streaming import follower, run
from sievelight.streaming.run import run_available

SHAPE = "stream long, t_ms long, label long, area long, cx double, cy double, min_x int, min_y int, max_x int, max_y int, border boolean, rle array<int>, px array<double>, py array<double>"


def _piece(t, label, x, y, half=4, border=False, rle=None):
    return (1, t, label, (2 * half) ** 2, float(x), float(y), x - half, y - half, x + half - 1, y + half - 1, border, rle, None, None)


def _stroke(t, px, py):
    return (1, t, *[None] * 10, [float(v) for v in px], [float(v) for v in py])


def test_region_follows_through_slices(spark):
    rows = [_stroke(0, [20, 60, 60, 20], [20, 20, 60, 60])]
    for k in range(30):
        rows += [_piece(33 * k, 1, 40 + 3 * k, 40 + k), _piece(33 * k, 2, 50 + 3 * k, 40 + k, 2), _piece(33 * k, 3, 40 + 3 * k, 120)]
    rows += [(1, 33 * 30, *[None] * 12), _piece(33 * 31, 1, 140, 80, border=True), _piece(33 * 32, 1, 136, 74)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SHAPE)
    got = [r.asDict() for r in run_available(df, lambda d: follower.follow(d, 320, 240), "follow", order="t_ms", slice_rows=20).orderBy("t_ms").collect()]
    assert len(got) == 33 and all(r["found"] and r["area"] == 64 + 0 * r["t_ms"] for r in got[:30])  # the small one is under the least area
    x0 = [min(r["xs"]) for r in got]
    assert x0[:30] == [20 + 3 * k for k in range(30)] and [min(r["ys"]) for r in got[:30]] == [20 + k for k in range(30)]
    assert not got[30]["found"] and x0[30] == x0[29] and got[31]["border"] and x0[31] == x0[29]
    assert x0[32] == x0[29] + 136 - (40 + 3 * 29)
    pieces = follower.picked(follower.Region([20.0, 60.0, 60.0, 20.0], [20.0, 20.0, 60.0, 60.0]), [dict(zip(follower.PIECES, (r[2], r[3], *r[4:12]), strict=True)) for r in (_piece(0, 1, 40, 40), _piece(0, 2, 48, 40, 3), _piece(0, 3, 57, 57, 3))], 30)
    assert pieces["labels"] == [1, 2] and pieces["area"] == 64 + 36  # the third is too far off


def test_a_tap_takes_what_is_under_it_and_becomes_a_box(spark):
    ring = [0 if 20 <= x < 60 and 20 <= y < 60 and not (36 <= x < 44 and 36 <= y < 44) else 1 for y in range(0, 80) for x in range(0, 80)]
    runs, last = [], 0
    for b in [1 - v for v in ring]:
        if b == last and runs:
            runs[-1] += 1
        else:
            runs += [1] if b or runs else [1]
            last = b
    at = {"label": 1, "area": 3000, "cx": 100.0, "cy": 100.0, "min_x": 0, "min_y": 0, "max_x": 79, "max_y": 79, "border": False, "rle": runs}
    tap = follower.Region.drawn([24.0], [24.0], 320, 240)
    assert tap.tap and len(tap.xs) == 16 and follower.picked(tap, [at], 30)["labels"] == [1]
    assert follower.picked(follower.Region.drawn([40.0], [40.0], 320, 240), [at], 30) is None  # the hole
    assert follower.Region.drawn([], [], 320, 240) is None
    region, centre = follower.followed(tap, None, follower.picked(tap, [at], 30))
    assert not region.tap and region.xs == [-20.0, 100.0, 100.0, -20.0] and centre == (100.0, 100.0)


def test_logs_and_live_counts(spark, tmp_path):
    rows = [(1_700_000_000 + k, "PASS" if k % 3 else "DEFECT", "a,b") for k in range(90)]
    df = spark.createDataFrame(rows, "s long, verdict string, note string").select(F.timestamp_seconds("s").alias("ts"), "verdict", "note")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run.logged(stream, "verdict", f"{tmp_path}/out", f"{tmp_path}/progress", 5).trigger(availableNow=True).start().awaitTermination()
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 90 and {x["type"] for x in lines} == {"verdict"} and all(x["wallMs"] - x["elapsedMs"] == 5 for x in lines)
    q = run.counted(stream, "60 seconds", "30 seconds").writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {}
    for s, v, _ in rows:
        for end in range(s // 30 * 30 + 30, s // 30 * 30 + 61, 30):
            want[(end, v)] = want.get((end, v), 0) + 1
    assert {(int(r.until.timestamp()), r.verdict): r.n for r in spark.sql("select cast(until as timestamp) as until, verdict, n from live").collect()} == want
    run.csv_log(df, f"{tmp_path}/csv")
    text = [x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().splitlines()]
    assert text[0] == "ts,verdict,note" and sum("a;b" in x for x in text) == 90


def test_sheet_adapts_slowly(spark):
    rows = [(g, t, 100.0 + 10 * g + t, 90.0) for g in (0, 1) for t in range(50)]
    got = {(r.g, r.t): r.mu for r in pixels.adapted(spark.createDataFrame(rows, "g long, t long, m double, mu0 double"), "g", "mu0").collect()}
    for g in (0, 1):
        mu = 90.0
        for t in range(50):
            mu = 0.98 * mu + 0.02 * (100.0 + 10 * g + t)
            assert abs(got[(g, t)] - mu) < 1e-9
