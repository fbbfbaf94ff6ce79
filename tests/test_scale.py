"""How work spreads: plans and sizes that must not follow the number of groups."""

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievelight.operators import crops, features, gates, pixels
from sievelight.sources import shared
from sievelight.streaming import tracker
from sievelight.streaming.run import run_available


def test_geometry_rows_do_not_meet_by_part(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), *(F.rand(3).alias(c) for c in ("area", "fill", "aspect", "hu1", "solidity")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = gates.geometry_failures(rows, gates.geometry_model(rows, "g"), "g")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_tiles_are_labelled_many_at_once(spark):
    """Across batches that cut tiles, with a pixel twice, as all in one batch; no group of its own in Python for each tile."""
    rng = np.random.default_rng(5)
    pixels_ = sorted({(int(i), int(y), int(x)) for i, y, x in rng.integers(0, 24, (3000, 3))}, key=lambda p: (p[0], p[1] // 8, p[2] // 8, p[1], p[2]))
    pixels_.insert(7, pixels_[7])
    cols = [pa.array(c) for c in zip(*pixels_, strict=True)]
    whole = pa.record_batch(cols, ["img", "y", "x"])
    got = [[r for b in pixels._tiled(iter([whole.slice(k, n) for k in range(0, whole.num_rows, n)]), 8) for r in b.to_pylist()] for n in (10_000, 7)]
    assert got[0] == got[1] and len(got[0]) == len(set(pixels_))
    on = spark.createDataFrame(pixels_, "img long, y int, x int")
    log = pixels.components(on, 1, tile=8)
    want = {(r.img, r.y, r.x): r.label for r in pixels.components(on, 1, tile=1024).collect()}
    assert {(r.img, r.y, r.x): r.label for r in log.collect()} == want and len(want) == len(set(pixels_))


def test_pieces_need_no_group_in_python(spark):
    stats = spark.createDataFrame([(1, 1, 100, 0, 0, 9, 9, 5.0, 5.0, False), (1, 2, 10, 11, 0, 12, 4, 12.0, 2.0, True), (2, 1, 5, 0, 0, 2, 2, 1.0, 1.0, False)], "img long, label int, area long, min_x int, min_y int, max_x int, max_y int, cx double, cy double, touches_border boolean")
    found = crops.merged(stats)
    assert sorted((r.img, r.label, r.area, r.max_x, r.touches_border) for r in found.collect()) == [(1, 1, 110, 12, True), (2, 1, 5, 2, False)]
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_slices_are_counted_by_the_longest_stream(spark):
    rows = spark.range(400).select((F.col("id") % 8).alias("stream"), (F.floor(F.col("id") / 8) * 33).alias("t_ms"), (F.col("id") / 8 * 10).alias("x"), (F.col("id") % 8 * 30.0).alias("y"), F.lit(900.0).alias("area"), F.lit(5.0).alias("sharp"), F.lit(False).alias("border"))
    batches = lambda name: len([p for p in Path(spark.conf.get("spark.checkpoint.dir")).glob(f"sievelight-{name}-*/progress/commits/*") if p.name.isdigit()])
    got = {}
    for name, key in (("alone", None), ("together", "stream")):
        out = run_available(rows, tracker.tracked, name, order="t_ms", slice_rows=100, key=key)
        got[name] = sorted(map(str, out.collect()))
    assert got["alone"] == got["together"] and got["alone"]
    assert batches("alone") >= 4 > batches("together") == 1
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_features_send_no_pixel_to_its_neighbours(spark):
    px = spark.range(64).select(F.lit(1).alias("img"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), *((F.col("id") * k % 50).cast("double").alias(c) for k, c in ((7, "red"), (11, "green"), (13, "blue"))))
    raw = features.raw_features(px, 8, 4)
    assert raw.count() == 16 and "Generate" not in raw._jdf.queryExecution().toString()
    one = {(r.r, r.c): r.raw for r in raw.collect()}[0, 0]
    assert abs(one[0] - sum((8 * y + x) * 7 % 50 for y in range(4) for x in range(4)) / 16 / 255) < 1e-12


def test_resizing_takes_tasks_by_its_pixels(spark, monkeypatch):
    px = spark.range(480).select(F.floor(F.col("id") / 120).alias("img"), F.floor(F.col("id") % 120 / 12).cast("int").alias("y"), (F.col("id") % 12).cast("int").alias("x"), (F.col("id") * 7 % 50).cast("double").alias("v"))
    squares = spark.range(4).select(F.col("id").alias("img"), F.lit(1.5).alias("x0"), (F.col("id") / 3).alias("y0"), (5.0 + F.col("id")).alias("side"))
    small = crops.resized(px, squares, 6, 10, 12, ("v",))
    want = {(r.img, r.y, r.x): round(r.v, 9) for r in small.collect()}
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    large = crops.resized(px, squares, 6, 10, 12, ("v",))
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", 10\n") == 5 and "RepartitionByExpression [img" in plan  # 480 pixels in tasks of 50: both joins and the sums
    assert {(r.img, r.y, r.x): round(r.v, 9) for r in large.collect()} == want and len(want) == 4 * 36
    assert spark.range(480).count() and shared.tasks_for(spark, 50) is None and shared.tasks_for(spark, 51) == 4


def test_pixels_are_not_sent_as_finely_as_crops_read_them(spark):
    px = spark.range(240).select(F.floor(F.col("id") / 120).alias("img"), F.floor(F.col("id") % 120 / 12).cast("int").alias("y"), (F.col("id") % 12).cast("int").alias("x"), (F.col("id") * 7 % 50).cast("double").alias("v"))
    squares = spark.range(4).select((F.col("id") % 2).alias("img"), F.col("id").alias("label"), (20.0 + F.col("id")).alias("cx"), (3.0 + 9 * F.col("id")).alias("cy"), (9.0 + F.col("id") * 5).alias("side"), (F.col("id") * 0.7).alias("theta"))
    fine = px.select("img", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"), "y", "x", "v").select("img", (4 * F.col("y") + F.floor(F.col("k") / 4)).cast("int").alias("y"), (4 * F.col("x") + F.col("k") % 4).alias("x"), "v")
    told = lambda df: {(r.img, r.label, r.y, r.x): round(r.v, 9) for r in df.collect()}
    want = told(crops.rotated(fine, squares, 5, 40, 48, ("v",)))
    assert told(crops.rotated(px, squares, 5, 40, 48, ("v",), factor=4)) == want and len(want) == 100
