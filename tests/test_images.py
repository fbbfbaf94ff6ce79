"""Components over tiles, links, rotated crops and squares against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievelight.operators import crops, links, pixels


def _flood(on):
    left, out, n = set(on), {}, 0
    for p in sorted(on):
        if p not in left:
            continue
        n += 1
        todo, own = [p], []
        left.discard(p)
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if q in left:
                    left.discard(q)
                    todo.append(q)
        out[n] = own
    return out


def _labels(on, least):
    kept = [c for _, c in sorted(_flood(on).items()) if len(c) >= least]
    return sorted((y, x, k + 1) for k, c in enumerate(kept) for y, x in c)


@pytest.mark.parametrize("tile", [5, 16, 1024])
def test_tiles_give_the_labels_of_the_whole_image(spark, tile):
    rng = random.Random(6)
    noise = [(y, x) for y in range(40) for x in range(33) if rng.random() < 0.42]
    spiral = [(y, x) for y in range(0, 40, 2) for x in range(30)] + [(y + 1, 29 if y % 4 == 0 else 0) for y in range(0, 38, 2)]  # one component through every tile
    cross = [(4, 4), (5, 5), (4, 16), (5, 15), (15, 15), (16, 16), (15, 17)]  # corners that touch over a corner of tiles
    images = {1: noise, 2: spiral, 7: cross, 9: [(0, 0)]}
    df = spark.createDataFrame([(k, y, x) for k, ps in images.items() for y, x in [*ps, *ps[:5]]], "img long, y int, x int").repartition(3)
    for least in (1, 3):
        got = pixels.components(df, least, tile).collect()
        for k, ps in images.items():
            assert sorted((r.y, r.x, r.label) for r in got if r.img == k) == _labels(set(ps), least)
    assert pixels.components(df.limit(0), 1, tile).count() == 0


def test_links_join_chains_hubs_and_spaces(spark):
    chain = [(0, k, k + 1) for k in range(200)]
    hub = [(1, 5000, k) for k in range(300)] + [(1, 7, 7)]
    apart = [(2, 9, 3), (2, 4, 3), (2, 20, 21), (3, 9, 20)]
    got = {(r.space, r.node): r.root for r in links.connected(spark.createDataFrame(chain + hub + apart + apart, "space long, u long, v long")).collect()}
    assert all(got[(0, k)] == 0 for k in range(201)) and got[(1, 5000)] == got[(1, 299)] == 0
    assert [got[(2, k)] for k in (9, 4, 3, 20, 21)] == [3, 3, 3, 20, 20] and got[(3, 20)] == 9
    assert links.connected(spark.createDataFrame([], "space long, u long, v long")).count() == 0


def _sample(image, u, v):
    h, w = len(image), len(image[0])
    x, y = u - 0.5, v - 0.5
    fx, fy = x - math.floor(x), y - math.floor(y)
    at = lambda r, c: image[max(0, min(h - 1, r))][max(0, min(w - 1, c))]
    r, c = math.floor(y), math.floor(x)
    return (1 - fy) * ((1 - fx) * at(r, c) + fx * at(r, c + 1)) + fy * ((1 - fx) * at(r + 1, c) + fx * at(r + 1, c + 1))


def test_rotated_crops_and_coverage_match_plain_loops(spark):
    rng = random.Random(2)
    image = [[rng.randrange(256) for _ in range(17)] for _ in range(13)]
    px = spark.createDataFrame([(1, y, x, float(v)) for y, row in enumerate(image) for x, v in enumerate(row)], "img long, y int, x int, v double")
    sq = [(1, 1, 8.2, 6.1, 7.7, 0.4), (1, 2, 1.0, 1.0, 9.0, -1.2), (1, 3, 8.5, 6.5, 5.0, 0.0)]  # the second reaches over the rim
    squares = spark.createDataFrame(sq, "img long, label int, cx double, cy double, side double, theta double")
    for turned in (0.0, math.pi):
        got = {(r.label, r.y, r.x): r.v for r in crops.rotated(px, squares, 6, 13, 17, ("v",), turned).collect()}
        assert len(got) == 3 * 36
        for _, k, cx, cy, side, theta in sq:
            for i in range(6):
                for j in range(6):
                    a, b, t = (j + 0.5) * side / 6 - side / 2, (i + 0.5) * side / 6 - side / 2, theta + turned
                    assert abs(got[(k, i, j)] - _sample(image, cx + a * math.cos(t) - b * math.sin(t), cy + a * math.sin(t) + b * math.cos(t))) < 1e-9
    on = {(y, x) for y in range(13) for x in range(17) if image[y][x] > 100}
    labelled = spark.createDataFrame([(1, y, x, k) for y, x in on for k in (1, 2, 3)], "img long, y int, x int, label int")
    got = {(r.label, r.r, r.c): r["cov"] for r in crops.rotated_coverage(labelled, squares, 3, 2).collect()}
    for _, k, cx, cy, side, theta in sq:
        for r in range(3):
            for c in range(2):
                hits = 0
                for i in range(4):
                    for j in range(4):
                        a, b = (c + (j + 0.5) / 4) * side / 2 - side / 2, (r + (i + 0.5) / 4) * side / 3 - side / 2
                        hits += (math.floor(cy + a * math.sin(theta) + b * math.cos(theta)), math.floor(cx + a * math.cos(theta) - b * math.sin(theta))) in on
                assert got[(k, r, c)] == hits / 16
    plain = {(r.y, r.x): r.v for r in crops.resized(px, spark.createDataFrame([(1, 6.0, 4.0, 5.0)], "img long, x0 double, y0 double, side double"), 6, 13, 17, ("v",)).collect()}
    straight = {(r.y, r.x): r.v for r in crops.rotated(px, squares.where("label = 3"), 6, 13, 17, ("v",)).collect()}
    assert plain.keys() == straight.keys() and all(abs(plain[k] - straight[k]) < 1e-9 for k in plain)


def test_squares_follow_the_axis(spark):
    bar = [(1, y, x, 1) for y in range(4, 6) for x in range(2, 14)]
    block = [(2, y, x, 1) for y in range(3, 7) for x in range(3, 7)]
    labelled = spark.createDataFrame(bar + block, "img long, y int, x int, label int")
    angles = pixels.shapes(labelled).selectExpr("img", "label", "theta", "aspect").withColumn("theta", crops.axis_angle(pixels.F.col("theta"), pixels.F.col("aspect"))).drop("aspect")
    got = {r.img: r for r in crops.canonical_square(labelled, angles, 2, 12, 16).collect()}
    assert got[1].theta == 0.0 and abs(got[1].cx - 16) < 1e-9 and abs(got[1].cy - 10) < 1e-9 and got[1].side == 24.0  # held to the image
    assert got[2].theta == 0.0 and abs(got[2].side - 9.6) < 1e-9


def test_angles_are_those_of_the_c_library_and_edges_of_squares_may_be_outside(spark):
    import math

    from sievelight.functions import stats

    angles = [-math.pi / 2 + k * 0.00157 for k in range(2001)]
    df = spark.createDataFrame([(a,) for a in angles], "a double")
    got = df.select("a", stats.cosine("a").alias("c"), stats.sine("a").alias("s"), stats.arc_tangent("a", F.lit(0.7)).alias("t")).collect()
    assert all((r.c, r.s, r.t) == (math.cos(r.a), math.sin(r.a), math.atan2(r.a, 0.7)) for r in got)
    edge = spark.createDataFrame([(2.0, 2.0, 2.0, 0.0)], "cx double, cy double, side double, theta double")
    assert edge.select(crops.inside_square(F.lit(1.0), F.lit(2.0)).alias("a"), crops.inside_square(F.lit(1.0), F.lit(2.0), False).alias("b")).first() == (True, False)


def test_sides_of_squares_are_tenths_rounded_once_and_what_spreads_is_not_broadcast(spark):
    from pyspark.sql import DataFrame

    box = spark.createDataFrame([(1, 0, 2, 0, 1)], "img long, min_x int, max_x int, min_y int, max_y int")
    assert pixels.crop_square(box, 99.0, 99.0).first().side == 3.6  # not 3 * 1.2
    sq = spark.createDataFrame([(1, 1, 2.0, 2.0, 3.0, 0.0)], "img long, label int, cx double, cy double, side double, theta double")
    px = spark.createDataFrame([(1, y, x, 1.0, 1) for y in range(4) for x in range(4)], "img long, y int, x int, v double, label int")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made: list[DataFrame] = [crops.rotated(px, sq, 5, 4, 4, ("v",)), crops.rotated_coverage(px, sq, 3, 3), crops.coverage(px, sq.withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0)}), 3, 3)]
    assert not any("BroadcastHashJoin" in plan(df) for df in made)
