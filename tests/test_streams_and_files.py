import json
import random

import numpy as np
import pytest

from sievelight.sources import formats
from sievelight.streaming import governor, tracker
from sievelight.streaming.run import run_available

SHAPE = "stream long, t_ms long, x double, y double, area double, sharp double, border boolean"


def test_parts_on_a_line_fire_once_each(spark):
    rows = []
    for s in (1, 2):
        for t in range(400):
            there = [(s, t * 33, float(t * 10 - start), 100.0, 2500.0, 5.0, False) for start in range(0, 4000, 400) if 0 <= t * 10 - start <= 320]
            rows += there or [(s, t * 33, None, None, None, None, None)]
    random.Random(1).shuffle(rows)
    got = run_available(spark.createDataFrame(rows, SHAPE).repartition(3), tracker.tracked, "line").collect()
    for s in (1, 2):
        fired = [e for e in got if e.stream == s and e.event == "LINE"]
        assert len(fired) == 10 and len({e.track for e in fired}) == 10
        assert [e.t_ms for e in sorted(fired, key=lambda e: e.t_ms)] == [(18 + 40 * k) * 33 for k in range(10)]


def test_steady_blocked_and_missed():
    p = tracker.TrackParams()
    det = lambda x, sharp=5.0, border=False: [{"x": x, "y": 100.0, "area": 900.0, "sharp": sharp, "border": border}]
    run = lambda frames: (lambda scene: [(t, *e) for t, found in frames for e in tracker.step(scene, t, found, p)])(tracker.Scene())
    still = run([(t * 100, det(50.0)) for t in range(12)])
    assert [(t, e) for t, _, e, _ in still] == [(600, "STEADY")]
    assert not run([(t * 100, det(50.0, border=True)) for t in range(12)])
    assert run([(t * 100, det(50.0, sharp=5.0 if t < 3 or t > 5 else 1.0)) for t in range(14)])[0][0] == 1100
    assert run([(0, det(50.0)), (100, det(50.0))] + [(200 + t * 100, []) for t in range(7)])[-1][2] == "EXITED"
    assert run([(0, det(50.0))] + [(100 + t * 100, []) for t in range(7)])[-1][2] == "EXITED_UNCONFIRMED"
    towards = tracker.TrackParams(direction=1, steady_on=False)
    scene = tracker.Scene()
    assert not [e for t in range(12) for e in tracker.step(scene, t * 33, det(300.0 - t * 20), towards) if e[1] == "LINE"]
    again = tracker.Scene.loads(scene.dumps())
    assert again == scene


def test_late_frames_change_nothing(spark, tmp_path):
    shape = spark.createDataFrame([], SHAPE).schema
    for k, t in enumerate((1000, 500)):
        spark.createDataFrame([(1, t, 1.0, 1.0, 900.0, 5.0, False)], SHAPE).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    q = tracker.tracked(stream).writeStream.format("memory").queryName("late").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.event for r in spark.sql("select * from late").collect()] == ["LATE"]


def test_governor_stream_equals_fold_and_loop(spark):
    rng = random.Random(2)
    rows, t = [], 0
    for i in range(400):
        t += rng.randint(500, 9000)
        rows.append((i, i % 3, t, rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([0.1, 0.2, 0.7, 0.86, float("nan"), None])))
    df = spark.createDataFrame(rows, "id long, stream long, t_ms long, status int, headroom double")
    streamed = {r.id: (r.target, r.level) for r in run_available(df, governor.governed, "gov").collect()}
    folded = {r.id: (r.target, r.level) for r in governor.levels(df).collect()}
    want = {}
    for s in range(3):
        level, since = 0, None
        for i, _, t, status, h in (r for r in rows if r[1] == s):
            known = h is not None and h == h
            due = 2 if status >= 3 or known and h > 0.85 else 1 if status >= 2 or known and h >= 0.7 else 0
            if due > level:
                level, since = due, None
            elif due < level:
                since = t if since is None else since
                if t - since >= 30_000:
                    level, since = due, None
            else:
                since = None
            want[i] = (due, level)
    assert streamed == folded == want


def test_matrix_files(spark, tmp_path):
    m = np.random.default_rng(3).normal(0, 1, (5, 4)).astype(np.float32)
    raw = formats.matrix_bytes(m)
    assert np.array_equal(formats.matrix_of(raw), m.astype(np.float16).astype(np.float32))
    for bad in (b"x" + raw[1:], raw[:-1], raw + b"0", raw[:10]):
        with pytest.raises(ValueError):
            formats.matrix_of(bad)
    (tmp_path / "a.f16").write_bytes(raw)
    (tmp_path / "b.f16").write_bytes(raw[:-1])
    got = formats.read_matrices(spark, str(tmp_path)).collect()
    assert sum(r.error is None for r in got) == 5 and sum(r.error is not None for r in got) == 1


def test_exports_stores_and_canonical_json(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "p1.json").write_text(json.dumps({"tMs": 5, "sanity": "OK", "trackId": 1, "label": "good", "phone": {"verdict": "PASS", "s": 0.5, "peak": [1, 2]}, "mask": {"x": 0, "y": 0, "w": 2, "h": 1, "rle": [1, 1]}}, indent=1))
    r = formats.read_export(spark, str(tmp_path), "parts").first()
    assert (r.name, r.phone.s, r.mask.rle, r.cov) == ("p1", 0.5, [1, 1], None)
    (tmp_path / "parts" / "p2.json").write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        formats.read_export(spark, str(tmp_path), "parts").collect()
    rows = lambda *x: spark.createDataFrame(list(x), "part_id string, fingerprint string, created_at_ms long")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    formats.save_parts(rows(("a", "f", 1), ("b", "g", 2)), f"{tmp_path}/store")
    formats.save_parts(rows(("a", "f", 3)), f"{tmp_path}/store")
    assert [(r.part_id, r.created_at_ms, r.outcome) for r in formats.load_parts(spark, f"{tmp_path}/store", "f").collect()] == [("a", 3, "Loaded"), ("b", 2, "FingerprintMismatch")]
    df = spark.createDataFrame([('{"b": [1, {"z": "é", "a": 0.1}], "a": null}',), ("{bad",), (None,)], "s string")
    assert [r.c for r in df.select(formats.canonical_json("s").alias("c")).collect()] == ['{"a":null,"b":[1,{"a":0.1,"z":"\\u00e9"}]}', None, None]
    assert spark.createDataFrame([("--my part/№1--",)], "n string").select(formats.safe_name("n").alias("n")).first().n == "my-part--1"


def test_negatives_and_photos(spark, tmp_path):
    path = f"{tmp_path}/negatives"
    rows = lambda *x, more="": spark.createDataFrame(list(x), f"id string, fingerprint string, created_at_ms long, g array<double>{more}")
    formats.add_negatives(rows(("b", "12", 5, [0.1]), ("a", "12", 5, [1.0]), ("c", "34", 1, [1.0])), path)
    formats.add_negatives(rows(("d", "12", 2, [2.0], [0.5]), more=", f array<double>"), path)
    for bad in (("a", "12", 9, [1.0]), ("e.tmp", "12", 9, [1.0]), ("e/", "12", 9, [1.0]), ("", "12", 9, [1.0]), (None, "12", 9, [1.0]), ("e", "12", 9, []), ("e", "12", 9, None)):
        with pytest.raises(ValueError):
            formats.add_negatives(rows(("f", "12", 9, [1.0]), bad), path)
    with pytest.raises(ValueError):
        formats.add_negatives(rows(("f", "12", 9, [1.0]), ("f", "12", 9, [1.0])), path)
    assert [(r.id, r.g[0], r.f) for r in formats.load_negatives(spark, path, "12").collect()] == [("d", 2.0, [0.5]), ("a", 1.0, None), ("b", float(np.float16(0.1)), None)]
    assert not formats.load_negatives(spark, path, "56").count()
    folder = tmp_path / "photos"
    (folder / "in").mkdir(parents=True)
    for name in ("Bad_2.JPG", "good1.png", "other.WebP", "notes.txt", "bad.bmp.txt", "in/bad.png"):
        (folder / name).write_bytes(name.encode())
    assert [(r.name, r.label, bytes(r.content)) for r in formats.photos(spark, str(folder)).collect()] == [("Bad_2.JPG", "bad", b"Bad_2.JPG"), ("good1.png", "good", b"good1.png"), ("other.WebP", None, b"other.WebP")]
    assert formats.photos(spark, str(folder), "good").where("label = 'good'").count() == 2


def test_slices_keep_state_from_batch_to_batch(spark):
    """Ten slices of one stream, rows of a frame in several files of no order: as many events as in one go, and a small state at the end."""
    rng = random.Random(4)
    rows = []
    for t in range(1500):
        there = [(7, t * 33, float(t * 10 - start), 60.0 + 80 * lane, 2500.0, 4 + rng.random(), False) for lane in (0, 1) for start in range(0, 15000, 400) if 0 <= t * 10 - start - 150 * lane <= 320]
        rows += there or [(7, t * 33, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SHAPE).repartition(7)
    cut = [tuple(r) for r in run_available(df, tracker.tracked, "cut", order="t_ms", slice_rows=300).orderBy("t_ms", "track", "event").collect()]
    one = [tuple(r) for r in run_available(df, tracker.tracked, "one").orderBy("t_ms", "track", "event").collect()]
    assert cut == one and len([r for r in cut if r[3] == "LINE"]) > 60
    assert all(1 <= len(r[5]) <= 3 and r[4] == r[5][0] for r in cut if r[3] == "LINE")


def test_judged_frames_of_a_steady_part_begin_with_the_one_that_fired():
    p = tracker.TrackParams(line_on=False)
    scene, fired = tracker.Scene(), []
    for k in range(12):
        fired += [(100 * k, *e) for e in tracker.advance(scene, 100 * k, [{"x": 160.0, "y": 120.0, "area": 900.0, "sharp": 9.0 if k == 3 else 8.0, "border": False}], p)]
    assert fired == [(600, 1, "STEADY", 600, [600, 300, 100])] and scene.tracks[0].crops == []


def test_grid_counts_every_rule_of_every_part(spark):
    from sievelight.operators import variants

    rng = random.Random(8)
    labels = ["good"] * 4 + ["defect"] * 4 + ["wrong"] * 3 + ["rotated"]
    rows = [(s, f"p{i}", lab, a, b, c, d, rng.choice(["PASS", "DEFECT", "NOT_ENROLLED"]), rng.choice([0.5, 1.0, 1.5, None]), rng.random()) for s in (0, 1) for a in variants.SCORES for b in variants.BANKS for c in variants.VIEWS for d in variants.TAUS for i, lab in enumerate(labels)]
    df = spark.createDataFrame(rows, "twin long, part string, label string, score string, bank string, way string, tau_rule string, verdict string, s double, sim double")
    got = variants.compared(df).collect()
    assert len(got) == 48 and sorted(r.place for r in got if r.study == 0) == list(range(1, 25))
    for r in got:
        own = [x for x in rows if x[0] == r.study and "/".join(x[3:7]) == r.variant]
        pairs = [(d[8], g[8]) for d in own for g in own if d[2] == "defect" and g[2] == "good" and d[8] is not None and g[8] is not None]
        want = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) if pairs else -1.0
        assert abs(r.auroc_defect - want) < 1e-9
        assert r.pass_good_k == sum(x[7] == "PASS" for x in own if x[2] == "good") and r.changes == sum(a != b for a, b in zip(r.variant.split("/"), ("SMOOTHED_MAX", "CORESET", "NONE", "LSO"), strict=True))
    best = min((r for r in got if r.study == 1), key=lambda r: r.place)
    assert all((best.auroc_defect, best.auroc_identity) >= (r.auroc_defect, r.auroc_identity) for r in got if r.study == 1)


def _session(spark, rows, name, slice_rows=1000, **how):
    from sievelight.streaming import session

    shape = SHAPE + ", sanity string, crop binary, stroke long, radius double"
    out = run_available(spark.createDataFrame(rows, shape), lambda df: session.operated(df, **how), name, order="t_ms", slice_rows=slice_rows)
    return sorted(((r.t_ms, r.track, r.event, r.stroke, r.frames, [bytes(c).decode() for c in r.crops] if r.crops else None) for r in out.collect()), key=str)


def test_circled_objects_are_judged_or_given_up(spark):
    see = lambda t, x, area=900.0, sharp=5.0: (1, t, x, 100.0, area, sharp, False, "OK", f"{x:g}@{t}".encode(), None, None)
    ask = lambda t, stroke, x, radius: (1, t, x, 100.0, None, None, None, None, None, stroke, radius)
    rows = [see(100 * k, x + 8 * (k % 2)) for k in range(40) for x in (50.0, 250.0)]  # neither is still, none crosses the line
    rows += [ask(300, 1, 52.0, 30.0), ask(1000, 2, 160.0, 20.0), ask(3000, 3, 160.0, 300.0)]
    rows += [see(100 * k, 100.0, 5000.0) for k in range(30, 40)]
    for size in (1000, 25):
        got = _session(spark, rows, "circle", size)
        told = [e for e in got if e[2] != "EXITED" and "EXITED" not in e[2]]
        assert [(t, e, s) for t, _, e, s, _, _ in told if e.startswith("CIRCLE")] == [(2600, "CIRCLE_FAILED", 2), (300, "CIRCLE_OK", 1), (3000, "CIRCLE_OK", 3)]
        judged = [(t, f, c) for t, _, e, _, f, c in told if e == "OPERATOR"]
        assert judged == [(300, [300], ["58@300"]), (3000, [3000], ["100@3000"])]  # the largest in the circle


def test_wrong_objects_are_captured_one_at_a_time(spark):
    see = lambda t, x, sanity="OK": (1, t, x, 100.0, 900.0, 5.0, False, sanity, f"{x:g}@{t}".encode(), None, None)
    rows = [see(100 * k, 50.0) for k in range(12)] + [see(100 * k, 250.0) for k in range(2, 14)] + [see(100 * k, 150.0, "MULTIPLE") for k in range(30, 42)] + [see(100 * k, 20.0) for k in range(50, 62)]
    got = _session(spark, rows, "negatives", 15, capture_ms=1000)
    assert [(t, e, c) for t, _, e, _, _, c in got if "EXITED" not in e] == [(3600, "REFUSED:MULTIPLE", None), (5600, "CAPTURED", ["20@5600"]), (600, "CAPTURED", ["50@600"]), (800, "BUSY", None)]
