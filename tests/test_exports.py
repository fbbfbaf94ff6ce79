"""Exports as a data source: what is written comes back, what is wrong is refused, and nothing is left of what failed."""

import json

import pytest

from sievelight.sources import exports

SHAPE = "kind string, name string, picture binary, tMs long, sanity string, index int, crop struct<x0:double,y0:double,side:double>, mask struct<x:int,y:int,w:int,h:int,rle:array<int>>, cov array<double>, geometry struct<area:int,fill:double,aspect:double,hu1:double,solidity:double>, theta double"
#: An L of five pixels: rows 1 to 3 of column 2, and two more at its foot.
MASK, CROP = (2, 1, 3, 3, [0, 1, 2, 1, 2, 3]), (1.0, 0.0, 6.0)


def _cov():
    on = {(1, 2), (2, 2), (3, 2), (3, 3), (3, 4)}
    hits = lambda r, c: sum((int(0 + (r + (i + 0.5) / 4) * 6 / 2), int(1 + (c + (j + 0.5) / 4) * 6 / 2)) in on for i in range(4) for j in range(4))
    return [hits(r, c) / 16 for r in range(2) for c in range(2)]


def _records(spark):
    rows = [("teach", f"{k:04d}", b"jpg%d" % k if k % 2 else None, 100 - 10 * (k // 2), "OK", k, CROP, MASK, _cov(), (5, 0.5, 0.5, 0.5, 0.5), 0.1) for k in range(5)]
    rows += [("negatives", "0000", None, 7, "NO_OBJECT", 0, None, None, None, None, None)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/a"
    exports.write(_records(spark), path, {"twinName": "L", "analysisFactor": 1})
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["manifest.json", "negatives", "teach"] and not (tmp_path / "a.tmp").exists()
    assert exports.checked(path) == {"twinName": "L", "analysisFactor": 1, "schema": 1, "counts": {"teach": 5, "parts": 0, "negatives": 1}}
    teach = exports.scan(spark, path, "teach").orderBy("place").collect()
    assert [(r.name, r.tMs, r.place) for r in teach] == [("0004", 80, 0), ("0002", 90, 1), ("0003", 90, 2), ("0000", 100, 3), ("0001", 100, 4)]  # by time, then index
    assert [bytes(r.picture) if r.picture else None for r in teach] == [None, None, b"jpg3", None, b"jpg1"]
    assert tuple(teach[0].mask) == MASK and tuple(teach[0].crop) == CROP and teach[0]["cov"] == _cov()
    assert [(r.sanity, r.mask) for r in exports.scan(spark, path, "negatives").collect()] == [("NO_OBJECT", None)]
    assert exports.scan(spark, path, "parts").count() == 0
    with pytest.raises(Exception, match="there already"):
        exports.write(_records(spark), path, {})
    exports.write(_records(spark).where("kind = 'negatives'"), path, {}, replace=True)
    assert exports.checked(path)["counts"] == {"teach": 0, "parts": 0, "negatives": 1}


def test_what_is_wrong_is_refused(spark, tmp_path):
    bad = _records(spark).withColumn("name", exports.F.when(exports.F.col("name") == "0003", "../x").otherwise(exports.F.col("name")))
    with pytest.raises(Exception, match="not a record"):
        exports.write(bad, f"{tmp_path}/b", {})
    assert not (tmp_path / "b").exists() and not (tmp_path / "b.tmp").exists()
    (tmp_path / "c" / "parts").mkdir(parents=True)
    (tmp_path / "c" / "manifest.json").write_text(json.dumps({"schema": 2}))
    with pytest.raises(Exception, match="schema 2"):
        exports.scan(spark, f"{tmp_path}/c", "parts").collect()
    (tmp_path / "c" / "manifest.json").write_text(json.dumps({"schema": 1}))
    (tmp_path / "c" / "parts" / "p.json").write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        exports.scan(spark, f"{tmp_path}/c", "parts").collect()


def test_consistency_tells_what_is_off(spark):
    rows = _records(spark).where("kind = 'teach'")
    shape = exports.pixels.shapes(exports.mask_pixels(rows.limit(1)).selectExpr("1L as img", "y", "x", "1 as label")).first()
    solid = 5 / 7
    right = rows.withColumn("theta", exports.F.lit(shape.theta)).withColumn("geometry", exports.F.expr(f"named_struct('area', 5, 'fill', {shape.fill!r}D, 'aspect', {shape.aspect!r}D, 'hu1', {shape.hu1!r}D, 'solidity', {solid!r}D)"))
    told = {r.name: r for r in exports.consistency(right.withColumn("cov", exports.F.expr("if(name = '0002', transform(cov, (x, i) -> if(i = 1, x + 0.0625D, x)), cov)")).withColumn("theta", exports.F.expr("if(name = '0003', theta + 0.5D, theta)")), 2, 2, 1).collect()}
    assert len(told) == 5 and all(r.geometry_max < 1e-9 for r in told.values())
    assert [(n, told[n].cov_off, told[n].cov_max) for n in ("0001", "0002")] == [("0001", 0, 0.0), ("0002", 1, 0.0625)]
    assert told["0001"].theta_max < 1e-12 and abs(told["0003"].theta_max - 0.5) < 1e-12
    short = rows.withColumn("mask", exports.F.expr("named_struct('x', 2, 'y', 1, 'w', 3, 'h', 3, 'rle', array(0, 1, 2))"))
    with pytest.raises(Exception, match="do not fill"):
        exports.mask_pixels(short).count()


def test_the_driver_keeps_a_string_a_task_and_broadcasts_no_records(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/d"
    exports.write(_records(spark), path, {})
    (tmp_path / "d" / "teach" / "note.txt").write_text("no record")
    monkeypatch.setattr(exports.fs, "FileSelector", None)  # a local folder is read as it is listed, not at once
    parts = exports.Reader(path, list(exports.KINDS), 2).partitions()
    assert sorted(len(p.names.split("/")) for p in parts) == [1, 1, 2, 2] and all(isinstance(p.names, str) for p in parts)
    read = sorted((k, n) for p in parts for k, n, _, _ in exports.Reader(path, list(exports.KINDS), 2).read(p))
    assert read == [("negatives", "0000"), *(("teach", f"{k:04d}") for k in range(5))]
    monkeypatch.undo()
    rows = spark.createDataFrame(_records(spark).where("kind = 'teach'").collect(), SHAPE)
    assert "Broadcast" not in exports.consistency(rows, 2, 2, 1)._jdf.queryExecution().executedPlan().toString()
