"""Evaluation exports as a data source: a folder with manifest.json and the records of teach, parts and negatives, a file each, with a
picture beside some.

Reading lists the folder once, refuses a manifest of another schema, and deals files out to tasks. Records grow with the data, so the
driver keeps a few bytes a file, and joins of records are by sorting. Writing puts each record's files into
<name>.tmp from the tasks; the commit writes the manifest with what the tasks counted and renames the folder, and what did not commit
is not an export.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import masks
from ..operators import crops, pixels
from .formats import SCHEMAS, safe_name

FORMAT, SCHEMA = "sievelight-export", 1
KINDS = ("teach", "parts", "negatives")
#: Files that a task reads, and a record as it is read and written.
FILES = 200
RECORD = "kind string, name string, record string, picture binary"


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    files, at = fs.FileSystem.from_uri(path)
    return files, at.rstrip("/")


@dataclass
class Some(InputPartition):
    kind: str
    names: str  # joined by slashes: a string a task, not one a file

    def __init__(self, kind: str, names: list[str]):
        super().__init__((kind, len(names)))
        self.kind, self.names = kind, "/".join(names)


def _listed(files: fs.FileSystem, folder: str) -> Iterator[str]:
    """The names of the records in a folder without their .json; of a local one as they are read, never all at once."""
    if isinstance(files, fs.LocalFileSystem):
        if not os.path.isdir(folder):
            return
        with os.scandir(folder) as found:
            yield from (f.name[:-5] for f in found if f.name.endswith(".json") and f.is_file())
    else:
        yield from (f.base_name[:-5] for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.base_name.endswith(".json"))


class Reader(DataSourceReader):
    def __init__(self, path: str, kinds: list[str], per_task: int):
        self.path, self.kinds, self.per_task = path, kinds, per_task

    def partitions(self) -> list[InputPartition]:
        checked(self.path)
        files, at = _folder(self.path)
        out: list[InputPartition] = []
        for kind in self.kinds:
            out += [Some(kind, names) for names in itertools.batched(_listed(files, f"{at}/{kind}"), self.per_task)]
        return out or [Some(self.kinds[0], [])]

    def read(self, partition: Some) -> Iterator[tuple]:
        files, at = _folder(self.path)
        for name in filter(None, partition.names.split("/")):
            base = f"{at}/{partition.kind}/{name}"
            with files.open_input_file(f"{base}.json") as f:
                record = f.read().decode()
            json.loads(record)  # what is no JSON fails the read
            picture = None
            if files.get_file_info(f"{base}.jpg").is_file:
                with files.open_input_file(f"{base}.jpg") as f:
                    picture = f.read()
            yield partition.kind, name, record, picture


@dataclass
class Counted(WriterCommitMessage):
    n: dict[str, int]


class Writer(DataSourceWriter):
    def __init__(self, path: str, manifest: dict, replace: bool):
        self.path, self.manifest, self.replace = path.rstrip("/"), manifest, replace
        files, at = _folder(self.path)
        if not replace and files.get_file_info(at).type != fs.FileType.NotFound:
            raise PySparkValueError(f"{path} is there already")

    def write(self, iterator: Iterator[Row]) -> Counted:
        files, at = _folder(f"{self.path}.tmp")
        counts: Counter = Counter()
        for r in iterator:
            if r["kind"] not in KINDS or not re.fullmatch(r"[A-Za-z0-9_-]+", r["name"] or ""):
                raise PySparkValueError(f"not a record of an export: {r['kind']} {r['name']}")
            files.create_dir(f"{at}/{r['kind']}", recursive=True)
            for end, content in (("json", r["record"].encode()), ("jpg", r["picture"])):
                if content is not None:
                    with files.open_output_stream(f"{at}/{r['kind']}/{r['name']}.{end}") as f:
                        f.write(bytes(content))
            counts[r["kind"]] += 1
        return Counted(dict(counts))

    def commit(self, messages: list[Counted]) -> None:
        counts: Counter = Counter()
        for m in messages:
            counts.update(m.n if m else {})
        files, at = _folder(f"{self.path}.tmp")
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/manifest.json") as f:
            f.write(json.dumps({**self.manifest, "schema": SCHEMA, "counts": {k: counts[k] for k in KINDS}}, indent=2).encode())
        _, final = _folder(self.path)
        if self.replace and files.get_file_info(final).type != fs.FileType.NotFound:
            files.delete_dir(final)
        files.move(at, final)

    def abort(self, messages: list[Counted]) -> None:
        files, at = _folder(f"{self.path}.tmp")
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)


class Export(DataSource):
    """Options: path; kinds (comma-joined) to read; manifest (JSON) to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> Reader:
        kinds = [k for k in self.options.get("kinds", ",".join(KINDS)).split(",") if k in KINDS]
        return Reader(self.options["path"], kinds or [KINDS[0]], int(self.options.get("files", FILES)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], json.loads(self.options.get("manifest", "{}")), overwrite)


def checked(path: str) -> dict:
    """The manifest of the export at path; another schema than this one's is refused."""
    files, at = _folder(path)
    with files.open_input_file(f"{at}/manifest.json") as f:
        manifest = json.loads(f.read())
    if manifest.get("schema") != SCHEMA:
        raise PySparkValueError(f"{path}: schema {manifest.get('schema')} is not supported")
    return manifest


def scan(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of one kind with name and picture, each as its kind's columns; of teach place says the order that it is taken in."""
    spark.dataSource.register(Export)
    rows = spark.read.format(FORMAT).option("path", path).option("kinds", kind).load()
    out = rows.select("name", F.from_json("record", SCHEMAS[kind], {"mode": "FAILFAST"}).alias("r"), "picture").select("name", "r.*", "picture")
    if kind == "teach":
        from ..functions.stats import positions

        order = F.struct("tMs", F.coalesce("index", F.lit(0)), "name")
        return positions(out.withColumn("all", F.lit(0)), ["all"], order).withColumnRenamed("_at", "place").drop("all")
    return out


def clip_name(name: Column) -> Column:
    """What a clip is called in file names."""
    cleaned = safe_name(name)
    return F.when(cleaned == "", "clip").otherwise(cleaned)


def finite_or_null(x: Column) -> Column:
    """JSON has no NaN and no infinity."""
    return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)


def write(records: DataFrame, path: str, manifest: dict, replace: bool = False) -> None:
    """records (kind, name, picture and further columns, which are the record) as the export at path; there is nothing at path unless all
    could be written."""
    spark = records.sparkSession
    spark.dataSource.register(Export)
    body = F.to_json(F.struct(*(F.col(f"`{c}`") for c in records.columns if c not in ("kind", "name", "picture"))), {"ignoreNullFields": "false"})
    rows = records.select("kind", "name", body.alias("record"), F.col("picture").cast("binary").alias("picture"))
    rows.write.format(FORMAT).option("path", path).option("manifest", json.dumps(manifest)).mode("overwrite" if replace else "append").save()


def mask_pixels(records: DataFrame, by: str = "name") -> DataFrame:
    """by, y and x of the pixels of records' masks; a mask whose runs do not fill its window stops the job."""
    m = F.col("mask")
    bits = masks.decoded(m["rle"])
    sound = F.when(F.aggregate(m["rle"], F.lit(0), lambda a, n: a + n) == m["w"] * m["h"], bits).otherwise(F.raise_error(F.concat(F.lit("runs do not fill the mask of "), F.col(by))).cast("array<int>"))
    one = records.where(m.isNotNull()).select(by, m["x"].alias("x0"), m["y"].alias("y0"), m["w"].alias("w"), F.posexplode(sound).alias("k", "bit")).where("bit = 1")
    return one.select(by, (F.col("y0") + F.floor(F.col("k") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("k") % F.col("w")).cast("int").alias("x"))


def consistency(records: DataFrame, gh: int, gw: int, factor: int) -> DataFrame:
    """name, cov_off (patches whose stored coverage isn't what mask and crop give), cov_max, geometry_max (largest relative difference of
    the stored geometry) and theta_max of the records (name, mask, crop, cov, geometry, theta) that have a mask."""
    numbers = records.where("mask is not null").select("name", F.xxhash64("name").alias("img"), "mask", "crop", "cov", "geometry", "theta")
    on = mask_pixels(numbers).join(numbers.select("name", "img").hint("merge"), "name").select("img", "y", "x", F.lit(1).alias("label"))
    squares = numbers.where("crop is not null and cov is not null").select("img", F.lit(1).alias("label"), F.col("crop.x0").alias("x0"), F.col("crop.y0").alias("y0"), F.col("crop.side").alias("side"))
    again = crops.coverage(on, squares, gh, gw, factor).select("img", (F.col("r") * gw + F.col("c")).alias("p"), F.col("cov").alias("now"))
    stored_ = numbers.select("img", F.posexplode("cov").alias("p", "cov"))
    off = F.abs(F.col("cov") - F.col("now"))
    cover = stored_.join(again.hint("merge"), ["img", "p"]).groupBy("img").agg(F.count_if(off > 0).alias("cov_off"), F.max(off).alias("cov_max"))
    shape = pixels.shapes(on).join(pixels.solidity(on).select("img", "label", "solidity").hint("merge"), ["img", "label"])
    far = lambda c: F.abs(F.col(c) - F.col(f"geometry.{c}")) / F.greatest(F.abs(F.col(f"geometry.{c}")), F.lit(1e-12))
    geometry = shape.withColumnRenamed("theta", "now").join(numbers.select("img", "name", "geometry", "theta").hint("merge"), "img")
    told = geometry.select("img", "name", F.greatest(*(far(c) for c in ("area", "fill", "aspect", "hu1", "solidity"))).alias("geometry_max"), F.abs(F.col("now") - F.col("theta")).alias("theta_max"))
    return told.join(cover.hint("merge"), "img", "left").select("name", F.coalesce("cov_off", F.lit(0)).alias("cov_off"), "cov_max", "geometry_max", "theta_max")
