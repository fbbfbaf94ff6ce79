"""Files: matrices of half floats, evaluation exports, part stores, session logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors

# What pictures' names end in, and what the names of negatives are made of.
PICTURES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
NEGATIVE_ID = r"^[A-Za-z0-9_-][A-Za-z0-9._-]*$"
# Fixed value: how a matrix file begins; little-endian int32 rows and columns follow, then binary16 numbers.
MAGIC = b"KZF16v1\n"


def matrix_bytes(m: np.ndarray) -> bytes:
    return MAGIC + np.array(m.shape, "<i4").tobytes() + np.ascontiguousarray(m, "<f2").tobytes()


def matrix_of(raw: bytes) -> np.ndarray:
    """Refuses another beginning, negative sizes, and contents that are too short or too long."""
    if raw[: len(MAGIC)] != MAGIC or len(raw) < len(MAGIC) + 8:
        raise ValueError("not a matrix file")
    rows, cols = (int(x) for x in np.frombuffer(raw, "<i4", 2, len(MAGIC)))
    body = raw[len(MAGIC) + 8 :]
    if rows < 0 or cols < 0 or len(body) != 2 * rows * cols:
        raise ValueError(f"{rows} x {cols} numbers do not match {len(body)} bytes")
    return np.frombuffer(body, "<f2").reshape(rows, cols).astype(np.float32)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """path, row and f of every row of every matrix file below path; error instead of rows where a file is refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                try:
                    m = matrix_of(bytes(raw))
                    yield pd.DataFrame({"path": p, "row": np.arange(len(m)), "f": list(m), "error": None})
                except ValueError as e:
                    yield pd.DataFrame({"path": [p], "row": [-1], "f": [None], "error": [str(e)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.f16").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, row long, f array<float>, error string")


CROP = "struct<x0:double,y0:double,side:double>"
MASK = "struct<x:int,y:int,w:int,h:int,rle:array<int>>"
GEOMETRY = "struct<area:int,fill:double,aspect:double,hu1:double,solidity:double>"
INFO = f"tMs bigint, sanity string, sharpness double, crop {CROP}, mask {MASK}, cov array<double>, geometry {GEOMETRY}, theta double"
PHONE = "struct<verdict:string,reason:string,raw:double,s:double,sim:double,a:double,peak:array<int>,ms:double>"
SCHEMAS = {"teach": f"{INFO}, index int", "negatives": f"{INFO}, index int", "parts": f"{INFO}, clip string, trackId int, label string, trigger string, phone {PHONE}"}


def read_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of one kind (teach, parts, negatives) of an evaluation export, with name; malformed ones fail the read."""
    rows = spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/{kind}")
    return rows.withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1))


def canonical(value: object) -> str:
    """JSON with sorted keys at every level and no space, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_json(c) -> object:
    """The canonical form of a column of JSON texts; null for what isn't JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else canonical(json.loads(x))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(c)


def save_parts(parts: DataFrame, path: str) -> None:
    """Parts by part_id, those already stored replaced and others kept: only their partitions are overwritten."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_id").parquet(path)


def load_parts(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Stored parts, newest first, with outcome: Loaded, or FingerprintMismatch for those of another pipeline."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.withColumn("outcome", F.when(F.col("fingerprint") == fingerprint, "Loaded").otherwise("FingerprintMismatch")).orderBy(F.desc("created_at_ms"), "part_id")


def add_negatives(rows: DataFrame, path: str) -> None:
    """Append descriptors of other objects: rows of id, fingerprint, created_at_ms, g (kept as half floats) and, if wanted, maps and crops.
    Refused as a whole, before anything is written, where an id is odd, comes again or is stored already, or a g is null or empty."""
    odd = ~F.coalesce(F.col("id").rlike(NEGATIVE_ID) & ~F.endswith("id", F.lit(".tmp")) & (F.size("g") > 0), F.lit(False))
    names = rows.select("id", odd.alias("bad"))
    try:
        names = names.unionByName(rows.sparkSession.read.parquet(path).select("id", F.lit(False).alias("bad")))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    bad = names.groupBy("id").agg(F.max("bad").alias("bad"), F.count("*").alias("n")).where("bad or n > 1").select("id").limit(5).collect()
    if bad:
        raise ValueError(f"bad or known negatives, such as {[r.id for r in bad]}")
    rows.withColumn("g", F.transform("g", vectors.half)).write.mode("append").parquet(path)


def load_negatives(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Stored negatives of one pipeline, oldest first; columns that only later ones have are null in those before."""
    return spark.read.option("mergeSchema", "true").parquet(path).where(F.col("fingerprint") == fingerprint).orderBy("created_at_ms", "id")


def photos(spark: SparkSession, folder: str, label: str | None = None) -> DataFrame:
    """name, label and content of the pictures that lie in a folder itself. Names that begin with bad or good, in any case, say the label;
    others have the one that is given."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    low = F.lower(name)
    known = F.when(low.startswith("bad"), "bad").when(low.startswith("good"), "good").otherwise(F.lit(label))
    ends = "{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in PICTURES) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ends}").load(folder)
    return files.select(name.alias("name"), known.alias("label"), "content").orderBy("name")


def safe_name(name) -> object:
    """Letters, digits and hyphens, no hyphens at the ends, 32 at most."""
    return F.substring(F.trim(F.regexp_replace(name, "[^A-Za-z0-9-]", "-"), F.lit("-")), 1, 32)
