"""The state of a session of edits: versioned frame records and metadata, kept as Parquet below one folder.

A save is a folder `version=n` that is written under another name and renamed, so a save that broke off is never seen and the
record of an older version stands in for it. A frame record has what an edit needs: the cells as they came, the cells in use, and
the flags of each frame, part and individual.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("frame", "part", "ind")
FLAGS = ("ignore_clustering", "disable_occluded")
_CELL = "struct<x: bigint, y: bigint, p: double, ox: double, oy: double>"


def records(source: DataFrame, original: DataFrame, flags: DataFrame) -> DataFrame:
    """frame, part, ind, the flags, src and orig: arrays of cells in (y, x) order. Keys of any of the three tables have a record; cells that
    a table does not have are an empty array, flags it does not have are false."""

    def packed(cells: DataFrame, name: str) -> DataFrame:
        full = cells.select(*KEY, *(F.col(c).cast(k).alias(c) if c in cells.columns else F.lit(0.0).alias(c) for c, k in (("x", "long"), ("y", "long"), ("p", "double"), ("ox", "double"), ("oy", "double"))))
        in_order = F.sort_array(F.collect_list(F.struct("y", "x", "p", "ox", "oy")))
        return full.groupBy(*KEY).agg(F.transform(in_order, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["p"].alias("p"), c["ox"].alias("ox"), c["oy"].alias("oy"))).alias(name))

    joined = packed(source, "src").join(packed(original, "orig"), list(KEY), "full_outer").join(flags, list(KEY), "full_outer")
    none = F.array().cast(f"array<{_CELL}>")
    return joined.select(*KEY, *(F.coalesce(F.col(f), F.lit(False)).alias(f) for f in FLAGS), *(F.coalesce(c, none).alias(c) for c in ("src", "orig")))


def cells_of(state: DataFrame, plane: str = "src") -> DataFrame:
    """The cells of records again: frame, part, ind, x, y, p, ox, oy."""
    return state.select(*KEY, F.inline(plane))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(int(m[1]) for s in fs.listStatus(p) if (m := re.fullmatch(r"version=(\d+)", s.getPath().getName())))


def save(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Keep records as the next version, and return it; if another session took that version meanwhile, it is an error."""
    version = (versions(spark, path) or [0])[-1] + 1
    made = f"{path}/.tmp-{uuid.uuid4().hex}"
    rows.write.parquet(made)
    source, fs = _fs(spark, made)
    target, _ = _fs(spark, f"{path}/version={version}")
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:  # unlike FileSystem.rename this never moves a folder into one that is there
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, none)
    except Exception as e:
        if fs.exists(target):
            fs.delete(source, True)
            raise RuntimeError(f"version {version} is there already") from e
        raise
    return version


def load(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Each key's record of its last version, of those up to `upto` if that is given; without a save this is an error."""
    known = [v for v in versions(spark, path) if upto is None or v <= upto]
    if not known:
        raise ValueError(f"no saved state in {path}")
    every = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in known])
    names = [c for c in every.columns if c not in (*KEY, "version")]
    newest = every.groupBy(*KEY).agg(F.max_by(F.struct(*names), "version").alias("r"))
    return newest.select(*KEY, "r.*")


def encode_metadata(meta: dict) -> str:
    """Metadata as JSON: numbers (also infinite ones), texts, lists, tables by text and null; anything else is refused."""

    def plain(v, where: str):
        if v is None or isinstance(v, bool | int | float | str):
            return v
        if isinstance(v, list | tuple):
            return [plain(x, where) for x in v]
        if isinstance(v, dict) and all(isinstance(k, str) for k in v):
            return {k: plain(x, f"{where}.{k}") for k, x in v.items()}
        raise TypeError(f"{where}: {type(v).__name__} is no metadata")

    return json.dumps(plain(meta, "meta"), sort_keys=True)


def decode_metadata(text: str) -> dict:
    """The metadata again; a text never makes objects of a class."""
    meta = json.loads(text)
    if not isinstance(meta, dict):
        raise ValueError("metadata is a table by text")
    return meta
