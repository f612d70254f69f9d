"""Session helpers: a tuned local session for tests, table access and the shared workspace for cut lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below `sf_dir`, read lazily; any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RUN = uuid.uuid4().hex[:12]
_fallback: str | None = None  # for sessions on one machine without a shared folder


def workspace(spark: SparkSession) -> str:
    """This run's folder for written tables below spark.checkpoint.dir, which all workers share.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster, whose workers would each write to a disk
    of their own, that is an error.
    """
    global _fallback
    where = spark.conf.get("spark.checkpoint.dir", None) or _fallback
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all workers share")
        where = _fallback = tempfile.mkdtemp(prefix="trailmark-")
    return f"{where.rstrip('/')}/trailmark/{_RUN}"


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this run has written into the workspace; call it when no result of theirs is read any more."""
    _delete(spark, workspace(spark))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the workspace and read it back: survives lost executors, and cuts the lineage."""
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trailmark_path = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by keys to as many partitions as there are shuffle partitions, or four for each core if that is more.

    For grouped maps that take long over few rows: partitions dealt by number are not put together for being small.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def filesystem(path: str):
    """The pyarrow file system of a path or URI (a local or mounted path, HDFS, S3 and the like), and the path there; for tasks."""
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_trailmark_path", None)
        if path:
            _delete(spark, path)
