"""Result tables: the CSV with three header rows, and imports of tables from other trackers."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COORDS = ("x", "y", "likelihood")


def pose_columns(parts: list[str], bodies: int) -> list[tuple[str, str, str]]:
    """Columns of the table: body by body, part by part, x, y, likelihood."""
    return [(f"Body{b + 1}", p, c) for b in range(bodies) for p in parts for c in COORDS]


def wide(poses: DataFrame, parts: list[str], bodies: int) -> DataFrame:
    """One row a frame with a column for each body, part and coordinate; one aggregate, no join."""
    picked = [F.max(F.when((F.col("body") == b) & (F.col("part") == p), F.col(c))).alias(f"{b}|{p}|{c}") for b in range(bodies) for p in parts for c in COORDS]
    return poses.groupBy("frame").agg(*picked).orderBy("frame")


def write_csv(poses: DataFrame, path: str, parts: list[str] | None = None, bodies: int | None = None) -> None:
    """Write poses (frame, body, part, x, y, likelihood) as one table folder: a header file and row files in frame order."""
    parts = parts or sorted(r["part"] for r in poses.select("part").distinct().collect())
    bodies = bodies or (poses.agg(F.max("body")).first()[0] or 0) + 1
    columns = pose_columns(parts, bodies)
    spark = poses.sparkSession
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for level in range(3):
        w.writerow([c[level] for c in columns])
    spark.createDataFrame([(out.getvalue().rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    wide(poses, parts, bodies).drop("frame").write.mode("overwrite").option("header", "false").csv(f"{path}/rows")


def _long(rows: DataFrame, columns: list[tuple[str, str, str]], names: list[str]) -> DataFrame:
    """Unpivot a wide table with a frame column: one generator, evaluated in the JVM."""
    bodies = list(dict.fromkeys(c[0] for c in columns))
    keys = list(dict.fromkeys((c[0], c[1]) for c in columns))
    at = {c: names[i] for i, c in enumerate(columns)}
    cell = lambda k, c: F.col(f"`{at[(*k, c)]}`").cast("double") if (*k, c) in at else F.lit(None).cast("double")
    points = F.array(*[F.struct(F.lit(bodies.index(k[0])).cast("long").alias("body"), F.lit(k[1]).alias("part"), *[cell(k, c).alias(c) for c in COORDS]) for k in keys])
    return rows.select("frame", F.explode(points).alias("p")).select("frame", "p.*")


def check(columns: list[tuple[str, str, str]]) -> None:
    """Every body has every part, and every part x, y and likelihood."""
    bodies, parts = {c[0] for c in columns}, {c[1] for c in columns}
    missing = [(b, p, c) for b in sorted(bodies) for p in sorted(parts) for c in COORDS if (b, p, c) not in set(columns)]
    if missing or not columns:
        raise ValueError(f"not a result table, without {missing[:3]}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Poses of a folder of write_csv. Frames are numbered through the row files in order of their names and lines."""
    header = [next(csv.reader([r["value"]])) for r in spark.read.text(f"{path}/header").collect()]
    columns = list(zip(*header, strict=True))
    check(columns)
    names = [f"c{i}" for i in range(len(columns))]
    rows = spark.read.schema(", ".join(f"{n} double" for n in names)).option("header", "false").csv(f"{path}/rows")
    return _long(_numbered(rows), columns, names)


def _numbered(rows: DataFrame) -> DataFrame:
    """Consecutive frame numbers in file order: positions within partitions plus the sizes of those before."""
    placed = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_file", F.col("_metadata.file_name"))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_file").alias("file")).orderBy("file", "_part").collect()
    base, total = {}, 0
    for r in sizes:
        base[r["_part"]] = total
        total += r["n"]
    if not base:
        return placed.withColumn("frame", F.lit(0).cast("long")).drop("_id", "_file", "_part")
    start = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("_part"))
    return placed.withColumn("frame", start + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_file", "_part")


def import_csv(spark: SparkSession, path: str) -> DataFrame:
    """Poses of a table with 3 or 4 header rows (scorer, [individuals,] bodyparts, coords) and the frame in the first column.

    Parts that not every individual has are left out, as is the individual 'single'; frames without a row get zeros.
    """
    lines = spark.read.text(path)
    head = [next(csv.reader([r["value"]])) for r in lines.limit(4).collect()]
    kinds = {h[0]: h[1:] for h in head if h and h[0] in ("scorer", "individuals", "bodyparts", "coords")}
    if not {"bodyparts", "coords"} <= set(kinds):
        raise ValueError("no header rows 'bodyparts' and 'coords'")
    seen: dict[tuple[str, str], int] = {}
    columns = []
    for i, (part, coord) in enumerate(zip(kinds["bodyparts"], kinds["coords"], strict=True)):
        if "individuals" in kinds:
            body = kinds["individuals"][i]
        else:  # x, y, likelihood, x2, y2, likelihood2, ... of several individuals
            body = f"Body{(int(coord.lstrip('xylikehood') or 1))}"
            coord = coord.rstrip("0123456789")
        columns.append((body, part, coord))
        seen[body, part] = seen.get((body, part), 0) + 1
    bodies = [b for b in dict.fromkeys(c[0] for c in columns) if b != "single"] or ["single"]
    parts = [p for p in dict.fromkeys(c[1] for c in columns) if all((b, p) in seen for b in bodies)]
    names = [f"c{i}" for i in range(len(columns))]
    rows = spark.read.schema("frame long, " + ", ".join(f"{n} double" for n in names)).option("mode", "DROPMALFORMED").csv(path).filter("frame IS NOT NULL")
    long = _long(rows, columns, names).withColumn("_b", F.col("body"))
    order = list(dict.fromkeys(c[0] for c in columns))
    keep = F.col("_b").isin([order.index(b) for b in bodies]) & F.col("part").isin(parts)
    number = F.element_at(F.array(*[F.lit(bodies.index(b) if b in bodies else -1).cast("long") for b in order]), (F.col("_b") + 1).cast("int"))
    found = long.filter(keep).withColumn("body", number).drop("_b")
    last = rows.agg(F.max("frame")).first()[0]
    spine = spark.range((last if last is not None else -1) + 1).select(F.col("id").alias("frame"))
    keys = spark.createDataFrame([(b, p) for b in range(len(bodies)) for p in parts], "body long, part string")
    return spine.crossJoin(F.broadcast(keys)).join(found, ["frame", "body", "part"], "left").fillna(0.0, list(COORDS)).select("frame", "body", "part", *COORDS)


def import_instances(frames: DataFrame, instances: DataFrame, points: DataFrame, parts: list[str], video: int = 0) -> DataFrame:
    """Poses of an annotation project's tables: frames (frame_id, video, frame_idx, instances_from, instances_to), instances (position, track,
    kind: 0 by a user, 1 predicted, score, points_from, points_to) and points (kind, position, x, y, visible, score), ranges by position.

    Of one video; where a track has several instances in a frame, a predicted one goes over a user's, then the later one. The
    likelihood is the point's score where it is visible, else 0. Tracks without any visible point are left out, the others numbered in
    order; frames without an instance of a track get zeros.
    """
    own = frames.filter(F.col("video") == video)
    found = own.filter("instances_to > instances_from").select("frame_idx", F.explode(F.sequence(F.col("instances_from"), F.col("instances_to") - 1)).alias("position"))
    best = F.max_by(F.struct("kind", "points_from", "points_to"), F.struct("kind", "position")).alias("i")
    chosen = found.join(instances, "position").groupBy("frame_idx", "track").agg(best).select("frame_idx", "track", "i.*").filter("points_to > points_from")
    placed = chosen.select("frame_idx", "track", "kind", F.posexplode(F.sequence(F.col("points_from"), F.col("points_to") - 1)).alias("n", "position"))
    seen = F.col("visible").cast("boolean")
    got = placed.join(points, ["kind", "position"]).select(
        F.col("frame_idx").alias("frame"), "track", F.element_at(F.array(*[F.lit(p) for p in parts]), (F.col("n") + 1).cast("int")).alias("part"), "x", "y", F.when(seen, F.coalesce("score", F.lit(1.0))).otherwise(0.0).alias("likelihood")
    )
    tracks = [r["track"] for r in got.groupBy("track").agg(F.max("likelihood").alias("l")).filter("l > 0").orderBy("track").collect()]
    spark = frames.sparkSession
    keys = spark.createDataFrame([(t, b, p) for b, t in enumerate(tracks) for p in parts], "track long, body long, part string")
    last = own.agg(F.max("frame_idx")).first()[0]
    spine = spark.range((last if last is not None else -1) + 1).select(F.col("id").alias("frame"))
    return spine.crossJoin(F.broadcast(keys)).join(got, ["frame", "track", "part"], "left").fillna(0.0, list(COORDS)).select("frame", "body", "part", *COORDS)


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """The first reader that can read the path."""
    for reader in (read_csv, import_csv):
        try:
            df = reader(spark, path)
            df.schema
            return df
        except Exception as e:  # the next reader may know it
            last = e
    raise ValueError(f"no reader for {path}") from last
