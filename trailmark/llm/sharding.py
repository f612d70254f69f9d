"""A store of immutable Parquet shards with size-tiered compaction and versioned manifests; DataFrame operations only.

An arrival is appended as small shards, of a fan-in-th of the target size at most, by the tasks that read it. Compaction puts shards
up to half the target into tiers by size (a tier spans a factor of the fan-in), forms runs of neighbours in a tier up to the target
size, and rewrites each run as one shard, which then belongs to a higher tier; `settle` repeats that until no tier has a run, and then
merges what is left over in the tiers. Sizes are those of texts before compression, with `ROW_BYTES` for the rest of a row.

A version's manifest is a Parquet folder with the shards that it adds and drops, and every `SNAPSHOT`-th has all its shards beside
that, so a commit writes as much as has changed. It is written under a temporary name and renamed, which fails if another writer was
first; the loser takes the next version, after a compaction only if the shards that it merged are still there. Readers see one version
as a whole, nothing is changed in place, and old versions can be read until `vacuum` is asked to forget them.

A writer claims the name of its part before it writes the first file and gives the claim up after its commit. `vacuum` looks at the files first, at
the claims next and at the versions last, so a part that it finds neither claimed nor listed belongs to no commit, made or to come:
the remains of a job that died, whose claim counts for nothing after `CLAIM_S` seconds.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.session import materialize, workspace

TARGET = 8 << 20
FAN_IN = 8
PLANNED_TOGETHER = 50_000
LISTED = 100_000
ROW_BYTES = 64
CLAIM_S = 7 * 86400
SNAPSHOT = 10
_MANIFEST = "shard_id string, part string, slot long, tier int, rows long, bytes long, checksum long, parents long"
_DELTA = f"{_MANIFEST}, added boolean"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Missing(RuntimeError):
    """A part that a manifest lists, or is about to list, is not there."""


class ShardStore:
    """`root`: a folder shared by all workers. Rows have a column doc_id and a column text; others are stored as they are.

    Null ids and texts are stored like any value (a null text has no bytes), repeated rows are stored as often as they
    come, an empty arrival commits a version without new shards. Columns named _part and _slot are the store's own. The first
    arrival sets the columns; later ones are cast to their types, miss some as nulls, and must not bring others. A store that holds
    no row, or none yet, reads as an empty table.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN) -> None:
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in

    # -- manifests -------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs(f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        first = max((int(m[1]) for n in names if (m := re.fullmatch(r"first-(\d+)", n))), default=0)
        return sorted(v for n in names if (m := re.fullmatch(r"v(\d+)", n)) and (v := int(m[1])) >= first)

    def _at(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}"

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, of the last one by default; none before the first."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version not in known:
            if version:
                raise ValueError(f"no version {version}")
            return self.spark.createDataFrame([], _MANIFEST)
        later, base = [], version
        while base and not self._exists(f"{self._at(base)}/all"):
            later.append(f"{self._at(base)}/delta")
            base -= 1
        shards = self.spark.read.schema(_MANIFEST).parquet(f"{self._at(base)}/all") if base else self.spark.createDataFrame([], _MANIFEST)
        if not later:
            return shards
        changes = self.spark.read.schema(_DELTA).parquet(*later)
        live = shards.unionByName(changes.filter("added").drop("added"))
        return live.join(changes.filter("NOT added").select("shard_id"), "shard_id", "left_anti")

    def _commit(self, changes: DataFrame, version: int, part: str | None = None, dropped: DataFrame | None = None) -> int:
        """Commit the shards that a version adds, and those that it drops (added = false), as `version` or the first free one after it.

        Raises Conflict if another writer has dropped one of the shards in `dropped` meanwhile, or if the version is taken and no `part` is added.
        """
        made = f"{self.root}/manifest/.tmp-{uuid.uuid4().hex}"
        changes.select(*[c.split()[0] for c in _DELTA.split(", ")]).write.parquet(f"{made}/delta")
        while True:
            if part and not self._exists(self._part(part)):
                raise Missing(f"the files of part {part} have gone before they were committed")
            try:
                self._rename(made, self._at(version))
                break
            except Conflict:
                gone = dropped is not None and not dropped.join(self.manifest(), "shard_id", "left_anti").isEmpty()
                if part is None or gone:
                    self._delete(made)
                    raise
                version = max([version, *self.versions()]) + 1
        if version % SNAPSHOT == 0:
            self._snapshot(version)
        return version

    def _part(self, part: str) -> str:
        return f"{self.root}/data/_part={part}"

    def _claim(self, part: str) -> str:
        """Say that a part is being written; `vacuum` leaves it alone until the claim is deleted."""
        path = f"{self.root}/claims/{part}"
        p, fs = self._fs(path)
        fs.create(p).close()
        return path

    def _snapshot(self, version: int) -> None:
        """All shards of a version beside what it changes; the same whoever writes it, so that a second writer may fail."""
        if not self._exists(f"{self._at(version)}/all"):
            made = f"{self.root}/manifest/.tmp-{uuid.uuid4().hex}"
            self.manifest(version).write.parquet(made)
            try:
                self._rename(made, f"{self._at(version)}/all")
            except Conflict:
                self._delete(made)

    def _rename(self, made: str, name: str) -> None:
        jvm = self.spark._jvm
        source, target = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(name)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, none)
        except Exception as e:
            if self._exists(name):
                raise Conflict(f"{name} is there already") from e
            raise

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    # -- data ------------------------------------------------------------------------------------------------------

    def _bytes(self):
        return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES

    def _schema(self) -> T.StructType:
        """The columns of the store's rows, as the first arrival has set them."""
        return T.StructType.fromJson(json.loads(self.spark.read.schema("columns string").parquet(f"{self.root}/columns").first()[0]))

    def _fitted(self, docs: DataFrame) -> DataFrame:
        """An arrival with the store's columns."""
        docs = docs.drop("_part", "_slot")
        if not self._exists(f"{self.root}/columns/_SUCCESS"):
            self.spark.createDataFrame([(json.dumps(docs.schema.jsonValue()),)], "columns string").coalesce(1).write.mode("ignore").parquet(f"{self.root}/columns")
        fields = self._schema().fields
        if more := set(docs.columns) - {f.name for f in fields}:
            raise ValueError(f"columns that the store does not have: {sorted(more)}")
        return docs.select(*[(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def _write(self, rows: DataFrame, part: str) -> DataFrame:
        """Write rows with a column _slot as one shard each, and describe what has been written, from the files."""
        path = self._part(part)
        rows.write.partitionBy("_slot").option("compression", "zstd").parquet(path)
        kinds = rows.schema["_slot"].dataType
        written = self.spark.read.schema(rows.schema).parquet(path)
        hashed = [f.name for f in rows.schema if f.name != "_slot" and "map<" not in f.dataType.simpleString()]
        return (
            written.groupBy(F.col("_slot").cast(kinds).alias("slot"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(self._bytes()).alias("bytes"), F.sum(F.xxhash64(*hashed).cast("decimal(20,0)")).alias("total"))
            .select(F.concat_ws("-", F.lit(part), F.col("slot").cast("string")).alias("shard_id"), F.lit(part).alias("part"), "slot", self._tier().alias("tier"), "rows", "bytes", F.pmod("total", F.lit(1 << 62)).cast("long").alias("checksum"))
        )

    def _tier(self):
        """0 for shards of an arrival's usual size and below, one more for each factor of the fan-in."""
        return F.greatest(F.floor(F.log(float(self.fan_in), F.col("bytes") * F.lit(self.fan_in * 2) / F.lit(self.target))), F.lit(0)).cast("int")

    def append(self, docs: DataFrame) -> int:
        """Add an arrival as small shards; returns the new version. Nothing is shuffled: each partition of the arrival writes its own
        shards, and deals its rows to several by a hash where they would be larger than a fan-in-th of the target."""
        docs = self._fitted(docs).withColumn("_p", F.spark_partition_id())
        piece = self.target // self.fan_in
        sizes = docs.groupBy("_p").agg(F.sum(self._bytes()).alias("bytes")).select("_p", F.ceil(F.col("bytes") / piece).alias("_slots"))
        version = (self.versions() or [0])[-1] + 1
        slots = self.spark.createDataFrame(sizes.collect(), sizes.schema)  # a row a partition
        if slots.isEmpty():
            return self._commit(self.spark.createDataFrame([], _DELTA), version)
        part = f"a{version:08d}{uuid.uuid4().hex[:6]}"
        claim = self._claim(part)
        dealt = docs.join(F.broadcast(slots), "_p", "left")
        slot = F.col("_p").cast("long") * (1 << 32) + F.pmod(F.xxhash64("doc_id", "text"), F.coalesce("_slots", F.lit(1)))
        made = self._write(dealt.withColumn("_slot", slot).drop("_p", "_slots"), part)
        version = self._commit(made.withColumn("parents", F.lit(0).cast("long")).withColumn("added", F.lit(True)), version, part)
        self._delete(claim)
        return version

    def plan(self, across: bool = False) -> DataFrame:
        """The manifest with `run`, the run that each shard of up to half the target goes to; null for shards that stay as they are.

        Runs are of one tier, or of all with `across`.
        """
        shards = self.manifest()
        groups = max(1, -(-shards.count() // PLANNED_TOGETHER))
        tier = Window.partitionBy("level", "some").orderBy("bytes", "shard_id")
        small = (
            shards.filter(F.col("bytes") * 2 <= self.target)
            .withColumn("level", F.lit(-1) if across else F.col("tier"))
            .withColumn("some", F.pmod(F.xxhash64("shard_id"), F.lit(groups)))
            .withColumn("upto", F.sum("bytes").over(tier.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("number", F.floor(F.coalesce("upto", F.lit(0)) / self.target))
            .withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("level", "some", "number")))
            .filter("members > 1")
            .select("shard_id", (F.xxhash64("level", "some", "number")).alias("run"))
        )
        return shards.join(small, "shard_id", "left")

    def compact(self, across: bool = False) -> int:
        """Merge the planned runs and commit the next version; the last version again if there is nothing to merge."""
        version = (self.versions() or [0])[-1]
        # Written, so that the version it comes from may be forgotten before this one is committed.
        runs = materialize(self.spark, self.plan(across).filter("run is not null"), "runs")
        shards, n = runs.agg(F.count(F.lit(1)), F.count_distinct("run")).first()
        if not n:
            return version
        part = f"c{version + 1:08d}{uuid.uuid4().hex[:6]}"
        claim = self._claim(part)
        merged = self._rows(runs.select(F.col("part").alias("_part"), F.col("slot").alias("_slot"), "run"), shards).drop("_part", "_slot").withColumnRenamed("run", "_slot")
        made = self._write(merged.repartition(n, "_slot"), part)
        parents = runs.groupBy(F.col("run").alias("slot")).agg(F.count(F.lit(1)).alias("parents"), F.pmod(F.sum(F.col("checksum").cast("decimal(38,0)")), F.lit(1 << 62)).cast("long").alias("was"), F.sum("rows").alias("had"))
        checked = made.join(parents, "slot").withColumn("parents", F.expr("CASE WHEN was = checksum AND had = rows THEN parents ELSE raise_error('a merged shard differs from its parents') END"))
        changes = checked.drop("was", "had").withColumn("added", F.lit(True)).unionByName(runs.drop("run").withColumn("added", F.lit(False)))
        try:
            version = self._commit(changes, version + 1, part, runs.select("shard_id"))
        except Conflict:  # another compaction was first
            self._delete(self._part(part))
            self._delete(claim)
            return self.compact(across)
        self._delete(claim)
        return version

    def settle(self) -> int:
        """Compact until no tier has a run, then what is left over across the tiers; older versions stay until `vacuum`."""
        version, across = None, False
        while True:
            new = self.compact(across)
            if new == version:
                if across:
                    return new
                across = True
            version = new

    def _rows(self, shards: DataFrame, count: int) -> DataFrame:
        """The stored rows of `count` given shards (_part, _slot, ...); partitions of other shards are pruned at run time.

        The list is broadcast up to `LISTED` shards, so that the rows themselves stay where they are.
        """
        fields = self._schema().fields if self._exists(f"{self.root}/columns/_SUCCESS") else T.StructType.fromDDL("doc_id long, text string").fields
        schema = T.StructType([*fields, T.StructField("_part", T.StringType()), T.StructField("_slot", T.LongType())])
        if not count:
            return self.spark.createDataFrame([], schema).join(shards, ["_part", "_slot"])
        shards = F.broadcast(shards) if count <= LISTED else shards
        return self.spark.read.schema(schema).parquet(f"{self.root}/data").join(shards, ["_part", "_slot"])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with shard_id, tier, shard_rows and shard_bytes; Missing if the files of a shard that it lists are not there."""
        manifest = self.manifest(version)
        if gone := {r["part"] for r in manifest.select("part").distinct().toLocalIterator()} - set(self._parts()):
            raise Missing(f"parts {sorted(gone)} of the manifest have no files")
        listed = manifest.select(F.col("part").alias("_part"), F.col("slot").alias("_slot"), F.col("shard_id"), "tier", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
        return self._rows(listed, manifest.count()).drop("_part", "_slot")

    def _parts(self) -> list[str]:
        p, fs = self._fs(f"{self.root}/data")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [n.removeprefix("_part=") for n in names if n.startswith("_part=")]

    def _claimed(self) -> set[str]:
        """Parts that a writer is at work on; claims of jobs that died long ago are deleted."""
        p, fs = self._fs(f"{self.root}/claims")
        out = set()
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if time.time() - s.getModificationTime() / 1000 < CLAIM_S:
                out.add(s.getPath().getName())
            else:
                fs.delete(s.getPath(), True)
        return out

    def vacuum(self, keep: int = 1) -> None:
        """Forget all but the last `keep` versions, whose readers must be done, and delete the parts that none of the others lists or claims."""
        parts, claimed, known = self._parts(), self._claimed(), self.versions()  # in this order, see above
        if not known:
            return
        for v in known[-keep:]:
            self._snapshot(v)
        used = {r["part"] for v in known[-keep:] for r in self.manifest(v).select("part").distinct().toLocalIterator()}
        # The folders of forgotten versions stay for as long as a claim counts, so that no late writer takes their numbers.
        p, fs = self._fs(f"{self.root}/manifest/first-{known[-keep:][0]:08d}")
        fs.create(p).close()
        for v in known[:-keep]:
            for name in ("delta", "all"):
                self._delete(f"{self._at(v)}/{name}")
        for s in fs.listStatus(p.getParent()):
            m = re.fullmatch(r"(v|first-)(\d+)", s.getPath().getName())
            if m and int(m[2]) < known[-keep:][0] and (m[1] != "v" or time.time() - s.getModificationTime() / 1000 > CLAIM_S):
                fs.delete(s.getPath(), True)
        for part in parts:
            if part not in used and part not in claimed:
                self._delete(self._part(part))


def shard(spark: SparkSession, docs: DataFrame, arrivals: int = 4, target: int = TARGET, fan_in: int = FAN_IN) -> DataFrame:
    """`docs` put into a new store by arrivals (dealt by a hash) and compacted until it is settled: doc_id, shard_id, tier, shard_rows,
    shard_bytes, version.

    A row for each row of `docs`: repeated rows, null ids and null or empty texts are stored like others; other columns are stored and
    not returned; an empty table gives no row. A row above the target size is a shard with whatever came with it.
    """
    store = ShardStore(spark, f"{workspace(spark)}/store-{uuid.uuid4().hex[:12]}", target, fan_in)
    turn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.filter(turn == i))
    version = store.settle()
    return store.read(version).select("doc_id", "shard_id", "tier", "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))
