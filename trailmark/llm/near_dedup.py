"""Near-duplicate groups by min-max hashing.

Each of `PERMUTATIONS` linear permutations of 32-bit shingle ids gives two signature values, the smallest and the
largest image, so 288 values cost 144 evaluations a shingle. A band takes three minima and three maxima, all of
different permutations: the six values agree independently, with probability J**6 for Jaccard similarity J. With 48
bands a pair at the threshold 0.8 meets in a band with probability 1 - 5e-7.

Documents with equal shingle sets are one class; only classes go on. The buckets connect them into groups: every member of
a bucket is tied to its smallest one, and the components of these ties are the groups. Within a group all members are
compared, a block of at most `BLOCK` members (and `BLOCK_BYTES` of sets) with itself or with another one in a task: by
size, by a byte of each signature value (a pair at the threshold falls below the estimate's limit with a probability of
1e-7), and then on full sets. A task keeps its links in a union-find, skips pairs that are connected already, and gives
one link for each union. So no bucket or group is capped, none emits its pairs, no link between groups' members is lost,
and a hot group is spread over as many tasks as it has pairs of blocks. Components of the links are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm import texthash as th
from trailmark.session import materialize, release

PERMUTATIONS = 144
ROWS = 6
BANDS = 48
BLOCK, BLOCK_BYTES, BUNDLE_BYTES = 4096, 24 << 20, 8 << 20
SMALL, ROWS_A_TASK = 200_000, 25_000
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_C = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def min_max(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest image of a non-empty set under each permutation."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    lo = hi = None
    for a in range(0, len(x), 2048):
        images = x[a : a + 2048, None] * _A + _C
        m, n = images.min(0), images.max(0)
        lo, hi = (m, n) if lo is None else (np.minimum(lo, m), np.maximum(hi, n))
    return lo, hi


def bands(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature (rows of lo and hi)."""
    half = ROWS // 2
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lo), BANDS)).copy()
    for i in range(half):
        at = np.arange(BANDS) * half + i
        acc = th.mix(acc * np.uint64(7) + lo[:, at].astype(np.uint64))
        acc = th.mix(acc * np.uint64(11) + hi[:, (at + half) % PERMUTATIONS].astype(np.uint64))
    return acc.view(np.int64)


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            for part in th.slices(batch):
                n, h1, h2, keys = [], [], [], np.zeros((part.num_rows, BANDS), np.int64)
                los, his, at = [], [], []
                for i, s in enumerate(th.shingle_sets(part.column(1), k)):
                    n.append(len(s))
                    h1.append(int(th.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    h2.append(int(th.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)))
                    if len(s):
                        lo, hi = min_max(s)
                        los.append(lo)
                        his.append(hi)
                        at.append(i)
                if at:
                    keys[at] = bands(np.stack(los), np.stack(his))
                flat = pa.array(keys.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)),
                     pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), flat)],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _sets(k: int):
    """doc_id, grp, n, items (the sorted set), sig (a byte of each signature value); input doc_id, text, grp."""

    def run(batches):
        for batch in batches:
            for part in th.slices(batch):
                items, sigs = [], []
                for s in th.shingle_sets(part.column(1), k):
                    items.append(s.tobytes())
                    sigs.append(np.concatenate(min_max(s)).astype(np.uint8).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(x) // 8 for x in items], pa.int64()), pa.array(items, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "grp", "n", "items", "sig"],
                )

    return run


def group_links(ids: np.ndarray, block: np.ndarray, items: list[np.ndarray], sigs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that connect what is connected among the members: of different blocks, or all if there is one block."""
    n = len(ids)
    size = np.array([len(x) for x in items])
    order = np.argsort(size, kind="stable")
    ids, block, size, sigs, items = ids[order], block[order], size[order], sigs[order], [items[i] for i in order]
    apart = len(set(block.tolist())) > 1
    share = percent / 100
    values = sigs.shape[1]
    least = (share - 5.2 * (share * (1 - share) / values) ** 0.5) * values
    root = np.arange(n)
    out = []
    for x in range(1, n):
        low = int(np.searchsorted(size, -(-size[x] * percent // 100)))  # smaller ones can't reach the threshold
        near = np.arange(low, x)
        near = near[root[near] != root[x]]
        if apart:
            near = near[block[near] != block[x]]
        if not len(near):
            continue
        near = near[np.count_nonzero(sigs[near] == sigs[x], axis=1) >= least]
        while len(near):
            y, near = int(near[-1]), near[:-1]
            at = np.minimum(np.searchsorted(items[x], items[y]), size[x] - 1)
            both = int((items[x][at] == items[y]).sum())
            if 100 * both >= percent * (int(size[x]) + int(size[y]) - both):
                out.append((int(max(ids[x], ids[y])), int(min(ids[x], ids[y]))))
                root[root == root[y]] = root[x]
                near = near[root[near] != root[x]]
    return out


def _linked(percent: int):
    def run(pdf):
        import pandas as pd

        out = []
        for _, g in pdf.groupby("grp", sort=False):
            if len(g) > 1:
                items = [np.frombuffer(b, np.uint64) for b in g["items"]]
                sigs = np.frombuffer(b"".join(g["sig"]), np.uint8).reshape(len(g), -1)
                out += group_links(g["doc_id"].to_numpy(), g["block"].to_numpy(), items, sigs, percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


class _Graph:
    """Connected components of links that come in batches; labels are kept for nodes with a link.

    Tables of up to `SMALL` rows (counted) are broadcast in its joins and written by few tasks; larger ones are shuffled.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.labels, self.count = spark, None, 0

    def _small(self, df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= SMALL else df

    def _put(self, df: DataFrame, name: str, most: int) -> tuple[DataFrame, int]:
        """Write a table of at most `most` rows and count it."""
        if most <= SMALL:
            df = df.coalesce(max(1, -(-most // ROWS_A_TASK)))
        out = materialize(self.spark, df, name)
        return out, out.count()

    def label(self, df: DataFrame, node: str, out: str) -> DataFrame:
        """`df` with the label of column `node`: itself if it has no link yet."""
        if self.labels is None:
            return df.withColumn(out, F.col(node))
        known = self._small(self.labels.select(F.col("node").alias(node), F.col("label").alias("_label")), self.count)
        return df.join(known, node, "left").withColumn(out, F.coalesce("_label", node)).drop("_label")

    def add(self, links: DataFrame, most: int) -> None:
        """Take in links (a, b), at most `most` of them."""
        lifted = self.label(self.label(links, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a != b").distinct()
        edges, n = self._put(lifted, "edges", most)
        moved, nodes = self._components(edges, n)
        if moved is None:
            return
        old = self.labels
        up = self._small(moved.select(F.col("node").alias("label"), F.col("label").alias("up")), nodes)
        fresh = moved
        if old is not None:
            fresh = moved.join(self._small(old.select("node"), self.count), "node", "left_anti")
            known = old.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
            fresh = known.unionByName(fresh.select("node", "label"))
        self.labels, self.count = self._put(fresh.select("node", "label"), "labels", self.count + nodes)
        release(self.spark, moved, *([old] if old is not None else []))

    def _components(self, edges: DataFrame, n: int) -> tuple[DataFrame | None, int]:
        """(node, label) for each node of the edges: the smallest node that it reaches.

        Every node hooks to its smallest neighbour, chains are shortened by pointer jumping, the graph is contracted, and so
        on until no edge is left; each step is written to the workspace, so that neither lineage nor driver grows.
        """
        labels, count = None, 0
        while n:
            both = edges.union(edges.select("b", "a"))
            parent, nodes = self._put(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")), "hook", 2 * n)
            while True:
                upper = self._small(parent.select(F.col("node").alias("up"), F.col("up").alias("top")), nodes)
                jumped, _ = self._put(parent.join(upper, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "jump", nodes)
                release(self.spark, parent)
                parent = jumped
                if jumped.filter("moved").isEmpty():
                    break
            old = labels
            if labels is None:
                labels, count = self._put(parent.select("node", F.col("up").alias("label")), "labels", nodes)
            else:
                moved = self._small(parent.select(F.col("node").alias("label"), "up"), nodes)
                labels, count = self._put(labels.join(moved, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels", count)
            nxt = (
                edges.join(self._small(parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), nodes), "a")
                .join(self._small(parent.select(F.col("node").alias("b"), F.col("up").alias("ub")), nodes), "b")
                .select(F.col("ua").alias("a"), F.col("ub").alias("b"))
                .filter("a != b")
                .distinct()
            )
            contracted, left = self._put(nxt, "edges", n)
            release(self.spark, edges, parent, *([old] if old is not None else []))
            edges, n = contracted, left
        release(self.spark, edges)
        return labels, count


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of `docs` (doc_id, text, ...): doc_id, n_shingles, component_id, kept, class_id.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct k-word shingles (A-Z in lower
    case, words between ASCII white space; a text of fewer words is one shingle). class_id is the smallest doc_id with
    the same set, component_id the smallest reachable one, kept marks that document. Null, empty and blank texts have no
    shingle and link with nothing. Rows with a null doc_id are not linked: their component_id is null and they are kept.
    Repeated rows stay, each with the same values; texts under one doc_id count as one document. Other columns are ignored.
    Ids that are no whole numbers are taken in the order of their type; there every row is a document of its own, also without an id.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _numbered(spark, docs, k, percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(spark, docs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "signatures")
    classes = materialize(
        spark,
        base.filter("doc_id is not null and n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id")),
        "classes",
    )
    entries = (
        base.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select("doc_id", F.explode("bands").alias("bucket"))
    )
    buckets = entries.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first != last")
    pairs = entries.join(buckets, "bucket").filter("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    pairs = materialize(spark, pairs, "pairs")
    groups = _Graph(spark)
    groups.add(pairs, pairs.count())
    graph = _Graph(spark)
    if groups.count:
        member = groups._small(groups.labels.select(F.col("node").alias("doc_id"), F.col("label").alias("grp")), groups.count)
        sets = materialize(spark, docs.join(member, "doc_id").select("doc_id", "text", "grp").mapInArrow(_sets(k), "doc_id long, grp long, n long, items binary, sig binary"), "sets")
        sizes = sets.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("n") * 8).alias("bytes"))
        sizes = sizes.select("grp", "bytes", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).alias("blocks"))
        sizes = materialize(spark, sizes, "sizes")
        total, count = sizes.filter("blocks = 1").agg(F.sum("bytes"), F.count(F.lit(1))).first()
        bundles = max(1, -(-(total or 0) // BUNDLE_BYTES))
        # Small groups are bundled; a member of a large one goes to each pair of blocks that has its own.
        placed = sets.join(groups._small(sizes.select("grp", "blocks"), groups.count), "grp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
        other = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        alone = F.col("blocks") == 1
        keyed = other.select(
            F.when(alone, F.pmod(F.xxhash64("grp"), F.lit(bundles))).otherwise(F.col("grp")).alias("bundle"), alone.alias("alone"),
            F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "grp", "doc_id", "block", "items", "sig",
        )
        links = materialize(spark, keyed.groupBy("alone", "bundle", "i", "j").applyInPandas(_linked(percent), "a long, b long"), "links")
        graph.add(links, links.count())
        release(spark, sets, sizes, links, groups.labels)
    release(spark, pairs)

    named = graph.label(classes, "class_id", "label")
    some = F.col("n_shingles") > 0
    own = F.col("doc_id")
    return (
        base.drop("bands")
        .join(named, ["h1", "h2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(some & own.isNotNull(), F.col("label")).otherwise(own).alias("component_id"), F.when(some & own.isNotNull(), F.col("class_id")).otherwise(own).alias("class_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(own == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
    )


def _numbered(spark: SparkSession, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates of rows that get a number first; the numbers are written, so that they stay what they are."""
    rows = materialize(spark, docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id()), "numbered")
    got = near_duplicates(spark, rows.select(F.col("uid").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("uid"), "n_shingles", F.col("component_id").alias("c"), F.col("class_id").alias("e"))
    named = got.join(rows.select("uid", "doc_id"), "uid")
    smallest = lambda key, out: named.groupBy(key).agg(F.min("doc_id").alias(out))
    joined = named.join(smallest("c", "component_id"), "c").join(smallest("e", "class_id"), "e")
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "class_id")


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs` of each group of near-duplicates, that of the smallest doc_id; rows with a null doc_id all stay.

    Where rows share a doc_id, each is a document of its own, so that different texts all stay; of a group's rows with the smallest doc_id
    the one with the smallest hash of its text does.
    """
    named = docs.filter("doc_id is not null")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = near_duplicates(spark, docs, k, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
        one = named.join(kept, "doc_id", "left_semi")
    else:
        rows = materialize(spark, named.withColumn("_uid", F.monotonically_increasing_id()), "numbered")
        groups = near_duplicates(spark, rows.select(F.col("_uid").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("_uid"), F.col("component_id").alias("_group"))
        first = groups.join(rows.select("_uid", F.struct("doc_id", F.xxhash64("text"), "_uid").alias("_order")), "_uid").groupBy("_group").agg(F.min_by("_uid", "_order").alias("_uid"))
        one = rows.join(first.select("_uid"), "_uid", "left_semi").drop("_uid")
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
