"""Ranked lexical search with range-maximum tables over posting lists.

The documents are mapped to postings of the query terms (term, frequency, length), which are written once; counts of documents
and terms follow from them. Then each task indexes its documents a block at a time: a posting list for each term in document order with the
impact of each posting, and over all lists a sparse table of the places of range maxima, which answers the largest impact of any
range of a list in two look-ups.

A query searches intervals of a block's documents, those of the highest bound first. An interval's bound is the sum over the query's
terms of the range maxima of its lists. The interval is split at the document of its largest term maximum: that document is scored in
full, and the intervals to its left and right get bounds of their own. Intervals whose bound can't reach the score of a query's
last hit so far are dropped, equal ones when all of their documents come after that hit. The hits go with the task from block to
block, so later blocks begin with a high limit. Many intervals of many queries are split at once, so all of it is array work.

A task gives its best hits of each query, as many as are asked for; the best of all follow in two levels. Queries are taken in
blocks of distinct texts of bounded size, of which one at a time is broadcast.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm import texthash as th
from trailmark.llm.blocks import text_blocks
from trailmark.session import materialize

TOP = 10
BLOCK_CHARS = 4 << 20
#: A block of the index ends at so many postings; a search step splits a quarter of a query's intervals, so many at least.
POSTINGS, STEP = 1 << 19, 8
SALTS = 32
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_SEPARATOR[128:] = False


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, A-Z in lower case, and the first of each text."""
    buf, offs = th.text_buffers(column)
    starts, ends, first = th.word_spans(buf, offs, _SEPARATOR)
    return th.word_hashes(buf, starts, ends), first


class Queries:
    """The terms of a block of query texts: sorted hashes, and (term, repeats) of each query one after the other."""

    def __init__(self, texts: list[str]) -> None:
        h, first = _hashed(pa.array(texts, pa.string()))
        self.keys = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        self.hashes = np.unique(h)
        query = np.repeat(np.arange(len(texts)), np.diff(first))
        both, self.repeats = np.unique(query * max(1, len(self.hashes)) + np.searchsorted(self.hashes, h), return_counts=True)
        self.query, self.term = both // max(1, len(self.hashes)), both % max(1, len(self.hashes))


def _postings(shared):
    """doc_id, n (all terms of the document), terms and tfs (the query terms in it and how often)."""

    def run(batches):
        hashes = shared.value
        for batch in batches:
            for part in th.slices(batch):
                h, first = _hashed(part.column(1))
                at = np.searchsorted(hashes, h)
                at[at == len(hashes)] = 0
                here = np.flatnonzero(hashes[at] == h) if len(hashes) else np.zeros(0, np.int64)
                row = np.searchsorted(first, here, "right") - 1
                both, tf = np.unique(row * max(1, len(hashes)) + at[here], return_counts=True)
                offs = pa.array(np.searchsorted(both, np.arange(part.num_rows + 1) * max(1, len(hashes))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int64))) for x in (both % max(1, len(hashes)), tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


class Index:
    """Posting lists of a block of documents with a sparse table of range maxima."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, terms: int) -> None:
        order = np.argsort(term * docs + doc)
        self.docs, self.doc, self.impact = docs, doc[order], impact[order]
        self.key = term[order] * docs + self.doc
        self.bounds = np.searchsorted(self.key, np.arange(terms + 1) * docs)
        longest = int(np.diff(self.bounds).max()) if terms else 0
        self.table = [np.arange(len(doc), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            below, half = self.table[-1], 1 << (len(self.table) - 1)
            left, right = below[: len(below) - half], below[half:]
            self.table.append(np.where(self.impact[right] > self.impact[left], right, left))
        self.log = np.zeros(longest + 2, np.int8)
        for j in range(1, len(self.table)):
            self.log[1 << j :] = j

    def maximum(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the largest impact among the postings a..b-1 of a list (not empty)."""
        out = np.empty(len(a), np.int64)
        level = self.log[b - a]
        for j in np.unique(level).tolist():
            here = np.flatnonzero(level == j)
            left, right = self.table[j][a[here]], self.table[j][b[here] - (1 << j)]
            out[here] = np.where(self.impact[right] > self.impact[left], right, left)
        return out


class Intervals:
    """Intervals of documents of queries: owner, low, high, bound, split; and for each its entries (term, repeats, a, b), the ranges of lists in it."""

    def __init__(self, index: Index, owner, low, high, part, term, repeats, a, b) -> None:
        some = b > a
        part, self.term, self.repeats, self.a, self.b = part[some], term[some], repeats[some], a[some], b[some]
        kept, begin = np.unique(part, return_index=True)  # entries are in the order of their intervals
        self.owner, self.low, self.high = owner[kept], low[kept], high[kept]
        self.size = np.diff(np.append(begin, len(part)))
        best = index.maximum(self.a, self.b)
        value = index.impact[best] * self.repeats
        self.bound = np.add.reduceat(value, begin) if len(begin) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(value, begin) if len(begin) else self.bound
        largest = np.flatnonzero(value == np.repeat(top, self.size))
        of = np.repeat(np.arange(len(kept)), self.size)[largest]
        self.split = index.doc[best[largest[np.unique(of, return_index=True)[1]]]]

    def take(self, which: np.ndarray) -> Intervals:
        """Those of the positions `which`, in ascending order."""
        out = object.__new__(Intervals)
        out.owner, out.low, out.high, out.size, out.bound, out.split = (x[which] for x in (self.owner, self.low, self.high, self.size, self.bound, self.split))
        entry = np.repeat((np.cumsum(self.size) - self.size)[which] - (np.cumsum(out.size) - out.size), out.size) + np.arange(int(out.size.sum()))
        out.term, out.repeats, out.a, out.b = (x[entry] for x in (self.term, self.repeats, self.a, self.b))
        return out

    def plus(self, *others: Intervals) -> Intervals:
        out = object.__new__(Intervals)
        for name in ("owner", "low", "high", "size", "bound", "split", "term", "repeats", "a", "b"):
            setattr(out, name, np.concatenate([getattr(x, name) for x in (self, *others)]))
        return out


def search(index: Index, queries: Queries, limit: np.ndarray, place: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, document, score) of the hits above 0 in the block, `top` of each query at least if there are so many.

    Query q wants scores above limit[q], or equal ones of documents before place[q].
    """
    n = len(queries.keys)
    a, b = index.bounds[queries.term], index.bounds[queries.term + 1]
    every = np.arange(n)
    alive = Intervals(index, every, np.zeros(n, np.int64), np.full(n, index.docs), queries.query, queries.term, queries.repeats, a, b)
    hits = [np.zeros(0, np.int64) for _ in range(3)]
    limit, place = limit.copy(), place.copy()
    while True:
        wanted = (alive.bound > limit[alive.owner]) | ((alive.bound == limit[alive.owner]) & (alive.low < place[alive.owner]))
        if not wanted.all():
            alive = alive.take(np.flatnonzero(wanted))
        if not len(alive.owner):
            return tuple(hits)
        order = np.lexsort((-alive.bound, alive.owner))
        begin = np.searchsorted(alive.owner[order], every)
        share = np.maximum(STEP, np.bincount(alive.owner, minlength=n) // 4)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - begin[alive.owner[order]]
        chosen = rank < share[alive.owner]
        now, alive = alive.take(np.flatnonzero(chosen)), alive.take(np.flatnonzero(~chosen))
        part = np.repeat(np.arange(len(now.owner)), now.size)
        # Where the document of the split stands, or would stand, in each list.
        at = np.searchsorted(index.key, now.term * index.docs + now.split[part])
        inside = np.minimum(at, len(index.doc) - 1)
        hit = (at < now.b) & (index.doc[inside] == now.split[part])
        begin = np.cumsum(now.size) - now.size
        score = np.add.reduceat(np.where(hit, index.impact[inside] * now.repeats, 0), begin)
        good = np.flatnonzero((score > 0) & ((score > limit[now.owner]) | ((score == limit[now.owner]) & (now.split < place[now.owner]))))
        if len(good):
            q, d, s = (np.concatenate([old, new[good]]) for old, new in zip(hits, (now.owner, now.split, score), strict=True))
            order = np.lexsort((d, -s, q))
            q, d, s = q[order], d[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, every)[q]
            hits = [x[rank < top] for x in (q, d, s)]
            full = rank == top - 1  # the last hit of a query that has enough
            limit[q[full]], place[q[full]] = s[full], d[full]
        left = Intervals(index, now.owner, now.low, now.split, part, now.term, now.repeats, now.a, at)
        right = Intervals(index, now.owner, now.split + 1, now.high, part, now.term, now.repeats, at + hit, now.b)
        alive = alive.plus(left, right)


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A posting's share of a document's score, in whole numbers."""
    m = 25 + 75 * n * documents // max(1, terms)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _best(shared, top: int, kind: str):
    """The `top` hits of each query among a task's documents: key, doc_id, score."""

    def run(batches):
        queries, weight, documents, terms = shared.value
        n, best, buffered, held = len(queries.keys), None, [], 0

        def block(best):
            rows = pa.Table.from_batches(buffered).combine_chunks()
            rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending")], null_placement="at_end"))  # documents in the order of ties
            lists = rows["terms"].combine_chunks()
            doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            term, tf = lists.flatten().to_numpy(), rows["tfs"].combine_chunks().flatten().to_numpy()
            index = Index(doc, term, impacts(tf, rows["n"].to_numpy()[doc], weight[term], documents, terms), len(lists), len(weight))
            limit, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if best is not None:
                q, s = best["query"].to_numpy(), best["score"].to_numpy()
                last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q] == top - 1)
                limit[q[last]] = s[last]
                # A document goes before an equal hit if its id is smaller: the number of the block's ids below that of the last hit.
                ids = pa.concat_arrays([rows["doc_id"].combine_chunks(), best["doc_id"].combine_chunks().take(pa.array(last))])
                rank = pa.compute.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="min").to_numpy()
                place[q[last]] = np.searchsorted(rank[: len(lists)], rank[len(lists) :])
            q, d, s = search(index, queries, limit, place, top)
            found = pa.table({"query": q, "doc_id": rows["doc_id"].combine_chunks().take(pa.array(d)), "score": s})
            both = pa.concat_tables([best, found]) if best is not None else found
            both = both.take(pa.compute.sort_indices(both, [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")).combine_chunks()
            q = both["query"].to_numpy()
            return both.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q] < top)).combine_chunks()

        for batch in batches:
            a, ends = 0, np.cumsum(np.asarray(batch.column(2).value_lengths())) if batch.num_rows else []
            while a < batch.num_rows:
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + POSTINGS - held, "right")))
                buffered.append(batch.slice(a, b - a))
                held += int(ends[b - 1]) - done
                a = b
                if held >= POSTINGS or a < batch.num_rows:
                    best, buffered, held = block(best), [], 0
        if buffered:
            best = block(best)
        if best is not None and best.num_rows:
            keys = pa.array(queries.keys, pa.string()).take(best["query"].combine_chunks())
            yield from pa.table({"key": keys, "doc_id": best["doc_id"], "score": best["score"]}).to_batches()

    return run


def ranked(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The `top` documents of `docs` (doc_id, text) for each row of `items` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and anything beyond ASCII, A-Z in lower case. A document's score is the sum over
    the item's terms, repeats included, of w * ((10**9 * tf) div (1000 * tf + 8 * m)) with m = 25 + (75 * n * N) div L and
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); only scores above 0 count, equal ones go by ascending doc_id, null ids last.
    Null and empty texts have no term: such documents are not counted and never found, such items find nothing. Each repeated row is a document of its
    own, repeated items have the same rows each. Ids may be of any type that has an order; other columns are ignored. An empty
    table on either side gives no row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = []
    for texts, _ in text_blocks(items, block_chars):
        queries = Queries(texts)
        schema = f"doc_id {kind}, n long, terms array<long>, tfs array<long>"
        mapped = materialize(spark, docs.mapInArrow(_postings(spark.sparkContext.broadcast(queries.hashes)), schema), "postings")
        documents, terms = mapped.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(len(queries.hashes), np.int64)
        for term, df in mapped.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row a query term at most
            frequency[term] = df
        weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * frequency + 1))).astype(np.int64)
        shared = spark.sparkContext.broadcast((queries, weight, documents, terms))
        some = mapped.filter(F.size("terms") > 0)
        out.append(materialize(spark, some.mapInArrow(_best(shared, top, kind), f"key string, doc_id {kind}, score long"), "hits"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    hits = reduce(DataFrame.unionByName, out).withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    for keys in (["key", "salt"], ["key"]):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    named = items.select("item_id", F.md5(F.col("text").cast("string").cast("binary")).alias("key")).filter("key is not null")
    return hits.join(named, "key").select("item_id", "rank", "doc_id", "score")


def oracle_sql(top: int = TOP) -> str:
    """DuckDB SQL with the rows of `ranked` for the tables documents and benchmark."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, {words} AS ws FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, uid, len(ws)::BIGINT AS n, ws FROM d WHERE len(ws) > 0),
stats AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM counted),
tf AS (SELECT uid, term, count(*)::BIGINT AS tf FROM (SELECT uid, unnest(ws) AS term FROM counted) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT item_id, unnest({words}) AS term FROM benchmark WHERE text IS NOT NULL),
scored AS (
  SELECT q.item_id, c.doc_id, c.uid, sum(floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * df.df + 1)))::BIGINT
    * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * c.n * s.docs) // s.terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN counted c USING (uid), stats s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= {top}"""
