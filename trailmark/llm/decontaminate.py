"""Benchmark decontamination by greedy string tiling.

Word 5-grams shared with a benchmark item are the seeds that pair a document with it. Each pair is tiled: running
Karp-Rabin over the unmarked parts finds the longest common runs of words, which are marked in both, longest first, never
overlapping, down to runs of five words. The share of the item's words under tiles does not depend on their order, so
passages that were cut and moved about are caught as well. An item of fewer than five words has one seed, all of its words, and
counts where these stand consecutively.

Two bounds, which lose nothing, keep frequent seeds cheap: an item that is covered has so many seed places in the text that one
of its rarest is among them, so only these bring up the item; and the words under all shared seeds must reach the threshold
before anything is tiled. The distinct texts of the benchmark are taken in blocks of about `BLOCK_CHARS` characters at most:
a block's seeds are broadcast, all documents are mapped, the result is written, and only then comes the next block.
Documents are only mapped, never shuffled.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import texthash as th
from trailmark.session import materialize

SEED = 5
COVERED = 0.5
BLOCK_CHARS = 16 << 20
PAIRS = 1 << 20
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_SEPARATOR[128:] = False


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII letters and digits, and everything beyond ASCII) in lower case, and the first of each text."""
    buf, offs = th.text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, first = th.word_spans(buf, offs, _SEPARATOR)
    return th.word_hashes(buf, starts, ends), first


def _windows(words: np.ndarray, marked: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, Karp-Rabin hashes) of the windows of s words without a marked one."""
    n = len(words) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(marked)])
    free = np.flatnonzero(taken[s:] == taken[:-s])
    rolling = np.zeros(n, np.uint64)
    base = 1
    for i in range(s):
        rolling += words[i : n + i] * np.uint64(base)
        base = base * th.PRIME & th.MASK
    return free, rolling[free]


def _matches(item: np.ndarray, text: np.ndarray, mi: np.ndarray, mt: np.ndarray, s: int):
    """(length, start in item, start in text) of the unmarked common runs of s words or more that can't be extended to the left.

    Windows of the text are sorted by (hash, word before), so that for a window of the item those with another word before are two
    slices: runs that are part of one a word earlier are never listed, however often words repeat.
    """
    at, ht = _windows(text, mt, s)
    ai, hi = _windows(item, mi, s)
    if not len(at) or not len(ai):
        return
    _, key = np.unique(np.concatenate([hi, ht]), return_inverse=True)
    before = lambda words, marked, x: np.where((x > 0) & ~marked[x - 1], words[x - 1], 0)
    bounded = lambda marked, x: (x == 0) | marked[x - 1]
    _, word = np.unique(np.concatenate([before(item, mi, ai), before(text, mt, at)]), return_inverse=True)
    word[: len(ai)] = np.where(bounded(mi, ai), -1, word[: len(ai)])  # a boundary is another word than any, also on the other side
    word[len(ai) :] = np.where(bounded(mt, at), -2, word[len(ai) :])
    both = key.astype(np.int64) * (len(word) + 3) + word + 2
    order = np.argsort(both[len(ai) :], kind="stable")
    at, keys, full = at[order], key[len(ai) :][order], both[len(ai) :][order]
    low, high = np.searchsorted(keys, key[: len(ai)], "left"), np.searchsorted(keys, key[: len(ai)], "right")
    skip, upto = np.searchsorted(full, both[: len(ai)], "left"), np.searchsorted(full, both[: len(ai)], "right")
    for i, begins, ends in ((ai, low, skip), (ai, upto, high)):
        n = ends - begins
        cum = np.cumsum(n)
        a = 0
        while a < len(i):  # so many item windows at a time that their pairs fit into a bounded array
            b = max(a + 1, int(np.searchsorted(cum, (cum[a - 1] if a else 0) + PAIRS, "right")))
            many = n[a:b]
            for low_, high_ in [(0, int(many.sum()))] if b > a + 1 or many[0] <= PAIRS else [(x, min(int(many[0]), x + PAIRS)) for x in range(0, int(many[0]), PAIRS)]:
                which = np.repeat(np.arange(a, b), many)[low_:high_] if b > a + 1 else np.full(high_ - low_, a)
                place = np.arange(low_, high_) - np.repeat(np.cumsum(many) - many, many)[low_:high_] if b > a + 1 else np.arange(low_, high_)
                x, y = i[which], at[begins[which] + place]
                yield _extended(item, text, mi, mt, x, y, s)
            a = b


def _extended(item, text, mi, mt, x, y, s: int):
    """Lengths of the runs that begin at x and y; pairs whose first s words differ for all their equal hash are left out."""
    length, going = np.zeros(len(x), np.int64), np.arange(len(x))
    k = 0
    while len(going):
        i, j = x[going] + k, y[going] + k
        inside = (i < len(item)) & (j < len(text))
        going, i, j = going[inside], i[inside], j[inside]
        same = (item[i] == text[j]) & ~mi[i] & ~mt[j]
        going = going[same]
        k += 1
        length[going] = k
    keep = length >= s
    return length[keep], x[keep], y[keep]


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in item, start in text, length) of each tile."""
    mi, mt = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out: list[tuple[int, int, int]] = []
    s = max(least, min(20, len(item)))
    while True:
        parts = list(_matches(item, text, mi, mt, s))
        k, i, j = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(3))
        longest = int(k.max()) if len(k) else 0
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for x in np.lexsort((j, i, -k)).tolist():
            n, a, b = int(k[x]), int(i[x]), int(j[x])
            if mi[a : a + n].any() or mt[b : b + n].any():
                again = True  # what is left of it may still be a tile of this length
                continue
            mi[a : a + n] = mt[b : b + n] = True
            out.append((a, b, n))
        if mi.all() or mt.all():
            return out
        if again and longest:
            continue
        if s == least:
            return out
        s = max(least, s // 2)


class Items:
    """The distinct texts of a block of the benchmark, with the seeds that bring them up in a sorted array."""

    def __init__(self, keys: list[str], texts: list[str], covered: float = COVERED) -> None:
        words, first = _words(pa.array(texts, pa.string()))
        self.keys, self.words, self.grams, self.k, self.need, self.covered = [], [], [], [], [], covered
        for key, a, b in zip(keys, first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                k = min(SEED, b - a)
                self.keys.append(key)
                self.words.append(words[a:b])
                self.k.append(k)
                self.grams.append(th.fold(words[a:b], k))
                self.need.append(covered * (b - a) if b - a >= SEED else float(b - a))
        every, count = np.unique(np.concatenate(self.grams), return_counts=True) if self.grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        seeds, owners = [], []
        for o, (g, k, need) in enumerate(zip(self.grams, self.k, self.need, strict=True)):
            # A tile of n words holds n - k + 1 seed places, so a covered item has need / k of them: all but so many less one bring it up.
            spare = max(0, int(np.ceil(need / k)) - 1)
            rarest = np.argsort(count[np.searchsorted(every, g)], kind="stable")[: max(1, len(g) - spare)]
            seeds.append(np.unique(g[rarest]))
            owners.append(np.full(len(seeds[-1]), o))
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(seed, kind="stable")
        self.owner = owner[order]
        self.seeds, self.first = np.unique(seed[order], return_index=True)
        self.last = np.append(self.first[1:], len(seed))
        self.lengths = sorted(set(self.k))

    def hits(self, words: np.ndarray, first: np.ndarray):
        """(text, its words, items that may be covered) by text; `first` has where each text's words begin and end."""
        pairs = []
        shared = {k: th.fold(words, k) for k in self.lengths}
        for k, grams in shared.items():
            if not len(grams) or not len(self.seeds):
                continue
            where = np.searchsorted(self.seeds, grams)
            where[where == len(self.seeds)] = 0
            places = np.flatnonzero(self.seeds[where] == grams)
            texts = np.searchsorted(first, places, "right") - 1
            inside = places + k <= first[texts + 1]
            found = np.unique(texts[inside] * len(self.seeds) + where[places[inside]])
            texts, seeds = found // len(self.seeds), found % len(self.seeds)
            n = self.last[seeds] - self.first[seeds]
            owners = self.owner[np.repeat(self.first[seeds] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pairs.append(np.unique(np.repeat(texts, n) * len(self.keys) + owners))
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        for t in np.unique(found // max(1, len(self.keys))).tolist():
            a, b = int(first[t]), int(first[t + 1])
            own = {k: np.sort(g[a : max(a, b - k + 1)]) for k, g in shared.items()}
            mine = found[np.searchsorted(found, t * len(self.keys)) : np.searchsorted(found, (t + 1) * len(self.keys))] % len(self.keys)
            yield t, words[a:b], [o for o in mine.tolist() if self._reachable(o, own[self.k[o]])]

    def _reachable(self, o: int, grams: np.ndarray) -> bool:
        """Whether the words of item o under seeds of the text reach the threshold."""
        g, k = self.grams[o], self.k[o]
        at = np.minimum(np.searchsorted(grams, g), max(0, len(grams) - 1))
        here = np.flatnonzero(grams[at] == g) if len(grams) else np.zeros(0, np.int64)
        edges = np.zeros(len(g) + k, np.int64)
        np.add.at(edges, here, 1)
        np.add.at(edges, here + k, -1)
        return int((np.cumsum(edges) > 0).sum()) >= self.need[o]

    def covered_by(self, o: int, text: np.ndarray) -> tuple[int, int] | None:
        """(words of item o under tiles, number of tiles), if they are enough."""
        found = tiles(self.words[o], text, self.k[o])
        under = sum(n for *_, n in found)
        return (under, len(found)) if under >= self.need[o] else None


def _scan(shared):
    def run(batches):
        items = shared.value
        for batch in batches:
            for part in th.slices(batch):
                words, first = _words(part.column(1))
                rows = []
                for t, text, some in items.hits(words, first):
                    for o in some:
                        if got := items.covered_by(o, text):
                            rows.append((t, items.keys[o], got[0], len(items.words[o]), got[1], got[0] / len(items.words[o])))
                if rows:
                    t, *rest = zip(*rows, strict=True)
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(t)), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))],
                        names=["doc_id", "key", "covered_words", "item_words", "n_tiles", "coverage"],
                    )

    return run


def _clean(shared, at: int):
    """Keeps the rows of which no item is covered."""

    def run(batches):
        items = shared.value
        for batch in batches:
            for part in th.slices(batch):
                words, first = _words(part.column(at))
                leaked = {t for t, text, some in items.hits(words, first) if any(items.covered_by(o, text) for o in some)}
                yield part.filter(pa.array([i not in leaked for i in range(part.num_rows)], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, covered: float, block_chars: int):
    """The distinct texts of the benchmark as Items of about `block_chars` characters at most, one block at a time.

    Texts are hashed to sixteen slots a block, whose sizes are counted; neighbouring slots are put together up to `block_chars`.
    """
    texts = benchmark.select(F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    slots = 16 * max(1, -(-(texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // block_chars))
    slot = F.pmod(F.xxhash64("text"), F.lit(slots))
    blocks, held = [[]], 0
    for r in texts.groupBy(slot.alias("slot")).agg(F.sum(F.length("text") + 1).alias("c")).orderBy("slot").collect():
        if blocks[-1] and held + r["c"] > block_chars:
            blocks.append([])
            held = 0
        blocks[-1].append(r["slot"])
        held += r["c"]
    for b in blocks:
        part = texts.filter((slot >= b[0]) & (slot <= b[-1])).orderBy("text").collect() if b else []
        yield Items([hashlib.md5(r["text"].encode()).hexdigest() for r in part], [r["text"] for r in part], covered), b is blocks[-1]


def without_leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` (text and any other columns) that `contaminated` would not list; nothing is shuffled.

    Between two blocks of the benchmark what is left is written to the workspace. Null and empty texts stay, repeated rows too.
    """
    spark = docs.sparkSession
    for items, last in _blocks(benchmark, covered, block_chars):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(items), docs.columns.index("text")), docs.schema)
        docs = docs if last else materialize(spark, docs, "clean")
    return docs


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and benchmark item with `covered` of the item's words under tiles, at least.

    `docs` has doc_id and text, `benchmark` item_id and text, ids of any type; columns doc_id, item_id, covered_words, item_words,
    n_tiles, coverage. Items of fewer than five words count if all their words stand consecutively. Null and empty texts and items
    match nothing. A null doc_id or item_id is carried as it is; repeated rows and items give a row each. An empty benchmark or no
    documents give no row. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key string, covered_words long, item_words long, n_tiles long, coverage double"
    out = []
    for items, last in _blocks(benchmark, covered, block_chars):
        found = docs.mapInArrow(_scan(spark.sparkContext.broadcast(items)), schema)
        out.append(found if last else materialize(spark, found, "found"))
    named = benchmark.select("item_id", F.md5(F.col("text").cast("string").cast("binary")).alias("key")).filter("key is not null")
    return reduce(DataFrame.unionByName, out).join(named, "key").select("doc_id", "item_id", "covered_words", "item_words", "n_tiles", "coverage")
