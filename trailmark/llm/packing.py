"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents in hash order, a long document being several packets of `PACKET` tokens. In every round
a queue's deficit grows by its quantum, its share of a window's tokens, and packets leave its head as long as they fit into the
deficit; what remains is carried into the next round. Windows of 4096 tokens are cut from what leaves, so a document is cut at
window ends and between packets only, and after any number of rounds each queue has had its share to within a packet.
Without target weights the shares are those of the queues' tokens, so all queues end together and only the last window is partly
filled; with weights, a queue that ends leaves its share to the others.

Since a deficit starts at 0 and its queue is never empty before its end, the packet that ends at token e of its queue leaves in
the first round r with r * quantum >= e, whatever the other queues hold. So the rounds, and with them the deficits that go from
window to window and from partition to partition, are a prefix sum in each queue, and the places of all packets are one over
(round, queue, token). Both are taken in two levels, of which the upper one has a row for some thousands of the lower one; no
task needs a whole queue. Token ids are written once and shuffled once, to meet the places of their packets.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import string
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm import texthash as th
from trailmark.session import materialize

WINDOW = 4096
END = 2
PACKET = 1024
BUCKET = 512
#: Rows of the lower level of a prefix sum for one of the upper level; rounds whose packets are put in order by one task.
SPAN, ROUNDS = 4096, 256
#: Up to so many queues (counted) are broadcast; beyond, only those with a thousandth of all documents are.
SMALL = 100_000
#: Words are kept in two generations of about so many bytes.
CACHE_BYTES = 64 << 20
_LATIN = re.compile(r"[a-zß-öø-ı\u0133-ňŋ-ž]+")
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0D]] = True
_OTHER = np.ones(256, bool)
_OTHER[[ord(c) for c in string.ascii_letters]] = False
_WORD = ~_OTHER
_WORD[[ord(c) for c in string.digits]] = True
_tokenizers: dict = {}


def _whole(c: str) -> bool:
    """Whether a character is a letter or digit and stays one, or several, in normal form and lower case, by old and new tables of Unicode."""
    return all(db.category(x)[0] in "LN" for x in unicodedata.normalize("NFC", c).lower() for db in (unicodedata, unicodedata.ucd_3_2_0))


@functools.cache
def _wholes() -> np.ndarray:
    """For each number of a character below 65536, `_whole`."""
    return np.array([not 0xD800 <= i < 0xE000 and _whole(chr(i)) for i in range(1 << 16)])


def _plain(file: dict) -> tuple:
    """(a tokenizer for words of lower-case Latin letters with a space between them, whether words are put in lower case first, the suffix of tokens
    that end a word), or (None, False, "") where the file has steps that may do anything else to such words."""
    from tokenizers import Tokenizer

    steps = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    before, cut, model = steps(file["normalizer"], "normalizers"), steps(file["pre_tokenizer"], "pretokenizers"), file["model"]
    white = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    split = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    bytes_ = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    usual = all(x == white or x["type"] in ("NFC", "Lowercase") for x in before) and cut == [split, bytes_] and model["type"] == "BPE" and model["end_of_word_suffix"] and not model["dropout"]
    if not usual or any(x["content"].strip().isalpha() for x in file["added_tokens"]):
        return None, False, ""
    short = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_]}
    tokenizer = Tokenizer.from_str(json.dumps(file | {"normalizer": None, "pre_tokenizer": short}))
    return tokenizer, any(x["type"] == "Lowercase" for x in before), model["end_of_word_suffix"]


class CachedTokenizer:
    """Token ids of texts by a `tokenizers` file whose pieces never span white space; equal words are encoded once.

    Texts are cut at spaces, tabs and line ends, and where a letter or digit is followed by ASCII punctuation other than
    an apostrophe, or what follows a letter in an added token; there such tokenizers always begin a new piece. The cuts are found on the
    bytes of an Arrow column, whose equal pieces Arrow tells apart from others; only different pieces become Python objects.
    Pieces not met before are encoded many to a string and told apart by the tokens' offsets; pieces of Latin letters only by the
    tokens that end a word, and, where the file has the usual steps (`_plain`), without its normaliser and patterns, which leave such
    pieces whole. Where such a file puts texts in lower case, pieces of ASCII letters are so before equal ones are sought. Tokenizers of
    another kind (spanning=True) encode whole texts.
    """

    def __init__(self, path: str, spanning: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are all in use
        from tokenizers import Tokenizer

        self.tokenizer, self.spanning = Tokenizer.from_file(path), spanning
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        file = json.loads(self.tokenizer.to_str())
        self.plain, self.lower, suffix = _plain(file)
        if self.plain:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        inner = {b for x in file["added_tokens"] for a, b in itertools.pairwise(x["content"]) if a.isalnum()}
        self.marks = np.zeros(256, bool)
        self.marks[[ord(c) for c in string.punctuation if c != "'" and c not in inner]] = True
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _keep(self, words: list[bytes], ids: list[bytes]) -> None:
        self.cache.update(zip(words, ids, strict=True))
        self.held += sum(map(len, words)) + sum(map(len, ids)) + 200 * len(words)

    def _learn(self, words: list[bytes]) -> None:
        width = np.dtype(self.dtype).itemsize
        texts = [w.decode() for w in words]
        latin = [bool(self.plain and _LATIN.fullmatch(t.lower() if self.lower else t)) for t in texts]
        plain = list(itertools.compress(zip(words, texts, strict=True), latin))
        for a in range(0, len(plain), 2048):
            part, text = zip(*plain[a : a + 2048], strict=True)
            text = " ".join(text)
            ids = np.array(self.plain.encode_batch_fast([text.lower() if self.lower else text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            raw = ids.tobytes()
            self._keep(part, [raw[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)])
        others = [(w, t) for w, t, x in zip(words, texts, latin, strict=True) if not x]
        for a in range(0, len(others), 512):
            part, text = zip(*others[a : a + 512], strict=True)
            e = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
            lengths = np.fromiter(map(len, text), np.int64, len(text)) + 1
            begins = np.array([o[0] for o in e.offsets], np.int64)
            cuts = (np.searchsorted(begins, np.concatenate([[0], np.cumsum(lengths)])) * width).tolist()
            raw = np.array(e.ids, self.dtype).tobytes()
            self._keep(part, [raw[i:j] for i, j in itertools.pairwise(cuts)])

    def _pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(all pieces of some texts, the first of each text and their number)."""
        inside = ~_WHITE[buf]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edges = offs[:-1][offs[:-1] < len(buf)]
        begin[edges] = inside[edges]
        marks = self.marks[buf[1:]]
        begin[1:] |= marks & _WORD[buf[:-1]]
        at = np.flatnonzero(marks & (buf[:-1] >= 128)) + 1
        x, y, z = (np.where(at >= i, buf[at - i], 0).astype(np.int64) for i in (1, 2, 3))
        number = np.where((y >= 0xC2) & (y < 0xE0), (y & 31) << 6 | (x & 63), np.where((y < 0xC0) & (y >= 0x80) & (z >= 0xE0) & (z < 0xF0), (z & 15) << 12 | (y & 63) << 6 | (x & 63), 0))
        begin[at[_wholes()[number]]] = True
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begin[1:]
        starts = np.flatnonzero(begin)
        to = np.zeros(len(starts) + 1, np.int64)
        lengths = np.flatnonzero(last) + 1 - starts
        np.cumsum(lengths, out=to[1:])
        data = buf[inside]
        if self.lower and len(starts):
            data |= np.repeat(~np.logical_or.reduceat(_OTHER[data], to[:-1]), lengths).view(np.uint8) << 5
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(data)])
        return pieces, np.searchsorted(starts, offs)

    def encode(self, column: pa.Array, tail: bytes = b"") -> tuple[np.ndarray, pa.Buffer]:
        """(where each text's ids begin, and the end; the bytes of all ids): each text has its ids and `tail`."""
        if self.spanning:
            raw = [np.array(e.ids, self.dtype).tobytes() + tail for e in self.tokenizer.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            return np.cumsum([0, *map(len, raw)]), pa.py_buffer(b"".join(raw))
        buf, offs = th.text_buffers(column)
        pieces, first = self._pieces(buf, offs)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.held > CACHE_BYTES:
            self.old, self.cache, self.held = self.cache, {}, 0
        new = [w for w in words if w not in self.cache]
        again = [w for w in new if w in self.old]
        self._keep(again, [self.old[w] for w in again])
        self._learn([w for w in new if w not in self.old])
        values = pa.array([*map(self.cache.__getitem__, words), tail], pa.large_binary())
        all_ids = values.take(pa.array(np.insert(coded.indices.to_numpy(), first[1:], len(words))))
        _, to, data = all_ids.buffers()
        to = np.frombuffer(to, np.int64)[all_ids.offset :]
        return to[first + np.arange(len(first))], data or pa.py_buffer(b"")

    def ids(self, texts: list[str]) -> list[bytes]:
        to, data = self.encode(pa.array(texts, pa.large_string()))
        raw = data.to_pybytes()
        return [raw[a:b] for a, b in itertools.pairwise(to.tolist())]


def tokenizer(path: str, spanning: bool = False) -> CachedTokenizer:
    """This worker's tokenizer for a file."""
    if (path, spanning) not in _tokenizers:
        _tokenizers[path, spanning] = CachedTokenizer(path, spanning)
    return _tokenizers[path, spanning]


def _before(sums: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """`sums` (a row for each `by` and `order`, a long) with `before`: the sum of `value` over the rows before, in two levels."""
    one = [F.lit(0).alias("_one")] if not by else []
    keyed = sums.select("*", F.floor(F.col(order) / SPAN).alias("_block"), *one)
    by = by or ["_one"]
    earlier = lambda keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    blocks = keyed.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    bases = blocks.select(*by, "_block", F.coalesce(F.sum("_sum").over(earlier(by, "_block")), F.lit(0)).alias("_base"))
    inside = keyed.withColumn("_in", F.coalesce(F.sum(value).over(earlier([*by, "_block"], order)), F.lit(0)))
    return inside.join(bases, [*by, "_block"]).withColumn("before", F.col("_in") + F.col("_base")).drop("_in", "_base", "_block", "_one")


def _queues(counted: DataFrame, target: dict[str, float] | None, window: int) -> DataFrame:
    """queue, docs, buckets, and base, up, down: a packet that ends at token e of the queue leaves in round base + ceil(e * up / down).

    The shares are those of the queues' tokens; with `target`, its weights (whole millionths), and queues without one come after all others.
    """
    d = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else F.lit(c).cast("decimal(19,0)")
    weights = {k: round(v * 10**6) for k, v in (target or {}).items() if round(v * 10**6) > 0}
    weight = F.lit(0)
    for k, v in weights.items():
        weight = F.when(F.col("queue") == k, v).otherwise(weight)
    df = counted.withColumn("weight", weight.cast("long"))
    rest = df.filter("weight = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("rest"))
    some = sum(weights.values())
    last = df.agg(F.coalesce(F.max(F.when(F.col("weight") > 0, F.ceil(F.col("tokens") * float(some) / (F.col("weight") * window)) + 1)), F.lit(0)).alias("last"))
    free = F.col("weight") == 0
    return df.join(F.broadcast(rest)).join(F.broadcast(last)).select(
        "queue", "docs", F.greatest(F.ceil(F.col("docs") / BUCKET), F.lit(1)).alias("buckets"), F.when(free, F.col("last")).otherwise(0).alias("base"),
        F.when(free, d("rest")).otherwise(d(some)).alias("up"), F.when(free, d("tokens") * d(window)).otherwise(d("weight") * d(window)).cast("decimal(28,0)").alias("down"),
    )


def _with_queues(rows: DataFrame, queues: DataFrame, count: int) -> DataFrame:
    """`rows` with the columns of their queue; a queue may have most of the rows."""
    if count <= SMALL:
        return rows.join(F.broadcast(queues), "queue")
    total = queues.agg(F.sum("docs")).first()[0]
    hot = queues.filter(F.col("docs") * 1000 >= total)  # a thousand at most
    cold = queues.filter(F.col("docs") * 1000 < total)
    return rows.join(F.broadcast(hot), "queue").unionByName(rows.join(F.broadcast(hot.select("queue")), "queue", "left_anti").join(cold, "queue"))


def places(rows: DataFrame, queues: DataFrame, count: int, packet: int = PACKET) -> DataFrame:
    """uid, at: the packets (start, length, place) of each document of `rows` (uid, queue, n, mixed), `place` in the order of service."""
    keyed = _with_queues(rows, queues, count).withColumn("bucket", F.pmod("mixed", "buckets"))
    order = Window.partitionBy("queue", "bucket").orderBy("mixed", "n", "uid").rowsBetween(Window.unboundedPreceding, 0)
    bases = _before(keyed.groupBy("queue", "bucket").agg(F.sum("n").alias("tokens")), ["queue"], "bucket", "tokens").select("queue", "bucket", "before")
    placed = keyed.withColumn("upto", F.sum("n").over(order)).join(bases, ["queue", "bucket"])
    start = F.col("k") * packet
    packets = (
        placed.select("uid", "queue", "n", "base", "up", "down", (F.col("before") + F.col("upto") - F.col("n")).alias("head"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / packet))).alias("k"))
        .select("uid", "queue", "base", "up", "down", start.alias("start"), F.least(F.lit(packet), F.col("n") - start).alias("length"), (F.col("head") + F.least(F.col("n"), start + packet)).alias("e"))
        .withColumn("round", F.col("base") + F.expr("(CAST(e AS DECIMAL(19,0)) * up + down - 1) div down"))
        .select("uid", "queue", "start", "length", "e", "round", F.floor(F.col("round") / ROUNDS).alias("some"))
    )
    served = Window.partitionBy("some").orderBy("round", "queue", "e").rowsBetween(Window.unboundedPreceding, -1)
    sums = _before(packets.groupBy("some").agg(F.sum("length").alias("tokens")), [], "some", "tokens").select("some", "before")
    at = packets.withColumn("_in", F.coalesce(F.sum("length").over(served), F.lit(0))).join(sums, "some")
    return at.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "length", (F.col("before") + F.col("_in")).alias("place")))).alias("at"))


def cut(at: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(row, start, length, place) of the pieces of documents whose packets are given: neighbours joined, cut at window ends."""
    flat = at.flatten()
    start, length, place = (flat.field(i).to_numpy() for i in range(3))
    row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + length[:-1])
    heads = np.flatnonzero(first)
    row, start, place, length = row[heads], start[heads], place[heads], np.add.reduceat(length, heads) if len(heads) else length
    windows = (place + length - 1) // window - place // window + 1
    n = np.repeat(np.arange(len(row)), windows)
    k = place[n] // window + np.arange(len(n)) - np.repeat(np.cumsum(windows) - windows, windows)
    low, high = np.maximum(place[n], k * window), np.minimum(place[n] + length[n], (k + 1) * window)
    return row[n], start[n] + low - place[n], high - low, low


def pack(spark: SparkSession, docs: DataFrame, path: str, window: int = WINDOW, end: int = END, target: dict[str, float] | None = None, spanning: bool = False, packet: int = PACKET) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    `docs` has doc_id (of any type), text, source; null text counts as empty (one token, `end`), null source is the source ''. A
    document is its ids (add_special_tokens=False) and `end`; each id lies in exactly one piece, a sequence has `window` ids but for
    the last one. `target` gives sources relative weights (others have none and come last). Repeated rows are packed each.
    Other columns are ignored; without rows there is no piece.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def tokenize(batches):
        t = tokenizer(path, spanning)
        tail = np.array([end], t.dtype).tobytes()
        width = np.dtype(t.dtype).itemsize
        for batch in batches:
            for part in th.slices(batch, "text"):
                to, data = t.encode(part.column(2), tail)
                ids = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(to), data]).cast(pa.binary())
                raw = memoryview(data)
                crc = [zlib.crc32(raw[a:b]) for a, b in itertools.pairwise(to.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(np.diff(to) // width), pa.array(crc, pa.int64()), ids],
                    names=["doc_id", "queue", "n", "crc", "ids"],
                )

    tokens = docs.mapInArrow(tokenize, f"doc_id {kind}, queue string, n long, crc long, ids binary")
    stored = materialize(spark, tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    counted = materialize(spark, stored.groupBy("queue").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")), "queues")
    rows = stored.select("uid", "queue", "n", F.xxhash64("doc_id", "n", "crc", "uid").alias("mixed"))
    at = places(rows, _queues(counted, target, window), counted.count(), packet)

    def pieces(batches):
        dtype = tokenizer(path, spanning).dtype
        for batch in batches:
            for part in th.slices(batch, "ids", most=4 << 20):
                row, start, length, place = cut(part.column(4), window)
                _, offsets, data = part.column(3).buffers()
                offsets = np.frombuffer(offsets, np.int32)[part.column(3).offset :][: part.num_rows + 1] // np.dtype(dtype).itemsize
                raw = memoryview(np.frombuffer(data, dtype)[offsets[0] : offsets[-1]].astype("<u4")).cast("B")
                low = 4 * (offsets[row] - offsets[0] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
                picked = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(picked), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), part.column(2).take(picked), pa.array(place // window), pa.array(place % window), part.column(1).take(picked)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
                )

    met = stored.select("uid", "doc_id", "queue", "n", "ids").join(at.hint("shuffle_hash"), "uid").select("doc_id", "queue", "n", "ids", "at")
    return met.mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
