"""SentencePiece encoding and decoding by a prefix table of last tokens.

A model of the merge type puts together the pair of neighbouring symbols whose concatenation scores best, the leftmost of equals, until
no neighbouring pair is a piece. Merges inside a token's span happen in the order in which they do in that span alone, so a
sequence of tokens is what the merges of a text give exactly if each token alone gives itself and no two neighbours would have
merged across their border first. That is the pair test: the merges of both tokens are replayed, best score first, and
the pair fails as soon as the best merge to do next is the one across.

So every prefix of a text has exactly one last token: of the pieces that an automaton finds to end there, the one that is
compatible with the last token of the prefix before it. The table of last tokens is filled from left to right with a bounded number of
tests at each place, and the ids are read from it backwards from the text's end.

Where no piece of the vocabulary has two neighbouring characters, as a letter followed by a full stop or by a space, no merge
can cross. Texts are cut there, and the table is made once for equal chunks that a worker has met before; a chunk may
have any length. Characters that are no piece become their UTF-8 bytes.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import texthash as th

SPACE = "▁"
END = 2
#: Approximate bytes of known chunks, and number of known pairs, at which a worker begins anew; longer chunks are not kept.
CACHE_BYTES, CACHE_PAIRS, KEEP = 64 << 20, 1 << 18, 64
#: Characters of a text that are cut into chunks at a time.
SEGMENT = 1 << 20
_models: dict = {}


class Pieces:
    """The vocabulary of a model file of the merge type without user-defined pieces, with byte pieces for unknown characters."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        text = [self.sp.id_to_piece(i) for i in range(n)]
        self.control = np.array([self.sp.is_control(i) for i in range(n)])
        self.byte = np.array([self.sp.is_byte(i) for i in range(n)])
        self.unknown = np.array([self.sp.is_unknown(i) for i in range(n)])
        self.ids = {text[i]: i for i in range(n) if not (self.control[i] or self.byte[i] or self.unknown[i])}
        self.score = {p: -self.sp.get_score(i) for p, i in self.ids.items()}  # the best merge has the smallest number
        self.byte_ids = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.names: list[str] = []  # tokens by number: the pieces, and unknown characters as they are met
        self.number: dict[str, int] = {}
        self.out: list[bytes] = []  # a token's ids
        self.spines: list[tuple[list, list]] = []
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.held = 0
        self.automaton = None  # made for the first text, so that a worker that decodes only does without
        decoded = [b"" if self.control[i] else bytes([int(text[i][1:-1], 16)]) if self.byte[i] else " ⁇ ".encode() if self.unknown[i] else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.lengths = np.array([len(b) for b in decoded], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.spaced = np.array([t.startswith(SPACE) and not c for t, c in zip(text, self.control, strict=True)])

    def ready(self) -> None:
        """Make the automaton of the pieces and the list of each one's merges."""
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            alone, left, right = self._alone(p)
            if alone:  # others are no result of merging
                self._token(p, left, right)
                self.automaton.add_word(p, (len(p), self.number[p]))
        self.automaton.make_automaton()
        self.cut = _cut(self.ids)

    def _token(self, p: str, left: list, right: list) -> int:
        self.number[p] = len(self.names)
        self.names.append(p)
        self.out.append(np.array([self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode()], np.int32).tobytes())
        self.spines.append((left, right))
        return self.number[p]

    def _alone(self, p: str):
        """Whether merging the characters of p gives p; its merges as (score, symbol at the left end, symbol at the right end) from both sides."""
        symbols, left, right = list(p), [], []
        while len(symbols) > 1:
            best = min(((self.score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return False, left, right
            s, i = best
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            left.append((s, symbols[0]))
            right.append((s, symbols[-1]))
        return True, left, right

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens end before one across their border is the best."""
        merges, others = self.spines[a][1], self.spines[b][0]
        u, v = self.names[a][-1], self.names[b][0]
        i = j = 0
        while True:
            across = self.score.get(u + v)
            ours = merges[i][0] if i < len(merges) else None
            theirs = others[j][0] if j < len(others) else None
            # Of equal scores the leftmost place comes first: inside a, across, inside b.
            if across is not None and (ours is None or across < ours) and (theirs is None or across <= theirs):
                return False
            if ours is not None and (theirs is None or ours <= theirs):
                u = merges[i][1]
                i += 1
            elif theirs is not None:
                v = others[j][1]
                j += 1
            else:
                return True

    def tokens(self, chunk: str) -> list[int]:
        """The tokens of a chunk, by the last token of each of its prefixes."""
        last: list[int | None] = [None] * (len(chunk) + 1)
        pairs, names = self.pairs, self.names

        def single(end: int) -> int:
            """The last character alone, where no piece is the last token."""
            c = chunk[end - 1]
            last[end] = self.number[c] if c in self.number else self._token(c, [], [])
            return last[end]

        for at, (length, token) in self.automaton.iter(chunk):
            end = at + 1
            if last[end] is not None:
                continue
            begin = end - length
            if begin:
                before = last[begin]
                if before is None:
                    before = single(begin)
                key = before << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(before, token)
                if not fits:
                    continue
            last[end] = token
        found, end = [], len(chunk)
        while end:
            token = last[end]
            if token is None:
                token = single(end)
            found.append(token)
            end -= len(names[token])
        found.reverse()
        return found

    def _chunk(self, chunk: str) -> bytes:
        ids = b"".join([self.out[t] for t in self.tokens(chunk)])
        if len(chunk) <= KEEP:
            self.chunks[chunk] = ids
            self.held += 160 + len(chunk) + len(ids)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, without an end id, as 32-bit integers."""
        if self.automaton is None:
            self.ready()
        if self.held > CACHE_BYTES:
            self.chunks, self.held = {}, 0
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs = {}
        out, get = [], self.chunks.get
        for segment in _segments(self.sp.normalize(text)):
            chunks = self.cut.findall(segment)
            known = list(map(get, chunks))
            if None in known:
                known = [get(c) or self._chunk(c) if k is None else k for c, k in zip(chunks, known, strict=True)]
            out.append(b"".join(known))
        return b"".join(out)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str] | pa.Array:
        """The texts of rows of ids; row i has ids[offs[i]:offs[i + 1]]."""
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        lengths, begins = self.lengths[ids], self.offsets[ids]
        some = np.flatnonzero(~self.control[ids])
        first = some[np.unique(row[some], return_index=True)[1]]
        first = first[self.spaced[ids[first]]]  # the space before a text's first piece is no part of the text
        lengths[first] -= 1
        begins[first] += 1
        ends = np.cumsum(lengths)
        raw = self.bytes[np.repeat(begins - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[offs]
        parted = self.control[ids[:-1]] & self.byte[ids[1:]]  # bytes before and after a control id are no character together
        starts = bounds[:-1][bounds[:-1] < len(raw)]
        try:
            raw.tobytes().decode()
            whole = not parted.any() and not ((raw[starts] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
        return pa.array([self._repaired(ids[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.large_string())

    def _repaired(self, ids: np.ndarray) -> str:
        """decode of one row in which bytes may be no UTF-8: each such byte becomes a replacement character."""
        out, run, fresh = [], bytearray(), True
        for i in [*ids.tolist(), None]:
            if i is not None and self.byte[i]:
                run += self.bytes[self.offsets[i] : self.offsets[i] + 1].tobytes()
                fresh = False
                continue
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
            run.clear()
            if i is None or self.control[i]:
                continue
            piece = self.bytes[self.offsets[i] : self.offsets[i] + self.lengths[i]].tobytes().decode()
            out.append(piece[1:] if fresh and self.spaced[i] else piece)
            fresh = False
        return "".join(out)


def _cut(pieces) -> re.Pattern:
    """A pattern of chunks: spaces, then marks, then all else; no piece has a character that ends a chunk before one that begins it."""
    before: dict[str, set[str]] = {}
    for p in pieces:
        for a, b in zip(p, p[1:], strict=False):
            before.setdefault(b, set()).add(a)
    if before.get(SPACE, set()) - {SPACE}:
        return re.compile(r"(?s).+")  # pieces span words
    marks = {c for c in map(chr, range(128)) if not c.isalnum()}  # a class of ASCII characters is quick to match
    while True:
        crossed = {c for c in marks if before.get(c, set()) - marks - {SPACE}}
        if not crossed:
            break
        marks -= crossed
    some = re.escape("".join(sorted(marks)))
    return re.compile(f"{SPACE}+[{some}]*[^{SPACE}{some}]*|[{some}]+[^{SPACE}{some}]*|[^{SPACE}{some}]+") if marks else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


_BORDER = re.compile(f"[^{SPACE}](?={SPACE})")


def _segments(text: str):
    """A long text in parts, cut where a space follows another character."""
    at = 0
    while len(text) - at > SEGMENT:
        border = _BORDER.search(text, at + SEGMENT - 1)
        if border is None:
            break
        yield text[at : border.end()]
        at = border.end()
    yield text[at:] if at else text


def model(path: str) -> Pieces:
    """This worker's vocabulary of a model file."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, path: str, column: str = "text", out: str = "ids", end: int | None = END) -> DataFrame:
    """`docs` with the ids of `column` as array<int>, followed by `end` unless that is None; the text column goes.

    The ids are those of the sentencepiece library without sampling. A null text counts as empty. Rows are only mapped: repeated rows and other columns
    are carried as they are (one called like `out` is replaced), and an empty table gives an empty one.
    """
    kept = docs.select(*[c for c in docs.columns if c not in (column, out)], F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column))
    tail = b"" if end is None else np.array([end], np.int32).tobytes()

    def run(batches):
        pieces = model(path)
        for batch in batches:
            for part in th.slices(batch, column, most=2 << 20):
                ids = [pieces.encode(t) + tail for t in part.column(part.num_columns - 1).to_pylist()]
                offs = np.cumsum([0] + [len(b) // 4 for b in ids]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], arrays], names=[*part.schema.names[:-1], out])

    schema = kept.drop(column).withColumn(out, F.lit(None).cast("array<int>")).schema
    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the text of the ids in `column`, as the library's decode gives it; control ids have no text.

    Null ids count as none and null elements are left out. Ids outside the vocabulary are an error. Other columns are carried as they are (one called like `out` is replaced).
    """
    kept = rows.select(*[c for c in rows.columns if c != out])

    def run(batches):
        pieces = model(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            texts = []
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            a = 0
            while a < batch.num_rows:  # some rows at a time, whose bytes are bounded unless one row is longer
                b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), 1 << 20, "right")) + a)
                part = lists.slice(a, b - a)
                ids = part.flatten()
                lengths = sizes[a:b]
                if ids.null_count:
                    row = np.repeat(np.arange(b - a), lengths)[np.asarray(ids.is_valid())]
                    lengths, ids = np.bincount(row, minlength=b - a), ids.drop_null()
                ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(pieces.lengths)):
                    raise ValueError("an id outside the vocabulary")
                texts.append(pieces.decode(ids, np.concatenate([[0], np.cumsum(lengths)])))
                a = b
            arr = pa.concat_arrays(texts) if texts else pa.array([], pa.large_string())
            yield pa.RecordBatch.from_arrays([*batch.columns, arr.cast(pa.string())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, kept.withColumn(out, F.lit("")).schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of `docs` (doc_id, text), encoded and decoded again."""
    both = decode(encode(docs.select("doc_id", "text"), path), path)
    written = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
