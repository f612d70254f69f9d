"""A binary frame store of probability maps as a Python data source: spark.read.format("framestore").

All numbers are little endian. A store is the chunks of `MAGIC` in order: the header (u64 frames, u32 parts, u32 height, u32 width, f64
frame rate, f64 stride, u32 video height, u32 video width, u32 crop y, u32 crop x, the largest u32 for no crop), the part names (u16
length, UTF-8), a lookup (a u64 for each frame: its place in the data), optionally a skeleton (u32 count, pairs of u32 part numbers;
before or after the lookup), the data, and at the end a trailer with the store's length, by which it is found behind a video that it has
been appended to. A frame has a map for each part: u8 flags (1 sparse, 2 offsets), u64 length, and zlib-compressed columns: sparse
u64 n, u32 y, u32 x, f32 p[, f32 offset y, f32 offset x], dense f32 p[, offset y, offset x] row by row. A map is stored sparse if it
has a third of its cells or fewer.

Readers plan one partition for each range of frames and read that range of the lookup; filters on frame and p are pushed into them.
Writers encode frame after frame into a file for each task; the commit makes one store of them, as the format has it, and a job that
fails leaves nothing.
"""

from __future__ import annotations

import base64
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from trailmark.session import filesystem

# Fixed values of the format.
MAGIC = {"file": b"DLFS", "header": b"DLFH", "parts": b"DBPN", "lookup": b"FLUP", "skeleton": b"DSKL", "data": b"FDAT", "end": b"DLFE"}
_HEADER = struct.Struct("<QIIIddIIII")
NO_CROP = 2**32 - 1
SPARSE_SHARE = 3

SCHEMA = "frame long, part string, x long, y long, p double, ox double, oy double"
_ARROW = pa.schema([("frame", pa.int64()), ("part", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("p", pa.float64()), ("ox", pa.float64()), ("oy", pa.float64())])
FRAMES_A_PARTITION = 512


@dataclass
class Header:
    frames: int
    height: int
    width: int
    stride: float
    parts: list[str]
    fps: float = 30.0
    video_height: int = 0
    video_width: int = 0
    crop: tuple[int, int] | None = None  # y, x
    skeleton: list[tuple[int, int]] = field(default_factory=list)
    lookup: int = 0  # where the lookup and the data begin in the file
    data: int = 0


def encode(cells: np.ndarray, height: int, width: int, level: int) -> bytes:
    """cells: rows of x, y, p, ox, oy of one frame and part, in (y, x) order."""
    offsets = bool(np.any(cells[:, 3:]))
    y, x = cells[:, 1].astype(int), cells[:, 0].astype(int)
    planes = [cells[:, 2], *((cells[:, 4], cells[:, 3]) if offsets else ())]
    if len(cells) * SPARSE_SHARE <= height * width:
        raw = b"".join([struct.pack("<Q", len(cells)), y.astype("<u4").tobytes(), x.astype("<u4").tobytes(), *(v.astype("<f4").tobytes() for v in planes)])
    else:
        raw = b""
        for v in planes:
            dense = np.zeros((height, width), "<f4")
            dense[y, x] = v
            raw += dense.tobytes()
    flags = (len(cells) * SPARSE_SHARE <= height * width) | offsets << 1
    body = zlib.compress(raw, level)
    return struct.pack("<BQ", flags, len(body)) + body


def decode(data: bytes, at: int, height: int, width: int) -> tuple[np.ndarray, int]:
    """(rows of x, y, p, ox, oy; the position after the map)."""
    flags, size = struct.unpack_from("<BQ", data, at)
    raw = zlib.decompress(data[at + 9 : at + 9 + size])
    if flags & 1:
        n = struct.unpack_from("<Q", raw)[0]
        column = lambda i, kind: np.frombuffer(raw, kind, n, 8 + 4 * n * i).astype(float)
        y, x, p = column(0, "<u4"), column(1, "<u4"), column(2, "<f4")
        oy, ox = (column(3, "<f4"), column(4, "<f4")) if flags & 2 else (np.zeros(n), np.zeros(n))
    else:
        planes = np.frombuffer(raw, "<f4").reshape(-1, height, width).astype(float)
        y, x = np.nonzero(planes[0])
        p = planes[0][y, x]
        oy, ox = (planes[1][y, x], planes[2][y, x]) if flags & 2 else (np.zeros(len(x)), np.zeros(len(x)))
    return np.stack([x, y, p, ox, oy], 1), at + 9 + size


def parse_header(f, where: str = "the file") -> Header:
    """The header of a store in a binary file, whether it begins there or stands behind other content."""
    start = 0
    if f.read(4) != MAGIC["file"]:
        size = f.seek(0, io.SEEK_END)
        f.seek(max(0, size - 12))
        tail = f.read(12)
        if tail[:4] != MAGIC["end"] or struct.unpack("<Q", tail[4:])[0] > size - 12:
            raise ValueError(f"{where} is not a frame store")
        start = size - 12 - struct.unpack("<Q", tail[4:])[0]
        f.seek(start)
        if f.read(4) != MAGIC["file"]:
            raise ValueError(f"{where} is not a frame store")

    def expect(found: bytes, name: str) -> None:
        if found != MAGIC[name]:
            raise ValueError(f"{where}: no {name} chunk")

    expect(f.read(4), "header")
    frames, parts, height, width, fps, stride, video_height, video_width, crop_y, crop_x = _HEADER.unpack(f.read(_HEADER.size))
    expect(f.read(4), "parts")
    names = []
    for _ in range(parts):
        (n,) = struct.unpack("<H", f.read(2))
        names.append(f.read(n).decode())
    h = Header(frames, height, width, stride, names, fps, video_height, video_width, None if NO_CROP in (crop_y, crop_x) else (crop_y, crop_x))
    if h.crop and (crop_y + height * stride > video_height or crop_x + width * stride > video_width):
        raise ValueError(f"{where}: the crop box does not lie in the video")
    chunk = f.read(4)
    while chunk != MAGIC["data"]:
        if chunk == MAGIC["lookup"]:
            h.lookup = f.tell()
            f.seek(h.lookup + 8 * frames)
            chunk = f.read(4)
        elif chunk == MAGIC["skeleton"]:
            f.read(4)  # writers disagree on what is counted, so pairs are read up to the next chunk
            while (chunk := f.read(4)) not in (MAGIC["lookup"], MAGIC["data"], b""):
                h.skeleton.append(struct.unpack("<II", chunk + f.read(4)))
        else:
            raise ValueError(f"{where}: no data chunk")
    if not h.lookup:
        raise ValueError(f"{where}: no lookup chunk")
    h.data = f.tell()
    return h


def read_header(path: str) -> Header:
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        return parse_header(f, path)


def _frames(f, h: Header, start: int, end: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(frame, a table of cells for each part) of a range of frames; only its part of the lookup is read."""
    f.seek(h.lookup + 8 * start)
    places = np.frombuffer(f.read(8 * (end - start)), "<u8")
    for frame, place in zip(range(start, end), places.tolist(), strict=True):
        f.seek(h.data + place)
        maps = []
        for _ in h.parts:
            head = f.read(9)
            maps.append(decode(head + f.read(struct.unpack("<BQ", head)[1]), 0, h.height, h.width)[0])
        yield frame, maps


def batch(rows: list[tuple[int, str, np.ndarray]]) -> pa.RecordBatch:
    n = [len(a) for *_, a in rows]
    a = np.concatenate([a for *_, a in rows])
    part = pa.array([p for _, p, _ in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), n)))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat([f for f, *_ in rows], n)), part, *(pa.array(a[:, i].astype(np.int64)) for i in (0, 1)), *(pa.array(a[:, i]) for i in (2, 3, 4))], schema=_ARROW)


@dataclass
class Layout:
    """What a store's header says, and how its maps are written; `frames` None is as many as the cells have."""

    height: int
    width: int
    parts: list[str]
    stride: float = 8.0
    threshold: float = 1e-7
    level: int = 6
    frames: int | None = None
    fps: float = 30.0
    video: tuple[int, int] | None = None
    crop: tuple[int, int] | None = None
    skeleton: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, options) -> Layout:
        """From the options of a writer: lists and pairs are JSON."""
        for name in ("height", "width", "parts"):
            if name not in options:
                raise ValueError(f"a frame store needs the option {name}")
        kinds = {"height": int, "width": int, "level": int, "frames": int, "stride": float, "threshold": float, "fps": float}
        return cls(**{k: kinds.get(k, json.loads)(options[k]) for k in cls.__dataclass_fields__ if k in options})

    def options(self) -> dict[str, str]:
        return {k: v if isinstance(v, str) else json.dumps(v) for k, v in vars(self).items() if v is not None}

    def encoded(self, cells: np.ndarray) -> bytes:
        """A frame from rows of part number, x, y, p, ox, oy."""
        cells = cells[np.lexsort((cells[:, 1], cells[:, 2], cells[:, 0]))]
        cuts = np.searchsorted(cells[:, 0], np.arange(len(self.parts) + 1))
        return b"".join(encode(cells[i:j, 1:], self.height, self.width, self.level) for i, j in zip(cuts[:-1], cuts[1:], strict=True))

    def head(self, sizes: np.ndarray) -> bytes:
        """All before the data, for a store whose frames have these sizes."""
        video = self.video or (int(self.height * self.stride), int(self.width * self.stride))
        out = [MAGIC["file"], MAGIC["header"], _HEADER.pack(len(sizes), len(self.parts), self.height, self.width, self.fps, self.stride, *video, *(self.crop or (NO_CROP, NO_CROP)))]
        out += [MAGIC["parts"], *(struct.pack("<H", len(p.encode())) + p.encode() for p in self.parts), MAGIC["lookup"], (np.cumsum(sizes) - sizes).astype("<u8").tobytes()]
        if self.skeleton:
            out += [MAGIC["skeleton"], struct.pack("<I", len(self.skeleton)), *(struct.pack("<II", *pair) for pair in self.skeleton)]
        return b"".join([*out, MAGIC["data"]])


@dataclass
class Written(WriterCommitMessage):
    """A task's file with the numbers and sizes (64 bit) of the frames in it, in their order there."""

    file: str
    frames: bytes
    sizes: bytes


class Writer(DataSourceArrowWriter):
    """Tasks hold one frame at a time, so the rows of a frame have to follow each other in one partition; which frames a partition has,
    and in what order, is free. Long stretches of frames in order are copied at once by the commit."""

    def __init__(self, path: str, layout: Layout, overwrite: bool) -> None:
        fs, name = filesystem(path)
        if not overwrite and fs.get_file_info(name).type != pa.fs.FileType.NotFound:
            raise ValueError(f"{path} exists; a store is written as a whole, so nothing can be appended to it")
        self.path, self.layout = path, layout
        self.folder = f"{path}.{uuid.uuid4().hex}.tasks"
        fs.create_dir(f"{name}{self.folder.removeprefix(path)}")  # here, so that a task that outlives its job has no place to write to

    def _numbers(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(frames, rows of part number, x, y, p, ox, oy) of the cells above the threshold."""
        column = lambda c, default=np.nan: batch[c].cast(pa.float64(), safe=False).fill_null(default).to_numpy(zero_copy_only=False)
        frame = batch["frame"].cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        if len(frame) and (frame.min() < 0 or self.layout.frames is not None and frame.max() >= self.layout.frames):
            raise ValueError("cells in frames that the store does not have")
        part = pa.compute.index_in(batch["part"].cast(pa.string()), value_set=pa.array(self.layout.parts, pa.string())).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        p = column("p")
        offsets = [column(c, 0.0) if c in batch.schema.names else np.zeros(len(p)) for c in ("ox", "oy")]
        keep = p > self.layout.threshold
        rows = np.stack([part, column("x"), column("y"), p, *offsets], 1)[keep]
        _, x, y = rows[:, :3].T
        if not ((x >= 0) & (x < self.layout.width) & (y >= 0) & (y < self.layout.height) & ~np.isnan(rows[:, 0])).all():
            raise ValueError("cells of no part or beyond the map")
        return frame[keep], rows

    def _by_frame(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        last, held = None, []
        for batch in batches:
            frame, rows = self._numbers(batch)
            cuts = [0, *(np.flatnonzero(np.diff(frame)) + 1).tolist(), len(frame)] if len(frame) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and frame[i] != last:
                    yield last, np.concatenate(held)
                    held = []
                last = int(frame[i])
                held.append(rows[i:j])
        if held:
            yield last, np.concatenate(held)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.folder)
        name = f"{folder}/{uuid.uuid4().hex}"
        frames, sizes = [], []
        with fs.open_output_stream(name, compression=None) as out:
            for frame, rows in self._by_frame(iterator):
                made = self.layout.encoded(rows)
                out.write(made)
                frames.append(frame)
                sizes.append(len(made))
        return Written(name, np.array(frames, np.int64).tobytes(), np.array(sizes, np.int64).tobytes())

    def commit(self, messages: list[Written | None]) -> None:
        """Join the tasks' files; frames without cells get empty maps. The store appears whole, by renaming."""
        messages = [m for m in messages if m is not None]
        numbers = lambda data: np.frombuffer(data, np.int64)
        frames, sizes = (np.concatenate([np.zeros(0, np.int64), *(numbers(getattr(m, k)) for m in messages)]) for k in ("frames", "sizes"))
        source = np.repeat(np.arange(len(messages)), [len(m.frames) // 8 for m in messages])
        starts = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(numbers(m.sizes)) - numbers(m.sizes) for m in messages)])
        order = np.argsort(frames, kind="stable")
        frames, sizes, source, starts = frames[order], sizes[order], source[order], starts[order]
        if len(frames) and not np.diff(frames).all():
            raise ValueError("rows of a frame are not together; sort them by frame within partitions that have whole frames")
        n = self.layout.frames if self.layout.frames is not None else int(frames[-1]) + 1 if len(frames) else 0
        empty = self.layout.encoded(np.zeros((0, 6)))
        every = np.full(n, len(empty), np.int64)
        every[frames] = sizes
        head = self.layout.head(every)
        breaks = (np.diff(source) != 0) | (np.diff(frames) != 1) | (starts[1:] != starts[:-1] + sizes[:-1])
        ends = [*(np.flatnonzero(breaks) + 1).tolist(), len(frames)] if len(frames) else []
        fs, name = filesystem(self.path)
        made = f"{filesystem(self.folder)[1]}/store"
        done = 0
        with fs.open_output_stream(made, compression=None) as out:

            def fill(until: int) -> None:
                for a in range(done, until, 4096):
                    out.write(empty * (min(until, a + 4096) - a))

            out.write(head)
            for i, j in zip([0, *ends][: len(ends)], ends, strict=True):
                fill(int(frames[i]))
                with fs.open_input_file(messages[source[i]].file) as f:
                    f.seek(int(starts[i]))
                    left = int(sizes[i:j].sum())
                    while left:
                        data = f.read(min(left, 8 << 20))
                        if not data:
                            raise OSError(f"{messages[source[i]].file} is shorter than its task has said")
                        out.write(data)
                        left -= len(data)
                done = int(frames[j - 1]) + 1
            fill(n)
            out.write(MAGIC["end"] + struct.pack("<Q", len(head) + int(every.sum())))
        fs.move(made, name)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what tasks have written, those that were given up among them."""
        fs, folder = filesystem(self.folder)
        for _ in range(5):  # a task that is being killed may add its file meanwhile
            try:
                fs.delete_dir(folder)
            except FileNotFoundError:
                return
            except OSError:
                continue


def write(cells: DataFrame, path: str, height: int, width: int, stride: float = 8.0, threshold: float = 1e-7, level: int = 6, frames: int | None = None, fps: float = 30.0,
          video: tuple[int, int] | None = None, crop: tuple[int, int] | None = None, parts: list[str] | None = None, skeleton: list[tuple[int, int]] = ()) -> None:
    """Write cells (frame, part, x, y, p[, ox, oy]) above the threshold, in any order.

    Blocks of frames are shuffled to the tasks of `Writer`. `video` is the size (height, width) of the video, that of the maps in pixels
    by default; `parts` are all parts by name by default; cells of no part, beyond the map or in frames below 0 or from `frames` on are
    an error. Without `frames` the last frame is the last one with a cell above the threshold.
    """
    from pyspark.sql import functions as F

    cells.sparkSession.dataSource.register(FrameStore)
    names = parts if parts is not None else sorted(r["part"] for r in cells.select(F.col("part").cast("string")).distinct().dropna().collect())
    layout = Layout(height, width, names, stride, threshold, level, frames, fps, video, crop, list(skeleton))
    kept = cells.select(*(c for c in ("frame", "part", "x", "y", "p", "ox", "oy") if c in cells.columns))
    together = kept.repartition(F.floor(F.col("frame") / FRAMES_A_PARTITION)).sortWithinPartitions("frame")
    together.write.format("framestore").mode("overwrite").options(**layout.options()).save(path)


@dataclass
class Range(InputPartition):
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.low, self.high, self.least = path, 0, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("frame",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                v = int(f.value)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    end = v + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif name == ("p",) and isinstance(f, GreaterThan):
                self.least = f.value if self.least is None else max(self.least, f.value)
            else:
                yield f

    def partitions(self):
        h = read_header(self.path)
        end = h.frames if self.high is None else min(h.frames, self.high)
        return [Range(a, min(end, a + FRAMES_A_PARTITION)) for a in range(self.low, end, FRAMES_A_PARTITION)] or [Range(0, 0)]

    def read(self, partition: Range):
        """Arrow batches of some ten thousand cells."""
        fs, name = filesystem(self.path)
        with fs.open_input_file(name) as f:
            h = parse_header(f, self.path)
            rows, held = [], 0
            for frame, maps in _frames(f, h, partition.start, partition.end):
                for part, a in zip(h.parts, maps, strict=True):
                    a = a if self.least is None else a[a[:, 2] > self.least]
                    if len(a):
                        rows.append((frame, part, a))
                        held += len(a)
                if held > 20_000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


class FrameStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framestore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        """cells.write.format("framestore").options(**Layout(...).options()).mode(...).save(path), once the class is registered."""
        if missing := {"frame", "part", "x", "y", "p"} - set(schema.fieldNames()):
            raise ValueError(f"cells without {sorted(missing)}")
        return Writer(self.options["path"], Layout.of(self.options), overwrite)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a store; a store appended to a video is found by its trailer."""
    spark.dataSource.register(FrameStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("framestore").load(path)


def append_to(store: str, video: str) -> None:
    """Put a store behind the content of another file, from which it can be read as before."""
    fs, name = filesystem(store)
    to, video_name = filesystem(video)
    made = f"{video_name}.{uuid.uuid4().hex}.tmp"
    with to.open_output_stream(made, compression=None) as out:
        for source, path in ((to, video_name), (fs, name)):
            with source.open_input_stream(path, compression=None) as f:
                while data := f.read(8 << 20):
                    out.write(data)
    to.move(made, video_name)


def pack(path: str) -> str:
    """A store as text."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        return base64.b64encode(f.read()).decode()


def unpack(text: str, path: str) -> None:
    fs, name = filesystem(path)
    with fs.open_output_stream(name, compression=None) as f:
        f.write(base64.b64decode(text))


def packed(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text: stores as text, a row each; paths may be folders or patterns. A store of 2 GB or more does not fit into a row."""
    from pyspark.sql import functions as F

    return spark.read.format("binaryFile").load(list(paths)).select("path", F.translate(F.base64("content"), "\r\n", "").alias("text"))


def packed_cells(stores: DataFrame, chunk: int = FRAMES_A_PARTITION) -> DataFrame:
    """path and the cells of stores (path, text), decoded `chunk` frames at a time; a null text has none."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                for b in unpacked(text.as_py(), chunk) if text.is_valid else ():
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path.as_py(), pa.string()), b.num_rows), *b.columns], names=["path", *b.schema.names])

    return stores.select("path", "text").mapInArrow(cells_of, f"path string, {SCHEMA}")


def unpacked(text: str, chunk: int | None = None) -> Iterator[pa.RecordBatch]:
    """The cells of a store given as text, a batch for all frames or for each `chunk` frames."""
    f = io.BytesIO(base64.b64decode(text))
    h = parse_header(f)
    step = chunk or max(1, h.frames)
    for a in range(0, h.frames, step):
        yield batch([(frame, part, cells) for frame, maps in _frames(f, h, a, min(h.frames, a + step)) for part, cells in zip(h.parts, maps, strict=True)])
