"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A record is a row: page_id, warc_type, record_id, refers_to, target_uri, date, content_type, headers (the WARC header as text),
block (bytes). Responses are built from pages, or read from WARC files; each yields one `metadata` and one `conversion`
record that carry its id in WARC-Refers-To, its URI and date, and the digests of its payload. Ids are version 5
UUIDs of content, so that a repeated task writes the same records. Everything maps over rows; nothing is shuffled. Markup is
read in one pass whose time grows with the page's length, whatever tags, quotes or comments it leaves open.

Null and empty pages give records with an empty payload; a null url leaves out the URI; repeated rows give the same records again,
other columns are ignored, empty tables give none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import filesystem

SCHEMA = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, headers string, block binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("5f2d7d0e-6c1b-5d0f-9f6e-0a8c6a1c2b3d")
_OPENING = re.compile(r"<!--|<(script|style|template|noscript|title)\b", re.I)
_CLOSING = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "noscript", "title")}
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>")
_ANCHOR = re.compile(r"<a\b([^>]*)>", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _split(page: str) -> tuple[str, str]:
    """The page up to its last `>`, where every tag has its end ahead (so that looking for it can't fail again and again), and the rest."""
    at = page.rfind(">") + 1
    return page[:at], page[at:]


def _visible(page: str) -> tuple[str, str | None]:
    """The page without comments, scripts, styles, templates and titles, and its first title; one pass, whatever is left open."""
    out, at, title, last = [], 0, None, page.rfind(">")
    for_sure = len(page)
    while m := _OPENING.search(page, at):
        kind = (m[1] or "").lower()
        if not kind:
            end = page.find("-->", m.end())
            out.append(page[at : m.start()])
            at = for_sure if end < 0 else end + 3
        elif m.end() > last:
            break  # no tag ends any more, and a comment could only be open
        else:
            begin = page.find(">", m.end()) + 1
            end = _CLOSING[kind].search(page, begin)
            out.append(page[at : m.start()])
            if kind == "title" and title is None and end:
                title = page[begin : end.start()]
            at = end.end() if end else for_sure
        out.append("\n")
    rest = page[at:]
    if (open_ := rest.find("<!--")) >= 0:
        rest = rest[:open_]
    return "".join([*out, rest]), title


def plain_text(page: str) -> str:
    """The text of a page, a line for each block, without scripts, styles, comments and markup."""
    return _lines(_visible(page)[0])


def _lines(visible: str) -> str:
    tagged, rest = _split(visible)
    lines = (" ".join(html.unescape(x).split()) for x in (_TAG.sub("", _BREAK.sub("\n", tagged)) + rest).split("\n"))
    return "\n".join(x for x in lines if x)


def outlinks(page: str) -> list[str]:
    """The targets of the page's anchors, in order."""
    found = (_HREF.search(m[1]) for m in _ANCHOR.finditer(_split(page)[0]))
    return [html.unescape(m[1] or m[2] or m[3] or "") for m in found if m]


def _header(fields: list[tuple[str, str | None]]) -> str:
    clean = ((k, re.sub(r"[\r\n]+", " ", v)) for k, v in fields if v is not None)
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean)


def record(page_id: int | None, kind: str, uri: str | None, date: str, content_type: str, block: bytes, payload_digest: str, refers_to: str | None = None, extra: list[tuple[str, str | None]] = ()) -> tuple:
    rid = f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {page_id} {uri} {date} {sha1(block)} {refers_to}')}>"
    head = _header([
        ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers_to),
        ("WARC-Block-Digest", sha1(block)), ("WARC-Payload-Digest", payload_digest), *extra, ("Content-Type", content_type), ("Content-Length", str(len(block))),
    ])
    return page_id, kind, rid, refers_to, uri, date, content_type, sha1(block), payload_digest, head, block


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> tuple:
    body = (page or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return record(page_id, "response", url, date, "application/http; msgtype=response", head + body, sha1(body))


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, body) of a response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if v], body


def derivatives(source: tuple) -> list[tuple]:
    """The metadata and the conversion record of a response."""
    page_id, _, rid, _, uri, date, *_ = source
    status, fields, body = split_http(source[NAMES.index("block")])
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    charset = (re.search(r"charset=\"?([\w.:-]+)", kind, re.I) or ["", "utf-8"])[1]
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    digest = source[NAMES.index("payload_digest")]
    visible, title = _visible(page)
    text = _lines(visible).encode()
    links = outlinks(page)
    meta = [("status", status), *((f"http-{k.lower()}", v) for k, v in fields), ("source-length", str(len(body))), ("source-digest", digest),
            ("text-length", str(len(text))), ("text-digest", sha1(text)), ("title", None if title is None else " ".join(html.unescape(title).split())), ("outlinks", str(len(links))), *(("outlink", x) for x in links)]
    block = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in meta if v is not None).encode()
    same = [("WARC-Source-Payload-Digest", digest), ("WARC-Source-Block-Digest", source[NAMES.index("block_digest")])]
    return [
        record(page_id, "metadata", uri, date, "application/warc-fields", block, sha1(block), rid, same),
        record(page_id, "conversion", uri, date, "text/plain; charset=utf-8", text, sha1(text), rid, same),
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 9, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


def _mapped(make):
    """make: values of a row -> records; in batches of some megabytes."""

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                for new in make(*(c[i].as_py() for c in batch.columns)):
                    rows.append(new)
                    held += len(new[-1])
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record for each page (page_id, url, html); a null html is an empty body, a null url leaves out the URI."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_mapped(lambda i, u, h: [response(i, u, h, date)]), SCHEMA)


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response among the records; other records give none.

    Pages without text give an empty conversion record. Repeated responses give the same records again.
    """
    return records.select(*NAMES).mapInArrow(_mapped(lambda *r: derivatives(r) if r[1] == "response" and r[-1] is not None else []), SCHEMA)


def page_derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """derive(responses(pages)) in one pass over the pages."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_mapped(lambda i, u, h: derivatives(response(i, u, h, date))), SCHEMA)


# -- files -------------------------------------------------------------------------------------------------------------


def member(row) -> bytes:
    """A record as a gzip member of a WARC file."""
    return gzip.compress(row["headers"].encode() + b"\r\n" + row["block"] + b"\r\n\r\n", mtime=0)


def write(records: DataFrame, folder: str) -> None:
    """A .warc.gz file for each partition, in a folder of a file system that all workers reach (a path or a URI that pyarrow knows, as of
    HDFS or S3); a file appears whole, by renaming, or not at all."""

    def put(rows):
        from pyspark import TaskContext

        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        made = f"{name}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(made, compression=None) as f:
            for row in rows:
                f.write(member(row))
        fs.move(made, name)

    records.select("headers", "block").foreachPartition(put)


_SIZE = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)


class _Members(io.RawIOBase):
    """What the gzip members of a stream hold; `damaged` once there is one that can't be read, up to which all is given."""

    def __init__(self, source) -> None:
        self.source, self.inflate, self.rest, self.held, self.damaged = source, zlib.decompressobj(31), b"", b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        while not self.held:
            if not self.rest:
                self.rest = self.source.read(1 << 14)
            if not self.rest:
                self.damaged |= self.begun
                return 0
            try:
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                    if not self.rest.strip(b"\0"):
                        self.rest = b""  # padding
                        continue
                self.held, self.rest = self.inflate.decompress(self.rest, 1 << 20), self.inflate.unconsumed_tail or self.inflate.unused_data
                self.begun = not self.inflate.eof
            except zlib.error:
                self.damaged = True
                return 0
        n = min(len(to), len(self.held))
        to[:n], self.held = self.held[:n], self.held[n:]
        return n

    begun = False


def parse(stream):
    """(header text, block, problem) of each record of a WARC file, gzipped by member or plain, read from a binary stream.

    A record without a Content-Length has an empty block and the problem `no Content-Length`, lines that belong to no record are
    `no record`; either way reading goes on at the next line that begins a record. A block that the file ends in is given as far
    as it goes, with the problem `cut short`, or `damaged gzip` where a member can't be read any further.
    """
    source = io.BufferedReader(stream) if not hasattr(stream, "peek") else stream
    members = _Members(source) if source.peek(2)[:2] == b"\x1f\x8b" else None
    data = io.BufferedReader(members, 1 << 18) if members else source
    line, problem = data.readline(1 << 16), None
    while line:
        if not line.strip(b"\r\n"):
            line = data.readline(1 << 16)
            continue
        problem, head, block = None, [line], b""
        if line.startswith(b"WARC/"):
            while (line := data.readline(1 << 16)).strip(b"\r\n"):
                head.append(line)
            size = _SIZE.search(b"".join(head))
            line = b"\n"
            if size:
                block = data.read(int(size[1]))
                problem = None if len(block) == int(size[1]) else "damaged gzip" if members and members.damaged else "cut short"
            else:
                problem = "no Content-Length"
        else:
            problem = "no record"
        if problem in ("no Content-Length", "no record"):
            while (line := data.readline(1 << 16)) and not line.startswith(b"WARC/"):
                pass
        text = b"".join(head) if problem != "no record" else head[0][:200]
        yield text.decode("utf-8", "replace").rstrip("\r\n") + "\r\n", block, problem
    if members and members.damaged and problem != "damaged gzip":
        yield "", b"", "damaged gzip"


def _row(head: str, block: bytes, problem: str | None) -> tuple:
    f = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:]) if k}
    kind, content = ("malformed", problem) if problem else (f.get("warc-type"), f.get("content-type"))
    return None, kind, f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), content, f.get("warc-block-digest", sha1(block)), f.get("warc-payload-digest"), head, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files in a folder; page_id is null. A file is streamed by one task, a record at a time.

    What is no sound record is a row of warc_type `malformed` with the reason in content_type (see `parse`), and stops nothing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "length")
    n = max(1, files.count())
    return files.repartition(min(n, 10_000), "path").select("path").mapInArrow(_mapped(_records), SCHEMA)


def _records(path: str):
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        for part in parse(f):
            yield _row(*part)
