"""WARC archives with a two-level capture index.

Writing: each page becomes a gzip member of its own in an archive. Of pages with equal payloads that
with the largest id is a ``response`` record, the others are ``revisit`` records that name it and hold
the HTTP header alone. Each task writes archives of its own under new names and returns the captures;
only returned names count, so a task that runs twice leaves an orphan, never a wrong entry.

Index: captures sorted by reversed-host URL key (``com,example,www)/path``) and id are written in
shards of gzip blocks of ``BLOCK`` lines. Each shard has a sparse directory with the first key of each
block. Look-ups binary-search the shards, the shard's directory and the block's lines, then read the
record by its range.

Paths go through pyarrow's file systems (local, S3, GCS, HDFS), never through open().

Null html is an empty payload; null URLs and ids are kept. Rows that repeat both id and payload are
each a response. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, folder_of, hot_join, spread, stored, table, tidy

DATE = "2000-01-01T00:00:00Z"
#: Captures of one compressed index block.
BLOCK = 1000
#: An archive is closed past this size.
ARCHIVE_BYTES = 1 << 30
LEVEL = 6


def url_key(url: str | None) -> str:
    """Reversed-host key of a URL."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return ")" + quote(url or "", safe="/?&=%")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + quote(rest.lower(), safe="/?&=%:@,;+$!*'()~")


def capture_key(url: str | None, page_id: int | None) -> str:
    """The sort key of a capture: URL key, then id."""
    return f"{url_key(url)} {'' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(head: list[tuple[str, str]], body: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(body)))])
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response, or a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(quote(c) if c < " " else c for c in url)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers_to))]
    return _member([*head, ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with digest, size and the member they have as a response."""
    for b in batches:
        html = [(x or "").encode() for x in b["html"].to_pylist()]
        ids, urls, shas = b["page_id"].to_pylist(), b["url"].to_pylist(), [digest(x) for x in html]
        members = [record(i, u, x, s, len(x), None, False) for i, u, x, s in zip(ids, urls, html, shas, strict=True)]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(shas), pa.array([len(x) for x in html], pa.int64()), pa.array(members, pa.binary())], ["page_id", "url", "sha", "size", "member"])


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for r in b.to_pylist():
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                leads = r["page_id"] == r["leader"]
                data = r["member"] if leads else record(r["page_id"], r["url"], b"", r["sha"], r["size"], r["leader"], True)
                out.write(data)
                for c, v in zip(rows, (capture_key(r["url"], r["page_id"]), name, at, len(data)), strict=True):
                    c.append(v)
                at += len(data)
                if at > ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages; the captures ``(key, archive, offset, length)``."""
    spark = pages.sparkSession
    batches_of(spark)
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    rows = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    payload = F.concat_ws(" ", "sha", F.col("size").cast("string"))
    made = rows.mapInArrow(tidy(_responses), "page_id long, url string, sha string, size long, member binary").withColumn("payload", payload)
    ids = rows.mapInArrow(_shas, "page_id long, sha string, size long")
    # digests by a scan of their own: members are compressed once, and only they are shuffled; a payload
    # of very many pages is dealt over several tasks
    leaders = stored(ids.groupBy(payload.alias("payload")).agg(F.max("page_id").alias("leader"), F.count("*").alias("times")), "leaders")
    total = leaders.agg(F.sum("times")).first()[0] or 0
    joined = hot_join(made, leaders, "payload", "times", total).select("page_id", "url", "sha", "size", "leader", "member")
    return stored(joined.mapInArrow(_writer(folder), "key string, archive string, offset long, length long"), "captures")


def _shas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        html = [(x or "").encode() for x in b["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["page_id"], pa.array([digest(x) for x in html]), pa.array([len(x) for x in html], pa.int64())], ["page_id", "sha", "size"])


def _indexer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at = None, uuid.uuid4().hex, 0
        lines: list[str] = []
        directory: list[tuple[str, int, int]] = []
        first = last = None

        def put() -> None:
            nonlocal at
            data = gzip.compress("".join(lines).encode(), 6)
            out.write(data)
            directory.append((lines[0].split("\t", 1)[0], at, len(data)))
            at += len(data)
            lines.clear()

        for b in batches:
            for key, archive, offset, length in zip(*(b[c].to_pylist() for c in ("key", "archive", "offset", "length")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                    first = key
                last = key
                lines.append(f"{key}\t{archive}\t{offset}\t{length}\n")
                if len(lines) >= BLOCK:
                    put()
        if out is not None:
            if lines:
                put()
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, first, last)], ["shard", "first", "last"])

    return run


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """Write shards and directories; (first key, last key, shard), one per shuffle partition, in order."""
    dealt = captures.repartitionByRange("key").sortWithinPartitions("key", "archive", "offset")
    shards = stored(dealt.mapInArrow(_indexer(folder), "shard string, first string, last string"), "shards")
    return sorted((r["first"], r["last"], r["shard"]) for r in shards.collect())  # at most one row per partition


class Reader:
    """Look-ups in archives and index of a folder, by binary search and range reads."""

    def __init__(self, folder: str, shards: list[tuple[str, str, str]]):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.shards = shards
        self.lasts = [s[1] for s in shards]
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.directories: dict[str, list] = {}
        self.block: tuple[tuple[str, int], list[list[str]]] | None = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 32:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.fs.open_input_file(f"{self.base}/{name}")
        self.files.move_to_end(name)
        f = self.files[name]
        f.seek(offset)
        return f.read(length)

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of all captures with the key."""
        found = []
        for s in range(bisect.bisect_left(self.lasts, key), len(self.shards)):
            first, _, shard = self.shards[s]
            if first > key:
                break
            if shard not in self.directories:
                self.directories = {shard: json.loads(self.fs.open_input_file(f"{self.base}/{shard}.dir").readall())}
            directory = self.directories[shard]
            at = max(0, bisect.bisect_left(directory, key, key=lambda d: d[0]) - 1)
            while at < len(directory) and directory[at][0] <= key:
                if self.block is None or self.block[0] != (shard, at):
                    text = gzip.decompress(self.read(f"{shard}.cdx.gz", directory[at][1], directory[at][2])).decode()
                    self.block = (shard, at), [x.split("\t") for x in text.split("\n")[:-1]]
                lines = self.block[1]
                i = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while i < len(lines) and lines[i][0] == key:
                    found.append((lines[i][1], int(lines[i][2]), int(lines[i][3])))
                    i += 1
                at += 1
        return found


def _look_up(folder: str, shards: list[tuple[str, str, str]]):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, shards)
        for b in batches:
            spots = sorted(x for key in b["key"].to_pylist() for x in reader.find(key))
            rows: list[list] = [[] for _ in names]
            for archive, offset, length in spots:
                head, http, payload = parse(reader.read(archive, offset, length))
                revisit = head["WARC-Type"] == "revisit"
                sha, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                if not revisit and (digest(payload), len(payload)) != (sha, size):
                    raise ValueError(f"damaged record in {archive} at {offset}")
                row = (number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, sha, head["WARC-Type"], number(head.get("WARC-Refers-To")), None if revisit else payload)
                for c, v in zip(rows, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names)

    return run


def look_up(keys: DataFrame, folder: str, shards: list[tuple[str, str, str]]) -> DataFrame:
    """The records of ``(key)`` rows, each key's captures once; a revisit's payload is null."""
    # an explicit number, for each small key costs the reading of a record
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.select("key").distinct().repartitionByRange(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(_look_up(folder, shards)), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def keys_of(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for u, i in zip(b["url"].to_pylist(), b["page_id"].to_pylist(), strict=True)], pa.string())], ["key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "key string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{folder_of(spark)}/warc-{uuid.uuid4().hex}"
    shards = write_index(write_archives(pages, folder), folder)
    return look_up(keys_of(pages), folder, shards).drop("payload", "url")
