"""WARC archives with a two-level capture index.

Writing: each task streams its pages into one archive, one gzip member a record, under a
temporary name that is moved when the archive is whole; the rows it returns (the captures) name
that file and are themselves committed as a table, so a repeated task leaves at most an unnamed
file. Of records with equal payloads of at least `min_bytes` the one with the largest page id is
a response and the others are revisits of it, without the payload.

Index: captures sorted by reversed-host key (com,example,www)/path) and page id are cut into
compressed blocks; a sparse directory beside each index file has the first key, offset and
length of its blocks. Reading: a binary search over the files' first keys deals each key to the
index files that may hold it (one, but for keys that span files: captures without url and id,
say, of which each file's share is read by a task of its own); a task finds the block by binary
search in the directory, reads that block's range, finds the captures in it and reads their
ranges from the archives, file by file in order of offset. Batches end at BATCH_BYTES.

Payload digests come first as a small table; the table of repeated payloads is broadcast while
it has at most BROADCAST_ROWS rows, else the pages meet it by a shuffle, apart from hot payloads.

Nulls: a null html is an empty payload, a null url has the empty key, a null page id never wins.
Rows that repeat page id and payload of a winner are all responses. Every row has a record.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, scratch, send, stored

BLOCK_LINES = 512
BROADCAST_ROWS = 100_000
HOT_SHARE = 2000
BATCH_BYTES = 4 << 20
CAPTURE = "key string, page_id long, file string, offset long, length long"
NO_ID = -(1 << 63)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI that every executor reaches (file, hdfs, s3, gs)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def reversed_host(url: str | None) -> str:
    """com,example,www)/path?query in place of scheme://www.example.com/path?query; the empty key without `://`."""
    if not url or "://" not in url:
        return ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min([i for i in (rest.find("/"), rest.find("?")) if i >= 0], default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def _line(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head.encode() + (b"" if revisit else payload)
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {_line(url)}")
    fields += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        fields += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Truncated: length"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.split(b"\r\n\r\n", 1)[1]
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if x and x != _name(None) else None
    out = {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"][5:], "bytes": int(fields["X-Payload-Length"]), "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload}
    if out["type"] == "response" and (len(payload) != out["bytes"] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["digest"]):
        raise ValueError(f"record of page {out['page_id']} does not match its digest")
    return out


def with_winners(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html and `winner`: the largest page id of equal payloads (null: the payload is alone or small)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    small = stored(pages.filter(F.octet_length("html") >= min_bytes).select("page_id", "digest"), "digests")
    groups = small.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    repeated = stored(groups.filter("n > 1"), "repeated")
    n = repeated.count()
    if n <= BROADCAST_ROWS:
        return pages.join(F.broadcast(repeated.drop("n")), "digest", "left")
    limit = small.count() // HOT_SHARE
    hot = F.broadcast(repeated.filter(F.col("n") > limit).drop("n"))
    rest = pages.join(hot.select("digest"), "digest", "left_anti").join(repeated.filter(F.col("n") <= limit).drop("n").hint("merge"), "digest", "left")
    return pages.join(hot, "digest").unionByName(rest)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives into `folder` (a URI all executors reach) and returns the stored captures."""
    rows = with_winners(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), min_bytes)
    rows = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), "winner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for b in batches:
            captures = []
            for i, url, html, winner in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if out is None:
                    out = fs.open_output_stream(f"{path}/.{name}.part", compression=None)
                member = build_record(i, url, html, winner, winner is not None and winner != i, date)
                out.write(member)
                captures.append((reversed_host(url), i, f"{folder}/{name}", offset, len(member)))
                offset += len(member)
            if captures:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*captures), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()
            fs.move(f"{path}/.{name}.part", f"{path}/{name}")

    return stored(arrow_map(rows, run, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Index files and their directories in `folder`; returns the stored manifest, one row an index file."""
    order = ["key", "page_id", "file", "offset"]
    parts = max(1, min(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), captures.count() // block_lines + 1))
    dealt = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        name = uuid.uuid4().hex
        state = {"out": None, "offset": 0}
        directory: list[tuple] = []

        def flush(lines: list[list]) -> None:
            if state["out"] is None:
                fs.create_dir(path, recursive=True)
                state["out"] = fs.open_output_stream(f"{path}/.{name}.idx.part", compression=None)
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            state["out"].write(block)
            directory.append((lines[0][0], lines[0][1], state["offset"], len(block)))
            state.setdefault("first", lines[0])
            state["offset"] += len(block)

        held: list[list] = []
        for b in batches:
            for key, i, file, offset, length in zip(*[b.column(k).to_pylist() for k in range(5)]):
                held.append([key, NO_ID if i is None else i, file, offset, length])
                if len(held) == block_lines:
                    flush(held)
                    held = []
        if held:
            flush(held)
        if directory:
            state["out"].close()
            fs.move(f"{path}/.{name}.idx.part", f"{path}/{name}.idx")
            with fs.open_output_stream(f"{path}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_pydict({"index": [f"{folder}/{name}.idx"], "directory": [f"{folder}/{name}.dir"], "first_key": [directory[0][0]], "first_id": [directory[0][1]], "first_file": [state["first"][2]], "first_offset": [state["first"][3]], "blocks": [len(directory)]})

    return stored(arrow_map(dealt, run, "index string, directory string, first_key string, first_id long, first_file string, first_offset long, blocks long"), "manifest")


class Index:
    """Binary search over index files (first key, first id, index, directory; in the order of all captures), their directories and blocks; keeps the directory and block last used."""

    def __init__(self, files: list[tuple[str, int, str, str]]):
        self.files = files
        self.first = [(k, i) for k, i, _, _ in self.files]
        self.kept: dict[str, object] = {}

    def _read(self, uri: str, offset: int | None = None, length: int | None = None) -> bytes:
        fs, path = open_store(uri)
        with fs.open_input_file(path) as f:
            return f.read() if offset is None else f.read_at(length, offset)

    def _once(self, slot: str, key: tuple, make) -> object:
        if self.kept.get(slot, (None,))[0] != key:
            self.kept[slot] = (key, make())
        return self.kept[slot][1]

    def places(self, key: tuple[str, int]) -> range:
        """The files that may hold a (key, page id): from the last that starts below it, onwards while they start at or below it."""
        return range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key))

    def captures(self, at: int, key: tuple[str, int]) -> Iterator[list]:
        """The captures of a (key, page id) in one file."""
        _, _, index, directory = self.files[at]
        blocks = self._once("directory", (directory,), lambda: [((k, i), o, n) for k, i, o, n in json.loads(zlib.decompress(self._read(directory)))])
        starts = self._once("starts", (directory,), lambda: [x[0] for x in blocks])
        for j in range(max(0, bisect.bisect_left(starts, key) - 1), len(blocks)):
            if starts[j] > key:
                break
            _, offset, length = blocks[j]
            lines = self._once("block", (index, offset), lambda: [json.loads(x) for x in zlib.decompress(self._read(index, offset, length)).split(b"\n")])
            for k in range(bisect.bisect_left(lines, [*key]), len(lines)):
                if (lines[k][0], lines[k][1]) != key:
                    break
                yield lines[k]


def lookup(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records of the wanted (url, page_id): page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    rows = sorted(manifest.collect(), key=lambda r: (r.first_key, r.first_id, r.first_file, r.first_offset))  # one row an index file; at most shuffle.partitions
    files = [(r.first_key, r.first_id, r["index"], r.directory) for r in rows]
    sent = send(wanted.sparkSession, files)
    keyed = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).distinct()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent())
        for b in batches:
            found = {(reversed_host(u), i) for u, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
            rows = [(at, k, i) for k, i in found for at in index.places((k, NO_ID if i is None else i))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int32(), pa.string(), pa.int64()))], ["file", "key", "page_id"])

    keyed = arrow_map(keyed, keys, "file int, key string, page_id long").distinct()
    # index files hold about equal numbers of captures, so a file a task is fair whatever the keys
    keyed = keyed.repartitionById(max(len(files), 1), F.col("file")).sortWithinPartitions("key", "page_id")
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent())

        def records(found: list[list]) -> Iterator[tuple]:
            found.sort(key=lambda c: (c[2], c[3]))
            name, file = None, None
            try:
                for _, _, uri, offset, length in found:
                    if uri != name:
                        if file is not None:
                            file.close()
                        fs, path = open_store(uri)
                        name, file = uri, fs.open_input_file(path)
                    r = parse_record(file.read_at(length, offset))
                    yield r["page_id"], r["url"], r["payload"], r["bytes"], r["digest"], r["type"], r["refers_to"]
            finally:
                if file is not None:
                    file.close()

        def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for row in rows:
                held.append(row)
                size += len(row[2]) + 256
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

        def wanted_captures() -> Iterator[list]:
            for b in batches:
                for at, k, i in zip(*[b.column(c).to_pylist() for c in range(3)]):
                    yield from index.captures(at, (k, NO_ID if i is None else i))

        captures = wanted_captures()
        while some := list(itertools.islice(captures, 1000)):
            yield from packed(records(some))

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return arrow_map(keyed, run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write archives and index, then read every page's record back through the index."""
    folder = folder or scratch(pages.sparkSession, "warc")
    manifest = write_index(write_archives(pages, folder, min_bytes), folder)
    return lookup(pages.select("url", "page_id"), manifest)
