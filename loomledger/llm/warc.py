"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member of an archive file; of equal
payloads the page of smallest id is a response, the others revisit it. A task
writes its own files under a fresh name and reports what it wrote, so a task
that runs again leaves no half-written archive behind that anything refers to.

Index, upper level: a sparse directory, the first key of every compressed block.
Lower level: the blocks, entries sorted by reversed-host key. An index is cut by
key ranges into files; each file ends with its own directory, and only the
files' first and last keys (one row per file) are held together.

Lookup: keys go to the files that may hold them, a binary search in the file's
directory names the blocks, one range read fetches a block, a binary search in
it gives the captures. Captures are then read from the archives by range, in
the archives' order, so that neighbours share a read.

Archives and indexes lie in the folder that driver and executors share, opened
by URI, so any store that pyarrow knows will do.

Defined cases: a null html is an empty payload; a null or blank url has the
empty key; a null page_id is never what another page revisits unless all its
equals have none, and is then a response; repeated rows are written each, and a
row whose id is the smallest of its equals is a response; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_text, ids, noted, scratch_dir, written

#: Entries of an index block, index rows of a file, and bytes of an archive before the next begins.
BLOCK = 256
FILE_ROWS = 500_000
ARCHIVE = 256 << 20
#: Captures closer than this in an archive are fetched by one read, up to READ bytes.
GAP = 64 << 10
READ = 8 << 20
#: Rows of revisit targets that may be broadcast; counted first.
BROADCAST_ROWS = 500_000
#: Dates and names that make archives reproducible.
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_CAPTURE = "key string, path string, offset long, length long"
_FILE = "first string, last string, path string, blocks_at long, size long, n long"


def target_uri(url: str | None) -> str:
    """The url as it stands in a record: on one line, ASCII."""
    return quote((url or "").strip(), safe="%/:=&?~#+!$,;'@()*[]")


def url_key(url: str | None) -> str:
    """Sort key: host labels reversed, then port, path and query in lower case; scheme, www. and fragment dropped."""
    url = target_uri(url)
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.lower()
    labels = [x for x in host.lower().removeprefix("www.").split(".") if x]
    port = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return f"{','.join(reversed(labels))}{port}){(parts.path or '/').lower()}{'?' + parts.query.lower() if parts.query else ''}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORDS, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if target := target_uri(url):
        head.append(f"WARC-Target-URI: {target}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; of a response the payload is digested anew and must agree with the header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _number(x) -> int | None:
    return None if x is None else int(x)


def _archiver(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, at = None, "", 0
        for pdf in batches:
            rows = []
            for page_id, url, html, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                if out is None or at >= ARCHIVE:
                    if out is not None:
                        out.close()
                    path, at = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    system, name = _open(path)
                    out = system.open_output_stream(name, compression=None)
                payload = (html or "").encode()
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record(_number(page_id), url, payload, digest_of(payload), _number(refers_to))) + pack.flush()
                out.write(member)
                rows.append((url_key(url), path, at, len(member)))
                at += len(member)
            yield pd.DataFrame(rows, columns=["key", "path", "offset", "length"])
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame) -> DataFrame:
    """Write every page; (key, path, offset, length) of each record, as a stored table."""
    spark = pages.sparkSession
    folder = _folder(spark, "warc")
    same = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html", same.alias("same"))
    # only equal payloads meet, as digests and counts; most pages have no equal
    equal = written(rows.groupBy("same").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("same", "least"), "warc_equal")
    equal = F.broadcast(equal) if equal.count() <= BROADCAST_ROWS else equal
    rows = rows.join(equal, "same", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("least"))
    rows = rows.select(id_text("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.when(F.col("least").isNotNull() & other, F.col("least").cast("string")).alias("refers_to"))
    return written(rows.mapInPandas(_archiver(folder), _CAPTURE), "warc_captures")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, made before any task writes to it."""
    base = scratch_dir(spark)
    uri = f"{base if ':' in base.split('/')[0] else 'file://' + base}/{name}-{uuid.uuid4().hex}"
    system, path = _open(uri)
    system.create_dir(path, recursive=True)
    return noted(spark, uri)


def _indexer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directory, held, size, n, last = [], [], 0, 0, ""
        out, path = None, ""

        def flush(rows: list) -> None:
            nonlocal size, out, path
            if out is None:
                path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.idx"
                system, name = _open(path)
                out = system.open_output_stream(name, compression=None)
            block = zlib.compress(json.dumps(rows).encode(), 6)
            directory.append((rows[0][0], size, len(block)))
            out.write(block)
            size += len(block)

        for pdf in batches:
            held += pdf[["key", "path", "offset", "length"]].values.tolist()
            while len(held) > BLOCK:
                flush(held[:BLOCK])
                n += BLOCK
                held = held[BLOCK:]
        if held:
            n += len(held)
            last = held[-1][0]
            flush(held)
            blocks_at = size
            out.write(zlib.compress(json.dumps(directory).encode(), 6))
            whole = out.tell()
            out.close()
            yield pd.DataFrame([(directory[0][0], last, path, blocks_at, whole, n)], columns=["first", "last", "path", "blocks_at", "size", "n"])

    return write


def build_index(captures: DataFrame) -> DataFrame:
    """One row per index file: first and last key, path, where its directory begins, size, entries; in key order."""
    spark = captures.sparkSession
    files = max(1, -(-captures.count() // FILE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "path", "offset"]
    ranges = captures.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return written(ranges.mapInPandas(_indexer(_folder(spark, "warc_index")), _FILE), "warc_index_files")


class IndexFile:
    """An index file opened by its directory alone."""

    def __init__(self, path: str, blocks_at: int, size: int) -> None:
        system, name = _open(path)
        self._file = system.open_input_file(name)
        self._directory = json.loads(zlib.decompress(self._file.read_at(size - blocks_at, blocks_at)))
        self._keys = [x[0] for x in self._directory]
        self._last: tuple[int, list] = (-1, [])

    def _block(self, i: int) -> list:
        if self._last[0] != i:
            _, at, size = self._directory[i]
            self._last = (i, json.loads(zlib.decompress(self._file.read_at(size, at))))
        return self._last[1]

    def find(self, key: str) -> Iterator[list]:
        """Entries of a key: from the block before the first that begins with it, as long as blocks may hold it."""
        i = max(0, bisect_left(self._keys, key) - 1)
        while i < len(self._keys) and self._keys[i] <= key:
            rows = self._block(i)
            keys = [r[0] for r in rows]
            yield from rows[bisect_left(keys, key) : bisect_right(keys, key)]
            i += 1

    def close(self) -> None:
        self._file.close()


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Captures (key, path, offset, length) of the distinct keys of `keys`."""
    spark = index.sparkSession
    # a row per index file, whose number is rows / FILE_ROWS or the number of shuffle partitions
    files = sorted(tuple(r) for r in index.select("first", "last", "path", "blocks_at", "size").collect())
    if not files:
        return spark.createDataFrame([], _CAPTURE)
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, f) for k in pdf["key"] for f in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pd.DataFrame(rows, columns=["key", "file"]).astype({"file": "int64"})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, opened = -1, None
        for pdf in batches:
            rows = []
            for key, file in zip(pdf["key"], pdf["file"], strict=True):
                if file != now:
                    if opened:
                        opened.close()
                    now, opened = file, IndexFile(*files[file][2:])
                for row in opened.find(key):
                    rows.append(row)
                    if len(rows) == 20_000:  # a key may have any number of captures
                        yield pd.DataFrame(rows, columns=["key", "path", "offset", "length"])
                        rows = []
            yield pd.DataFrame(rows, columns=["key", "path", "offset", "length"])
        if opened:
            opened.close()

    routed = keys.select("key").distinct().mapInPandas(route, "key string, file long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return routed.repartitionByRange(n, "file", "key").sortWithinPartitions("file", "key").mapInPandas(find, _CAPTURE)


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """Range-read the captures' records: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for."""
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, file = None, None
        for pdf in batches:
            todo = list(zip(pdf["path"], pdf["offset"], pdf["length"], strict=True))
            rows, i = [], 0
            while i < len(todo):
                name, begin, size = todo[i]
                end, j = begin + size, i + 1
                while j < len(todo) and todo[j][0] == name and 0 <= todo[j][1] - end <= GAP and todo[j][1] + todo[j][2] - begin <= READ:
                    end, j = todo[j][1] + todo[j][2], j + 1
                if name != path:
                    if file:
                        file.close()
                    system, own = _open(name)
                    path, file = name, system.open_input_file(own)
                data = file.read_at(end - begin, begin)
                for _, at, length in todo[i:j]:
                    fields = parse(zlib.decompress(data[at - begin : at - begin + length], 31))
                    rows.append([fields[c] for c in columns])
                if len(rows) >= 5000 or (with_payload and sum(len(r[-1] or b"") for r in rows) > READ):
                    yield _frame(rows, columns)
                    rows = []
                i = j
            yield _frame(rows, columns)
        if file:
            file.close()

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    kinds = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}
    return ordered.mapInPandas(read, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _frame(rows: list[list], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: ids(values) if c in ("page_id", "refers_to") else pd.Series(list(values), dtype="int64" if c == "payload_bytes" else object) for c, values in zip(columns, zip(*rows) if rows else [()] * len(columns), strict=True)})  # noqa: B905


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, and read every one back by its url key."""
    captures = write_archives(pages)
    found = written(lookup(build_index(captures), captures), "warc_found")
    return read_records(found)
