"""WARC archives with a two-level capture index.

``write`` makes one WARC/1.1 record per page, each a gzip member of its own, in
archives of ``ARCHIVE_BYTES`` or less in the shared folder. Of records with equal
payloads of 100 bytes or more, that with the smallest page_id is a ``response``, the others
are ``revisit`` records that name it and hold the HTTP head alone.

The capture index is sorted by (key, page_id), where the key is the URL with its
host reversed (``com,example,www)/path?query``). Each range partition of it is one
index file of compressed blocks of ``BLOCK_LINES`` lines; the directory has a line
per block: its first key, file, offset and length. The directory of a file is
kept in a file beside it, and the list of files with their first keys is the top.

``lookup`` finds captures: a binary search in the top names the file, one in that
file's directory the block, one in the block the line, and the line the byte
range of the record, which is all that is read of the archive. ``read`` looks up
every capture that was asked for, in parallel, by ranges of the key.

Writers name files by a fresh token and return what they wrote; only what a
finished task has returned is indexed, so a task that is run again after a lost
executor leaves an unnamed file at most. Files are opened by their URI, so the
shared folder can be in any store that Arrow opens.

The key of a URL is made by one column expression, and travels with the page from
the writer to the index; a capture that is asked for and isn't in the index is an
error, never a missing row.

Edge cases: a null html is an empty payload, of 0 bytes; a null url has the key
')'; repeated page_ids are records of their own, read back in turn, and of equal
payloads under the smallest page_id that with the smallest url (null first) is the
response, one of them if rows repeat in full; pages of a null page_id come last, and
where no page of a payload has an id, all are responses, as a revisit could not name
one; other columns are not read; no pages give no archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, copies

LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"

_CAPTURE = (
    "key string, page_id long, archive string, offset long, length long, record_id string"
)
_DIRECTORY = "key string, page_id long, file string, blocks long, captures long"
_RECORD = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
)


def _order(key: str, page_id: int | None) -> tuple[bytes, bool, int]:
    """Keys by their UTF-8 bytes, as Spark sorts strings; a null page_id last."""
    return key.encode("utf-8", "surrogatepass"), page_id is None, page_id or 0


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def record_name(page_id: int | None) -> str:
    """The record's URI: of its page, so that a revisit can name it before it is written."""
    return f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{page_id}"


def record(row: dict, record_id: str) -> bytes:
    """One WARC record; the payload of a revisit is left out, its HTTP head is kept."""
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = row["refers_to"] is not None
    block = http if revisit else http + payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"WARC-X-Page-ID: {'' if row['page_id'] is None else row['page_id']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_name(row['refers_to'])}>",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record, read from its bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = named["WARC-Type"]
    refers = named.get("WARC-Refers-To", "").removeprefix("<urn:page:").rstrip(">")
    return {
        "page_id": int(named["WARC-X-Page-ID"].strip()) if named["WARC-X-Page-ID"].strip() else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers) if refers else None,
        "intact": kind == "revisit" or (len(payload) == size and hashlib.sha256(payload).hexdigest() == digest),
        "payload": payload,
        "url": named["WARC-Target-URI"],
    }


def _archiver(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        stream, name, offset = None, "", 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "page_id", "archive", "offset", "length", "record_id")}
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("key", "page_id", "url", "html", "digest", "refers_to")}
                if stream is None or offset > ARCHIVE_BYTES:
                    if stream is not None:
                        stream.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    where.create_dir(base, recursive=True)
                    stream = where.open_output_stream(f"{base}/{name}", compression=None)
                record_id = record_name(row["page_id"])
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = packer.compress(record(row, record_id)) + packer.flush()
                stream.write(data)
                for c, v in (
                    ("key", row["key"]),
                    ("page_id", row["page_id"]),
                    ("archive", f"{folder}/{name}"),
                    ("offset", offset),
                    ("length", len(data)),
                    ("record_id", record_id),
                ):
                    out[c].append(v)
                offset += len(data)
            yield pa.RecordBatch.from_pydict(
                out,
                schema=pa.schema(
                    [
                        ("key", pa.string()),
                        ("page_id", pa.int64()),
                        ("archive", pa.string()),
                        ("offset", pa.int64()),
                        ("length", pa.int64()),
                        ("record_id", pa.string()),
                    ]
                ),
            )
        if stream is not None:
            stream.close()

    return run


def _indexer(folder: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sorted captures of a partition to a file of compressed blocks, with its directory beside it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, base = _open(folder)
        name = uuid.uuid4().hex
        directory: list[list] = []
        lines: list[str] = []
        first: list = []
        stream, offset, total = None, 0, 0

        def flush() -> None:
            nonlocal offset, lines
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 4)
            stream.write(data)
            directory.append([*first, offset, len(data)])
            offset += len(data)
            lines = []

        for frame in frames:
            for key, page_id, archive, at, length, record_id in frame.itertuples(index=False, name=None):
                page_id = None if pd.isna(page_id) else int(page_id)
                if stream is None:
                    where.create_dir(base, recursive=True)
                    stream = where.open_output_stream(f"{base}/{name}.cdx", compression=None)
                if not lines:
                    first = [key, page_id]
                lines.append(json.dumps([key, page_id, archive, int(at), int(length), record_id]))
                total += 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if stream is None:
            return
        if lines:
            flush()
        stream.close()
        with where.open_output_stream(f"{base}/{name}.dir", compression=None) as out:
            out.write("\n".join(map(json.dumps, directory)).encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(
            {
                "key": [directory[0][0]],
                "page_id": pd.array([directory[0][1]], "Int64"),
                "file": [f"{folder}/{name}"],
                "blocks": [len(directory)],
                "captures": [total],
            }
        )

    return run


class Reader:
    """Range reads through the two levels of the index, in one task or on the driver."""

    def __init__(self, top: list[tuple[str, int | None, str]]):
        self.top = sorted(top, key=lambda r: _order(r[0], r[1]))
        self._starts = [_order(k, p) for k, p, _ in self.top]
        self._directory: tuple[str, list, list] = ("", [], [])
        self._block: tuple[tuple[str, int], list, list] = (("", -1), [], [])
        self._files: dict[str, pa.NativeFile] = {}

    def _range(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self._files:
            if len(self._files) >= 64:
                self._files.pop(next(iter(self._files))).close()
            where, path = _open(uri)
            self._files[uri] = where.open_input_file(path)
        return self._files[uri].read_at(length, offset)

    def _lines(self, file: str, entry: list) -> tuple[list, list]:
        if self._block[0] != (file, entry[2]):
            rows = [json.loads(x) for x in zlib.decompress(self._range(f"{file}.cdx", entry[2], entry[3])).split(b"\n")]
            self._block = ((file, entry[2]), rows, [_order(r[0], r[1]) for r in rows])
        return self._block[1:]

    def captures(self, key: str, page_id: int | None = None, any_page: bool = True) -> Iterator[list]:
        """The index lines of a key, or of one of its captures, in order."""
        low = (key.encode("utf-8", "surrogatepass"), False, -(1 << 63)) if any_page else _order(key, page_id)
        high = (low[0], True, 0) if any_page else low
        at = max(0, bisect.bisect_left(self._starts, low) - 1)
        while at < len(self.top) and self._starts[at] <= high:
            file = self.top[at][2]
            if self._directory[0] != file:
                where, path = _open(f"{file}.dir")
                with where.open_input_stream(path, compression=None) as source:
                    entries = [json.loads(x) for x in source.read().split(b"\n")]
                self._directory = (file, entries, [_order(e[0], e[1]) for e in entries])
            _, entries, starts = self._directory
            block = max(0, bisect.bisect_left(starts, low) - 1)
            while block < len(entries) and starts[block] <= high:
                rows, orders = self._lines(file, entries[block])
                for k in range(bisect.bisect_left(orders, low), bisect.bisect_right(orders, high)):
                    yield rows[k]
                block += 1
            at += 1

    def fetch(self, line: list) -> dict:
        return parse(zlib.decompress(self._range(line[2], line[3], line[4]), 31))


class Archive:
    """What ``write`` has made: the top of the index, a small list with a row per index file."""

    def __init__(self, spark: SparkSession, scratch: Scratch, top: list[tuple[str, int | None, str]]):
        self.spark, self.scratch, self.top = spark, scratch, top

    def lookup(self, url: str) -> list[dict]:
        """Every capture of ``url``, with its payload, by binary searches and range reads."""
        reader = Reader(self.top)
        key = self.spark.createDataFrame([(url,)], "url string").select(url_key(F.col("url"))).first()[0]
        return [reader.fetch(line) for line in reader.captures(key)]

    def read(self, wanted: DataFrame) -> DataFrame:
        """A row per row of ``wanted`` (url, page_id): what the archives hold of that capture."""
        top = self.top

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader, fields = Reader(top), [f.split()[0] for f in _RECORD.split(", ")]
            last, turns = None, iter(())
            for frame in frames:
                found = []
                for key, page_id in frame.itertuples(index=False, name=None):
                    page_id = None if pd.isna(page_id) else int(page_id)
                    # rows that repeat a capture, neighbours in this order, take its records in turn
                    line = next(turns, None) if last == (key, page_id) else None
                    if line is None:
                        last, turns = (key, page_id), reader.captures(key, page_id, any_page=False)
                        line = next(turns, None)
                    if line is None:
                        raise LookupError(f"no capture of {key!r} with page_id {page_id}")
                    found.append(reader.fetch(line))
                out = pd.DataFrame([[r[f] for f in fields] for r in found], columns=fields, dtype=object)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

        keys = wanted.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
        # ranges of the key, so that neighbours in the index are read by one task
        ranged = keys.repartitionByRange(_tasks(self.spark), "key", "page_id").sortWithinPartitions("key", "page_id")
        return ranged.select("key", F.col("page_id").cast("string")).mapInPandas(run, _RECORD)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def url_key(url: Column) -> Column:
    """Reversed host, port, then path and query: neighbours in a site are neighbours in the index."""
    plain = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.split(F.regexp_replace(plain, "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "#", 2)[0]
    authority = F.regexp_extract(rest, "^([^/?]*)", 1)
    path = F.regexp_replace(rest, "^[^/?]*", "")
    host = F.lower(F.regexp_replace(authority, "(?s)^.*@", ""))
    name = F.substring_index(host, ":", 1)
    tail = F.regexp_replace(host, "^[^:]*", "")
    tail = F.when(tail == ":", "").otherwise(tail)
    slash = F.when((rest != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(F.reverse(F.split(name, "\\.")), ","), tail, F.lit(")"), slash, path)


def write(spark: SparkSession, pages: DataFrame) -> Archive:
    """Write every page to archives and index them."""
    scratch = Scratch(spark, "warc")
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    rows = rows.withColumns(
        {"key": url_key(F.col("url")), "digest": F.sha2(F.col("html").cast("binary"), 256), "bytes": F.octet_length("html")}
    )
    # payloads that occur more than once, and who keeps them: narrow rows, summed before the shuffle
    captures = rows.filter(F.col("bytes") >= LEAST_PAYLOAD).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    keeper = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url"))
    shared = captures.groupBy("digest").agg(keeper.alias("first"), F.sum("n").alias("n"), F.max("n").alias("twins"))
    shared = shared.filter("n > 1").select(
        F.col("digest").alias("_digest"), F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), "twins"
    )
    shared = scratch.save(shared, "shared")
    marked = rows.join(shared, F.col("digest") == F.col("_digest"), "left")
    columns = [*rows.columns, "first", "first_url"]
    later = ~(F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url")))
    twins = shared.filter("twins > 1")
    if twins.isEmpty():
        marked = marked.withColumn("refers_to", F.when(later, F.col("first")))
    else:
        # rows that repeat (page_id, url, html) in full are numbered from their count, so that one of them is first
        plain = F.coalesce(F.col("twins"), F.lit(0)) <= 1
        repeated = marked.filter(~plain).groupBy(*columns).agg(F.count("*").alias("n"))
        repeated = copies(repeated, "n", "copy").drop("n")
        marked = marked.filter(plain).select(*columns, F.lit(1).cast("long").alias("copy")).unionByName(repeated)
        marked = marked.withColumn("refers_to", F.when(later | (F.col("copy") > 1), F.col("first")))
    written = marked.select("key", "page_id", "url", "html", "digest", "refers_to").mapInArrow(
        _archiver(f"{scratch.path}/archives"), _CAPTURE
    )
    captures = scratch.save(written, "captures")
    tasks = _tasks(spark)
    ranged = captures.repartitionByRange(tasks, "key", F.col("page_id").asc_nulls_last()).sortWithinPartitions(
        "key", F.col("page_id").asc_nulls_last()
    )
    # ids as strings: pandas would make floats of longs among nulls
    ranged = ranged.withColumn("page_id", F.col("page_id").cast("string"))
    top = scratch.save(ranged.mapInPandas(_indexer(f"{scratch.path}/index"), _DIRECTORY), "top")
    lines = [(r["key"], r["page_id"], r["file"]) for r in top.collect()]  # one row per index file
    return Archive(spark, scratch, lines)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A row per page, as read back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    return write(spark, pages).read(pages)


#: Without intact, which tells whether a response's payload has its digest.
ORACLE = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, p.payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
