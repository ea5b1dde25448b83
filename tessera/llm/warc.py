"""WARC archives with a two-level capture index.

Writing: every page becomes one WARC 1.1 record, a gzip member of its own. Of the pages with
equal payloads the one with the largest id is the response; the others are revisits that
refer to it and carry no payload. Tasks write files under names that no other attempt uses and
return the captures they wrote, so files of lost attempts are never referred to.

Index: captures are sorted by reversed-host URL key (and page id), written as compressed
blocks of ``BLOCK_LINES`` lines, with a sparse directory of the blocks' first keys beside each
index file. One row per index file says where its keys begin; ``INDEX_FILES`` bounds them.

Lookup: a wanted key is sent to its index file by that small table; there the directory is
binary-searched for the block and the block for the line. Records are then read by byte range,
in file order.

Defined results: a null html has an empty payload, equal to other empty ones. A null url is
indexed under "-". Ids should be unique; where rows repeat an id and payload, one of them is
the response and the others refer to that id. A null id is smaller than any other and is
never referred to unless all equal payloads lack an id. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import new_stage_path, stage

# Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 512
# Captures per index file, and the most index files, so their table can be broadcast.
INDEX_LINES = 200_000
INDEX_FILES = 4096
LEVEL = 4
DATE = "2020-01-01T00:00:00Z"
# Ranges closer than this are read in one go, up to READ_BYTES.
READ_GAP, READ_BYTES = 1 << 16, 1 << 23

CAPTURE = "surt string, page_id long, record_type string, payload_digest string, archive string, offset long, length long"


def surt(url: str | None) -> str:
    """The URL with its host reversed, so that pages of a domain sort together."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return quote(url.strip().lower(), safe="/:?&=%,)(")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(f"{','.join(reversed(host.split('.')))}{port}){rest}".lower(), safe="/:?&=%,)(")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_response: bool) -> bytes:
    """One record, uncompressed."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + (payload if is_response else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>" if page_id is None else f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if not is_response:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(member: bytes) -> dict:
    """A gzip member as page id, payload size and digest, type and reference; checks what it can."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if named["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError("payload does not match its record")
    number = lambda k: int(named[k]) if k in named else None
    return {
        "page_id": number("WARC-Page-ID"), "payload_bytes": size, "payload_digest": digest,
        "record_type": named["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"),
    }


def _open(path: str):
    """(file system, path) of a shared folder's file, whatever store it is in."""
    return fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; the captures, as a stored table."""
    spark = pages.sparkSession
    root = root or new_stage_path(spark, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("digest")).withColumn(
        "row", F.monotonically_increasing_id()  # only tells rows of one id and payload apart
    )
    same_id = rows.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("last"))
    first = same_id.groupBy("digest").agg(
        F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("order"), "page_id", "n", "last")).alias("top")
    ).select("digest", "top.*").withColumnRenamed("page_id", "refers_to")
    typed = (
        rows.join(first, "digest")
        .withColumn(
            "is_response", F.col("page_id").eqNullSafe(F.col("refers_to")) & ((F.col("n") == 1) | (F.col("row") == F.col("last")))
        )
        .select("page_id", "url", "html", "refers_to", "is_response")
    )

    def write(batches):
        store, folder = _open(root)
        store.create_dir(folder, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to, is_response in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                body = (html or "").encode()
                digest = digest_of(body)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(make_record(page_id, url, body, digest, refers_to, is_response)) + packer.flush()
                out.write(member)
                rows.append((surt(url), page_id, "response" if is_response else "revisit", digest, f"{root}/{name}", at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])],
                    names=[x.split(" ")[0] for x in CAPTURE.split(", ")],
                )
        if out is not None:
            out.close()

    return stage(typed.mapInArrow(write, CAPTURE), "captures")


def write_index(captures: DataFrame, root: str | None = None, files: int | None = None) -> DataFrame:
    """Write the two-level index; the files' table (first_surt, first_page, file), as a stored table."""
    spark = captures.sparkSession
    root = root or new_stage_path(spark, "captures")
    files = files or max(1, min(INDEX_FILES, -(-captures.count() // INDEX_LINES)))
    ordered = captures.select(
        "surt", F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), F.to_json(F.struct("record_type", "payload_digest", "archive", "offset", "length")).alias("line")
    )
    ordered = ordered.repartitionByRange(files, "surt", "page").sortWithinPartitions("surt", "page")

    def write(batches):
        store, folder = _open(root)
        name, out, directory, lines, at = uuid.uuid4().hex, None, [], [], 0

        def flush():
            nonlocal at, lines
            packed = zlib.compress("\n".join(f"{s} {p} {x}" for s, p, x in lines).encode(), LEVEL)
            out.write(packed)
            directory.append([lines[0][0], lines[0][1], at, len(packed)])
            at += len(packed)
            lines = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}.cdx", compression=None)
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with store.open_output_stream(f"{folder}/{name}.dir", compression=None) as side:
            side.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_pydict({
            "first_surt": [directory[0][0]], "first_page": pa.array([directory[0][1]], pa.int64()), "file": [f"{root}/{name}"],
        })

    return stage(ordered.mapInArrow(write, "first_surt string, first_page long, file string"), "capture-files")


def _tasks(spark: SparkSession) -> int:
    """Given outright, because ranges are small and what they stand for is not: merging them would read in one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    store, name = _open(path)
    with store.open_input_file(name) as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)


class IndexReader:
    """One index file: its directory, and the block read last."""

    def __init__(self, file: str):
        self.file, self.directory, self.block, self.lines = file, json.loads(_read(f"{file}.dir")), -1, []
        self.firsts = [(d[0], d[1]) for d in self.directory]

    def find(self, key: str, page: int) -> list[dict]:
        """All lines of (key, page), from the block that can hold the first on."""
        out, i = [], max(0, bisect.bisect_left(self.firsts, (key, page)) - 1)
        while i < len(self.directory) and self.firsts[i] <= (key, page):
            if i != self.block:
                _, _, offset, length = self.directory[i]
                rows = zlib.decompress(_read(f"{self.file}.cdx", offset, length)).decode().split("\n")
                self.block, self.lines = i, [(s, int(p), x) for s, p, x in (r.split(" ", 2) for r in rows)]
            at = bisect.bisect_left(self.lines, (key, page, ""))
            while at < len(self.lines) and self.lines[at][:2] == (key, page):
                out.append(json.loads(self.lines[at][2]))
                at += 1
            i += 1
        return out


def lookup(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, archive, offset, length) of every capture of the distinct (url, page_id) in ``wanted``."""
    spark = wanted.sparkSession
    table = sorted((r["first_surt"], r["first_page"], r["file"]) for r in index.collect())  # at most INDEX_FILES rows
    found = "page_id long, archive string, offset long, length long"
    if not table:
        return spark.createDataFrame([], found)
    files = spark.sparkContext.broadcast(table)

    def route(batches):
        firsts = [(s, p) for s, p, _ in files.value]
        for batch in batches:
            keys = [surt(u) for u in batch.column(0).to_pylist()]
            pages = [-(1 << 63) if p is None else p for p in batch.column(1).to_pylist()]
            # a key's lines may begin in the file before the one that starts with it
            spans = [(max(0, bisect.bisect_left(firsts, k) - 1), max(0, bisect.bisect_right(firsts, k) - 1)) for k in zip(keys, pages)]
            rows = [(n, k, p) for k, p, (a, b) in zip(keys, pages, spans) for n in range(a, b + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                names=["file", "surt", "page"],
            )

    def search(batches):
        reader, now = None, None
        for batch in batches:
            rows = []
            for number, key, page in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    reader, now = IndexReader(files.value[number][2]), number
                rows += [(page, x["archive"], x["offset"], x["length"]) for x in reader.find(key, page)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["page_id", "archive", "offset", "length"],
            )

    routed = wanted.select("url", F.col("page_id").cast("long")).distinct().mapInArrow(route, "file long, surt string, page long")
    # each index file's keys are split by range too, so a file in demand is served by several tasks
    ordered = routed.distinct().repartitionByRange(_tasks(spark), "file", "surt", "page").sortWithinPartitions("file", "surt", "page")
    return ordered.mapInArrow(search, found)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """The records at ``ranges`` (archive, offset, length), read in file order and checked."""

    def read(batches):
        source, opened = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            out, i = [], 0
            while i < len(rows):
                archive, start, length = rows[i]
                j, end = i + 1, start + length
                while j < len(rows) and rows[j][0] == archive and rows[j][1] - end <= READ_GAP and rows[j][1] + rows[j][2] - start <= READ_BYTES:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                if archive != opened:
                    store, name = _open(archive)
                    source, opened = store.open_input_file(name), archive
                source.seek(start)
                data = source.read(end - start)
                out += [read_record(data[o - start : o - start + n]) for _, o, n in rows[i:j]]
                i = j
            columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(columns, kinds)], names=columns)

    ordered = ranges.select("archive", "offset", "length").repartitionByRange(_tasks(ranges.sparkSession), "archive", "offset")
    ordered = ordered.sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages``, index the captures, look every page up and read its record back."""
    index = write_index(write_archives(pages))
    return read_ranges(lookup(pages.select("url", "page_id"), index))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BITS = "['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111']"
ORACLE = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41),
    lambda i: ({_BITS})[position(substr(sha1(body), i, 1) IN '0123456789abcdef')]), '') AS b FROM payloads
)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1
    + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
    + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM bits
"""
