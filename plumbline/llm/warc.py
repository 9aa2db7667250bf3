"""WARC archives with a two-level capture index.

Writing: each task writes WARC/1.1 archives of gzip members, a record each, and returns a capture line for every
page's record (URL key, capture, file, offset, length). An archive begins with a warcinfo record and ends when it has
reached a fixed size. Blocks are HTTP responses. Of equal payloads of at least ``least`` bytes one is a response and
the others revisit it: they hold its head and the id of its record.

Index: capture lines sorted by the key, whose host is reversed, are cut into compressed blocks in a few index
files; a sparse directory beside each file holds the first key and the byte range of every block. Reading: a
lookup finds the index file, then the block, by binary search, reads that range, searches the block, and reads the
record's range from its archive.

Files are written below the shared folder through Arrow's file systems, named by partition and attempt; only the
capture lines of attempts that ended are used, so a lost executor leaves at most an unused file.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.scratch import Scratch

#: Capture lines of an index block, bytes at which an archive ends, and archives a reader holds open.
LINES, ROTATE, OPEN = 512, 1 << 30, 64
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "url_key string, capture string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels in reverse order, joined by commas, then ")" and the path with its query, lower-cased; "" for none."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(kind: str, fields: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [("WARC-Type", kind), *fields, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 5, mtime=0)


def http(payload: bytes, *, body: bool = True) -> bytes:
    """The payload as an HTTP response, or its head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + (payload if body else b"")


def _clean(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


class _Archive:
    """The archive that a task is writing; a new one begins where one is full."""

    def __init__(self, folder: str, run: uuid.UUID, date: str, rotate: int):
        self.fs, self.root = _opened(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.run, self.date, self.rotate, self.out, self.at, self.name = run, date, rotate, None, 0, ""

    def write(self, member: bytes) -> tuple[str, int]:
        """Name of the archive and the place at which the record begins."""
        if self.out is None or self.at >= self.rotate:
            self.close()
            self.name, self.at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
            fields = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(self.run, self.name)}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name)]
            self._put(record("warcinfo", fields, "application/warc-fields", b"software: plumbline\r\nformat: WARC File Format 1.1\r\n"))
        at = self.at
        self._put(member)
        return self.name, at

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.at += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _writer(folder: str, run_id: str, date: str, rotate: int = ROTATE):
    def run(batches):
        own = uuid.UUID(run_id)
        archive = _Archive(folder, own, date, rotate)
        name_of = lambda capture: f"<urn:uuid:{uuid.uuid5(own, capture)}>"
        try:
            for batch in batches:
                captured = []
                for at_row in range(0, batch.num_rows, 128):
                    for row in batch.slice(at_row, 128).to_pylist():
                        payload = row["html"] or b""
                        capture = f"{row['page_id']}~{row['copy']}" if row["page_id"] is not None else f"None~{uuid.uuid4().hex}"
                        fields = [("WARC-Record-ID", name_of(capture)), ("WARC-Date", date), ("WARC-Target-URI", row["url"] or f"urn:page:{capture}"), ("WARC-Payload-Digest", f"sha256:{row['digest']}")]
                        if row["revisit"]:
                            fields += [("WARC-Refers-To", name_of(row["first"])), ("WARC-Profile", _REVISIT)]
                        member = record("revisit" if row["revisit"] else "response", fields, "application/http; msgtype=response", http(payload, body=not row["revisit"]))
                        captured.append((url_key(row["url"]), capture, *archive.write(member), len(member)))
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in captured], _SCHEMA.types[k]) for k in range(5)], schema=_SCHEMA)
        finally:
            archive.close()

    return run


_SCHEMA = pa.schema([("url_key", pa.string()), ("capture", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _indexer(folder: str):
    """Writes the sorted capture lines of a partition as blocks and a directory; returns a row for the file."""

    def run(batches):
        fs, root = _opened(folder)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        fs.create_dir(root, recursive=True)
        directory, held, at, out = [], [], 0, None

        def flush():
            nonlocal at, held, out
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}.blocks", compression=None)
            block = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            out.write(block)
            directory.append([held[0][:2], at, len(block)])
            at += len(block)
            held = []

        for batch in batches:
            for row in batch.to_pylist():
                held.append([row["url_key"], row["capture"], row["file"], row["offset"], row["length"]])
                if len(held) == LINES:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.directory", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory).encode(), 6))
            yield pa.RecordBatch.from_pylist([{"name": name, "key": directory[0][0][0], "capture": directory[0][0][1]}])

    return run


class Index:
    """Lookups in one index file: its directory in memory, one block at a time."""

    def __init__(self, folder: str, name: str):
        self.fs, self.root = _opened(folder)
        with self.fs.open_input_stream(f"{self.root}/{name}.directory", compression=None) as f:
            self.directory = json.loads(zlib.decompress(f.read()))
        self.firsts = [tuple(k) for k, _, _ in self.directory]
        self.file = self.fs.open_input_file(f"{self.root}/{name}.blocks")
        self.held, self.lines = -1, []

    def find(self, key: str, capture: str) -> tuple[str, int, int] | None:
        """File, offset and length of a capture."""
        k = bisect.bisect_right(self.firsts, (key, capture)) - 1
        if k < 0:
            return None
        if k != self.held:
            _, offset, length = self.directory[k]
            block = zlib.decompress(self.file.read_at(length, offset)).decode()
            self.held, self.lines = k, [tuple(json.loads(x)) for x in block.split("\n")]
        i = bisect.bisect_left(self.lines, (key, capture))
        if i < len(self.lines) and self.lines[i][:2] == (key, capture):
            return self.lines[i][2:]
        return None


_READ = "page_id long, record_type string, record_id string, refers_to string, read_bytes long, read_digest string"


def _reader(archives: str, index: str, names):
    """Looks captures up and reads their records."""

    def run(batches):
        files = names.value
        firsts = [(k, c) for k, c, _ in files]
        fs, root = _opened(archives)
        opened: OrderedDict[str, pa.NativeFile] = OrderedDict()
        current: tuple[int, Index] | None = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                key, capture = row["url_key"], row["capture"]
                k = max(0, bisect.bisect_right(firsts, (key, capture)) - 1)
                if current is None or current[0] != k:
                    current = (k, Index(index, files[k][2]))
                place = current[1].find(key, capture)
                if place is None:
                    raise LookupError(f"no capture {capture} of {key}")
                name, offset, length = place
                if name not in opened:
                    if len(opened) >= OPEN:
                        opened.popitem(last=False)[1].close()
                    opened[name] = fs.open_input_file(f"{root}/{name}")
                opened.move_to_end(name)
                fields, block = parse(opened[name].read_at(length, offset))
                payload = block.partition(b"\r\n\r\n")[2]
                digest = hashlib.sha256(payload).hexdigest()
                if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha256:{digest}":
                    raise ValueError(f"the payload of {capture} is not the one written")
                page = capture.partition("~")[0]
                rows.append((None if page == "None" else int(page), fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), len(payload), digest))
            names_ = ("page_id", "record_type", "record_id", "refers_to", "read_bytes", "read_digest")
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=list(names_))

    return run


def round_trip(spark: SparkSession, pages: DataFrame, *, least: int = 100, date: str | None = None) -> DataFrame:
    """Writes pages as WARC archives, indexes them, looks every capture up and reads it back.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to. The payload is the
    html in UTF-8, a null empty. Of records with equal payloads of at least ``least`` bytes the one with the smallest
    page_id is a response and the others revisit it; of rows that repeat that page_id one is. Bytes and digest of a
    revisit are those of the response it refers to, as read. A null page_id sorts last; a group without any page_id
    has responses only. A row without a url gets one made of its page_id. Other columns are not read. An empty table
    gives an empty table. date is the records' WARC-Date (now, if None).
    """
    scratch = Scratch(spark, "warc")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    # Rows that repeat a page_id are numbered; most ids have one row, and only where one has more is a window needed.
    same = F.coalesce(F.col("page_id").cast("string"), F.concat_ws("~", "digest", "url"))
    if base.where("page_id is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        numbered = base.withColumn("copy", F.lit(0).cast("long"))
    else:
        numbered = base.withColumn("copy", F.row_number().over(Window.partitionBy(same).orderBy("digest", "url")).cast("long") - 1)
    # Digests of one row need no join; written, so that the join has no aggregate below it and a hot digest can be split.
    groups = numbered.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "copy"))).alias("f"))
    groups = groups.where("c > 1 and f is not null")
    groups = scratch.save(groups.select(F.col("digest").alias("d"), F.concat_ws("~", F.col("f.page_id").cast("string"), F.col("f.copy").cast("string")).alias("first")), "groups")
    flagged = numbered.join(groups, (F.col("digest") == F.col("d")) & (F.octet_length("html") >= least), "left").drop("d")
    own = F.concat_ws("~", F.coalesce(F.col("page_id").cast("string"), F.lit("None")), F.col("copy").cast("string"))
    flagged = flagged.withColumn("revisit", F.coalesce(F.col("first") != own, F.lit(False)))
    folder = scratch.path("archives")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    written = flagged.select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "copy", "first", "revisit")
    captures = scratch.save(written.mapInArrow(_writer(folder, str(uuid.uuid4()), date), _CAPTURE), "captures")
    ordered = captures.repartitionByRange("url_key", "capture").sortWithinPartitions("url_key", "capture")
    index = scratch.path("index")
    files = scratch.save(ordered.mapInArrow(_indexer(index), "name string, key string, capture string"), "files").orderBy("key", "capture").collect()
    names = spark.sparkContext.broadcast([(r.key, r.capture, r["name"]) for r in files])
    wanted = captures.select("url_key", "capture").repartitionByRange("url_key", "capture").sortWithinPartitions("url_key", "capture")
    read = scratch.save(wanted.mapInArrow(_reader(folder, index, names), _READ), "read")
    target = read.where("record_type = 'response'").select(F.col("record_id").alias("t"), F.col("page_id").alias("tp"), F.col("read_bytes").alias("tb"), F.col("read_digest").alias("td"))
    out = read.join(target, read.refers_to == target.t, "left")
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "page_id", F.when(revisit, F.col("tb")).otherwise(F.col("read_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("td")).otherwise(F.col("read_digest")).alias("payload_digest"), "record_type", F.col("tp").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY digest)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
