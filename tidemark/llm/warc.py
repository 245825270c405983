"""WARC archives: written with revisit records, and read back sequentially.

Writer: one gzip member a record, so that any record can be reached by its offset. Records of equal payloads share a
digest; of each group the record with the largest id is the ``response``, the others are ``revisit`` records that refer to it and hold no
payload of their own. Reader: one pass over a file's bytes; members are inflated by an incremental ``zlib`` decompressor, a record's
block is framed by its Content-Length, and its digest is verified. ``verified`` then holds every revisit against the archives' responses: one
with the page id it refers to, its payload digest and its length must be there.

Files are written by the executors into the shared folder through a file system chosen by its scheme. Each task writes to a name of its own
and renames the file when it is whole, and only files in the written manifest are read: a lost executor's
half-written file is never seen. Memory is bounded by a record and a read buffer.

Cases: null payloads are empty; empty payloads are a group like any other if ``least`` is 0; payloads smaller than ``least`` are
all responses; repeated ids with equal payloads: the one of the largest url is the response, and one of rows that are equal altogether; a
null id is smaller than all others; null urls are written as an empty target; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Work, freeing, materialise, table

#: Date of all records: archives of the same pages are equal byte for byte.
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 16
#: Copies of a group's response, so that the records of a very large group are joined in as many tasks.
SALTS = 64
COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None, refers: bool) -> bytes:
    """A WARC record as one gzip member."""
    uid = lambda x: f"<urn:page:{'null' if x is None else x}>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not refers:
        block += payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {uid(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url),
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers:
        fields += [f"WARC-Refers-To: {uid(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Damaged(ValueError):
    """A record that is cut short, badly framed, or does not match its digest."""


def members(source: BinaryIO, size: int = READ) -> Iterator[bytes]:
    """The inflated members of a stream of gzip members, read once from front to back."""
    z, parts, left = zlib.decompressobj(31), [], b""
    while True:
        data = left or source.read(size)
        if not data:
            break
        left = b""
        try:
            parts.append(z.decompress(data))
        except zlib.error as e:
            raise Damaged(str(e)) from e
        if z.eof:
            yield b"".join(parts)
            left, z, parts = z.unused_data, zlib.decompressobj(31), []
            if not left:
                left = source.read(size)
                if not left:
                    return
    if any(parts) or not z.eof:
        raise Damaged("the last member is cut short")


def read(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, HTTP body) of every record; framing and block digest are verified."""
    for raw in members(source):
        head, sep, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not sep or not lines[0].startswith("WARC/1."):
            raise Damaged("no WARC header")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields.get("content-length", -1))
        if n < 0 or rest[n:] != b"\r\n\r\n":
            raise Damaged("the block is not as long as Content-Length says")
        block = rest[:n]
        if f"sha1:{digest(block)}" != fields["warc-block-digest"]:
            raise Damaged("block digest")
        http, _, body = block.partition(b"\r\n\r\n")
        fields["http-content-length"] = next(v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")) if k.lower() == "content-length")
        if fields["warc-type"] == "response" and f"sha1:{digest(body)}" != fields["warc-payload-digest"]:
            raise Damaged("payload digest")
        yield fields, body


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, payload, sha, size) with u: 0, and 0, 1, 2, … for rows that are equal altogether. Payloads move only where there are such rows."""
    key = ["page_id", "url", "sha", "size"]
    with freeing(rows.sparkSession):
        twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*[F.col(k).alias(f"d_{k}") for k in key])
        if twice.isEmpty():
            return rows.withColumn("u", F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"d_{k}")) for k in key]
    equal = rows.join(twice, same, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.first("payload").alias("payload"))
    equal = equal.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("c").cast("int") - 1)))
    alone = rows.join(twice, same, "left_anti").withColumn("u", F.lit(0))
    return alone.unionByName(equal.select(*alone.columns))


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the archives; returns the manifest: file, records."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    rows = _numbered(rows)
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("k"), "url", "u")
    light = rows.select("sha", "size", "page_id", order.alias("o"))  # no payload is shuffled to form the groups
    groups = light.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("o").alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.least(F.col("c"), F.lit(SALTS)).cast("int") - 1)))
    many = copies.select(F.col("sha").alias("g_sha"), F.col("size").alias("g_size"), "salt", "top", F.least(F.col("c"), F.lit(SALTS)).alias("n"))
    # the number of copies is not known to a record before the join: it meets each count it may have
    salted = rows.withColumn("key", F.pmod(F.xxhash64("page_id", "url", "u"), F.lit(SALTS)))
    spread = many.withColumn("key", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda x: x % F.col("n") == F.col("salt"))))
    own = salted.join(spread, (F.col("sha") == F.col("g_sha")) & (F.col("size") == F.col("g_size")) & (salted["key"] == spread["key"]), "left")
    first = F.col("top").isNull() | ((F.coalesce("page_id", F.lit(-(1 << 63))) == F.col("top.k")) & (F.col("url") == F.col("top.url")) & (F.col("u") == F.col("top.u")))
    ready = own.select("page_id", "url", "payload", (~first).alias("refers"), F.when(F.col("top.k") > -(1 << 63), F.col("top.k")).alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, out = f"{folder}/{uuid.uuid4().hex}", 0, None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers", "to")), strict=True):
                page_id, url, body, refers, to = (x.as_py() for x in row)
                if out is None:
                    fs, path = _open(f"{name}.part")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                out.write(record(page_id, url, body, digest(body), to if refers else None, refers))
                n += 1
        if out is not None:
            out.close()
            fs.move(path, path.removesuffix(".part") + ".warc.gz")
            yield pa.RecordBatch.from_pydict({"file": pa.array([f"{name}.warc.gz"]), "records": pa.array([n], pa.int64())})

    return ready.mapInArrow(run, "file string, records long")


def contents(files: DataFrame) -> DataFrame:
    """The records of the archives in column ``file``, each read once from front to back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None or "null" in x else int(x.rpartition(":")[2].rstrip(">"))
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                fs, path = _open(uri)
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None) as source:
                    for fields, _ in read(source):
                        kind = fields["warc-type"]
                        rows.append((number(fields["warc-record-id"]), int(fields["http-content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), kind, number(fields.get("warc-refers-to"))))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return files.select("file").mapInArrow(run, COLUMNS)


def verified(records: DataFrame) -> DataFrame:
    """``records``, a written table, if every revisit refers to a response that is there, with its digest and length; else ``Damaged`` is raised.
    Counts by target are summed up before they move, so that a group of any size is no more than a row of each task."""
    target = F.when(F.col("record_type") == "revisit", F.col("refers_to")).otherwise(F.col("page_id"))
    by = records.groupBy(target.alias("target"), "payload_digest", "payload_bytes")
    found = by.agg(F.count(F.when(F.col("record_type") == "response", 1)).alias("responses"), F.count(F.when(F.col("record_type") == "revisit", 1)).alias("revisits"))
    bad = found.where("revisits > 0 and responses = 0").select("target").limit(1).collect()
    if bad:
        raise Damaged(f"a revisit refers to page {bad[0]['target']}, which has no response of its digest and length")
    return records


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and returns what was read, verified. The archives stay if ``folder`` names their place; else they go when they have been read."""
    with Work(pages.sparkSession) as work:
        manifest = work.save(write(pages, folder or work.folder("warc")), "manifest")
        return verified(materialise(contents(manifest.repartition(max(1, manifest.count()), "file")), "records"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


_B32 = "".join(f"|| substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, {5 * i + 1}, 5))::INT >> {k}) & 31) + 1, 1)" for i in range(8) for k in (15, 10, 5, 0))[3:]
ORACLE = f"""SELECT page_id, n::BIGINT AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS top FROM (SELECT page_id, sha1(coalesce(html, '')) AS s, strlen(coalesce(html, '')) AS n FROM pages))"""
