"""WARC archives with revisits resolved.

Headers (identity, payload digest and size) are shuffled by digest; of each payload that is large
enough one record keeps it and the others become revisits of it. Tasks write .warc.gz files of about
FILE_BYTES of records, a warcinfo record first and one gzip member a record, as WARC tools expect. A
file's name belongs to one attempt of one task; the list of files that Spark commits says which count, and
files of lost or repeated attempts are deleted. Archives are read back record by record, and revisits are
joined to the responses they refer to.

Records carry the page's id in the fields Page-ID and Refers-To-Page-ID, beside the standard ones (readers
ignore fields that they don't know); record ids are random, so no two runs share one.

Defined cases: a null html is an empty payload; payloads below `min_bytes` are always responses; of
equal payloads the largest page_id is the response (a null page_id is smaller than any other); rows
repeating both page_id and html are one response each; a revisit whose response is not in the archives
stays, without payload_bytes; an empty table gives no files and no records. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.envelope import exists
from .common import delete, lookup_by_group, new_path, stage

MIN_BYTES = 1000
FILE_BYTES = 32 << 20
SEPARATOR = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
STANDARD = "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))


def resolve(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(revisit_page, digest, refers_to, refers_url) of the records that become revisits. rows: staged headers."""
    large = rows.where(F.col("bytes") >= min_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("refers_url"), F.count("*").alias("n"))
    copied = stage(groups.where("n > 1"), "copied")
    found = lookup_by_group(large, copied, "digest", "n")
    copies = found.where("not page_id <=> original and original is not null")
    return copies.select(F.col("page_id").alias("revisit_page"), "digest", F.col("original").alias("refers_to"), "refers_url")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of a path as Spark writes them; HDFS and object stores as Arrow supports them."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + SEPARATOR) + packer.flush()


def _page_record(row: tuple, date: str) -> bytes:
    page_id, url, html, digest, refers_to, refers_url = row
    uri = lambda u: (u or "").replace("\r", "").replace("\n", "")
    fields = [
        ("WARC-Target-URI", uri(url)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is None:
        return _record("response", fields, HTTP + html.encode("utf-8", "surrogatepass"))
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", uri(refers_url)), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", str(refers_to))]
    return _record("revisit", fields, HTTP)


def _writer(path: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(path)
        attempt, done, out, size, count = uuid.uuid4().hex, [], None, 0, 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name = f"pages-{TaskContext.get().partitionId():06d}-{attempt}-{len(done):04d}.warc.gz"
                    out, size, count = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                    info = f"software: tallyloom\r\nformat: WARC File Format 1.1\r\nconformsTo: {STANDARD}\r\n"
                    out.write(_record("warcinfo", [("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info.encode()))
                member = _page_record(row, date)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["file", "records"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write deduplicated archives below path and return the list of files with their records.

    date: that of all records, by default now. Revisits refer to the URI and date of their response.
    """
    spark = pages.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = stage(headers(pages), "headers")
    revisits = resolve(rows, min_bytes).distinct()
    html = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("_html")).withColumn("_digest", F.sha1("_html"))
    met = html["page_id"].eqNullSafe(revisits["revisit_page"]) & (html["_digest"] == revisits["digest"])
    records = html.join(revisits, met, "left").select("page_id", "url", "_html", "_digest", "refers_to", "refers_url")
    store, folder = _open(path)
    store.create_dir(folder, recursive=True)
    records.mapInArrow(_writer(path, date, file_bytes), "file string, records long").write.parquet(f"{path}/list")
    written = spark.read.schema("file string, records long").parquet(f"{path}/list")
    found = _files(spark, path).withColumn("file", F.regexp_extract("path", "([^/]+)$", 1))
    for lost in found.join(written, "file", "left_anti").toLocalIterator():  # those of attempts that did not count
        delete(spark, lost.path)
    return written


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The paths of the archives; their contents are not read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one at a time."""
    while data:
        unpacker = zlib.decompressobj(31)
        yield unpacker.decompress(data) + unpacker.flush()
        data = unpacker.unused_data


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _identity(value: str | None) -> int | None:
    return int(value) if value else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = _open(path)
            with store.open_input_stream(name, compression=None) as file:
                data = file.read()
            out, size = [], 0
            for member in members(data):
                fields, block = parse_record(member)
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                out.append((_identity(fields["Page-ID"]), fields["WARC-Target-URI"], kind, digest, _identity(fields.get("Refers-To-Page-ID")), payload))
                size += len(block)
                if size >= 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
            yield _batch(out)


NAMES = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload"]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; a revisit has no payload of its own."""
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"
    return _files(spark, path).mapInArrow(_read, schema)


def resolved_records(spark: SparkSession, path: str) -> DataFrame:
    """Records read back, revisits joined to their responses: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is taken from the payload as read.
    """
    read = read_archives(spark, path).select(
        "page_id",
        "record_type",
        F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "refers_to",
        F.octet_length("payload").cast("long").alias("bytes"),
    )
    rows = stage(read, "records")
    revisits = rows.where("record_type = 'revisit'")
    originals = rows.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("original_digest"), F.col("bytes").alias("payload_bytes")
    )
    referred = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    groups = stage(referred.join(originals, "refers_to").dropDuplicates(["refers_to", "original_digest"]), "originals")
    met = lookup_by_group(revisits, groups, "refers_to", "n").where("original_digest = payload_digest")
    keys = originals.select("refers_to", F.col("original_digest").alias("payload_digest"))
    lost = revisits.join(keys, ["refers_to", "payload_digest"], "left_anti").withColumn("payload_bytes", F.lit(None).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = rows.where("record_type = 'response'").withColumnRenamed("bytes", "payload_bytes")
    return responses.select(columns).unionByName(met.select(columns)).unionByName(lost.select(columns))


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved_records(spark, path)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
             max(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
FROM s
"""
