"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing stays in the JVM and on any file system that Spark writes to: a record is a string of headers, an empty line
and the payload, and the CRLF CRLF that ends a record is the writer's line separator. A payload that an earlier record
holds is not written again: a ``revisit`` record points to that record.

Reading: one partition a file. The reader takes over equality and IN predicates on the record type and on the header
columns; it parses a record's headers first and skips the payload by its Content-Length (a seek in plain files; gzip is read on) if the predicates drop
the record or the payload is not asked for (``payload=false``).

Nulls and edge cases: a null html is an empty payload; null page_ids and urls have no header and read as null. Line
breaks in a url become a space. Payloads may hold anything, record headers too: lengths alone tell where they end. Rows
that share the smallest page_id of equal payloads are all responses; rows with a null page_id revisit a page that has
one. An empty table writes no record and reads as empty.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tessera.plans.staging import new_path

#: From this many bytes on, a payload is worth a revisit record.
MIN_REVISIT = 100
BATCH_BYTES = 8 << 20
#: Column of the data source -> header
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "page_id": "X-Page-Id",
    "payload_length": "X-Payload-Length",
    "refers_to_page": "X-Refers-To-Page",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload binary"


# Writing


def plan(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest, n_bytes, and refers_to: the page whose payload a revisit repeats.

    The digests of equal payloads meet in an aggregate that combines before its shuffle; only payloads that occur twice
    are joined back, and a hot one is split by the skew join."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.length(body).cast("long").alias("n_bytes"))
    twice = rows.filter(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    return rows.join(twice, "digest", "left").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def records(planned: DataFrame) -> DataFrame:
    """One string a record, without the CRLF CRLF at its end."""
    revisit = F.col("refers_to").isNotNull()
    name = lambda page: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.substring("digest", 1, 32), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value.cast("string"))
    headers = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, line("WARC-Refers-To", name(F.col("refers_to")))),
        line("X-Page-Id", F.col("page_id")),
        line("X-Payload-Length", F.col("n_bytes")),
        line("X-Refers-To-Page", F.col("refers_to")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))),
    )
    return planned.select(F.concat(headers, F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.coalesce("html", F.lit("")))).alias("record"))


def write(pages: DataFrame, path: str, records_per_file: int = 50_000) -> None:
    records(plan(pages)).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


# Reading


def _skip(stream, n: int) -> None:
    """Past a payload: by a seek where the file allows it, else in pieces that are dropped at once."""
    if stream.seekable():
        stream.seek(n, io.SEEK_CUR)
        return
    while n > 0:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise ValueError("the last record is cut off")
        n -= got


def parse(stream, wanted, payload: bool) -> Iterator[tuple[dict, int, bytes | None]]:
    """(Headers, content length, payload) of the records that ``wanted`` accepts by their headers."""
    while version := stream.readline():
        if version.strip() == b"":
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {version[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        n = int(headers.get("content-length", 0))
        if not wanted(headers):
            _skip(stream, n)
        elif not payload:
            _skip(stream, n)
            yield headers, n, None
        else:
            body = stream.read(n)
            if len(body) < n:
                raise ValueError("the last record is cut off")
            yield headers, n, body


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo) and f.value is not None:
                values = {f.value}
            elif column in HEADERS and isinstance(f, In):
                values = set(f.value)
            else:
                yield f
                continue
            self.equal[column] = self.equal.get(column, values) & values

    def partitions(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else "file://"
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        return [_File(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.size and f.base_name[0] not in "._"]

    def read(self, partition):
        from pyarrow import fs

        if not isinstance(partition, _File):  # no file at all
            return
        names = {c: h.lower() for c, h in HEADERS.items()}
        wanted = lambda h: all(h.get(names[c]) in v for c, v in self.equal.items())
        system, path = fs.FileSystem.from_uri(partition.uri)
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("content_length", pa.int64()), ("payload", pa.binary())])
        rows: list[tuple] = []
        size = 0

        def batch():
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        opened = system.open_input_stream(path, compression="gzip") if path.endswith(".gz") else system.open_input_file(path)
        with io.BufferedReader(opened, 1 << 20) as stream:
            for headers, n, body in parse(stream, wanted, self.payload):
                rows.append((*(headers.get(names[c]) for c in HEADERS), n, body))
                size += 300 + len(body or b"")
                if size > BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives, read them back, and return what the archives say of each page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    page, long = F.col("page_id").cast("long").alias("page_id"), lambda c: F.col(c).cast("long")
    full = read(spark, path).filter("record_type = 'response'")
    short = read(spark, path, payload=False).filter("record_type = 'revisit'")
    return full.select(page, F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        short.select(page, long("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", long("refers_to_page").alias("refers_to"))
    )
