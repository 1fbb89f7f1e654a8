"""Snapshots from outside: manifests, files with different columns, batches that can be taken up again, arrays, logs, catalogs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import storage

SAFE = re.compile(r"^[A-Za-z0-9:/._=%+-]+$")
#: Words that make a text long enough for an index.
LEAST_WORDS = 20


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(date, url, records, bytes) of a JSON manifest ``{"date": ..., "files": [{"url", "records", "bytes"}]}``."""
    rows = spark.read.schema("date string, files array<struct<url:string,records:long,bytes:long>>").json(path, multiLine=True)
    return rows.select("date", F.explode("files").alias("f")).select("date", "f.url", "f.records", "f.bytes")


def read_by_name(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files as one table, columns matched by name; a column that a file lacks is null."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*paths)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited JSON with declared columns; other fields are left out."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A report's CSV with a header, all columns as text."""
    return spark.read.option("header", True).csv(path)


def from_arrays(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """Arrays of equal length as a table; they go over as Arrow columns."""
    return spark.createDataFrame(pa.table(columns))


def write_grouped(df: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """Parquet in files of so many rows, whole or not at all: written beside and renamed."""
    spark = df.sparkSession
    part = path + ".building"
    storage.remove(spark, part)
    df.write.option("maxRecordsPerFile", rows).option("parquet.block.size", 64 << 20).option("compression", "zstd").parquet(part)
    storage.remove(spark, path)
    storage.move(spark, part, path)


# Batches that can be taken up again


def fetch(spark: SparkSession, files: list[str], wanted: DataFrame, folder: str, batch: int = 20, most: int | None = None) -> dict:
    """Of files of works (doi, abstract_inverted_index, ...), those with an abstract whose DOI is wanted, a part for each batch of
    files. Parts that are there are not made again, so that a run that broke off goes on. Returns the progress, which is also
    written as ``progress.json``."""
    for f in files:
        if not SAFE.match(f):
            raise ValueError(f"unexpected characters in {f!r}")
    batches = [files[i : i + batch] for i in range(0, len(files), batch)]
    ids = wanted.select(F.lower("doi").alias("doi")).distinct()
    for i, group in enumerate(batches[:most]):
        part = f"{folder}/part-{i:04d}"
        if storage.status(spark, part):
            continue
        works = read_by_name(spark, *group).filter("doi IS NOT NULL AND abstract_inverted_index IS NOT NULL")
        works = works.select(F.lower(F.regexp_replace("doi", "^https://doi.org/", "")).alias("doi"), "id", F.col("abstract_inverted_index").alias("inverted"))
        write_grouped(works.join(ids, "doi", "left_semi"), part)
    done = [e.path for e in storage.listed(spark, folder) if e.is_folder and e.name.startswith("part-") and not e.name.endswith(".building")]
    kept = spark.read.parquet(*done).count() if done else 0
    progress = {"files": len(files), "batches": len(batches), "batches_done": len(done), "complete": len(done) == len(batches), "works_kept": kept}
    storage.write_json(spark, f"{folder}/progress.json", progress)
    return progress


def long_abstracts(works: DataFrame, inverted: str = "inverted") -> DataFrame:
    """Works with their abstract as text, if it has words enough; one work a DOI, that with the smallest id."""
    from tessera.sources.files import inverted_text

    texts = works.withColumn("abstract", inverted_text(inverted)).filter(F.size(F.split("abstract", " ")) >= LEAST_WORDS)
    return texts.groupBy("doi").agg(F.min(F.struct("id", "abstract")).alias("x")).select("doi", "x.id", "x.abstract")


def encode_missing(texts: DataFrame, encode, folder: str, batch: int = 100_000) -> int:
    """Adds vectors (id, e) of the texts (id, text) that a folder lacks, a batch of ids at a time, each written before the next; so
    a run that broke off goes on where it was. Returns how many were added."""
    spark = texts.sparkSession
    added = 0
    while True:
        have = storage.listed(spark, folder)
        left = texts.join(spark.read.parquet(folder).select("id"), "id", "left_anti") if have else texts
        part = left.orderBy("id").limit(batch)  # the parameter's batch, not a sample: the loop ends when none is left
        if (n := part.count()) == 0:
            return added
        part.select("id", encode(F.col("text")).alias("e")).write.mode("append").parquet(folder)
        added += n


# Logs and catalogs


def append_log(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines below a folder for each day of their column ``ts``."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(folder)


def read_log(spark: SparkSession, folder: str, schema: str, days: int, until: str) -> DataFrame:
    """The log's last so many days before and with a day; other days' files are not read."""
    rows = spark.read.schema(schema + ", day date").json(folder)
    return rows.filter(F.col("day").between(F.date_sub(F.lit(until).cast("date"), days - 1), F.lit(until).cast("date")))


def attach(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Views with a prefix over each table folder below a folder, other signs than letters and digits as an underscore: what
    attaching a store read-only is elsewhere."""
    names = []
    for e in storage.listed(spark, folder):
        if e.is_folder and not e.name.startswith((".", "_")):
            names.append(prefix + re.sub(r"\W", "_", e.name))
            spark.read.parquet(e.path).createOrReplaceTempView(names[-1])
    return names
