"""Publishing a dataset: files of one graph, with checksums and a manifest, made current by one pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import storage

MANIFEST, CHECKSUMS = "manifest.json", "SHA256SUMS"


def check_same_graph(stats: dict, metrics: dict) -> None:
    """A table of measures has to describe the graph that is published."""
    named = {"fingerprint": ("snapshot", "snapshot"), "nodes": ("nodes", "nodes"), "edges": ("edges", "edges")}
    wrong = [f"{what}: the graph has {stats.get(a)}, the table {metrics.get(b)}" for what, (a, b) in named.items() if stats.get(a) != metrics.get(b)]
    if wrong:
        raise ValueError("not the same graph; " + "; ".join(wrong))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of a folder's files, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).filter(~F.element_at(F.split("name", "/"), -1).rlike(r"^[._]"))


def publish(tables: dict[str, DataFrame], root: str, version: str, stats: dict, metrics: dict, write=None) -> dict:
    """Writes the tables as a version below a root, with checksums and a manifest, and makes it current. A version that is not
    finished is never pointed at; older ones are removed. Returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    check_same_graph(stats, metrics)
    final, part = f"{root}/{version}", f"{root}/{version}.building"
    storage.remove(spark, part)
    for name, df in tables.items():
        (write or (lambda d, p: d.write.parquet(p)))(df, f"{part}/{name}")
    listed = sorted((r["name"], r["bytes"], r["sha256"]) for r in checksums(spark, part).collect())  # a row a file
    storage.write_text(spark, f"{part}/{CHECKSUMS}", "".join(f"{h}  {n}\n" for n, _, h in listed))
    manifest = {"version": version, "stats": stats, "metrics": metrics, "files": [{"name": n, "bytes": b, "sha256": h} for n, b, h in listed]}
    storage.write_json(spark, f"{part}/{MANIFEST}", manifest)
    storage.move(spark, part, final)
    storage.switch(spark, root, version)
    storage.clean(spark, root, version.split("-")[0])
    return manifest
