"""The corpus pipeline: documents in, sharded training documents out.

Each stage gets what its predecessor kept. All but the last return the columns of their input; the last adds shard and
slot. A stage that looks at rows twice tells them by their place in the table, so its input has to be a written table,
as between the stages. Other columns may have any names: they travel in one struct where a stage has columns of its own;
only the last stage replaces columns named shard and slot. The toxicity model has no SQL form, so there is no SQL for the
whole; tests hold each stage against slow versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, near_copies, sharding, toxicity
from tessera.llm.columns import kept, packed
from tessera.plans.staging import drop, scope, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    rows = packed(docs).withColumn("text", F.col("doc.text"))
    return toxicity.score(rows, model).filter(F.col("score") < toxicity.THRESHOLD).select(*kept(docs, name="doc"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard similarity of five-word shingles of 0.8 or more) stays: that
    with the smallest doc_id, and the first of its rows."""
    row = F.monotonically_increasing_id().alias("row")
    found = stage(near_copies.near_copies(docs.select(row, "doc_id", "text")), "groups")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("first.row")
    gone = found.select("row").join(first, "row", "left_anti")
    return packed(docs).withColumn("row", row).join(gone, "row", "left_anti").select(*kept(docs, name="doc"))


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = packed(docs).withColumn("text", F.col("doc.text"))
    scanned = decontaminate.scan(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return decontaminate.remove_documents(scanned).select(*kept(docs, name="doc"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.take(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in shards of nearly equal bytes, in order of doc_id."""
    return sharding.shard(docs, 8, F.length(F.coalesce("text", F.lit("")).cast("binary")) + 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmarks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written, and what its stage wrote on the way is removed, as is the result before it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        with scope(spark) as kept_tables:
            docs = stage(step(spark, docs, sf_dir), name)
            kept_tables.append(docs)
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
