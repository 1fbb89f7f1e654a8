"""The queries over the synthetic tables: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, licenses, media, mixing, pii, sharding, simhash, substring_dedup, toxicity, warc
from tessera.plans.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.store(docs).withColumn("n_bytes", F.length(F.coalesce("text", F.lit("")).cast("binary")).cast("long")).drop("text")
    return media.read(stored).select(
        "doc_id", "n_bytes", "decoded.payload_bytes", "decoded.payload_sha256", "decoded.tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "decoded.feature",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *[count(k) for k in pii.STRICT], base, pii.listed(F.col("spans")).alias("spans"), added)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit()
    return scanned.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stage(mixing.narrow(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "sizes")
    mixed = mixing.decided(sizes, mixing.thresholds(sizes))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.license", ",").alias("licenses"),
        F.round(F.coalesce(F.array_max("licenses.dice"), F.lit(0.0)), 6).alias("best_dice"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard(docs, 8, F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digest(substring_dedup.with_spans(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage(simhash.fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp"), "documents")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_media, op2_warc, op3_pii, op4_decontaminate, op5_toxicity, op6_mixing, op7_licenses, op8_sharding, op9_substring_dedup, op10_simhash)}
ORACLES: dict[str, str] = {
    "op7_licenses": licenses.oracle(),
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM m
    """,
    "op4_decontaminate": """
        WITH dw AS (
            SELECT doc_id, words FROM (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents)),
        bw AS (
            SELECT item_id, words, least(10, len(words)) AS k FROM (
                SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark) WHERE len(words) > 0),
        b AS (SELECT DISTINCT item_id, k, words[i + 1 : i + k] AS win FROM (SELECT *, unnest(range(len(words) - k + 1)) AS i FROM bw)),
        ks AS (SELECT DISTINCT k FROM b),
        dwin AS (SELECT doc_id, k, i, words[i + 1 : i + k] AS win FROM (
            SELECT doc_id, words, k, unnest(range(len(words) - k + 1)) AS i FROM dw CROSS JOIN ks WHERE len(words) >= k)),
        h AS (SELECT doc_id, item_id, i, k FROM dwin JOIN b USING (k, win)),
        hit AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY 1),
        it AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY 1)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op9_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        w AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 50], ' ') AS win FROM (SELECT *, unnest(range(len(words) - 49)) AS i FROM d WHERE len(words) >= 50)),
        f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM w JOIN f USING (win) WHERE first < doc_id),
        g AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY 1)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
               sha256(CASE WHEN ps IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(ps, i - 1)), ' ') END) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
}
