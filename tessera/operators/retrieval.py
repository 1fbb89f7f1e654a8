"""Retrieval: inverted index, BM25, dense similarity, rank fusion and their evaluation.

The queries are the benchmark's items, a stated set that is small beside the texts; its tokens are joined to the
postings, so only the postings of query tokens are read on. Postings and lengths are written once a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.portable import all_words, tokens
from tessera.operators import dense
from tessera.plans.tables import Query, Tables

col = F.col
K1, B = 1.5, 0.75
TOP = 10
RRF = 60
MAX_TOKENS = 16
#: Postings that a query's tokens may have together, and the tokens that are kept whatever they have.
MAX_POSTINGS, MIN_TOKENS = 3_000_000, 3


def _post(t: Tables) -> DataFrame:
    return t.texts.select("id", F.explode(tokens(col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def postings(t: Tables) -> DataFrame:
    """(id, token, tf), made once a plan."""
    return t.once("postings", _post)


def lengths(t: Tables) -> DataFrame:
    """(id, len) of all texts, those without a token too."""
    return t.once("lengths", lambda t: t.texts.select("id", F.coalesce(F.size(tokens(col("text"))), F.lit(0)).alias("len")))


def query_tokens(t: Tables, most: int = MAX_TOKENS, budget: int = MAX_POSTINGS, least: int = MIN_TOKENS, items: DataFrame | None = None) -> DataFrame:
    """The rarest tokens of each query that occur in the texts at all, as far as their postings stay within a budget; but a
    few in any case."""
    q = (t.table("benchmark") if items is None else items).select("item_id", F.explode(F.array_distinct(tokens(col("text")))).alias("token"))
    df = postings(t).join(q.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    w = Window.partitionBy("item_id").orderBy("df", "token")
    cost = F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return q.join(df, "token").withColumns({"r": F.row_number().over(w), "cost": cost}).filter((col("r") <= most) & ((col("cost") <= budget) | (col("r") <= least))).drop("cost")


def bm25(t: Tables, k1: float = K1, b: float = B, binary: bool = True, items: DataFrame | None = None, among=None) -> DataFrame:
    """(item_id, id, score): Okapi BM25 with binary or true term frequency; of the texts that a predicate admits."""
    stats = lengths(t).agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = F.lit(1.0) if binary else col("tf").cast("double")
    idf = F.log(1 + (col("n") - col("df") + 0.5) / (col("df") + 0.5))
    used = t.once("query_tokens", query_tokens) if items is None else query_tokens(t, items=items)
    hit = used.join(postings(t), "token").join(lengths(t), "id").crossJoin(F.broadcast(stats))
    if among is not None:
        hit = hit.join(t.texts.filter(among).select("id"), "id", "left_semi")
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * col("len") / col("mean")))
    return hit.groupBy("item_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def top(scored: DataFrame, k: int = TOP, query: str = "item_id") -> DataFrame:
    w = Window.partitionBy(query).orderBy(col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(col("rank") <= k)


TEXT_CTES = f"""
tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM texts),
post AS (SELECT id, token, count(*) AS tf FROM tok GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM benchmark),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT item_id, token, df, row_number() OVER w AS r FROM q JOIN dfs USING (token) WINDOW w AS (PARTITION BY item_id ORDER BY df, token ROWS UNBOUNDED PRECEDING) QUALIFY r <= {MAX_TOKENS} AND (sum(df) OVER w <= {MAX_POSTINGS} OR r <= {MIN_TOKENS})),
lens AS (SELECT id, coalesce(len(regexp_extract_all(lower(text), '[a-z]{{3,}}')), 0) AS len FROM texts),
st AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
bm AS (SELECT item_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * {K1 + 1} / (1 + {K1} * ({1 - B} + {B} * len / mean))), 6) AS score FROM qt JOIN post USING (token) JOIN lens USING (id), st GROUP BY 1, 2),
bmtf AS (SELECT item_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN post USING (token) JOIN lens USING (id), st GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= {TOP}),
tf AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM bmtf QUALIFY rank <= {TOP})
"""


def cosine_top(t: Tables, k: int = TOP) -> DataFrame:
    """For every hundredth vector, its nearest others by cosine."""
    v = t.table("embeddings").select(col("vec_id").alias("id"), col("embedding").alias("e"), "label")
    found = dense.nearest(v.filter("id % 100 = 0").select(col("id").alias("item_id"), "e"), v.select("id", "e"), k, others_only=True)
    label = v.select("id", "label")
    return found.join(label, "id").join(label.select(col("id").alias("item_id"), col("label").alias("want")), "item_id")


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
COSINE = f"cos AS (SELECT * FROM (SELECT q.vec_id AS item_id, v.vec_id AS id, q.label AS want, v.label, round({DOT.format('q.embedding', 'v.embedding')} / sqrt({DOT.format('q.embedding', 'q.embedding')} * {DOT.format('v.embedding', 'v.embedding')}), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) <= {TOP})"


def rrf(*rankings: tuple[DataFrame, float], k: int = RRF) -> DataFrame:
    """(item_id, id, score): reciprocal ranks of weighted rankings, added."""
    each = [r.select("item_id", "id", (F.lit(w) / (k + col("rank"))).alias("x")) for r, w in rankings]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.groupBy("item_id", "id").agg(F.round(F.sum("x"), 9).alias("score"))


def rrf_imputed(a: DataFrame, b: DataFrame, k: int = RRF, missing: int = TOP + 1) -> DataFrame:
    """Fusion in which an item that one ranking lacks gets the rank after its last."""
    both = a.select("item_id", "id", col("rank").alias("ra")).join(b.select("item_id", "id", col("rank").alias("rb")), ["item_id", "id"], "full")
    return both.withColumn("score", F.round(1.0 / (k + F.coalesce("ra", F.lit(missing))) + 1.0 / (k + F.coalesce("rb", F.lit(missing))), 9))


def _relevance(t: Tables) -> DataFrame:
    """Whether a text holds an item word for word; only texts that share the item's rarest tokens are looked at."""
    ranked = top(bm25(t)).join(t.texts.select("id", "text"), "id").join(t.table("benchmark").select("item_id", col("text").alias("item")), "item_id")
    return ranked.select("item_id", "id", "rank", F.contains("text", col("item")).alias("hit"))


def _metrics(t: Tables) -> DataFrame:
    best = _relevance(t).groupBy("item_id").agg(F.min(F.when(col("hit"), col("rank"))).alias("first"))
    every = t.table("benchmark").select("item_id").distinct().join(best, "item_id", "left")
    at = lambda k: F.avg((F.coalesce("first", F.lit(9999)) <= k).cast("int")).alias(f"r{k}")
    return every.agg(F.count("*").alias("queries"), at(1), at(5), F.avg(F.coalesce(1.0 / col("first"), F.lit(0.0))).alias("mrr"))


def _topup(t: Tables) -> DataFrame:
    """Texts with both words that the sparse ranking of no query has."""
    return t.texts.filter(all_words(col("text"), ["idiot", "the"])).join(top(bm25(t)).select("id"), "id", "left_anti").select("id", "source")


QUERIES = {
    "query_tokens": Query("item_id:l token:s df:l r:l", query_tokens, "SELECT * FROM qt", TEXT_CTES),
    "inverted_index": Query("token:s df:l tf:l", lambda t: postings(t).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), "SELECT token, count(*) AS df, sum(tf) AS tf FROM post GROUP BY 1", TEXT_CTES),
    "bm25_topk": Query("item_id:l id:l score:d rank:l", lambda t: top(bm25(t)), "SELECT * FROM sparse", TEXT_CTES),
    "pool_bm25_tf": Query("item_id:l id:l score:d rank:l", lambda t: top(bm25(t, 1.2, 0.75, binary=False)), "SELECT * FROM tf", TEXT_CTES),
    "cosine_topk": Query("item_id:l id:l score:d", cosine_top, "SELECT item_id, id, score FROM cos", COSINE),
    "rrf_fusion": Query("item_id:l id:l score:d", lambda t: rrf((top(bm25(t)), 0.7), (top(bm25(t, 1.2, 0.75, binary=False)), 1.0)), "SELECT item_id, id, round(sum(x), 9) AS score FROM (SELECT item_id, id, 0.7::DOUBLE / (60 + rank) AS x FROM sparse UNION ALL SELECT item_id, id, 1.0::DOUBLE / (60 + rank) FROM tf) GROUP BY 1, 2", TEXT_CTES),
    "rrf_impute": Query("item_id:l id:l score:d", lambda t: rrf_imputed(top(bm25(t)), top(bm25(t, 1.2, 0.75, binary=False))), "SELECT item_id, id, round(1.0::DOUBLE / (60 + coalesce(a.rank, 11)) + 1.0::DOUBLE / (60 + coalesce(b.rank, 11)), 9) AS score FROM sparse a FULL JOIN tf b USING (item_id, id)", TEXT_CTES),
    "exact_topup": Query("id:l source:s", _topup, "SELECT id, source FROM texts WHERE text ILIKE '%idiot%' AND text ILIKE '%the%' AND id NOT IN (SELECT id FROM sparse)", TEXT_CTES),
    "retrieval_metrics": Query("queries:l r1:d r5:d mrr:d", _metrics, "SELECT count(*) AS queries, avg((coalesce(first, 9999) <= 1)::INT) AS r1, avg((coalesce(first, 9999) <= 5)::INT) AS r5, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN (SELECT item_id, min(rank) FILTER (contains(d.text, b.text)) AS first FROM sparse JOIN texts d USING (id) JOIN benchmark b USING (item_id) GROUP BY 1) USING (item_id)", TEXT_CTES),
}
