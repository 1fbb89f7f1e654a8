"""Hybrid search over texts and what is built on it: query statistics, fusion with a weight ramp, filters, pools of several
rankings, an index of long texts, passages, contexts, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.portable import tokens
from tessera.operators import dense
from tessera.operators.retrieval import RRF, TEXT_CTES, TOP, bm25, lengths, postings, query_tokens, rrf, top
from tessera.plans.tables import Query, Tables

col = F.col
#: The word ranking counts nothing up to the first share of query tokens that its best text holds, and fully from the second.
COVERAGE_FLOOR, COVERAGE_FULL = 0.5, 0.7
#: Long texts have so many words.
LONG = 20
#: Words of each text in a context, and texts in it.
CONTEXT_WORDS, CONTEXT_TEXTS = 30, 3
SYNONYMS = [("the", "this"), ("and", "with"), ("that", "which"), ("der", "jener"), ("les", "des"), ("una", "otra")]


def query_stats(t: Tables) -> DataFrame:
    """Of each query: its tokens, the document frequency of the rarest, how specific that is, and which share of the tokens
    its best text by words holds."""
    n = lengths(t).agg(F.count("*").alias("n"))
    used = t.once("query_tokens", query_tokens)
    best = top(bm25(t), 1).select("item_id", "id")
    held = used.join(best, "item_id").join(postings(t).select("id", "token"), ["id", "token"], "left_semi").groupBy("item_id").agg(F.count("*").alias("held"))
    each = used.groupBy("item_id").agg(F.count("*").alias("tokens"), F.min("df").alias("df")).join(held, "item_id", "left")
    return each.crossJoin(F.broadcast(n)).select("item_id", "tokens", "df", F.log(col("n") / col("df")).alias("idf"), (F.coalesce("held", F.lit(0)) / col("tokens")).alias("coverage"))


def ramp(coverage: Column) -> Column:
    """What the word ranking counts for: 0 at the floor, 1 from full coverage on."""
    part = (coverage - COVERAGE_FLOOR) / (COVERAGE_FULL - COVERAGE_FLOOR)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)), 3)


def vectors(t: Tables) -> DataFrame:
    """(id, e): texts with a word, encoded."""
    words = F.array_distinct(tokens(col("text")))
    return t.once("vectors", lambda t: t.texts.filter(F.size(words) > 0).select("id", dense.encode(words).alias("e")))


def query_vectors(t: Tables) -> DataFrame:
    words = F.array_distinct(tokens(col("text")))
    return t.table("benchmark").filter(F.size(words) > 0).select("item_id", dense.encode(words).alias("e"))


def dense_top(t: Tables, k: int = TOP) -> DataFrame:
    return top(t.once("dense", lambda t: dense.nearest(query_vectors(t), vectors(t), k)).filter("score > 0"), k)


def sparse_top(t: Tables, k: int = TOP) -> DataFrame:
    return t.once("sparse", lambda t: top(bm25(t), k))


def fused(t: Tables) -> DataFrame:
    """Reciprocal ranks of words, weighted by the ramp, and of vectors, added."""
    weight = query_stats(t).select("item_id", ramp(col("coverage")).alias("w"))
    by_words = sparse_top(t).join(weight, "item_id", "left").select("item_id", "id", (F.coalesce("w", F.lit(1.0)) / (RRF + col("rank"))).alias("x"))
    by_vector = dense_top(t).select("item_id", "id", (F.lit(1.0) / (RRF + col("rank"))).alias("x"))
    return by_words.unionByName(by_vector).groupBy("item_id", "id").agg(F.round(F.sum("x"), 9).alias("score"))


def hybrid(t: Tables) -> DataFrame:
    """The fused ranking with each text's place in both legs."""
    place = lambda ranked, name: ranked.select("item_id", "id", col("rank").alias(name))
    return top(fused(t)).join(place(sparse_top(t), "by_words"), ["item_id", "id"], "left").join(place(dense_top(t), "by_vector"), ["item_id", "id"], "left")


def targets(t: Tables) -> DataFrame:
    """(item_id, id): the first text that holds a query's text. Only texts with the query's rarest token are looked at."""
    rare = t.once("query_tokens", query_tokens).filter("r = 1").select("item_id", "token")
    pairs = rare.join(postings(t).select("id", "token"), "token").join(t.table("benchmark").select("item_id", col("text").alias("item")), "item_id")
    held = pairs.join(t.texts.select("id", "text"), "id").filter(F.contains("text", col("item")))
    return held.groupBy("item_id").agg(F.min("id").alias("id"))


def located(t: Tables) -> DataFrame:
    """Where a query's known text stands in each ranking, whether or not it is found."""
    found = t.once("targets", targets)
    ranks = [r.select("item_id", "id", col("rank").alias(n)) for n, r in (("by_words", sparse_top(t)), ("by_vector", dense_top(t)), ("fused", top(fused(t))))]
    for r in ranks:
        found = found.join(r, ["item_id", "id"], "left")
    return found


def pilot(t: Tables) -> DataFrame:
    """The rank of each query's text among all by vector: one more than the texts that are nearer."""
    q = query_vectors(t).join(t.once("targets", targets), "item_id").join(vectors(t).withColumnRenamed("e", "own"), "id")
    dot = F.aggregate(F.zip_with("e", "own", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return dense.ranks_of(q.select("item_id", "e", F.round(dot, 6).alias("score")), vectors(t))


RANKERS = ("words", "pool", "vector", "hybrid")


def rankings(t: Tables) -> DataFrame:
    """All rankings of all queries: (ranker, item_id, id, rank)."""
    each = {"words": sparse_top(t), "pool": top(bm25(t, 1.2, 0.75, binary=False)), "vector": dense_top(t), "hybrid": top(fused(t))}
    parts = [r.select(F.lit(n).alias("ranker"), "item_id", "id", "rank") for n, r in each.items()]
    return t.once("rankings", lambda _: parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def _hits(t: Tables) -> DataFrame:
    """(ranker, item_id, rank) for every ranker and query with a known text; rank is null if it isn't found."""
    known = t.once("targets", targets)
    every = known.crossJoin(F.broadcast(t.spark.createDataFrame([(r,) for r in RANKERS], "ranker string")))
    return every.join(rankings(t), ["ranker", "item_id", "id"], "left")


def report(t: Tables) -> DataFrame:
    """Recall and mean reciprocal rank of each ranker, the size of its pool, and a fingerprint of what it returned."""
    at = lambda k: F.avg((F.coalesce("rank", F.lit(9999)) <= k).cast("int")).alias(f"r{k}")
    quality = _hits(t).groupBy("ranker").agg(F.count("*").alias("queries"), at(1), at(5), at(10), F.avg(F.coalesce(1.0 / col("rank"), F.lit(0.0))).alias("mrr"))
    line = F.concat_ws(":", col("item_id").cast("string"), col("rank").cast("string"), col("id").cast("string"))
    mark = F.sum(F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long"))  # of a set, so no order is needed
    return quality.join(rankings(t).groupBy("ranker").agg(F.count("*").alias("pool"), mark.alias("mark")), "ranker")


def depths(t: Tables) -> DataFrame:
    """How deep the known texts stand, by ranker."""
    band = F.when(col("rank") == 1, "1 first").when(col("rank") <= 5, "2 to five").when(col("rank") <= 10, "3 to ten").otherwise("4 absent")
    return _hits(t).groupBy("ranker", band.alias("band")).agg(F.count("*").alias("queries"))


def paired(t: Tables) -> DataFrame:
    """For how many queries each ranker is better, worse or the same as the words alone."""
    r = F.coalesce("rank", F.lit(9999))
    hits = _hits(t).select("ranker", "item_id", r.alias("r"))
    base = hits.filter("ranker = 'words'").select("item_id", col("r").alias("base"))
    n = lambda c, name: F.count_if(c).alias(name)
    return hits.filter("ranker <> 'words'").join(base, "item_id").groupBy("ranker").agg(n(col("r") < col("base"), "better"), n(col("r") > col("base"), "worse"), n(col("r") == col("base"), "same"))


def filtered(t: Tables) -> DataFrame:
    """The word ranking among texts of a language and a span of years."""
    return top(bm25(t, among=(col("lang") == "en") & col("year").between(2002, 2007)))


def substituted(t: Tables) -> DataFrame:
    """Self-retrieval under synonyms: in each query the first occurrence of some words is replaced by another; what rank its
    text then has."""
    text = col("text")
    for word, other in SYNONYMS:
        text = F.regexp_replace(text, rf"(?s)^(.*?)\b{word}\b", rf"$1{other}")
    items = t.table("benchmark").select("item_id", text.alias("text"))
    ranked = top(bm25(t, items=items))
    return t.once("targets", targets).join(ranked.select("item_id", "id", "rank"), ["item_id", "id"], "left")


def pooled(t: Tables) -> DataFrame:
    """The candidates of both legs, copies of a text mapped to its first record; by words goes before by vector."""
    first = t.texts.filter("length(norm) >= 20").groupBy("norm").agg(F.min("id").alias("first")).join(t.texts.select("norm", "id"), "norm").select("id", "first")
    both = sparse_top(t).select("item_id", "id", F.lit(1).alias("leg"), "rank").unionByName(dense_top(t).select("item_id", "id", F.lit(2).alias("leg"), "rank"))
    mapped = both.join(first, "id", "left").withColumn("record", F.coalesce("first", "id"))
    return mapped.groupBy("item_id", "record").agg(F.min(F.struct("leg", "rank")).alias("x"), F.count("*").alias("sources")).select("item_id", "record", "x.leg", "x.rank", "sources")


def long_index(t: Tables) -> DataFrame:
    """An index of texts of at least LONG words, one a normalised text: the id, its words, distinct tokens and copies."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    long = t.texts.withColumn("words", n).filter(col("words") >= LONG)
    return long.groupBy("norm").agg(F.min(F.struct("id", "words", F.size(F.array_distinct(tokens(col("text")))).alias("tokens"))).alias("x"), F.count("*").alias("copies")).select("x.*", "copies")


def long_search(t: Tables) -> DataFrame:
    """BM25 with true frequencies, over the index of long texts."""
    kept = long_index(t).select("id")
    return top(bm25(t, 1.2, 0.75, binary=False).join(kept, "id", "left_semi"))


def passages(t: Tables) -> DataFrame:
    """(id, line, token, tf): the lines of texts as passages."""
    lines = t.texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "part"))
    return lines.select("id", "line", F.explode(tokens(col("part"))).alias("token")).groupBy("id", "line", "token").agg(F.count("*").alias("tf"))


def passage_search(t: Tables) -> DataFrame:
    """The passages most like each query: the idf of shared words over the root of a passage's length."""
    p = t.once("passages", passages)
    size = p.groupBy("id", "line").agg(F.sum("tf").alias("len"))
    n = size.agg(F.count("*").alias("n"))
    df = p.groupBy("token").agg(F.count("*").alias("pdf"))
    q = t.once("query_tokens", query_tokens).select("item_id", "token")
    hit = q.join(df, "token").join(p, "token").crossJoin(F.broadcast(n)).groupBy("item_id", "id", "line").agg(F.sum(F.log(col("n") / col("pdf")) + 1).alias("s"))
    scored = hit.join(size, ["id", "line"]).select("item_id", "id", "line", F.round(col("s") / F.sqrt("len"), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(col("score").desc(), "id", "line")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


def contexts(t: Tables) -> DataFrame:
    """What a reader gets for each query: the first words of the best texts, in order."""
    best = top(fused(t), CONTEXT_TEXTS).join(t.texts.select("id", "text"), "id")
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, CONTEXT_WORDS)
    each = best.select("item_id", F.struct("rank", F.array_join(words, " ").alias("x")).alias("s"))
    return each.groupBy("item_id").agg(F.array_sort(F.collect_list("s")).alias("all")).select("item_id", F.size("all").alias("texts"), F.md5(F.array_join("all.x", " | ")).alias("context"))


def aliases(t: Tables) -> DataFrame:
    """Sources under their known names, and titles as words apart by one space."""
    known = F.create_map(*[F.lit(x) for pair in (("src0", "zero"), ("src1", "one"), ("src2", "two")) for x in pair])
    title = F.trim(F.regexp_replace(F.lower(F.substring("text", 1, 60)), "[^a-z0-9]+", " "))
    return t.texts.select("id", F.coalesce(F.try_element_at(known, col("source")), col("source")).alias("source"), title.alias("title"))


WORDS = "regexp_extract_all(lower(text), '[a-z]{3,}')"
DENSE = f"""
enc AS MATERIALIZED (SELECT id, d, count(*)::DOUBLE AS w FROM (SELECT DISTINCT id, unnest({WORDS}) AS token FROM texts) JOIN place USING (token) GROUP BY 1, 2),
qenc AS MATERIALIZED (SELECT item_id, d, count(*)::DOUBLE AS w FROM q JOIN place USING (token) GROUP BY 1, 2),
en AS (SELECT id, sqrt(sum(w * w)) AS n FROM enc GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qenc GROUP BY 1),
sims AS MATERIALIZED (SELECT item_id, id, round(s / (qn.n * en.n), 6) AS score FROM (SELECT item_id, id, sum(a.w * b.w) AS s FROM qenc a JOIN enc b USING (d) GROUP BY 1, 2) JOIN en USING (id) JOIN qn USING (item_id)),
dense AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM sims WHERE score > 0 QUALIFY rank <= {TOP}),
best AS (SELECT item_id, id FROM sparse WHERE rank = 1),
stats AS MATERIALIZED (SELECT item_id, count(*) AS tokens, min(df) AS df, ln((SELECT n FROM st) / min(df)) AS idf, count(p.id) / count(*) AS coverage
    FROM qt LEFT JOIN best USING (item_id) LEFT JOIN post p ON p.id = best.id AND p.token = qt.token GROUP BY 1),
weights AS (SELECT item_id, round(greatest(0, least(1, (coverage - {COVERAGE_FLOOR}) / {COVERAGE_FULL - COVERAGE_FLOOR}))::DOUBLE, 3) AS w FROM stats),
fusedall AS (SELECT item_id, id, round(sum(x), 9) AS score FROM (
    SELECT item_id, id, coalesce(w, 1) / ({RRF} + rank) AS x FROM sparse LEFT JOIN weights USING (item_id) UNION ALL SELECT item_id, id, 1.0::DOUBLE / ({RRF} + rank) FROM dense) GROUP BY 1, 2),
fused AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM fusedall QUALIFY rank <= {TOP}),
target AS MATERIALIZED (SELECT qt.item_id, min(p.id) AS id FROM qt JOIN post p USING (token) JOIN texts x ON x.id = p.id JOIN benchmark b ON b.item_id = qt.item_id WHERE r = 1 AND contains(x.text, b.text) GROUP BY 1),
ranked AS MATERIALIZED (SELECT 'words' AS ranker, item_id, id, rank FROM sparse UNION ALL SELECT 'pool', item_id, id, rank FROM tf UNION ALL SELECT 'vector', item_id, id, rank FROM dense UNION ALL SELECT 'hybrid', item_id, id, rank FROM fused),
hits AS MATERIALIZED (SELECT n.ranker, target.item_id, ranked.rank FROM target CROSS JOIN (VALUES ('words'), ('pool'), ('vector'), ('hybrid')) n(ranker) LEFT JOIN ranked ON ranked.ranker = n.ranker AND ranked.item_id = target.item_id AND ranked.id = target.id)
"""
PLACE = f"place AS MATERIALIZED (SELECT token, ('0x' || substr(md5(token), 1, 8))::BIGINT % {dense.DIM} AS d FROM (SELECT token FROM tok UNION SELECT token FROM q))"
CTES = ", ".join(x.strip() for x in (TEXT_CTES, PLACE, DENSE))


def _synonyms(column: str) -> str:
    for word, other in SYNONYMS:
        column = f"regexp_replace({column}, '\\b{word}\\b', '{other}')"
    return column


SWAPPED = TEXT_CTES.replace("FROM benchmark)", f"FROM (SELECT item_id, {_synonyms('text')} AS text FROM benchmark))")
RIGHT = f"""target AS (SELECT o.item_id, min(p.id) AS id FROM (SELECT item_id, token FROM (SELECT DISTINCT item_id, unnest({WORDS}) AS token FROM benchmark) JOIN dfs USING (token)
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY df, token) = 1) o JOIN post p USING (token) JOIN texts x ON x.id = p.id JOIN benchmark b ON b.item_id = o.item_id WHERE contains(x.text, b.text) GROUP BY 1)"""
LINES = f"""lines AS (SELECT id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM texts),
ptok AS MATERIALIZED (SELECT id, line, token, count(*) AS tf FROM (SELECT id, line, unnest(regexp_extract_all(lower(part), '[a-z]{{3,}}')) AS token FROM lines) GROUP BY 1, 2, 3),
plen AS (SELECT id, line, sum(tf) AS len FROM ptok GROUP BY 1, 2), pdf AS (SELECT token, count(*) AS df FROM ptok GROUP BY 1)"""
SPLIT = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"

QUERIES = {
    "query_stats": Query("item_id:l tokens:l df:l idf:d coverage:d", query_stats, "SELECT * FROM stats", CTES),
    "sparse_weight": Query("item_id:l w:d", lambda t: query_stats(t).select("item_id", ramp(col("coverage")).alias("w")), "SELECT * FROM weights", CTES),
    "dense_topk": Query("item_id:l id:l score:d rank:l", dense_top, "SELECT * FROM dense", CTES),
    "hybrid_search": Query(
        "item_id:l id:l rank:l by_words:l by_vector:l", hybrid,
        "SELECT f.item_id, f.id, f.rank, s.rank AS by_words, d.rank AS by_vector FROM fused f LEFT JOIN sparse s USING (item_id, id) LEFT JOIN dense d USING (item_id, id)", CTES,
    ),
    "find_ranks": Query(
        "item_id:l id:l by_words:l by_vector:l fused:l", located,
        "SELECT t.item_id, t.id, s.rank AS by_words, d.rank AS by_vector, f.rank AS fused FROM target t LEFT JOIN sparse s USING (item_id, id) LEFT JOIN dense d USING (item_id, id) LEFT JOIN fused f USING (item_id, id)", CTES,
    ),
    "pilot_ranks": Query("item_id:l rank:l", pilot, "SELECT t.item_id, 1 + count(*) FILTER (o.score > s.score) AS rank FROM target t JOIN sims s USING (item_id, id) JOIN sims o ON o.item_id = t.item_id GROUP BY 1", CTES),
    "ranker_report": Query(
        "ranker:s queries:l r1:d r5:d r10:d mrr:d pool:l mark:l", report,
        """SELECT * FROM (SELECT ranker, count(*) AS queries, avg((coalesce(rank, 9999) <= 1)::INT) AS r1, avg((coalesce(rank, 9999) <= 5)::INT) AS r5, avg((coalesce(rank, 9999) <= 10)::INT) AS r10,
           avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr FROM hits GROUP BY 1) JOIN (SELECT ranker, count(*) AS pool, sum(('0x' || substr(md5(concat_ws(':', item_id, rank, id)), 1, 8))::BIGINT) AS mark FROM ranked GROUP BY 1) USING (ranker)""", CTES,
    ),
    "rank_depths": Query("ranker:s band:s queries:l", depths, "SELECT ranker, CASE WHEN rank = 1 THEN '1 first' WHEN rank <= 5 THEN '2 to five' WHEN rank <= 10 THEN '3 to ten' ELSE '4 absent' END AS band, count(*) AS queries FROM hits GROUP BY 1, 2", CTES),
    "paired_rankers": Query(
        "ranker:s better:l worse:l same:l", paired,
        "SELECT h.ranker, count(*) FILTER (coalesce(h.rank, 9999) < coalesce(b.rank, 9999)) AS better, count(*) FILTER (coalesce(h.rank, 9999) > coalesce(b.rank, 9999)) AS worse, count(*) FILTER (coalesce(h.rank, 9999) = coalesce(b.rank, 9999)) AS same FROM hits h JOIN hits b ON b.item_id = h.item_id AND b.ranker = 'words' WHERE h.ranker <> 'words' GROUP BY 1", CTES,
    ),
    "filtered_search": Query(
        "item_id:l id:l score:d rank:l", filtered,
        f"SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM bm JOIN texts USING (id) WHERE lang = 'en' AND year BETWEEN 2002 AND 2007 QUALIFY rank <= {TOP}", TEXT_CTES,
    ),
    "synonym_retrieval": Query("item_id:l id:l rank:l", substituted, "SELECT t.item_id, t.id, s.rank FROM target t LEFT JOIN sparse s USING (item_id, id)", f"{SWAPPED.strip()}, {RIGHT}"),
    "candidate_pool": Query(
        "item_id:l record:l leg:l rank:l sources:l", pooled,
        "SELECT item_id, record, min(leg) AS leg, arg_min(rank, (leg, rank)) AS rank, count(*) AS sources FROM (SELECT item_id, coalesce(first, id) AS record, leg, rank FROM (SELECT item_id, id, 1 AS leg, rank FROM sparse UNION ALL SELECT item_id, id, 2, rank FROM dense) LEFT JOIN (SELECT id, min(id) OVER (PARTITION BY norm) AS first FROM texts WHERE length(norm) >= 20) USING (id)) GROUP BY 1, 2", CTES,
    ),
    "long_index": Query(
        "id:l words:l tokens:l copies:l", long_index,
        f"SELECT id, words, tokens, copies FROM (SELECT id, len({SPLIT}) AS words, len(list_distinct({WORDS})) AS tokens, count(*) OVER (PARTITION BY norm) AS copies, row_number() OVER (PARTITION BY norm ORDER BY id) AS r FROM texts WHERE len({SPLIT}) >= {LONG}) WHERE r = 1",
    ),
    "long_search": Query(
        "item_id:l id:l score:d rank:l", long_search,
        f"SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM bmtf WHERE id IN (SELECT min(id) FROM texts WHERE len({SPLIT}) >= {LONG} GROUP BY norm) QUALIFY rank <= {TOP}", TEXT_CTES,
    ),
    "passage_search": Query(
        "item_id:l id:l line:l score:d rank:l", passage_search,
        "SELECT item_id, id, line, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id, line) AS rank FROM (SELECT item_id, id, line, round(sum(ln((SELECT count(*) FROM plen) / pdf.df) + 1) / sqrt(any_value(len)), 6) AS score FROM qt JOIN pdf USING (token) JOIN ptok USING (token) JOIN plen USING (id, line) GROUP BY 1, 2, 3) QUALIFY rank <= 3", f"{TEXT_CTES.strip()}, {LINES}",
    ),
    "contexts": Query(
        "item_id:l texts:l context:s", contexts,
        f"SELECT item_id, count(*) AS texts, md5(string_agg(array_to_string({SPLIT}[1:{CONTEXT_WORDS}], ' '), ' | ' ORDER BY rank)) AS context FROM fused JOIN texts USING (id) WHERE rank <= {CONTEXT_TEXTS} GROUP BY 1", CTES,
    ),
    "source_aliases": Query("id:l source:s title:s", aliases, "SELECT id, CASE source WHEN 'src0' THEN 'zero' WHEN 'src1' THEN 'one' WHEN 'src2' THEN 'two' ELSE source END AS source, trim(regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]+', ' ', 'g')) AS title FROM texts"),
}
