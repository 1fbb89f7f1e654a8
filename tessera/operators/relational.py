"""Relational forms that the other queries do not show: sampled axes, null-safe equality, scalar subqueries, names resolved to
people, boolean aggregates in HAVING, hidden sort keys, set operations, safe casts, and numbered index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.portable import bucket, count_if, share, tokens
from tessera.functions.ranks import before
from tessera.operators.disambiguation import CTES, thinned
from tessera.operators.learning import bcubed
from tessera.plans.tables import Query, Tables

col = F.col


def axis(t: Tables, start: int = 1995, step: int = 2) -> DataFrame:
    """Every second year of an axis."""
    return t.pubs.filter((col("year") - start) % step == 0).groupBy("year").agg(F.count("*").alias("papers"))


def same_or_both_missing(t: Tables) -> DataFrame:
    """Pairs of neighbouring documents whose labels are equal, two missing ones counting as equal."""
    labels = t.table("documents").select("doc_id").join(t.table("labels").select("doc_id", "toxic"), "doc_id", "left")
    after = labels.select((col("doc_id") - 1).alias("doc_id"), col("toxic").alias("after"))
    return labels.join(after, "doc_id").agg(F.count("*").alias("pairs"), count_if(col("toxic").eqNullSafe(col("after"))).alias("same"), count_if(col("toxic") == col("after")).alias("equal"))


def projected(t: Tables) -> DataFrame:
    """Each kind's papers beside totals that do not depend on it."""
    totals = t.pubs.agg(F.count("*").alias("all"), F.max("price").alias("dearest")).crossJoin(t.persons.agg(F.count("*").alias("pages")))
    return t.pubs.groupBy("kind").agg(F.count("*").alias("papers")).crossJoin(F.broadcast(totals))


def resolved(t: Tables) -> DataFrame:
    """Names taken from lists and resolved to the one page that has them; a name of several pages stays unresolved."""
    lists = t.slots.join(t.persons.select("person", "name", "brand"), "person").groupBy("pid").agg(F.collect_list(F.concat_ws("/", "name", "brand")).alias("names"))
    pages = t.persons.groupBy(F.concat_ws("/", "name", "brand").alias("n")).agg(F.count("*").alias("pages"), F.min("person").alias("page"))
    each = lists.select("pid", F.explode("names").alias("n")).join(pages, "n", "left")
    return each.groupBy("pid").agg(F.count("*").alias("names"), count_if(col("pages") == 1).alias("resolved"), F.min(F.when(col("pages") == 1, col("page"))).alias("first"))


def mixed_copies(t: Tables) -> DataFrame:
    """Normalised texts that stand in two sources at least, one of them among the first ten."""
    low = col("source").isin(*[f"src{i}" for i in range(10)])
    return t.texts.filter("length(norm) >= 30").groupBy("norm").agg(F.bool_or(low).alias("a"), F.bool_or(~low).alias("b"), F.min("id").alias("id"), F.min("source").alias("some")).filter("a AND b").select("id", "some")


def hidden_order(t: Tables, k: int = 10) -> DataFrame:
    """The venues whose dearest paper is cheapest; the price orders them and is not shown."""
    return t.pubs.groupBy("venue").agg(F.count("*").alias("papers"), F.max("price").alias("p")).orderBy("p", "venue").limit(k).drop("p")


def exact_first(t: Tables) -> DataFrame:
    """Venues by a part of their name, the one that is called so before all others."""
    v = t.pubs.filter(F.contains(F.lower("venue"), F.lit("nation_2"))).groupBy("venue").agg(F.count("*").alias("papers")).withColumn("exact", F.lower("venue") == "nation_2")
    return v.orderBy(col("exact").desc(), col("papers").desc(), "venue").limit(5)


def in_all(t: Tables) -> DataFrame:
    """People with papers of every kind, as an intersection."""
    s = t.slots.filter("NOT on_bin").join(t.pubs.select("pid", "kind"), "pid")
    of = lambda k: s.filter(col("kind") == k).select("person")
    return of("journal").intersect(of("conference")).intersect(of("preprint"))


def surnames(t: Tables) -> DataFrame:
    """Of each paper: whether the last words of its names are in order and all different."""
    lists = t.slots.filter("n_authors BETWEEN 2 AND 10").join(t.persons.select("person", "name"), "person").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("x"))
    last = F.transform("x.name", lambda n: F.lower(F.element_at(F.split(F.regexp_replace(n, " [0-9]{4}$", ""), " "), -1)))
    return lists.select("pid", last.alias("s")).select("pid", F.array_join("s", ",").alias("names"), (col("s") == F.array_sort("s")).alias("ordered"), (F.size(F.array_distinct("s")) == F.size("s")).alias("distinct"))


def casts(t: Tables) -> DataFrame:
    """Numbers taken out of JSON text, where they are numbers."""
    e = t.table("events").select("event_type", F.regexp_extract("props", r'"k": *([^,}]*)', 1).try_cast("bigint").alias("k"), F.substr("event_type", F.lit(1), F.lit(1)).try_cast("int").alias("none"))
    return e.groupBy("event_type").agg(F.count("k").alias("numbers"), F.sum("k").alias("total"), F.count("none").alias("none"))


def index_rows(t: Tables) -> DataFrame:
    """The texts of an index in the order of their ids, numbered without gaps: those with three words or more and a language."""
    some = t.texts.filter((F.size(tokens(col("text"))) >= 3) & col("lang").isNotNull()).select("id", "lang", "year")
    return before(some, [col("id")], {"row": F.lit(1)})


SCOPES = {"all": "true", "journal": "kind = 'journal'", "no preprints": "kind <> 'preprint'", "open": "has_oa", "teams": "n_authors BETWEEN 2 AND 50", "identified": "orcid"}


def scopes(t: Tables) -> DataFrame:
    """Papers and people under each of six definitions of a paper, in one pass."""
    orcid = t.slots.groupBy("pid").agg(F.bool_or("has_orcid").alias("orcid"))
    s = t.slots.filter("NOT on_bin").join(t.pubs.select("pid", "kind", "has_oa"), "pid").join(orcid, "pid")
    per = s.agg(*[x for i, c in enumerate(SCOPES.values()) for x in (F.countDistinct(F.when(F.expr(c), col("pid"))).alias(f"p{i}"), F.countDistinct(F.when(F.expr(c), col("person"))).alias(f"q{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scope"), col(f"p{i}").alias("papers"), col(f"q{i}").alias("people")) for i, n in enumerate(SCOPES)]))
    return per.select(rows.alias("r")).select("r.*")


def floors(t: Tables) -> DataFrame:
    """Blocks that were thinned to look like bins, in two trivial clusterings that any other has to beat: everyone alone, and one
    cluster a name."""
    x = thinned(t).withColumn("alone", F.concat_ws("/", col("person").cast("string"), col("pid").cast("string")))
    one = lambda c, name: bcubed(x, "person", c).withColumn("floor", F.lit(name))
    return one("alone", "alone").unionByName(one("name", "together"))


def sampled_years(t: Tables) -> DataFrame:
    """Shares of two hash buckets of people, by year: a deterministic sample that every engine takes alike."""
    s = t.slots.join(t.pubs.select("pid", "year"), "pid").withColumn("b", bucket(col("person"), 10))
    return s.groupBy("year").agg(F.count("*").alias("slots"), share(col("b").isin(0, 1)).alias("sampled"))


THIN = "SELECT name, person, pid FROM ins QUALIFY row_number() OVER (PARTITION BY person ORDER BY pid) <= CASE WHEN ('0x' || substr(md5(person::VARCHAR), 1, 8))::BIGINT % 3 = 0 THEN 2 ELSE 1 END"


QUERIES = {
    "axis_sample": Query("year:l papers:l", axis, "SELECT year, count(*) AS papers FROM pubs WHERE (year - 1995) % 2 = 0 GROUP BY 1"),
    "null_safe": Query("pairs:l same:l equal:l", same_or_both_missing, "SELECT count(*) AS pairs, count(*) FILTER (a.toxic IS NOT DISTINCT FROM b.toxic) AS same, count(*) FILTER (a.toxic = b.toxic) AS equal FROM l a JOIN l b ON b.doc_id = a.doc_id + 1", "l AS (SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id))"),
    "scalar_projection": Query("kind:s papers:l total:l dearest:d pages:l", lambda t: projected(t).withColumnRenamed("all", "total"), "SELECT kind, count(*) AS papers, (SELECT count(*) FROM pubs) AS total, (SELECT max(price) FROM pubs) AS dearest, (SELECT count(*) FROM persons) AS pages FROM pubs GROUP BY 1"),
    "name_resolution": Query(
        "pid:l names:l resolved:l first:l", resolved,
        "SELECT pid, count(*) AS names, count(*) FILTER (pages = 1) AS resolved, min(page) FILTER (pages = 1) AS first FROM slots JOIN persons p USING (person) LEFT JOIN (SELECT name, brand, count(*) AS pages, min(person) AS page FROM persons GROUP BY 1, 2) n ON n.name = p.name AND n.brand = p.brand GROUP BY 1",
    ),
    "mixed_copies": Query("id:l some:s".replace("some", "source"), lambda t: mixed_copies(t).withColumnRenamed("some", "source"), "SELECT min(id) AS id, min(source) AS source FROM texts WHERE length(norm) >= 30 GROUP BY norm HAVING bool_or(source IN (" + ", ".join(f"'src{i}'" for i in range(10)) + ")) AND bool_or(source NOT IN (" + ", ".join(f"'src{i}'" for i in range(10)) + "))"),
    "hidden_order": Query("venue:s papers:l", hidden_order, "SELECT venue, count(*) AS papers FROM pubs GROUP BY 1 ORDER BY max(price), venue LIMIT 10"),
    "exact_first": Query("venue:s papers:l exact:b", exact_first, "SELECT venue, count(*) AS papers, lower(venue) = 'nation_2' AS exact FROM pubs WHERE contains(lower(venue), 'nation_2') GROUP BY 1 ORDER BY exact DESC, papers DESC, venue LIMIT 5"),
    "people_of_all_kinds": Query("person:l", in_all, " INTERSECT ".join(f"SELECT person FROM slots JOIN pubs USING (pid) WHERE NOT on_bin AND kind = '{k}'" for k in ("journal", "conference", "preprint"))),
    "surnames": Query(
        "pid:l names:s ordered:b distinct:b".replace("distinct", "different"), lambda t: surnames(t).withColumnRenamed("distinct", "different"),
        "SELECT pid, array_to_string(s, ',') AS names, s = list_sort(s) AS ordered, len(list_distinct(s)) = len(s) AS different FROM (SELECT pid, list(lower(string_split(name, ' ')[-1]) ORDER BY position) AS s FROM slots JOIN persons USING (person) WHERE n_authors BETWEEN 2 AND 10 GROUP BY 1)",
    ),
    "try_casts": Query("event_type:s numbers:l total:l none:l".replace("none", "bad"), lambda t: casts(t).withColumnRenamed("none", "bad"), "SELECT event_type, count(k) AS numbers, sum(k) AS total, count(TRY_CAST(substr(event_type, 1, 1) AS INT)) AS bad FROM (SELECT event_type, TRY_CAST(regexp_extract(props, '\"k\": *([^,}]*)', 1) AS BIGINT) AS k FROM events) GROUP BY event_type"),
    "index_rows": Query("id:l row:l lang:s", index_rows, "SELECT id, row_number() OVER (ORDER BY id) - 1 AS row, lang FROM texts WHERE len(regexp_extract_all(lower(text), '[a-z]{3,}')) >= 3 AND lang IS NOT NULL"),
    "six_scopes": Query("scope:s papers:l people:l", scopes, " UNION ALL ".join(f"SELECT '{n}' AS scope, count(DISTINCT pid) AS papers, count(DISTINCT person) AS people FROM slots JOIN pubs USING (pid) JOIN (SELECT pid, bool_or(has_orcid) AS orcid FROM slots GROUP BY 1) USING (pid) WHERE NOT on_bin AND {c}" for n, c in SCOPES.items())),
    "cluster_floors": Query(
        "floor:s items:l precision:d recall:d".replace("floor", "arm"), lambda t: floors(t).withColumnRenamed("floor", "arm"),
        f"SELECT 'alone' AS arm, sum(n) AS items, 1 AS precision, sum(n * 1.0::DOUBLE / n) / sum(n) AS recall FROM (SELECT person, count(*) AS n FROM th GROUP BY 1) UNION ALL SELECT 'together', sum(n), sum(n * n::DOUBLE / nb) / sum(n), 1 FROM (SELECT name, person, count(*) AS n, sum(count(*)) OVER (PARTITION BY name) AS nb FROM th GROUP BY 1, 2)", f"{CTES}, th AS MATERIALIZED ({THIN})",
    ),
    "hash_sample_years": Query("year:l slots:l sampled:d", sampled_years, "SELECT year, count(*) AS slots, avg((('0x' || substr(md5(person::VARCHAR), 1, 8))::BIGINT % 10 IN (0, 1))::INT) AS sampled FROM slots JOIN pubs USING (pid) GROUP BY 1"),
}
