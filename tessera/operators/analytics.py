"""Dashboard analytics: scans, scalar functions, aggregates and windows over papers, people, venues and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.portable import all_words, bigrams, bucket, count_if, share, tokens
from tessera.functions.ranks import percent_rank, with_total
from tessera.plans.staging import stage
from tessera.plans.tables import Query, Tables

LAST_FULL_YEAR = 2000
FIRST_YEAR = 1995
col = F.col


def _concentration(t: Tables, k: int = 3) -> DataFrame:
    """Share of a year's papers that its k largest venues hold, by kind."""
    per = t.pubs.groupBy("kind", "year", "venue").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind", "year")
    ranked = per.select("*", F.row_number().over(w.orderBy(col("n").desc(), "venue")).alias("r"), F.sum("n").over(w).alias("total"))
    return ranked.groupBy("kind", "year").agg(F.max("total").alias("papers"), F.sum(F.when(col("r") <= k, col("n"))).alias("top"), F.max(F.when(col("r") == 1, col("venue"))).alias("leader")).withColumn("share", col("top") / col("papers"))


def _cohorts(t: Tables) -> DataFrame:
    """Of the people who began in a year, the share still active 1, 3 and 5 years later; horizons not reached are null."""
    career = t.slots.filter("NOT on_bin").join(t.pubs, "pid").groupBy("person").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    alive = lambda h: share(F.when(col("first") + h <= LAST_FULL_YEAR, col("last") >= col("first") + h)).alias(f"after{h}")
    return career.groupBy("first").agg(F.count("*").alias("people"), alive(1), alive(3), alive(5))


def _newcomers(t: Tables) -> DataFrame:
    on = t.slots.filter("NOT on_bin").join(t.pubs.select("pid", "year"), "pid").select("person", "year").distinct()
    first = on.groupBy("person").agg(F.min("year").alias("first"))
    return on.join(first, "person").groupBy("year").agg(F.count("*").alias("active"), count_if(col("first") == col("year")).alias("new"))


def _positions(t: Tables) -> DataFrame:
    s = t.slots.filter("NOT on_bin AND n_authors >= 3")
    output = t.slots.filter("NOT on_bin").groupBy("person").agg(F.count("*").alias("papers"))
    band = F.when(col("papers") < 20, "1 under 20").when(col("papers") < 30, "2 20 to 29").otherwise("3 30 or more")
    return s.join(output, "person").groupBy(band.alias("band")).agg(F.count("*").alias("slots"), share(col("position") == 1).alias("first"), share((col("position") > 1) & (col("position") < col("n_authors"))).alias("middle"), share(col("position") == col("n_authors")).alias("last"))


def _alphabetical(t: Tables) -> DataFrame:
    """Share of papers whose authors' names are in order, against chance 1/n!, by venue."""
    s = t.slots.join(t.persons, "person").filter("n_authors BETWEEN 2 AND 6")
    lists = s.groupBy("pid", "n_authors").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("x")).select("pid", "n_authors", F.transform("x", lambda v: v["name"]).alias("names"))
    ordered = lists.select("pid", (col("names") == F.array_sort("names")).alias("ordered"), (F.lit(1.0) / F.factorial(col("n_authors").cast("int"))).alias("chance"))
    return ordered.join(t.pubs, "pid").groupBy("venue").agg(F.count("*").alias("papers"), share(col("ordered")).alias("observed"), F.avg("chance").alias("expected"))


def _changing(t: Tables, rising: bool = True) -> DataFrame:
    """Words by the ratio of their smoothed shares of texts in two spans of years."""
    each = t.texts.select("id", "year", F.explode(F.array_distinct(tokens(col("text")))).alias("word"))
    n = t.texts.agg(count_if(col("year") < 2005).alias("n_old"), count_if(col("year") >= 2005).alias("n_new"))
    words = each.groupBy("word").agg(count_if(col("year") < 2005).alias("old"), count_if(col("year") >= 2005).alias("new")).filter("old + new >= 30")
    return words.crossJoin(F.broadcast(n)).withColumn("ratio", ((col("new") + 5) / (col("n_new") + 5)) / ((col("old") + 5) / (col("n_old") + 5))).orderBy(col("ratio").desc() if rising else col("ratio"), "word").limit(40)


AXES = ("per_year", "growth", "open", "orcid", "team", "unidentified")


def venue_axes(t: Tables) -> DataFrame:
    """The six measures of each venue. Growth compares three years with the three before, between -1 and 1."""
    paper = t.slots.groupBy("pid").agg(F.max("n_authors").alias("n"), F.bool_or("has_orcid").alias("orcid"), F.bool_or("on_bin").alias("unknown"))
    late = count_if(col("year").between(LAST_FULL_YEAR - 2, LAST_FULL_YEAR))
    early = count_if(col("year").between(LAST_FULL_YEAR - 5, LAST_FULL_YEAR - 3))
    per = t.pubs.filter("kind <> 'preprint'").join(paper, "pid").groupBy("venue").agg(
        F.count("*").alias("papers"), (F.count("*") / F.countDistinct("year")).alias("per_year"), F.coalesce(F.try_divide((late - early).cast("double"), late + early), F.lit(0.0)).alias("growth"),
        share(col("has_oa")).alias("open"), share(col("orcid")).alias("orcid"), F.avg("n").alias("team"), share(col("unknown")).alias("unidentified"),
    )
    return per.select("venue", "papers", *[F.round(c, 9).alias(c) for c in AXES])


def _profiles(t: Tables) -> DataFrame:
    """Each venue's measures and, for each, the share of the other venues that are below."""
    out = stage(venue_axes(t), "axes")
    for c in AXES:
        out = percent_rank(out, c, f"{c}_rank")
    return out


def _treemap(t: Tables, k: int = 3) -> DataFrame:
    """The k largest venues of each segment and the rest as one row."""
    per = t.pubs.groupBy("segment", "venue").agg(F.count("*").alias("papers"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("segment").orderBy(col("papers").desc(), "venue")))
    return ranked.groupBy("segment", F.when(col("r") <= k, col("venue")).otherwise("other venues").alias("venue")).agg(F.sum("papers").alias("papers"))


def _publishers(t: Tables) -> DataFrame:
    names = t.spark.sql("SELECT * FROM VALUES ('AUTOMOBILE', 'Alpha'), ('BUILDING', 'Beta'), ('FURNITURE', 'Gamma'), ('MACHINERY', 'Alpha') AS x(segment, publisher)")
    period = F.when(col("year") < 1998, "1995-1997").otherwise("1998-2001")
    per = t.pubs.join(F.broadcast(names), "segment", "left").groupBy(period.alias("period"), F.coalesce("publisher", F.lit("other")).alias("publisher")).agg(F.count("*").alias("papers"))
    return per.withColumn("share", col("papers") / F.sum("papers").over(Window.partitionBy("period"))).filter("publisher <> 'other'")


#: Field -> (column expression, the same in SQL)
FIELDS = {
    "text": ("text IS NOT NULL AND length(text) > 0",) * 2, "lang": ("lang IS NOT NULL",) * 2, "source": ("source IS NOT NULL",) * 2,
    "email": ("contains(text, '@')",) * 2, "lines": ("contains(text, '\n')", "contains(text, chr(10))"), "asks": ("contains(text, '?')",) * 2, "colon": ("contains(text, ':')",) * 2,
    "stop": ("contains(text, '.')",) * 2, "comma": ("contains(text, ',')",) * 2, "quote": ("contains(text, '\"')", "contains(text, '\"')"), "hash": ("contains(text, '#')",) * 2, "plus": ("contains(text, '+')",) * 2,
    "short": ("length(text) < 500",) * 2, "long": ("length(text) > 3000",) * 2, "normed": ("length(norm) >= 30",) * 2,
    "digits": ("text RLIKE '[0-9]'", "regexp_matches(text, '[0-9]')"), "upper": ("text RLIKE '[A-Z]{4}'", "regexp_matches(text, '[A-Z]{4}')"),
}


def _coverage(t: Tables) -> DataFrame:
    """The share of each source's texts that have each of 17 fields, in one pass."""
    wide = t.texts.groupBy("source").agg(*[share(F.expr(c)).alias(f"f_{n}") for n, (c, _) in FIELDS.items()])
    long = wide.unpivot(["source"], [f"f_{n}" for n in FIELDS], "field", "share")
    return long.withColumn("field", F.substr("field", F.lit(3)))


def _density(t: Tables) -> DataFrame:
    per = t.slots.filter("NOT on_bin").groupBy("person").agg(F.count("*").alias("papers"), F.countDistinct("n_authors").alias("sizes"))
    cell = lambda c: F.floor(F.log10(col(c).cast("double")) * 4 + 1e-9)
    return per.groupBy(cell("papers").alias("x"), cell("sizes").alias("y")).agg(F.count("*").alias("people"))


def _url(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return t.table("pages").select("page_id", F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"), host.alias("host"), F.regexp_extract(host, "([^.]+)$", 1).alias("tld"), F.length("url").alias("n"))


def _twins(t: Tables) -> DataFrame:
    """Normalised titles that several texts share, of at least 30 letters."""
    return t.texts.filter("length(norm) >= 30").groupBy("norm").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.countDistinct("source").alias("sources")).filter("copies > 1")


def _venue_names(t: Tables) -> DataFrame:
    n = t.pubs.groupBy("prefix", "venue").agg(F.count("*").alias("n"))
    best = n.groupBy("prefix").agg(F.max(F.struct("n", F.lit(0))).alias("x"), F.max("n").alias("top"), F.sum("n").alias("papers"))
    return n.join(best, "prefix").filter("n = top").groupBy("prefix").agg(F.min("venue").alias("usual"), F.max("papers").alias("papers"))


def _lifespans(t: Tables) -> DataFrame:
    v = t.pubs.groupBy("venue", "segment").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.countDistinct("year").alias("active"))
    return v.groupBy("segment", "first").agg(F.count("*").alias("series"), share(col("last") >= LAST_FULL_YEAR).alias("alive"), F.median("active").alias("active"))


def _slots(t: Tables) -> DataFrame:
    """Lists of a paper's authors and flags, taken apart again by position."""
    lists = t.slots.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("position", "person", "has_orcid"))).alias("x"))
    flat = lists.select("pid", F.posexplode(F.arrays_zip(F.transform("x", lambda v: v["person"]).alias("person"), F.transform("x", lambda v: v["has_orcid"]).alias("has_orcid"))))
    return flat.select("pid", (col("pos") + 1).alias("position"), "col.person", "col.has_orcid")


def _arrays(t: Tables) -> DataFrame:
    w = tokens(col("text"))
    return t.texts.select("id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.size(F.filter(w, lambda x: F.length(x) > 5)).alias("long"), F.get(F.array_sort(F.array_distinct(w)), F.lit(0)).alias("least"), F.array_contains(w, "the").alias("has_the"))


def _quota(t: Tables) -> DataFrame:
    """At most 5 papers with and 10 without open access for each venue, by a portable hash order."""
    order = F.md5(F.concat(col("pid").cast("string"), F.lit("-7")))
    w = Window.partitionBy("venue", "has_oa").orderBy(order, "pid")
    return t.pubs.withColumn("r", F.row_number().over(w)).filter("r <= CASE WHEN has_oa THEN 5 ELSE 10 END").select("venue", "has_oa", "pid")


def _postings(t: Tables) -> DataFrame:
    """For each query: cumulative postings of its tokens from the rarest on, as far as 3,000, but three tokens at least."""
    wanted = t.table("benchmark").select("item_id", F.explode(F.array_distinct(tokens(col("text")))).alias("token"))
    each = t.texts.select("id", F.explode(F.array_distinct(tokens(col("text")))).alias("token"))
    df = wanted.join(each.groupBy("token").agg(F.count("*").alias("df")), "token")
    along = Window.partitionBy("item_id").orderBy("df", "token")
    upto = F.sum("df").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("upto", upto).withColumn("r", F.row_number().over(along)).filter("r <= 3 OR (r <= 16 AND upto <= 3000)")


VENUE_AXES = f"""paper AS (SELECT pid, max(n_authors) AS n, bool_or(has_orcid) AS orcid, bool_or(on_bin) AS unknown FROM slots GROUP BY 1),
axes AS (SELECT venue, papers, {', '.join(f'round({c}, 9) AS {c}' for c in AXES)} FROM (SELECT venue, count(*) AS papers, count(*)::DOUBLE / count(DISTINCT year) AS per_year, coalesce((late - early)::DOUBLE / nullif(late + early, 0), 0) AS growth,
    avg(has_oa::INT) AS open, avg(orcid::INT) AS orcid, avg(n) AS team, avg(unknown::INT) AS unidentified
    FROM pubs JOIN paper USING (pid) JOIN (SELECT venue, count(*) FILTER (year BETWEEN 1998 AND 2000) AS late, count(*) FILTER (year BETWEEN 1995 AND 1997) AS early FROM pubs JOIN paper USING (pid) WHERE kind <> 'preprint' GROUP BY 1) USING (venue)
    WHERE kind <> 'preprint' GROUP BY venue, late, early))"""
WORDS_OF_YEAR = "e AS (SELECT DISTINCT id, year, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM texts)"
CHANGE = "SELECT word, old, new, ((new + 5) / (n_new + 5)) / ((old + 5) / (n_old + 5)) AS ratio FROM (SELECT word, count(*) FILTER (year < 2005) AS old, count(*) FILTER (year >= 2005) AS new FROM e GROUP BY 1 HAVING count(*) >= 30), (SELECT count(*) FILTER (year < 2005) AS n_old, count(*) FILTER (year >= 2005) AS n_new FROM texts)"

QUERIES = {
    "scan_project_filter": Query("pid:l year:l price:d", lambda t: t.pubs.filter((col("price") > 200000) & col("year").between(1996, 1998)).select("pid", "year", "price"), "SELECT pid, year, price FROM pubs WHERE price > 200000 AND year BETWEEN 1996 AND 1998"),
    "kind_case": Query("kind:s papers:l", lambda t: t.pubs.groupBy("kind").agg(F.count("*").alias("papers")), "SELECT kind, count(*) AS papers FROM pubs GROUP BY 1"),
    "ilike_all_words": Query("id:l source:s", lambda t: t.texts.filter(all_words(col("text"), ["the", "LICENSE"])), "SELECT id, source FROM texts WHERE text ILIKE '%the%' AND text ILIKE '%license%'"),
    "term_share": Query("year:l texts:l stupid:d license:d mail:d", lambda t: t.texts.groupBy("year").agg(F.count("*").alias("texts"), *[share(F.lower("text").rlike(p)).alias(n) for n, p in (("stupid", r"\bstupid\b"), ("license", r"\blicen[sc]e"), ("mail", "@mail[0-9]"))]), r"SELECT year, count(*) AS texts, avg(regexp_matches(lower(text), '\bstupid\b')::INT) AS stupid, avg(regexp_matches(lower(text), '\blicen[sc]e')::INT) AS license, avg(regexp_matches(lower(text), '@mail[0-9]')::INT) AS mail FROM texts GROUP BY 1"),
    "page_format_hist": Query("format:s pages:l", lambda t: t.table("pages").groupBy(F.when(col("url").rlike(r"\?.*="), "query").when(col("url").rlike("#"), "fragment").when(col("url").rlike("/[0-9]+$"), "number").otherwise("other").alias("format")).agg(F.count("*").alias("pages")), r"SELECT CASE WHEN regexp_matches(url, '\?.*=') THEN 'query' WHEN regexp_matches(url, '#') THEN 'fragment' WHEN regexp_matches(url, '/[0-9]+$') THEN 'number' ELSE 'other' END AS format, count(*) AS pages FROM pages GROUP BY 1"),
    "url_parts": Query("page_id:l scheme:s host:s tld:s n:l", _url, "SELECT page_id, split_part(url, ':', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(regexp_extract(url, '^https?://([^/?#]+)', 1), '([^.]+)$', 1) AS tld, length(url) AS n FROM pages"),
    "title_norm_twins": Query("first:l copies:l sources:l", _twins, "SELECT min(id) AS first, count(*) AS copies, count(DISTINCT source) AS sources FROM texts WHERE length(norm) >= 30 GROUP BY norm HAVING count(*) > 1"),
    "token_bigrams": Query("bigram:s texts:l", lambda t: t.texts.select("id", F.explode(F.array_distinct(bigrams(tokens(col("text"))))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("texts")).filter("texts >= 20"), "SELECT bigram, count(*) AS texts FROM (SELECT DISTINCT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS bigram FROM (SELECT id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM texts)) GROUP BY 1 HAVING count(*) >= 20"),
    "array_ops": Query("id:l n:l distinct:l long:l least:s has_the:b".replace("distinct", "uniq"), lambda t: _arrays(t).withColumnRenamed("distinct", "uniq"), "SELECT id, len(w) AS n, len(list_distinct(w)) AS uniq, len(list_filter(w, lambda x: length(x) > 5)) AS long, list_sort(w)[1] AS least, list_contains(w, 'the') AS has_the FROM (SELECT id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM texts)"),
    "zip_explode_slots": Query("pid:l position:l person:l has_orcid:b", _slots, "SELECT pid, position, person, has_orcid FROM slots"),
    "md5_bucket": Query("bucket:l persons:l", lambda t: t.persons.groupBy(bucket(col("person"), 10).alias("bucket")).agg(F.count("*").alias("persons")), "SELECT ('0x' || substr(md5(person::VARCHAR), 1, 8))::BIGINT % 10 AS bucket, count(*) AS persons FROM persons GROUP BY 1"),
    "growth_by_kind": Query("year:l journal:l conference:l preprint:l", lambda t: t.pubs.groupBy("year").agg(*[count_if(col("kind") == k).alias(k) for k in ("journal", "conference", "preprint")]), "SELECT year, count(*) FILTER (kind = 'journal') AS journal, count(*) FILTER (kind = 'conference') AS conference, count(*) FILTER (kind = 'preprint') AS preprint FROM pubs GROUP BY 1"),
    "team_stats": Query("year:l mean:d med:d single:d large:d", lambda t: t.slots.filter("position = 1").join(t.pubs, "pid").groupBy("year").agg(F.avg("n_authors").alias("mean"), F.median("n_authors").alias("med"), share(col("n_authors") == 1).alias("single"), share(col("n_authors") >= 6).alias("large")), "SELECT year, avg(n_authors) AS mean, median(n_authors) AS med, avg((n_authors = 1)::INT) AS single, avg((n_authors >= 6)::INT) AS large FROM slots JOIN pubs USING (pid) WHERE position = 1 GROUP BY 1"),
    "twin_shares": Query(
        "year:l texts:l twins:d", lambda t: t.texts.join(t.texts.filter("length(norm) >= 30").groupBy("norm").agg((F.countDistinct("source") > 1).alias("twin")), "norm", "left").groupBy("year").agg(F.count("*").alias("texts"), share(F.coalesce("twin", F.lit(False))).alias("twins")),
        "SELECT year, count(*) AS texts, avg(coalesce(twin, false)::INT) AS twins FROM texts LEFT JOIN (SELECT norm, count(DISTINCT source) > 1 AS twin FROM texts WHERE length(norm) >= 30 GROUP BY 1) USING (norm) GROUP BY 1",
    ),
    "metadata_shares": Query("year:l orcid:d bins:d oa:d", lambda t: t.slots.join(t.pubs, "pid").groupBy("year").agg(share(col("has_orcid")).alias("orcid"), share(col("on_bin")).alias("bins"), share(col("has_oa")).alias("oa")), "SELECT year, avg(has_orcid::INT) AS orcid, avg(on_bin::INT) AS bins, avg(has_oa::INT) AS oa FROM slots JOIN pubs USING (pid) GROUP BY 1"),
    "cohort_survival": Query("first:l people:l after1:d after3:d after5:d", _cohorts, "SELECT first, count(*) AS people, avg(CASE WHEN first + 1 <= 2000 THEN (last >= first + 1)::INT END) AS after1, avg(CASE WHEN first + 3 <= 2000 THEN (last >= first + 3)::INT END) AS after3, avg(CASE WHEN first + 5 <= 2000 THEN (last >= first + 5)::INT END) AS after5 FROM (SELECT person, min(year) AS first, max(year) AS last FROM slots JOIN pubs USING (pid) WHERE NOT on_bin GROUP BY 1) GROUP BY 1"),
    "newcomers": Query("year:l active:l new:l", _newcomers, "SELECT year, count(*) AS active, count(*) FILTER (first = year) AS new FROM a JOIN (SELECT person, min(year) AS first FROM a GROUP BY 1) USING (person) GROUP BY 1", "a AS (SELECT DISTINCT person, year FROM slots JOIN pubs USING (pid) WHERE NOT on_bin)"),
    "position_bands": Query("band:s slots:l first:d middle:d last:d", _positions, "SELECT CASE WHEN papers < 20 THEN '1 under 20' WHEN papers < 30 THEN '2 20 to 29' ELSE '3 30 or more' END AS band, count(*) AS slots, avg((position = 1)::INT) AS first, avg((position > 1 AND position < n_authors)::INT) AS middle, avg((position = n_authors)::INT) AS last FROM slots JOIN (SELECT person, count(*) AS papers FROM slots WHERE NOT on_bin GROUP BY 1) USING (person) WHERE NOT on_bin AND n_authors >= 3 GROUP BY 1"),
    "unidentified_by_position": Query("position:l slots:l bins:d", lambda t: t.slots.groupBy("position").agg(F.count("*").alias("slots"), share(col("on_bin")).alias("bins")), "SELECT position, count(*) AS slots, avg(on_bin::INT) AS bins FROM slots GROUP BY 1"),
    "alphabetical_vs_chance": Query("venue:s papers:l observed:d expected:d", _alphabetical, "SELECT venue, count(*) AS papers, avg((names = list_sort(names))::INT) AS observed, avg(1.0::DOUBLE / factorial(n_authors::INT)) AS expected FROM (SELECT pid, n_authors, list(name ORDER BY position) AS names FROM slots JOIN persons USING (person) WHERE n_authors BETWEEN 2 AND 6 GROUP BY 1, 2) JOIN pubs USING (pid) GROUP BY 1"),
    "style_by_decade": Query("year:l asks:d colon:d words:d", lambda t: t.texts.groupBy("year").agg(share(F.contains("text", F.lit("?"))).alias("asks"), share(F.contains("text", F.lit(":"))).alias("colon"), F.avg(F.size(F.split("text", " "))).alias("words")), "SELECT year, avg(contains(text, '?')::INT) AS asks, avg(contains(text, ':')::INT) AS colon, avg(len(string_split(text, ' '))) AS words FROM texts GROUP BY 1"),
    "coverage_matrix": Query(
        "source:s field:s share:d", _coverage,
        "SELECT source, substr(field, 3) AS field, share FROM (SELECT source, " + ", ".join(f"avg(({c})::INT) AS f_{n}" for n, (_, c) in FIELDS.items()) + f" FROM texts GROUP BY 1) UNPIVOT (share FOR field IN ({', '.join('f_' + n for n in FIELDS)}))",
    ),
    "team_quantiles": Query("period:l q05:d q25:d q50:d q75:d q95:d", lambda t: t.slots.filter("position = 1").join(t.pubs, "pid").groupBy((F.floor((col("year") - 1995) / 2) * 2 + 1995).alias("period")).agg(F.percentile("n_authors", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("q")).select("period", *[col("q")[i].alias(f"q{p:02}") for i, p in enumerate((5, 25, 50, 75, 95))]), "SELECT (year - 1995) // 2 * 2 + 1995 AS period, quantile_cont(n_authors, 0.05) AS q05, quantile_cont(n_authors, 0.25) AS q25, quantile_cont(n_authors, 0.5) AS q50, quantile_cont(n_authors, 0.75) AS q75, quantile_cont(n_authors, 0.95) AS q95 FROM slots JOIN pubs USING (pid) WHERE position = 1 GROUP BY 1"),
    "joint_density": Query("x:l y:l people:l", _density, "SELECT floor(log10(papers::DOUBLE) * 4 + 1e-9) AS x, floor(log10(sizes::DOUBLE) * 4 + 1e-9) AS y, count(*) AS people FROM (SELECT person, count(*) AS papers, count(DISTINCT n_authors) AS sizes FROM slots WHERE NOT on_bin GROUP BY 1) GROUP BY 1, 2"),
    "distinct_split": Query("kind:s people:l orcid:l", lambda t: t.slots.join(t.pubs, "pid").groupBy("kind").agg(F.countDistinct("person").alias("people"), F.countDistinct(F.when(col("has_orcid"), col("person"))).alias("orcid")), "SELECT kind, count(DISTINCT person) AS people, count(DISTINCT person) FILTER (has_orcid) AS orcid FROM slots JOIN pubs USING (pid) GROUP BY 1"),
    "mode_deterministic": Query("prefix:s usual:s papers:l", _venue_names, "SELECT prefix, arg_min(venue, r) AS usual, sum(n) AS papers FROM (SELECT prefix, venue, count(*) AS n, row_number() OVER (PARTITION BY prefix ORDER BY count(*) DESC, venue) AS r FROM pubs GROUP BY 1, 2) GROUP BY 1"),
    "listagg_members": Query("prefix:s venues:s", lambda t: t.pubs.groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_set("venue")), ", ").alias("venues")), "SELECT prefix, string_agg(DISTINCT venue, ', ' ORDER BY venue) AS venues FROM pubs GROUP BY 1"),
    "concentration": Query("kind:s year:l papers:l top:l leader:s share:d", _concentration, "SELECT kind, year, max(total) AS papers, sum(n) FILTER (r <= 3) AS top, max(venue) FILTER (r = 1) AS leader, sum(n) FILTER (r <= 3) / max(total) AS share FROM (SELECT kind, year, venue, count(*) AS n, row_number() OVER (PARTITION BY kind, year ORDER BY count(*) DESC, venue) AS r, sum(count(*)) OVER (PARTITION BY kind, year) AS total FROM pubs GROUP BY 1, 2, 3) GROUP BY 1, 2"),
    "publisher_share": Query("period:s publisher:s papers:l share:d", _publishers, "SELECT * FROM (SELECT CASE WHEN year < 1998 THEN '1995-1997' ELSE '1998-2001' END AS period, coalesce(publisher, 'other') AS publisher, count(*) AS papers, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY CASE WHEN year < 1998 THEN '1995-1997' ELSE '1998-2001' END) AS share FROM pubs LEFT JOIN (VALUES ('AUTOMOBILE', 'Alpha'), ('BUILDING', 'Beta'), ('FURNITURE', 'Gamma'), ('MACHINERY', 'Alpha')) x(segment, publisher) USING (segment) GROUP BY 1, 2) WHERE publisher <> 'other'"),
    "venue_profiles": Query(
        "venue:s papers:l " + " ".join(f"{c}:d {c}_rank:d" for c in AXES), _profiles,
        "SELECT *, " + ", ".join(f"percent_rank() OVER (ORDER BY {c}) AS {c}_rank" for c in AXES) + " FROM axes", VENUE_AXES,
    ),
    "venue_medians": Query("axis:s middle:d", lambda t: venue_axes(t).unpivot(["venue"], list(AXES), "axis", "v").groupBy("axis").agg(F.median("v").alias("middle")), f"SELECT axis, median(v) AS middle FROM axes UNPIVOT (v FOR axis IN ({', '.join(AXES)})) GROUP BY 1", VENUE_AXES),
    "left_out": Query(
        "people:l inside:l left_out:d", lambda t: t.persons.filter("page_kind = 'numbered'").join(t.slots.groupBy("person").agg(F.countDistinct("n_authors").alias("sizes")), "person", "left").agg(F.count("*").alias("people"), count_if(col("sizes") >= 2).alias("inside"), share(F.coalesce(col("sizes") < 2, F.lit(True))).alias("left_out")),
        "SELECT count(*) AS people, count(*) FILTER (sizes >= 2) AS inside, avg(coalesce(sizes < 2, true)::INT) AS left_out FROM persons LEFT JOIN (SELECT person, count(DISTINCT n_authors) AS sizes FROM slots GROUP BY 1) USING (person) WHERE page_kind = 'numbered'",
    ),
    "falling_words": Query("word:s old:l new:l ratio:d", lambda t: _changing(t, rising=False), f"SELECT * FROM ({CHANGE}) ORDER BY ratio, word LIMIT 40", WORDS_OF_YEAR),
    "treemap_topk": Query("segment:s venue:s papers:l", _treemap, "SELECT segment, CASE WHEN r <= 3 THEN venue ELSE 'other venues' END AS venue, sum(papers) AS papers FROM (SELECT segment, venue, count(*) AS papers, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, venue) AS r FROM pubs GROUP BY 1, 2) GROUP BY 1, 2"),
    "share_of_total": Query("venue:s papers:l share:d", lambda t: t.pubs.groupBy("venue").agg(F.count("*").alias("papers")).transform(with_total, "papers").withColumn("share", col("papers") / col("total")), "SELECT venue, count(*) AS papers, count(*) / sum(count(*)) OVER () AS share FROM pubs GROUP BY 1"),
    "quota_sample": Query("venue:s has_oa:b pid:l", _quota, "SELECT venue, has_oa, pid FROM pubs QUALIFY row_number() OVER (PARTITION BY venue, has_oa ORDER BY md5(pid::VARCHAR || '-7'), pid) <= CASE WHEN has_oa THEN 5 ELSE 10 END"),
    "running_postings": Query(
        "item_id:l token:s df:l upto:l", _postings,
        "SELECT item_id, token, df, upto FROM (SELECT *, sum(df) OVER (PARTITION BY item_id ORDER BY df, token ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY item_id ORDER BY df, token) AS r FROM q JOIN d USING (token)) WHERE r <= 3 OR (r <= 16 AND upto <= 3000)",
        "d AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM texts) GROUP BY 1), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM benchmark)",
    ),
    "rising_words": Query("word:s old:l new:l ratio:d", _changing, "SELECT word, old, new, ((new + 5) / (n_new + 5)) / ((old + 5) / (n_old + 5)) AS ratio FROM (SELECT word, count(*) FILTER (year < 2005) AS old, count(*) FILTER (year >= 2005) AS new FROM e GROUP BY 1 HAVING count(*) >= 30), (SELECT count(*) FILTER (year < 2005) AS n_old, count(*) FILTER (year >= 2005) AS n_new FROM texts) ORDER BY ratio DESC, word LIMIT 40", "e AS (SELECT DISTINCT id, year, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM texts)"),
    "lifespans": Query("segment:s first:l series:l alive:d active:d", _lifespans, "SELECT segment, first, count(*) AS series, avg((last >= 2000)::INT) AS alive, median(active) AS active FROM (SELECT venue, segment, min(year) AS first, max(year) AS last, count(DISTINCT year) AS active FROM pubs GROUP BY 1, 2) GROUP BY 1, 2"),
    "overview": Query("papers:l people:l bins:l slots:l venues:l open:d mean_team:d", lambda t: t.pubs.agg(F.count("*").alias("papers"), F.countDistinct("venue").alias("venues"), share(col("has_oa")).alias("open")).crossJoin(t.persons.agg(count_if(col("page_kind") == "numbered").alias("people"), count_if(col("page_kind") == "disambiguation").alias("bins"))).crossJoin(t.slots.agg(F.count("*").alias("slots"), F.avg(F.when(col("position") == 1, col("n_authors"))).alias("mean_team"))), "SELECT * FROM (SELECT count(*) AS papers, count(DISTINCT venue) AS venues, avg(has_oa::INT) AS open FROM pubs), (SELECT count(*) FILTER (page_kind = 'numbered') AS people, count(*) FILTER (page_kind = 'disambiguation') AS bins FROM persons), (SELECT count(*) AS slots, avg(n_authors) FILTER (position = 1) AS mean_team FROM slots)"),
    "homonyms": Query("name:s people:l", lambda t: t.persons.filter("page_kind = 'numbered'").groupBy("name").agg(F.count("*").alias("people")).filter("people > 1"), "SELECT name, count(*) AS people FROM persons WHERE page_kind = 'numbered' GROUP BY 1 HAVING count(*) > 1"),
    "affiliation": Query("page_kind:s persons:l affiliated:d", lambda t: t.persons.groupBy("page_kind").agg(F.count("*").alias("persons"), share(col("has_affiliation")).alias("affiliated")), "SELECT page_kind, count(*) AS persons, avg(has_affiliation::INT) AS affiliated FROM persons GROUP BY 1"),
    "venue_search": Query("venue:s papers:l exact:b", lambda t: t.pubs.filter(col("venue").ilike("%an%")).groupBy("venue").agg(F.count("*").alias("papers")).withColumn("exact", F.lower("venue") == "iran"), "SELECT venue, count(*) AS papers, lower(venue) = 'iran' AS exact FROM pubs WHERE venue ILIKE '%an%' GROUP BY 1"),
    "hosts_by_page": Query("host:s pages:l share:d", lambda t: _url(t).groupBy("host").agg(F.count("*").alias("pages")).transform(with_total, "pages").withColumn("share", col("pages") / col("total")), "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, count(*) / sum(count(*)) OVER () AS share FROM pages GROUP BY 1"),
    "event_props": Query("event_type:s events:l value:d", lambda t: t.table("events").groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.round("value", 4).cast("decimal(20,4)")).cast("double").alias("value")), "SELECT event_type, count(*) AS events, sum(round(value, 4)::DECIMAL(20, 4))::DOUBLE AS value FROM events GROUP BY 1"),
}
