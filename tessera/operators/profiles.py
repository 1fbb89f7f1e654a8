"""Profiles of people and venues: what a page of each shows, for all of them at once, and how they are searched for.

A lookup of one key is a filter on these results; everything is keyed by person or venue, so that Catalyst pushes it down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.portable import count_if, jaro_winkler, share
from tessera.operators.graph import EDGES, degrees, edges, people_of_teams, triangles, triangles_of
from tessera.plans.tables import Query, Tables

col = F.col
#: Least similarity of a close spelling, and the length from which spellings are compared.
FUZZY, FUZZY_LENGTH = 0.86, 6
TOP = 3


def first_of(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(col("rank") <= k)


# People


def author_stats(t: Tables) -> DataFrame:
    """Each person's papers, years, mean team, share with an ORCID, and places on papers of three or more; co-authors on papers
    of 2 to 50, people and shared names apart."""
    s = t.slots.filter("NOT on_bin").join(t.pubs.select("pid", "year"), "pid")
    large = col("n_authors") >= 3
    own = s.groupBy("person").agg(
        F.count("*").alias("papers"), F.min("year").alias("first"), F.max("year").alias("last"), F.avg("n_authors").alias("team"), share(col("has_orcid")).alias("orcid"),
        count_if(large & (col("position") == 1)).alias("as_first"), count_if(large & (col("position") == col("n_authors"))).alias("as_last"), count_if(large).alias("on_large"),
    )
    small = t.slots.filter("n_authors BETWEEN 2 AND 50").select("pid", "person", "on_bin")
    other = small.select("pid", col("person").alias("other"), col("on_bin").alias("bin"))
    met = small.filter("NOT on_bin").join(other, "pid").filter("person <> other").select("person", "other", "bin").distinct()
    degree = met.groupBy("person").agg(count_if(~col("bin")).alias("coauthors"), count_if(col("bin")).alias("on_bins"))
    return own.join(degree, "person", "left").fillna(0, ["coauthors", "on_bins"])


def author_yearly(t: Tables) -> DataFrame:
    return t.slots.filter("NOT on_bin").join(t.pubs, "pid").groupBy("person", "year", "kind").agg(F.count("*").alias("papers"))


def together(t: Tables) -> DataFrame:
    """(person, other, papers, last): both directions, bins left out, papers of 2 to 50 authors."""
    a = t.authored.select("pid", "year", "person")
    return a.join(t.authored.select("pid", col("person").alias("other")), "pid").filter("person <> other").groupBy("person", "other").agg(F.count("*").alias("papers"), F.max("year").alias("last"))


def author_coauthors(t: Tables) -> DataFrame:
    """The strongest co-authors of each person."""
    named = together(t).join(t.persons.select(col("person").alias("other"), "name"), "other")
    return first_of(named, "person", TOP, col("papers").desc(), col("name"), col("other"))


def coauthors_at(t: Tables) -> DataFrame:
    """Of each person: the co-authors with two joint papers or more who also publish at the first venue by name, and how many
    co-authors there are in all; the first number never stands for the second."""
    venue = F.broadcast(t.pubs.agg(F.min("venue").alias("venue")))
    there = t.slots.filter("NOT on_bin").join(t.pubs.filter("kind <> 'preprint'").join(venue, "venue", "left_semi"), "pid", "left_semi").select(col("person").alias("other")).distinct()
    pairs = together(t)
    listed = pairs.filter("papers >= 2").join(there, "other", "left_semi").groupBy("person").agg(F.count("*").alias("listed"))
    return pairs.groupBy("person").agg(F.count("*").alias("total")).join(listed, "person", "left").fillna(0, ["listed"])


def author_venues(t: Tables) -> DataFrame:
    """The main venues of each person, without preprints."""
    n = t.slots.filter("NOT on_bin").join(t.pubs.filter("kind <> 'preprint'"), "pid").groupBy("person", "venue").agg(F.count("*").alias("papers"))
    return first_of(n, "person", TOP, col("papers").desc(), col("venue"))


def author_papers(t: Tables, first: int | None = 1996, last: int | None = 1999, kind: str | None = "journal") -> DataFrame:
    """Each person's latest papers under the filters, with the true number of matches beside the capped list."""
    tests = [(first, col("year") >= first), (last, col("year") <= last), (kind, col("kind") == kind)]
    found = t.slots.filter("NOT on_bin").select("pid", "person", "position").join(t.pubs, "pid")
    for value, test in tests:
        found = found if value is None else found.filter(test)
    total = F.count("*").over(Window.partitionBy("person"))
    return first_of(found.withColumn("matching", total), "person", TOP, col("year").desc(), col("pid").desc())


def name_search(t: Tables) -> DataFrame:
    """People whose name holds each of some texts: exact names first, then by papers, with how many share the name."""
    wanted = F.broadcast(t.spark.createDataFrame([("widget",), ("cold",), ("cold bolt",)], "q string"))
    papers = t.slots.groupBy("person").agg(F.count("*").alias("papers"))
    same = t.persons.groupBy("name").agg(F.count("*").alias("namesakes"))
    hits = t.persons.join(wanted, F.contains(F.lower("name"), col("q"))).join(papers, "person", "left").fillna(0, ["papers"]).join(same, "name")
    order = (F.lower("name") == col("q")).desc(), col("papers").desc(), col("name"), col("person")
    return first_of(hits, "q", 10, *order).select("q", "rank", "person", "name", "page_kind", "papers", "namesakes")


def fuzzy_names(t: Tables) -> DataFrame:
    """For misspelled names: those of the same first three letters that are spelled alike, by Jaro-Winkler. Only where nothing
    holds the name, and only for names long enough."""
    names = t.persons.select("name").distinct()
    wrong = names.select(F.concat(F.substr("name", F.lit(1), F.length("name") - 2), F.lit("x")).alias("q")).filter(F.length("q") >= FUZZY_LENGTH).distinct()
    wrong = wrong.join(names, col("q") == col("name"), "left_anti").withColumn("k", F.substring("q", 1, 3))
    near = wrong.join(names.withColumn("k", F.substring("name", 1, 3)), "k").filter(~F.contains("name", col("q")))
    scored = near.withColumn("s", F.round(jaro_winkler("name", "q"), 6)).filter(col("s") >= FUZZY)
    return first_of(scored, "q", TOP, col("s").desc(), col("name")).select("q", "name", "s", "rank")


# Papers


def paper_twins(t: Tables) -> DataFrame:
    """The other texts with the same normalised title, the earliest ten of each."""
    long = t.texts.filter("length(norm) >= 30").select("norm", "id", "year", "source")
    copies = long.groupBy("norm").agg(F.count("*").alias("n")).filter("n > 1")
    some = long.join(copies, "norm")
    firsts = first_of(some, "norm", 11, col("year"), col("id")).select("norm", col("id").alias("twin"), col("year").alias("twin_year"), "rank")
    pairs = some.select("norm", "id").join(firsts, "norm").filter("id <> twin")
    return first_of(pairs.drop("rank"), "id", 10, col("twin_year"), col("twin")).select("id", "twin", "rank")


def paper_search(t: Tables, words: tuple[str, ...] = ("the", "and"), lang: str | None = "en", first: int | None = 2003, last: int | None = None, k: int = 30) -> DataFrame:
    """The latest texts that hold all words, under the filters."""
    found = t.texts
    for w in words:
        found = found.filter(F.contains(F.lower("text"), F.lit(w.lower())))
    for value, test in ((lang, col("lang") == lang), (first, col("year") >= first), (last, col("year") <= last)):
        found = found if value is None else found.filter(test)
    return found.orderBy(col("year").desc_nulls_last(), "id").limit(k).select("id", "year", "source")


# Venues


def venue_head(t: Tables) -> DataFrame:
    """Each venue's size, span, active years, name variants (its segments) and shares."""
    return t.pubs.groupBy("venue").agg(F.count("*").alias("papers"), F.min("year").alias("first"), F.max("year").alias("last"), F.countDistinct("year").alias("active"), F.countDistinct("segment").alias("variants"), share(col("has_oa")).alias("open"))


def venue_yearly(t: Tables) -> DataFrame:
    paper = t.slots.groupBy("pid").agg(F.max("n_authors").alias("n"), F.bool_or("on_bin").alias("unknown"))
    return t.pubs.filter("kind <> 'preprint'").join(paper, "pid").groupBy("venue", "year").agg(F.count("*").alias("papers"), F.avg("n").alias("team"), share(col("has_oa")).alias("open"), share(col("unknown")).alias("unidentified"))


def venue_names(t: Tables) -> DataFrame:
    """The variants of each venue, by size."""
    n = t.pubs.groupBy("venue", "segment").agg(F.count("*").alias("papers"), F.min("year").alias("first"), F.max("year").alias("last"))
    return first_of(n, "venue", 6, col("papers").desc(), col("segment"))


def venue_recent(t: Tables) -> DataFrame:
    return first_of(t.pubs, "venue", TOP, col("year").desc(), col("pid").desc()).select("venue", "rank", "pid", "year", "kind")


def venue_scatter(t: Tables, least: int = 30, since: int = 1998) -> DataFrame:
    """Venues large and live enough to plot."""
    return venue_head(t).filter((col("papers") >= least) & (col("last") >= since)).select("venue", "papers", F.round(100 * col("open"), 1).alias("pct_open"), "last")


def top_venues(t: Tables, first: int = 1996, last: int = 1999, least: int = 5, k: int = 10) -> DataFrame:
    """The leading venues of a span of years by each of three measures."""
    team = t.slots.groupBy("pid").agg(F.max("n_authors").alias("n"))
    v = t.pubs.filter((col("kind") != "preprint") & col("year").between(first, last)).join(team, "pid").groupBy("venue").agg(F.count("*").alias("papers"), F.round(100 * share(col("has_oa")), 6).alias("open_access"), F.round(F.avg("n"), 6).alias("authors_per_paper"))
    long = v.filter(col("papers") >= least).withColumn("size", col("papers")).select("venue", "size", col("papers").cast("double").alias("papers"), "open_access", "authors_per_paper").unpivot(["venue", "size"], ["papers", "open_access", "authors_per_paper"], "metric", "value")
    return first_of(long, "metric", k, col("value").desc(), col("size").desc(), col("venue"))


def venue_fuzzy(t: Tables) -> DataFrame:
    """Venues by a part of the name, else by the closest spelling. There are few venues, so all are compared."""
    wanted = F.broadcast(t.spark.createDataFrame([("nation_1",), ("natoin_2",), ("nation 7x",), ("xyzzyx",)], "q string"))
    v = t.pubs.groupBy("venue").agg(F.count("*").alias("papers"))
    pairs = v.crossJoin(wanted).withColumn("holds", F.contains(F.lower("venue"), col("q"))).withColumn("s", F.round(jaro_winkler(F.lower("venue"), "q"), 6))
    some = pairs.withColumn("any", F.bool_or("holds").over(Window.partitionBy("q"))).filter(col("holds") | (~col("any") & (col("s") >= FUZZY)))
    return first_of(some, "q", 8, (F.lower("venue") == col("q")).desc(), F.when(col("any"), 0.0).otherwise(col("s")).desc(), col("papers").desc(), col("venue")).select("q", "rank", "venue", "papers")


def by_year(t: Tables) -> DataFrame:
    """Records of each year by how they are marked, and the shares that are open or carry an ORCID."""
    orcid = t.slots.groupBy("pid").agg(F.bool_or("has_orcid").alias("orcid"))
    return t.pubs.join(orcid, "pid", "left").groupBy("year").agg(F.count("*").alias("records"), count_if(col("segment") == "BUILDING").alias("versions"), count_if(col("segment") == "MACHINERY").alias("concepts"), count_if(~col("segment").isin("BUILDING", "MACHINERY")).alias("plain"), share(col("has_oa")).alias("open"), share(F.coalesce("orcid", F.lit(False))).alias("orcid"))


def url_countries(t: Tables) -> DataFrame:
    """The last part of each host with its share of all pages, the twelve largest."""
    last = F.trim(F.regexp_extract(F.regexp_extract("url", "^https?://([^/?#]+)", 1), r"([^.]+)$", 1))
    n = t.table("pages").groupBy(last.alias("country")).agg(F.count("*").alias("pages"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("pages").alias("all")))).withColumn("pct", F.round(100.0 * col("pages") / col("all"), 1)).orderBy(col("pages").desc(), "country").limit(12)


# The graph around a person


def clustering(t: Tables) -> DataFrame:
    """Each person's local clustering: closed pairs of neighbours over all pairs."""
    return people_of_teams(t).people().join(triangles_of(t), "node", "left").select("node", "degree", F.when(col("degree") > 1, 2 * F.coalesce("triangles", F.lit(0)) / (col("degree") * (col("degree") - 1))).otherwise(0.0).alias("clustering"))


def graph_shape(t: Tables) -> DataFrame:
    """Nodes, edges, density, and global clustering (three times the triangles over the wedges)."""
    e = t.once("edges", edges)
    d = degrees(e).agg(F.count("*").alias("nodes"), F.sum(col("degree") * (col("degree") - 1) / 2).alias("wedges"), (F.sum("degree") / 2).cast("long").alias("edges"))
    closed = triangles(e).agg(F.sum("triangles").alias("closed"))
    return d.crossJoin(F.broadcast(closed)).select("nodes", "edges", (2 * col("edges") / (col("nodes") * (col("nodes") - 1))).alias("density"), F.try_divide("closed", "wedges").alias("transitivity"))


SEARCH = "wanted(q) AS (VALUES ('widget'), ('cold'), ('cold bolt'))"
TOGETHER = "tog AS MATERIALIZED (SELECT x.person, y.person AS other, count(*) AS papers, max(x.year) AS last FROM authored x JOIN authored y ON x.pid = y.pid AND x.person <> y.person GROUP BY 1, 2)"
PAPER = "paper AS (SELECT pid, max(n_authors) AS n, bool_or(on_bin) AS unknown, bool_or(has_orcid) AS orcid FROM slots GROUP BY 1)"
CLOSED = f"{EDGES}, deg AS MATERIALIZED (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1), tri AS MATERIALIZED (SELECT node, count(*) AS triangles FROM (SELECT unnest([x.u, x.v, y.v]) AS node FROM edges x JOIN edges y ON y.u = x.v JOIN edges z ON z.u = x.u AND z.v = y.v) GROUP BY 1)"

QUERIES = {
    "author_stats": Query(
        "person:l papers:l first:l last:l team:d orcid:d as_first:l as_last:l on_large:l coauthors:l on_bins:l", author_stats,
        """SELECT person, papers, first, last, team, orcid, as_first, as_last, on_large, coalesce(coauthors, 0) AS coauthors, coalesce(on_bins, 0) AS on_bins FROM (
           SELECT person, count(*) AS papers, min(year) AS first, max(year) AS last, avg(n_authors) AS team, avg(has_orcid::INT) AS orcid, count(*) FILTER (n_authors >= 3 AND position = 1) AS as_first,
           count(*) FILTER (n_authors >= 3 AND position = n_authors) AS as_last, count(*) FILTER (n_authors >= 3) AS on_large FROM slots JOIN pubs USING (pid) WHERE NOT on_bin GROUP BY 1)
           LEFT JOIN (SELECT x.person, count(DISTINCT y.person) FILTER (NOT y.on_bin) AS coauthors, count(DISTINCT y.person) FILTER (y.on_bin) AS on_bins FROM slots x JOIN slots y ON x.pid = y.pid AND x.person <> y.person WHERE x.n_authors BETWEEN 2 AND 50 GROUP BY 1) USING (person)""",
    ),
    "author_yearly": Query("person:l year:l kind:s papers:l", author_yearly, "SELECT person, year, kind, count(*) AS papers FROM slots JOIN pubs USING (pid) WHERE NOT on_bin GROUP BY 1, 2, 3"),
    "author_coauthors": Query(
        "person:l other:l papers:l last:l rank:l", author_coauthors,
        f"SELECT person, other, papers, last, row_number() OVER (PARTITION BY person ORDER BY papers DESC, name, other) AS rank FROM tog JOIN (SELECT person AS other, name FROM persons) USING (other) QUALIFY rank <= {TOP}", TOGETHER,
    ),
    "coauthors_at": Query(
        "person:l total:l listed:l", coauthors_at,
        "SELECT person, count(*) AS total, count(*) FILTER (papers >= 2 AND other IN (SELECT person FROM slots JOIN pubs USING (pid) WHERE NOT on_bin AND kind <> 'preprint' AND venue = (SELECT min(venue) FROM pubs))) AS listed FROM tog GROUP BY 1", TOGETHER,
    ),
    "author_venues": Query(
        "person:l venue:s papers:l rank:l", author_venues,
        f"SELECT person, venue, count(*) AS papers, row_number() OVER (PARTITION BY person ORDER BY count(*) DESC, venue) AS rank FROM slots JOIN pubs USING (pid) WHERE NOT on_bin AND kind <> 'preprint' GROUP BY 1, 2 QUALIFY rank <= {TOP}",
    ),
    "author_papers": Query(
        "person:l pid:l year:l position:l matching:l rank:l", author_papers,
        f"SELECT person, pid, year, position, count(*) OVER (PARTITION BY person) AS matching, row_number() OVER (PARTITION BY person ORDER BY year DESC, pid DESC) AS rank FROM slots JOIN pubs USING (pid) WHERE NOT on_bin AND year BETWEEN 1996 AND 1999 AND kind = 'journal' QUALIFY rank <= {TOP}",
    ),
    "name_search": Query(
        "q:s rank:l person:l name:s page_kind:s papers:l namesakes:l", name_search,
        """SELECT q, row_number() OVER (PARTITION BY q ORDER BY (lower(name) = q) DESC, papers DESC, name, person) AS rank, person, name, page_kind, papers, namesakes FROM (
           SELECT p.*, coalesce(n, 0) AS papers, count(*) OVER (PARTITION BY name) AS namesakes FROM persons p LEFT JOIN (SELECT person, count(*) AS n FROM slots GROUP BY 1) USING (person)) JOIN wanted ON contains(lower(name), q) QUALIFY rank <= 10""", SEARCH,
    ),
    "fuzzy_names": Query(
        "q:s name:s s:d rank:l", fuzzy_names,
        f"""SELECT q, name, round(jaro_winkler_similarity(name, q), 6) AS s, row_number() OVER (PARTITION BY q ORDER BY round(jaro_winkler_similarity(name, q), 6) DESC, name) AS rank FROM (SELECT DISTINCT substr(name, 1, length(name) - 2) || 'x' AS q FROM persons)
            JOIN (SELECT DISTINCT name FROM persons) ON substr(q, 1, 3) = substr(name, 1, 3) WHERE length(q) >= {FUZZY_LENGTH} AND q NOT IN (SELECT name FROM persons) AND NOT contains(name, q) AND round(jaro_winkler_similarity(name, q), 6) >= {FUZZY} QUALIFY rank <= {TOP}""",
    ),
    "paper_twins": Query(
        "id:l twin:l rank:l", paper_twins,
        "SELECT a.id, b.id AS twin, row_number() OVER (PARTITION BY a.id ORDER BY b.year, b.id) AS rank FROM texts a JOIN texts b ON a.norm = b.norm AND a.id <> b.id WHERE length(a.norm) >= 30 QUALIFY rank <= 10",
    ),
    "paper_search": Query("id:l year:l source:s", paper_search, "SELECT id, year, source FROM texts WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND lang = 'en' AND year >= 2003 ORDER BY year DESC NULLS LAST, id LIMIT 30"),
    "venue_head": Query("venue:s papers:l first:l last:l active:l variants:l open:d", venue_head, "SELECT venue, count(*) AS papers, min(year) AS first, max(year) AS last, count(DISTINCT year) AS active, count(DISTINCT segment) AS variants, avg(has_oa::INT) AS open FROM pubs GROUP BY 1"),
    "venue_yearly": Query("venue:s year:l papers:l team:d open:d unidentified:d", venue_yearly, "SELECT venue, year, count(*) AS papers, avg(n) AS team, avg(has_oa::INT) AS open, avg(unknown::INT) AS unidentified FROM pubs JOIN paper USING (pid) WHERE kind <> 'preprint' GROUP BY 1, 2", PAPER),
    "venue_names": Query("venue:s segment:s papers:l first:l last:l rank:l", venue_names, "SELECT venue, segment, count(*) AS papers, min(year) AS first, max(year) AS last, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, segment) AS rank FROM pubs GROUP BY 1, 2 QUALIFY rank <= 6"),
    "venue_recent": Query("venue:s rank:l pid:l year:l kind:s", venue_recent, f"SELECT venue, row_number() OVER (PARTITION BY venue ORDER BY year DESC, pid DESC) AS rank, pid, year, kind FROM pubs QUALIFY rank <= {TOP}"),
    "venue_scatter": Query("venue:s papers:l pct_open:d last:l", venue_scatter, "SELECT venue, count(*) AS papers, round(100 * avg(has_oa::INT), 1) AS pct_open, max(year) AS last FROM pubs GROUP BY 1 HAVING count(*) >= 30 AND max(year) >= 1998"),
    "top_venues": Query(
        "metric:s venue:s value:d rank:l", top_venues,
        """SELECT metric, venue, value, row_number() OVER (PARTITION BY metric ORDER BY value DESC, size DESC, venue) AS rank FROM (SELECT venue, count(*) AS size, count(*)::DOUBLE AS papers, round(100 * avg(has_oa::INT), 6) AS open_access, round(avg(n), 6) AS authors_per_paper
           FROM pubs JOIN paper USING (pid) WHERE kind <> 'preprint' AND year BETWEEN 1996 AND 1999 GROUP BY 1 HAVING count(*) >= 5) UNPIVOT (value FOR metric IN (papers, open_access, authors_per_paper)) QUALIFY rank <= 10""", PAPER,
    ),
    "venue_fuzzy": Query(
        "q:s rank:l venue:s papers:l", venue_fuzzy,
        f"""SELECT q, row_number() OVER (PARTITION BY q ORDER BY (lower(venue) = q) DESC, CASE WHEN hit THEN 0 ELSE s END DESC, papers DESC, venue) AS rank, venue, papers FROM (SELECT *, bool_or(holds) OVER (PARTITION BY q) AS hit FROM (
            SELECT q, venue, papers, contains(lower(venue), q) AS holds, round(jaro_winkler_similarity(lower(venue), q), 6) AS s FROM (SELECT venue, count(*) AS papers FROM pubs GROUP BY 1), (VALUES ('nation_1'), ('natoin_2'), ('nation 7x'), ('xyzzyx')) w(q)))
            WHERE holds OR (NOT hit AND s >= {FUZZY}) QUALIFY rank <= 8""",
    ),
    "records_by_year": Query(
        "year:l records:l versions:l concepts:l plain:l open:d orcid:d", by_year,
        "SELECT year, count(*) AS records, count(*) FILTER (segment = 'BUILDING') AS versions, count(*) FILTER (segment = 'MACHINERY') AS concepts, count(*) FILTER (segment NOT IN ('BUILDING', 'MACHINERY')) AS plain, avg(has_oa::INT) AS open, avg(coalesce(orcid, false)::INT) AS orcid FROM pubs LEFT JOIN paper USING (pid) GROUP BY 1", PAPER,
    ),
    "url_countries": Query("country:s pages:l pct:d", url_countries, "SELECT trim(regexp_extract(regexp_extract(url, '^https?://([^/?#]+)', 1), '([^.]+)$', 1)) AS country, count(*) AS pages, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM pages GROUP BY 1 ORDER BY pages DESC, country LIMIT 12"),
    "local_clustering": Query("node:l degree:l clustering:d", clustering, "SELECT node, degree, CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering FROM deg LEFT JOIN tri USING (node)", CLOSED),
    "network_shape": Query(
        "nodes:l edges:l density:d transitivity:d", graph_shape,
        "SELECT count(*) AS nodes, sum(degree) // 2 AS edges, sum(degree) / (count(*) * (count(*) - 1)) AS density, (SELECT sum(triangles) FROM tri) / sum(degree * (degree - 1) / 2) AS transitivity FROM deg", CLOSED,
    ),
}
