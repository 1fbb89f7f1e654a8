"""Single records in full, for all keys at once, and reports on labels, scores and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import before, with_total
from tessera.plans.tables import Query, Tables
from tessera.sources import files

col = F.col
#: Steps of the grid on which a threshold is tuned.
GRID = 20


def author_detail(t: Tables) -> DataFrame:
    """Each person's papers, years, venues and main venue (ties: the first by name), from counts by person and venue."""
    per = t.slots.filter("NOT on_bin").join(t.pubs, "pid").groupBy("person", "venue").agg(F.count("*").alias("n"), F.min("year").alias("first"), F.max("year").alias("last"))
    main = F.min(F.struct((-col("n")).alias("n"), col("venue"))).alias("main")
    return per.groupBy("person").agg(F.sum("n").alias("papers"), F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("venues"), main).withColumn("main", col("main.venue"))


def degree_split(t: Tables) -> DataFrame:
    """Distinct co-authors of each person on papers of 2 to 50 authors, people and shared names apart."""
    s = t.slots.filter("n_authors BETWEEN 2 AND 50").select("pid", "person", "on_bin")
    other = s.select("pid", col("person").alias("other"), col("on_bin").alias("bin"))
    pairs = s.filter("NOT on_bin").join(other, "pid").filter("person <> other").select("person", "other", "bin").distinct()
    return pairs.groupBy("person").agg(F.count_if(~col("bin")).alias("people"), F.count_if("bin").alias("bins"))


def paper_detail(t: Tables) -> DataFrame:
    """Each paper with its authors' names in order, and how many of them are identified."""
    named = t.slots.join(t.persons.select("person", "name"), "person")
    lists = named.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("a"), F.count_if("has_orcid").alias("orcids"), F.count_if("on_bin").alias("bins"))
    return lists.join(t.pubs, "pid").withColumn("authors", F.array_join("a.name", "; "))


def venue_detail(t: Tables, k: int = 3) -> DataFrame:
    """The people with most papers at each venue."""
    n = t.slots.filter("NOT on_bin").join(t.pubs.select("pid", "venue"), "pid").groupBy("venue", "person").agg(F.count("*").alias("papers"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("venue").orderBy(col("papers").desc(), "person"))).filter(col("rank") <= k)


def oa_gaps(t: Tables, k: int = 10) -> DataFrame:
    """Venues and kinds with the smallest open share."""
    return t.pubs.groupBy("venue", "kind").agg(F.count("*").alias("papers"), F.avg(col("has_oa").cast("int")).alias("open")).orderBy(F.round("open", 9), "venue", "kind").limit(k)


def survival(t: Tables) -> DataFrame:
    """The share of people with at least v papers, from a row a distinct number of papers."""
    h = t.slots.filter("NOT on_bin").groupBy("person").agg(F.count("*").alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    up = before(h, [col("v").desc()], {"above": col("c")}).withColumn("least", col("above") + col("c"))
    return with_total(up, "c", "n").withColumn("share", col("least") / col("n"))


def threshold_curve(t: Tables) -> DataFrame:
    """Precision, recall and F1 at each threshold of a score; the confusion counts are running sums over the grid, so no
    row is looked at once per threshold. The score is a text's length, in parts of 4,000 characters."""
    labels = t.table("labels").filter("quality IS NOT NULL").select("doc_id", "quality")
    s = t.table("documents").select("doc_id", F.least(F.floor(col("n_chars") * GRID / 4000), F.lit(GRID)).alias("step")).join(labels, "doc_id")
    n = s.groupBy("step").agg(F.sum("quality").alias("yes"), F.sum(1 - col("quality")).alias("no"))
    from_ = Window.orderBy(col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    c = n.select("step", F.sum("yes").over(from_).alias("tp"), F.sum("no").over(from_).alias("fp"), F.sum("yes").over(Window.partitionBy()).alias("all"))
    return c.select("step", "tp", "fp", (col("all") - col("tp")).alias("fn"), F.try_divide(2 * col("tp"), col("tp") + col("fp") + (col("all"))).alias("f1"))


def agreement(t: Tables) -> DataFrame:
    """Confusion of two labels by source."""
    both = t.table("labels").filter("quality IS NOT NULL AND toxic IS NOT NULL").join(t.texts.select(col("id").alias("doc_id"), "source"), "doc_id")
    cell = lambda q, x: F.count_if((col("quality") == q) & (col("toxic") == x)).alias(f"n{q}{x}")
    return both.groupBy("source").agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))


def usage(t: Tables) -> DataFrame:
    """Counts, users, median and largest value of each kind of event."""
    return t.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.median("value").alias("median"), F.max("value").alias("largest"))


def rank_overlap(t: Tables, k: int = 50) -> DataFrame:
    """How many of the k first people by papers are among the k first by co-authors."""
    deg, n = degree_split(t), t.slots.filter("NOT on_bin").groupBy("person").agg(F.count("*").alias("papers"))
    a = n.orderBy(col("papers").desc(), "person").limit(k).select("person")
    b = deg.orderBy(col("people").desc(), "person").limit(k).select("person")
    return a.join(b, "person").agg(F.count("*").alias("common"))


VENUES = "SELECT person, venue, count(*) AS n, min(year) AS first, max(year) AS last FROM slots JOIN pubs USING (pid) WHERE NOT on_bin GROUP BY 1, 2"
SPLIT = "deg AS (SELECT person, count(*) FILTER (NOT bin) AS people, count(*) FILTER (bin) AS bins FROM (SELECT DISTINCT a.person, b.person AS other, b.on_bin AS bin FROM slots a JOIN slots b USING (pid) WHERE NOT a.on_bin AND a.person <> b.person AND a.n_authors BETWEEN 2 AND 50) GROUP BY 1)"

def reports(t: Tables) -> DataFrame:
    """Text reports of the nations of each region, a title, a header, dashes and rows each, taken apart again."""
    nation = t.table("nation").join(t.table("region"), col("n_regionkey") == col("r_regionkey"))
    row = F.concat(col("n_name"), F.lit("  "), F.format_string("%,d", col("n_nationkey") * 1000), F.lit("  "), col("n_nationkey").cast("string"), F.lit("%"))
    lines = nation.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    text = lines.select(F.concat(F.lit("=== "), "r_name", F.lit("\nname  n  share\n----  -  -----\n"), "rows", F.lit("\n\nloose note\n")).alias("value"))
    found = text.lateralJoin(files.ReportSections(col("value").outer())).filter("row > 0")
    return found.select("title", F.get("cells", F.lit(0)).alias("name"), files.number(F.get("cells", F.lit(1))).alias("n"), files.number(F.get("cells", F.lit(2))).alias("share"))


QUERIES = {
    "report_sections": Query("title:s name:s n:d share:d", reports, "SELECT r_name AS title, n_name AS name, n_nationkey * 1000 AS n, n_nationkey AS share FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "author_detail": Query("person:l papers:l first:l last:l venues:l main:s", author_detail, f"SELECT person, sum(n) AS papers, min(first) AS first, max(last) AS last, count(*) AS venues, arg_min(venue, (-n, venue)) AS main FROM ({VENUES}) GROUP BY 1"),
    "degree_split": Query("person:l people:l bins:l", degree_split, "SELECT * FROM deg", SPLIT),
    "paper_detail": Query("pid:l year:l venue:s authors:s orcids:l bins:l", paper_detail, "SELECT pid, year, venue, authors, orcids, bins FROM pubs JOIN (SELECT pid, string_agg(name, '; ' ORDER BY position) AS authors, count(*) FILTER (has_orcid) AS orcids, count(*) FILTER (on_bin) AS bins FROM slots JOIN persons USING (person) GROUP BY 1) USING (pid)"),
    "venue_detail": Query("venue:s person:l papers:l rank:l", venue_detail, f"SELECT venue, person, n AS papers, row_number() OVER (PARTITION BY venue ORDER BY n DESC, person) AS rank FROM ({VENUES}) QUALIFY rank <= 3"),
    "oa_gaps": Query("venue:s kind:s papers:l open:d", oa_gaps, "SELECT venue, kind, count(*) AS papers, avg(has_oa::INT) AS open FROM pubs GROUP BY 1, 2 ORDER BY round(open, 9), venue, kind LIMIT 10"),
    "survival": Query("v:l c:l least:l share:d", survival, "SELECT v, c, sum(c) OVER (ORDER BY v DESC) AS least, sum(c) OVER (ORDER BY v DESC) / sum(c) OVER () AS share FROM (SELECT v, count(*) AS c FROM (SELECT person, count(*) AS v FROM slots WHERE NOT on_bin GROUP BY 1) GROUP BY 1)"),
    "threshold_curve": Query("step:l tp:l fp:l fn:l f1:d", threshold_curve, f"SELECT step, tp, fp, a - tp AS fn, 2.0::DOUBLE * tp / (tp + fp + a) AS f1 FROM (SELECT step, sum(yes) OVER (ORDER BY step DESC) AS tp, sum(no) OVER (ORDER BY step DESC) AS fp, sum(yes) OVER () AS a FROM (SELECT least(floor(n_chars * {GRID} / 4000.0::DOUBLE), {GRID}) AS step, sum(quality) AS yes, sum(1 - quality) AS no FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1))"),
    "agreement": Query("source:s n00:l n01:l n10:l n11:l", agreement, "SELECT source, " + ", ".join(f"count(*) FILTER (quality = {q} AND toxic = {x}) AS n{q}{x}" for q in (0, 1) for x in (0, 1)) + " FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1"),
    "usage": Query("event_type:s n:l users:l median:d largest:d", usage, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, median(value) AS median, max(value) AS largest FROM events GROUP BY 1"),
    "rank_overlap": Query("common:l", rank_overlap, "SELECT count(*) AS common FROM (SELECT person FROM slots WHERE NOT on_bin GROUP BY 1 ORDER BY count(*) DESC, person LIMIT 50) JOIN (SELECT person FROM deg ORDER BY people DESC, person LIMIT 50) USING (person)", SPLIT),
}
