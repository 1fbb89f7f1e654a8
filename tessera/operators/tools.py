"""Typed, bounded query tools, and the guarded door for ad-hoc SQL."""

from __future__ import annotations

import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.portable import count_if, share
from tessera.plans.tables import Query, Tables

col = F.col
#: Metric -> (expression, population, note)
METRICS = {
    "papers": (F.count, "true", "all papers"),
    "open": (None, "kind <> 'preprint'", "share in open access, without preprints"),
    "price": (None, "true", "mean price"),
}
PLAN_NODES = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Distinct", "Union", "Window", "SubqueryAlias", "View", "Generate", "Expand", "Intersect", "Except", "OneRowRelation",
    "LocalRelation", "UnresolvedSubqueryColumnAliases", "WithCTE", "CTERelationDef", "CTERelationRef", "LogicalRelation", "LogicalRDD", "Relation", "Range", "Pivot", "Unpivot", "Tail", "Offset", "RebalancePartitions",
}


class Refused(ValueError):
    """The question is outside what the tool answers; the message says why."""


def count_papers(t: Tables, kind: str | None = None, first: int | None = None, last: int | None = None, venue: str | None = None, least_price: float | None = None) -> DataFrame:
    """Papers by kind under any of the filters."""
    if first is not None and last is not None and first > last:
        raise Refused("the first year is after the last")
    if kind is not None and kind not in ("journal", "conference", "preprint"):
        raise Refused(f"no such kind: {kind}")
    tests = [(kind, lambda v: col("kind") == v), (first, lambda v: col("year") >= v), (last, lambda v: col("year") <= v), (venue, lambda v: col("venue").ilike(v)), (least_price, lambda v: col("price") >= v)]
    found = t.pubs
    for value, test in tests:
        if value is not None:
            found = found.filter(test(value))
    return found.groupBy("kind").agg(F.count("*").alias("papers"))


def timeseries(t: Tables, metric: str) -> DataFrame:
    if metric not in METRICS:
        raise Refused(f"no such metric: {metric}; there are {', '.join(METRICS)}")
    value = {"papers": F.count("*").cast("double"), "open": share(col("has_oa")), "price": F.avg("price")}[metric]
    return t.pubs.filter(METRICS[metric][1]).groupBy("year").agg(value.alias("value"))


def top_entities(t: Tables, k: int = 20) -> DataFrame:
    """The people with most papers; a leaderboard, so k is what it is for."""
    return t.slots.filter("NOT on_bin").groupBy("person").agg(F.count("*").alias("papers")).join(t.persons.select("person", "name"), "person").orderBy(col("papers").desc(), "person").limit(k)


def namesakes(t: Tables) -> DataFrame:
    """For each shared name: its people, their papers, and the papers on its bins."""
    s = t.slots.groupBy("person").agg(F.count("*").alias("n"))
    p = t.persons.join(s, "person", "left").fillna(0, ["n"])
    return p.groupBy("name").agg(count_if(col("page_kind") == "numbered").alias("people"), F.sum(F.when(col("page_kind") == "numbered", col("n")).otherwise(0)).alias("papers"), F.sum(F.when(col("page_kind") != "numbered", col("n")).otherwise(0)).alias("on_bins")).filter("people > 1")


def _plain(sql: str) -> str:
    """The statement without literals, quoted names and comments."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)


def _nodes(plan):
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]


def guarded_sql(spark: SparkSession, sql: str, cap: int = 200, seconds: float = 5.0, views: set[str] | None = None) -> tuple[list, bool]:
    """(Rows, whether there are more) of one SELECT over registered views.

    The statement is parsed by Spark, and every node of its analysed plan has to be a query node; so commands and writes
    are refused whatever they look like. Files are refused by name. A timer interrupts what runs too long."""
    text = _plain(sql).strip().rstrip(";")
    if ";" in text or not re.match(r"(?is)(select|with)\b", text):
        raise Refused("one SELECT or WITH statement only")
    if re.search(r"(?i)\b(reflect|java_method|read_files|input_file_name|try_reflect|python)\b|\b(parquet|csv|json|orc|text|binaryfile|avro|delta)\s*\.", sql):
        raise Refused("files and foreign calls are out of reach")
    statement = sql.strip().rstrip(";")
    # parsed before anything runs, since a session runs commands as soon as it has analysed them
    for node in _nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)):
        name = node.nodeName().lstrip("'").split(" ")[0]
        if name not in PLAN_NODES and not (name.startswith("Unresolved") and "Function" not in name):
            raise Refused(f"{name} isn't part of a query")
    df = spark.sql(statement)
    for node in _nodes(df._jdf.queryExecution().analyzed()):
        if (name := node.nodeName().split(" ")[0]) not in PLAN_NODES:
            raise Refused(f"{name} isn't part of a query")
        if name == "View" and views is not None and str(node.desc().identifier().table()).lower() not in views:
            raise Refused(f"no such view: {node.desc().identifier().table()}")
    tag = f"guard-{threading.get_ident()}-{id(df)}"
    spark.addTag(tag)
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        rows = df.limit(cap + 1).collect()
    except Exception as e:
        if not timer.is_alive():
            raise Refused(f"stopped after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return rows[:cap], len(rows) > cap


def _guard(t: Tables) -> DataFrame:
    """What the guard makes of a list of statements."""
    t.pubs.createOrReplaceTempView("pubs")
    tries = ["SELECT count(*) FROM pubs", "DROP VIEW pubs", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc/x`", "WITH a AS (SELECT venue FROM pubs) SELECT count(DISTINCT venue) FROM a", "INSERT INTO pubs SELECT * FROM pubs"]
    out = []
    for s in tries:
        try:
            out.append((s, "ok", len(guarded_sql(t.spark, s, seconds=120)[0])))
        except Refused:
            out.append((s, "refused", 0))
    return t.spark.createDataFrame(out, "statement string, outcome string, n long")


QUERIES = {
    "count_papers": Query("kind:s papers:l", lambda t: count_papers(t, first=1996, last=1999, venue="%a%", least_price=100000), "SELECT kind, count(*) AS papers FROM pubs WHERE year BETWEEN 1996 AND 1999 AND venue ILIKE '%a%' AND price >= 100000 GROUP BY 1"),
    "timeseries_metric": Query("year:l value:d", lambda t: timeseries(t, "open"), "SELECT year, avg(has_oa::INT) AS value FROM pubs WHERE kind <> 'preprint' GROUP BY 1"),
    "top_entities": Query("person:l name:s papers:l", top_entities, "SELECT person, name, papers FROM (SELECT person, count(*) AS papers FROM slots WHERE NOT on_bin GROUP BY 1) JOIN persons USING (person) ORDER BY papers DESC, person LIMIT 20"),
    "namesakes": Query("name:s people:l papers:l on_bins:l", namesakes, "SELECT name, count(*) FILTER (page_kind = 'numbered') AS people, coalesce(sum(n) FILTER (page_kind = 'numbered'), 0) AS papers, coalesce(sum(n) FILTER (page_kind <> 'numbered'), 0) AS on_bins FROM (SELECT name, page_kind, coalesce(n, 0) AS n FROM persons LEFT JOIN (SELECT person, count(*) AS n FROM slots GROUP BY 1) USING (person)) GROUP BY 1 HAVING count(*) FILTER (page_kind = 'numbered') > 1"),
    "sql_guard": Query("statement:s outcome:s n:l", _guard, "SELECT * FROM (VALUES ('SELECT count(*) FROM pubs', 'ok', 1), ('DROP VIEW pubs', 'refused', 0), ('SELECT 1; SELECT 2', 'refused', 0), ('SELECT * FROM parquet.`/etc/x`', 'refused', 0), ('WITH a AS (SELECT venue FROM pubs) SELECT count(DISTINCT venue) FROM a', 'ok', 1), ('INSERT INTO pubs SELECT * FROM pubs', 'refused', 0)) v(statement, outcome, n)"),
}
