"""The entities of the queries, as derived from the star schema: papers, author slots, persons, texts and vectors.

Papers are orders, venues the customer's nation, an author slot a distinct (order, part), persons are parts; every 50th
person is a name shared by several people (a bin), which never counts as a person.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.portable import title_norm
from tessera.plans.staging import stage


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def once(self, name: str, make) -> DataFrame:
        """make(self), written when it is first asked for: for what a plan reads several times."""
        return self.kept(name, lambda t: stage(make(t), name))

    def kept(self, name: str, make) -> DataFrame:
        """make(self), a table that it has written itself, when it is first asked for."""
        if name not in self._made:
            self._made[name] = make(self)
        return self._made[name]

    @functools.cached_property
    def pubs(self) -> DataFrame:
        kind = F.when(F.col("o_orderstatus") == "F", "conference").when(F.col("o_orderstatus") == "O", "journal").otherwise("preprint")
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        place = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return (
            self.table("orders")
            .join(place, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_orderkey").alias("pid"), F.year("o_orderdate").alias("year"), kind.alias("kind"), F.col("n_name").alias("venue"), F.col("r_name").alias("prefix"), F.col("c_mktsegment").alias("segment"), (F.col("o_totalprice") > 150000).alias("has_oa"), F.col("o_totalprice").alias("price"))
        )

    @functools.cached_property
    def slots(self) -> DataFrame:
        """Dealt by paper once, which serves the distinct slots, their numbers and joins by paper."""
        one = self.table("lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("pid"), F.col("l_partkey").alias("person")).agg((F.max("l_discount") > 0.05).alias("has_orcid"))
        of = Window.partitionBy("pid")
        return one.select("*", F.row_number().over(of.orderBy("person")).alias("position"), F.count("*").over(of).alias("n_authors"), (F.col("person") % 50 == 0).alias("on_bin"))

    @functools.cached_property
    def persons(self) -> DataFrame:
        kind = F.when(F.col("p_partkey") % 50 == 0, "disambiguation").otherwise("numbered")
        return self.table("part").select(F.col("p_partkey").alias("person"), F.col("p_name").alias("name"), kind.alias("page_kind"), (F.col("p_size") > 25).alias("has_affiliation"), F.col("p_brand").alias("brand"))

    @functools.cached_property
    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", (2000 + F.col("doc_id") % 10).alias("year"), title_norm(F.col("text")).alias("norm"))

    @functools.cached_property
    def authored(self) -> DataFrame:
        """Slots of identified people on papers of 2 to 50 authors, with the paper's year."""
        return self.slots.filter("NOT on_bin AND n_authors BETWEEN 2 AND 50").join(self.pubs.select("pid", "year", "kind", "venue"), "pid")


#: The same in DuckDB's SQL.
SQL = """
pubs AS (SELECT o_orderkey AS pid, year(o_orderdate) AS year,
    CASE o_orderstatus WHEN 'F' THEN 'conference' WHEN 'O' THEN 'journal' ELSE 'preprint' END AS kind,
    n_name AS venue, r_name AS prefix, c_mktsegment AS segment, o_totalprice > 150000 AS has_oa, o_totalprice AS price
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
slots AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY person) AS position, count(*) OVER (PARTITION BY pid) AS n_authors, person % 50 = 0 AS on_bin
    FROM (SELECT l_orderkey AS pid, l_partkey AS person, max(l_discount) > 0.05 AS has_orcid FROM lineitem GROUP BY 1, 2)),
persons AS (SELECT p_partkey AS person, p_name AS name, CASE WHEN p_partkey % 50 = 0 THEN 'disambiguation' ELSE 'numbered' END AS page_kind, p_size > 25 AS has_affiliation, p_brand AS brand FROM part),
texts AS (SELECT doc_id AS id, text, lang, source, 2000 + doc_id % 10 AS year, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS norm FROM documents),
authored AS (SELECT s.*, p.year, p.kind, p.venue FROM slots s JOIN pubs p USING (pid) WHERE NOT on_bin AND n_authors BETWEEN 2 AND 50)
"""

CASTS = {"l": ("long", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN")}


class Query:
    """A query: its columns (``name:type`` with l, d, s or b), its DataFrame and the same in DuckDB's SQL.

    Both sides are cast to the columns' types; doubles are rounded to six places, by the builder itself where ``rounded`` says so
    (Spark's rounding goes through decimals)."""

    def __init__(self, columns: str, build, sql: str | None = None, ctes: str = "", rounded: bool = False):
        self.columns = [c.split(":") for c in columns.split()]
        self.build, self._sql, self._ctes, self.rounded = build, sql, ctes, rounded

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.on(Tables(spark, sf_dir))

    def on(self, tables: Tables) -> DataFrame:
        """The result over tables that other queries may use too, with what was written for them."""
        df = self.build(tables)
        one = lambda c, k: F.round(F.col(c).cast("double"), 6) if k == "d" and not self.rounded else F.col(c).cast(CASTS[k][0])
        return df.select(*[one(c, k).alias(c) for c, k in self.columns])

    @property
    def sql(self) -> str | None:
        if self._sql is None:
            return None
        one = lambda c, k: f"round(CAST({c} AS DOUBLE), 6) AS {c}" if k == "d" else f"CAST({c} AS {CASTS[k][1]}) AS {c}"
        return f"WITH {SQL}{', ' + self._ctes if self._ctes else ''} SELECT {', '.join(one(c, k) for c, k in self.columns)} FROM ({self._sql}) AS result"
