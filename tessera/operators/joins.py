"""Joins: semi, anti, scalar, correlated, range and two-hop."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbourhoods import listed
from tessera.operators.teams import Block, Homes, Lists, span
from tessera.plans.tables import Query, Tables

col = F.col
AS_OF, HORIZON = 1998, 2


def teams(t: Tables) -> DataFrame:
    """The people of each paper; they are at most 50."""
    return t.authored.groupBy("pid", "year", "venue").agg(F.collect_list("person").alias("people"))


def arcs(team: DataFrame) -> DataFrame:
    """(a, b, year): a row for each paper and ordered pair of its people."""
    return team.select("year", "people", F.explode("people").alias("a")).select("a", F.explode("people").alias("b"), "year").filter("a <> b")


def adjacency(t: Tables) -> DataFrame:
    """Both directions of co-authorship by year; bins and papers with one or over 50 authors are left out."""
    return arcs(teams(t)).groupBy("a", "b", "year").agg(F.count("*").alias("papers"))


#: adj: the same in SQL
ADJ = "adj AS (SELECT x.person AS a, y.person AS b, x.year, count(*) AS papers FROM authored x JOIN authored y ON x.pid = y.pid AND x.person <> y.person GROUP BY 1, 2, 3)"


def anchors(t: Tables) -> DataFrame:
    """People with three papers as of the year."""
    return t.authored.filter(col("year") <= AS_OF).groupBy("person").agg(F.count("*").alias("papers")).filter("papers >= 3").select(col("person").alias("a"))


ANCHORS = f"anchors AS (SELECT person AS a FROM authored WHERE year <= {AS_OF} GROUP BY 1 HAVING count(*) >= 3)"


def then_lists(t: Tables) -> DataFrame:
    """(a, b, papers, last), a row a person: the co-authors as of the year, the papers with each and the last one's year."""

    def make(t: Tables) -> DataFrame:
        team = t.once("teams", teams).filter(col("year") <= AS_OF)
        dealt = team.select("year", "people", F.explode("people").alias("a")).repartitionByRange("a")
        pairs = dealt.select("a", F.explode("people").alias("b"), "year").filter("a <> b")
        return listed(pairs.groupBy("a", "b").agg(F.count("*").cast("int").alias("papers"), F.max("year").alias("last")), "papers", "last")

    return t.kept("lists_then", make)


def neighbours(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(Edges as of the year, degrees as of the year), from the written lists."""
    lists = then_lists(t)
    edges = lists.select("a", F.explode(F.arrays_zip("b", "papers", "last")).alias("x")).select("a", "x.b", col("x.papers").cast("long").alias("papers"), "x.last")
    return edges, lists.select("a", F.size("b").cast("long").alias("degree"))


def future(t: Tables) -> DataFrame:
    """(a, b), once each: co-authors of the two years after."""
    return arcs(t.once("teams", teams).filter(col("year").between(AS_OF + 1, AS_OF + HORIZON))).select("a", "b").distinct()


NEIGHBOURS = f"n AS MATERIALIZED (SELECT a, b, sum(papers) AS papers, max(year) AS last FROM adj WHERE year <= {AS_OF} GROUP BY 1, 2), deg AS (SELECT a, count(*) AS degree FROM n GROUP BY 1)"


#: What can be asked of the candidates, and its type.
MEASURED = {"common": "int", "adamic": "double", "allocation": "double", "strength": "int", "above": "int", "da": "int", "db": "int", "y": "int"}
#: Rows in a batch that a task gives back.
BATCH = 500_000


class Paths:
    """From one anchor: the people two steps away and not one, by place, and what the people between say of them."""

    def __init__(self, lists: Lists, a: int, near: np.ndarray, papers: np.ndarray, last: np.ndarray):
        self.lists, self.near, self.papers, self.last = lists, near, papers, last
        self.via, self.to = lists.of(near)
        n = np.bincount(self.to, minlength=len(lists.ids))
        n[near] = 0
        n[a] = 0
        self.hit = np.flatnonzero(n > 0)
        self.common = n[self.hit]

    @functools.cached_property
    def at(self) -> np.ndarray:
        """Where in the lists each of ``to`` is."""
        return span(self.lists.first[self.via], self.lists.size[self.via])

    def _sum(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.to, np.repeat(weight[self.via], self.lists.size[self.via]), len(self.lists.ids))[self.hit]

    @functools.cached_property
    def adamic(self) -> np.ndarray:
        return self._sum(self.lists.adamic)

    @functools.cached_property
    def allocation(self) -> np.ndarray:
        return self._sum(self.lists.allocation)

    @functools.cached_property
    def strength(self) -> np.ndarray:
        least = np.minimum(np.repeat(self.papers, self.lists.size[self.via]), self.lists.papers[self.at])
        out, more = np.ones(len(self.lists.ids), np.int32), least > 1
        np.maximum.at(out, self.to[more], least[more])
        return out[self.hit]

    def above(self, at: np.ndarray) -> np.ndarray:
        """For some of the found, how many have a higher Adamic-Adar score to six places."""
        return len(self.score) - np.searchsorted(np.sort(self.score), self.score[at], side="right")

    @functools.cached_property
    def score(self) -> np.ndarray:
        return np.rint(self.adamic * 1e6)

    def among(self, ids: np.ndarray) -> np.ndarray:
        """1 for those of the found that are among ids."""
        ids_here = self.lists.ids
        if not len(ids) or not len(self.hit):
            return np.zeros(len(self.hit), np.int32)
        place = np.searchsorted(ids_here, ids)
        place = place[(place < len(ids_here)) & (ids_here[np.minimum(place, len(ids_here) - 1)] == ids)]
        out = np.zeros(len(self.hit), np.int32)
        at = np.minimum(np.searchsorted(self.hit, place), len(self.hit) - 1)
        out[at[self.hit[at] == place]] = 1
        return out


def homes(t: Tables) -> Homes:
    """The teams by blocks of people, made when they are first asked for."""
    return t.kept("homes", lambda t: Homes(t.once("teams", teams).filter(col("year") <= AS_OF + HORIZON), AS_OF))


def found(t: Tables, columns: list[str], pick: Callable | None = None, fold: Callable | None = None, schema: str | None = None, only: Callable | None = None, gather: Callable | None = None) -> DataFrame:
    """(a, b, columns of MEASURED) for the candidates, or for those of the mask that ``pick(paths, then)`` gives, of all anchors or
    those that ``only`` says. ``fold`` makes, of a dict of these columns for the rows of some whole anchors, one of the schema's
    columns; what ``gather()`` makes for a block takes such dicts by ``add`` and gives one of the schema's columns at its ``end``."""
    home = homes(t)
    sent = t.kept("degrees", lambda t: t.spark.sparkContext.broadcast((home.ids, home.degree))) if "db" in columns else None  # 12 bytes a person
    kinds = [("a", np.int64), ("b", np.int64), *[(c, {"int": np.int32, "double": np.float64}[MEASURED[c]]) for c in columns]]

    def work(block: Block):
        rows: list[list[np.ndarray]] = []
        degree, of, n = None, None, 0
        held = gather() if gather else None

        def flush():
            if rows:
                out = {c: np.concatenate(x).astype(k, copy=False) for x, (c, k) in zip(zip(*rows, strict=True), kinds, strict=True)}
                rows.clear()
                if held:
                    held.add(out)
                else:
                    yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in (fold(out) if fold else out).items()})

        for lists, a, own, near, papers, last, then in block.each():
            if only and not only(int(a)):
                continue
            if sent and of is not lists:
                every, known = sent.value
                of, degree = lists, known[np.minimum(np.searchsorted(every, lists.ids), max(len(every) - 1, 0))]  # who is found has one
            p = Paths(lists, own, near, papers, last)
            at = np.arange(len(p.hit)) if pick is None else np.flatnonzero(pick(p, then))
            if len(at):
                make = {"above": p.above, "da": lambda at: np.full(len(at), len(near), np.int32), "db": lambda at: degree[p.hit[at]], "y": lambda at: p.among(then)[at]}  # noqa: B023
                rows.append([np.full(len(at), a), lists.ids[p.hit[at]], *[make[c](at) if c in make else getattr(p, c)[at] for c in columns]])
                n += len(at)
            if n >= BATCH:
                yield from flush()
                n = 0
        yield from flush()
        if held:
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in held.end().items()})

    return home.walk(work, schema or ", ".join(["a long", "b long", *[f"{c} {MEASURED[c]}" for c in columns]]))


def candidates(t: Tables, pick: Callable | None = None) -> DataFrame:
    """People two steps from an anchor and not one step, with what the people between say of them. No row is made for a path:
    a block of anchors walks the lists of those next to them (see teams)."""
    x = found(t, ["common", "adamic", "allocation", "strength"], pick)
    return x.select("a", "b", col("common").cast("long").alias("common"), "adamic", "allocation", col("strength").cast("long").alias("strength"))


CANDIDATES = "cand AS MATERIALIZED (SELECT x.a, y.b, count(*) AS common, sum(1 / ln(greatest(d.degree, 2)::DOUBLE)) AS adamic, sum(1.0::DOUBLE / d.degree) AS allocation, max(least(x.papers, y.papers)) AS strength FROM n x JOIN anchors USING (a) JOIN n y ON y.a = x.b AND y.b <> x.a JOIN deg d ON d.a = x.b WHERE NOT EXISTS (SELECT 1 FROM n z WHERE z.a = x.a AND z.b = y.b) GROUP BY 1, 2)"
GRAPH_CTES = f"{ADJ}, {ANCHORS}, {NEIGHBOURS}, {CANDIDATES}"


def _both(t: Tables) -> DataFrame:
    n = t.slots.filter("NOT on_bin").join(t.pubs, "pid").groupBy("person", "venue").agg(F.count("*").alias("n"))
    least = t.pubs.agg(F.min("venue").alias("x"), F.max("venue").alias("y"))
    one = lambda c: n.join(F.broadcast(least.select(col(c).alias("venue"))), "venue").select("person", col("n").alias(f"n_{c}"))
    return one("x").join(one("y"), "person")


def _history(t: Tables) -> DataFrame:
    """For each person and year: papers in the same venue strictly before it."""
    per = t.authored.groupBy("person", "venue", "year").agg(F.count("*").alias("n"))
    q = per.select("person", "venue", col("year").alias("q"))
    return q.join(per, ["person", "venue"]).filter("year < q").groupBy("person", "q").agg(F.sum("n").alias("before"), F.countDistinct("venue").alias("venues"))


def _among(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the ids are known; those known are in order."""
    if not len(known):
        return np.zeros(len(ids), bool)
    return known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids


def new_links(p: Paths, then: np.ndarray) -> np.ndarray:
    """Of an anchor's co-authors after, who was not one before."""
    return then[~_among(then, p.lists.ids[p.near])]


def _origin(t: Tables) -> DataFrame:
    """Where new links of anchors in the years after come from: two steps away, farther, or a newcomer; counted where they are found,
    of whoever is farther against all people as of the year (8 bytes each)."""
    home = homes(t)
    sent = t.spark.sparkContext.broadcast(home.ids)

    def work(block: Block):
        two, rest = 0, [np.zeros(0, np.int64)]
        for lists, _, own, near, papers, last, then in block.each():
            p = Paths(lists, own, near, papers, last)
            new = new_links(p, then)
            far = ~_among(new, lists.ids[p.hit])
            two += len(new) - int(far.sum())
            rest.append(new[far])
        seen = _among(np.concatenate(rest), sent.value)
        yield pa.RecordBatch.from_pydict({"origin": ["distance 2", "farther", "newcomer"], "links": [two, int(seen.sum()), int((~seen).sum())]})

    return home.walk(work, "origin string, links long").groupBy("origin").agg(F.sum("links").alias("links")).filter("links > 0")


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves up, as a Query does."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def jaccard(x: dict[str, np.ndarray]) -> np.ndarray:
    return x["common"] / (x["da"].astype(np.int64) + x["db"] - x["common"])


def _featured(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    attachment = x["da"].astype(np.int64) * x["db"]
    return {"a": x["a"], "b": x["b"], "common": x["common"].astype(np.int64), "jaccard": rounded(jaccard(x)), "attachment": attachment, "y": x["y"].astype(np.int64)}


def features(t: Tables) -> DataFrame:
    """Candidates with similarity measures, and whether they become co-authors in the two years after. The task that finds a pair
    makes its row as it is returned: for Spark nothing is left to compute or to round, which took more time a row than the walk."""
    return found(t, ["common", "da", "db", "y"], fold=_featured, schema="a long, b long, common long, jaccard double, attachment long, y long")


QUERIES = {
    "semi_in": Query("pid:l year:l", lambda t: t.pubs.join(t.slots.filter("n_authors >= 7").select("pid"), "pid", "left_semi"), "SELECT pid, year FROM pubs WHERE pid IN (SELECT pid FROM slots WHERE n_authors >= 7)"),
    "anti_not_exists": Query("person:l name:s", lambda t: t.persons.join(t.slots.join(t.pubs.filter("kind = 'journal' AND has_oa AND year = 1999"), "pid"), "person", "left_anti"), "SELECT person, name FROM persons WHERE NOT EXISTS (SELECT 1 FROM slots s JOIN pubs p USING (pid) WHERE kind = 'journal' AND has_oa AND year = 1999 AND s.person = persons.person)"),
    "scalar_cross": Query("venue:s papers:l ratio:d", lambda t: t.pubs.groupBy("venue").agg(F.count("*").alias("papers")).crossJoin(F.broadcast(t.pubs.agg((F.count("*") / F.countDistinct("venue")).alias("mean")))).withColumn("ratio", col("papers") / col("mean")), "SELECT venue, papers, papers / mean AS ratio FROM (SELECT venue, count(*) AS papers FROM pubs GROUP BY 1), (SELECT count(*) / count(DISTINCT venue) AS mean FROM pubs)"),
    "correlated_count": Query("person:l papers:l", lambda t: t.persons.join(t.slots.groupBy("person").agg(F.count("*").alias("papers")), "person", "left").fillna(0, ["papers"]), "SELECT person, (SELECT count(*) FROM slots s WHERE s.person = p.person) AS papers FROM persons p"),
    "authors_in_both": Query("person:l n_x:l n_y:l", _both, "SELECT person, n_x, n_y FROM (SELECT person, count(*) AS n_x FROM slots JOIN pubs USING (pid) WHERE NOT on_bin AND venue = (SELECT min(venue) FROM pubs) GROUP BY 1) JOIN (SELECT person, count(*) AS n_y FROM slots JOIN pubs USING (pid) WHERE NOT on_bin AND venue = (SELECT max(venue) FROM pubs) GROUP BY 1) USING (person)"),
    "pair_papers": Query("a:l b:l papers:l first:l last:l", lambda t: adjacency(t).filter("a < b").groupBy("a", "b").agg(F.sum("papers").alias("papers"), F.min("year").alias("first"), F.max("year").alias("last")).filter("papers >= 3"), "SELECT a, b, sum(papers) AS papers, min(year) AS first, max(year) AS last FROM adj WHERE a < b GROUP BY 1, 2 HAVING sum(papers) >= 3", ADJ),
    "range_history": Query("person:l q:l before:l venues:l", _history, "SELECT x.person, x.year AS q, sum(y.n) AS before, count(DISTINCT y.venue) AS venues FROM h x JOIN h y ON x.person = y.person AND x.venue = y.venue AND y.year < x.year GROUP BY 1, 2", "h AS (SELECT person, venue, year, count(*) AS n FROM authored GROUP BY 1, 2, 3)"),
    "two_hop_candidates": Query("a:l b:l common:l adamic:d allocation:d strength:l", candidates, "SELECT * FROM cand", GRAPH_CTES),
    "link_features": Query("a:l b:l common:l jaccard:d attachment:l y:l", features, rounded=True, sql=f"SELECT c.a, c.b, common, common / (x.degree + z.degree - common) AS jaccard, x.degree * z.degree AS attachment, coalesce(f.y, 0) AS y FROM cand c JOIN deg x ON x.a = c.a JOIN deg z ON z.a = c.b LEFT JOIN (SELECT DISTINCT a, b, 1 AS y FROM adj WHERE year BETWEEN {AS_OF + 1} AND {AS_OF + 2}) f ON f.a = c.a AND f.b = c.b", ctes=GRAPH_CTES),
    "new_link_origin": Query("origin:s links:l", _origin, f"SELECT CASE WHEN EXISTS (SELECT 1 FROM cand WHERE cand.a = w.a AND cand.b = w.b) THEN 'distance 2' WHEN EXISTS (SELECT 1 FROM deg WHERE deg.a = w.b) THEN 'farther' ELSE 'newcomer' END AS origin, count(*) AS links FROM (SELECT DISTINCT adj.a, adj.b FROM adj JOIN anchors USING (a) WHERE year BETWEEN {AS_OF + 1} AND {AS_OF + 2} AND NOT EXISTS (SELECT 1 FROM n WHERE n.a = adj.a AND n.b = adj.b)) w GROUP BY 1", GRAPH_CTES),
}
