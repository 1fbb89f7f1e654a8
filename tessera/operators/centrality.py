"""Tables of graph measures: numbering, ranks where a measure may say nothing, agreement of measures, scopes, tractable cores,
exact and ego betweenness, and label propagation around a person."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranks import before
from tessera.operators import graph, rounds
from tessera.operators.graph import ARCS, CORE_ROUNDS, EDGES, POWER_ROUNDS, RANK_ROUNDS, _unrolled_cores, _unrolled_power, _unrolled_ranks, degrees, edges
from tessera.operators.joins import rounded
from tessera.operators.learning import average_ranks
from tessera.operators.profiles import first_of
from tessera.plans.tables import Query, Tables

col = F.col
#: Edges that an exact computation may take; nodes shown around a person; egos of a band of degrees.
BUDGET, AROUND, EGOS = 20_000, 30, 5


def edge_table(t: Tables) -> DataFrame:
    return t.once("edges", edges)


def numbered(t: Tables) -> DataFrame:
    """Nodes numbered from 0 in the order of their ids."""
    return before(degrees(edge_table(t)).select("node"), [col("node")], {"number": F.lit(1)})


def node_table(t: Tables) -> DataFrame:
    """Each node's name, records, years and degree."""
    years = t.slots.filter("NOT on_bin").join(t.pubs.select("pid", "year"), "pid").groupBy("person").agg(F.count("*").alias("records"), F.min("year").alias("first"), F.max("year").alias("last"))
    return t.persons.select("person", "name").join(years, "person").join(degrees(edge_table(t)).withColumnRenamed("node", "person"), "person", "left").fillna(0, ["degree"])


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the place of each value from the largest on, equal values sharing one; 0 where there is none (null or NaN)."""
    known = df.filter(col(value).isNotNull() & ~F.isnan(col(value).cast("double")))
    place = before(known.groupBy(value).agg(F.count("*").alias("c")), [col(value).desc()], {"above": col("c")}).select(value, (col("above") + 1).cast("long").alias(name))
    return df.join(place, value, "left").fillna(0, [name])


def degree_ranks(t: Tables) -> DataFrame:
    """All people by degree; those without co-authors are not ranked."""
    return ranked(t.persons.select("person").join(degrees(edge_table(t)).withColumnRenamed("node", "person"), "person", "left"), "degree", "rank")


MEASURES = ("degree", "pagerank", "core", "eigenvector")


def measured(t: Tables) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
    """(Ids, values of each measure by place, to six places; NaN where one is of the largest component only), or none if there are
    more nodes than values can be sent of."""

    def make(t: Tables):
        if not (g := graph.arcs_once(t)):
            return None
        inside = rounds.largest(g)
        found = (g.degree, rounds.ranks(g, 0.85, 1e-9, 200), rounds.cores(g, 500), np.where(inside, rounds.principal(g, inside, 1e-9, 1000), np.nan))
        return g.ids, {m: rounded(x.astype(float)) for m, x in zip(MEASURES, found, strict=True)}

    return t.kept("measured", make)


def measures(t: Tables) -> DataFrame:
    """(node, degree, pagerank, core, eigenvector) of every node; null where a measure is of the largest component only."""

    def make(t: Tables) -> DataFrame:
        if found := measured(t):
            return graph.arcs_once(t).rows(**{m: pa.array(x, mask=np.isnan(x)) for m, x in found[1].items()})
        e = edge_table(t)
        parts = [graph.pagerank(e).withColumnRenamed("rank", "pagerank"), graph.kcore(e), graph.eigenvector(e).withColumnRenamed("score", "eigenvector")]
        out = degrees(e)
        for p in parts:
            out = out.join(p, "node", "left")
        return out.select("node", *[F.round(col(m).cast("double"), 6).alias(m) for m in MEASURES])

    return t.once("measures", make)


def centrality_table(t: Tables) -> DataFrame:
    """The measures with a rank for each."""
    out = measures(t)
    for m in MEASURES:
        out = ranked(out, m, f"{m}_rank")
    return out


def central(t: Tables, k: int = 10) -> DataFrame:
    """The leaders by each measure, with their names."""
    long = measures(t).unpivot(["node"], list(MEASURES), "measure", "value").filter("value IS NOT NULL").join(t.persons.select(col("person").alias("node"), "name"), "node")
    return first_of(long, "measure", k, col("value").desc(), col("node")).select("measure", "rank", "node", "name", "value")


def percentiles(t: Tables) -> DataFrame:
    """Each node's rank and the share of nodes that are not above it, by degree and PageRank."""
    n = measures(t).agg(F.count("*").alias("n"))
    out = measures(t).select("node", "degree", "pagerank")
    for m in ("degree", "pagerank"):
        out = ranked(out, m, f"{m}_rank")
    share = lambda m: (1 - (col(f"{m}_rank") - 1) / col("n")).alias(f"{m}_share")
    return out.crossJoin(F.broadcast(n)).select("node", "degree_rank", share("degree"), "pagerank_rank", share("pagerank"))


PAIRS = [("degree", "pagerank"), ("degree", "core"), ("pagerank", "eigenvector")]


def _mean_ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def _first(x: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest; of equal ones the first. Places are in the order of ids."""
    some = np.flatnonzero(x >= np.partition(x, -k)[-k]) if len(x) > k else np.arange(len(x))
    return some[np.argsort(-x[some], kind="stable")[:k]]


def _agrees(x: np.ndarray, y: np.ndarray, k: int) -> tuple[float | None, int]:
    known = ~(np.isnan(x) | np.isnan(y))
    x, y = x[known], y[known]
    p, q = _mean_ranks(x), _mean_ranks(y)
    rho = float(np.corrcoef(p, q)[0, 1]) if len(x) > 1 and p.std() > 0 and q.std() > 0 else None
    return rho, len(np.intersect1d(_first(x, k), _first(y, k)))


def agreement(t: Tables, k: int = 50) -> DataFrame:
    """For pairs of measures: the correlation of their average ranks, and how many of the first k they share. The values are on the
    driver from the rounds, where they are ranked; by joins if there are more nodes than values can be sent of."""
    if found := measured(t):
        return t.spark.createDataFrame([(a, b, *_agrees(found[1][a], found[1][b], k)) for a, b in PAIRS], "a string, b string, rho double, common long")
    m = measures(t)
    out = None
    for a, b in PAIRS:
        both = m.filter(col(a).isNotNull() & col(b).isNotNull()).select("node", a, b)
        rho = average_ranks(average_ranks(both, a, "ra"), b, "rb").agg(F.corr("ra", "rb").alias("rho"))
        top = lambda c: both.orderBy(col(c).desc(), "node").limit(k).select("node")  # noqa: B023, E731
        one = rho.crossJoin(F.broadcast(top(a).join(top(b), "node").agg(F.count("*").alias("common")))).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho", "common")
        out = one if out is None else out.unionByName(one)
    return out


def scopes(t: Tables) -> DataFrame:
    """Nodes, edges and mean degree with and without bins, and of journal papers alone."""
    small = t.slots.filter("n_authors BETWEEN 2 AND 50").join(t.pubs.select("pid", "kind"), "pid")

    def one(name: str, rows: DataFrame) -> DataFrame:
        a = rows.select("pid", col("person").alias("u"))
        e = a.join(rows.select("pid", col("person").alias("v")), "pid").filter("u < v").select("u", "v").distinct()
        return e.agg(F.count("*").alias("edges"), F.countDistinct("u").alias("x")).crossJoin(F.broadcast(degrees(e).agg(F.count("*").alias("nodes")))).select(F.lit(name).alias("scope"), "nodes", "edges", (2 * col("edges") / col("nodes")).alias("mean_degree"))

    return one("with bins", small).unionByName(one("without bins", small.filter("NOT on_bin"))).unionByName(one("journals", small.filter("NOT on_bin AND kind = 'journal'")))


def core_sizes(t: Tables) -> DataFrame:
    """Nodes and edges of each core, and whether it is the first that an exact computation can take."""
    if g := graph.arcs_once(t):
        found = rounds.cores(g, 500)
        core, k_edges = g.rows(core=found), rounds.least_of_ends(g, found)
    else:
        e, core = edge_table(t), t.once("cores", lambda t: graph.kcore(edge_table(t)))
        at = lambda c, n: core.select(col("node").alias(c), col("core").alias(n))
        k_edges = e.join(at("u", "cu"), "u").join(at("v", "cv"), "v").groupBy(F.least("cu", "cv").alias("k")).agg(F.count("*").alias("e"))
    k_nodes = core.groupBy(col("core").alias("k")).agg(F.count("*").alias("n"))
    sizes = before(k_nodes.join(k_edges, "k", "left").fillna(0, ["e"]), [col("k").desc()], {"nb": col("n"), "eb": col("e")}).select("k", (col("nb") + col("n")).cast("long").alias("nodes"), (col("eb") + col("e")).cast("long").alias("edges"))
    first = sizes.filter(col("edges") <= BUDGET).agg(F.min("k").alias("first"))
    return sizes.crossJoin(F.broadcast(first)).select("k", "nodes", "edges", F.coalesce(col("k") == col("first"), F.lit(False)).alias("chosen"))


def egos(t: Tables) -> DataFrame:
    """Some people of each band of degrees, by hash: (ego, band)."""
    d = degrees(edge_table(t)).withColumn("band", F.floor(F.log2("degree")).cast("long"))
    return t.once("egos", lambda _: first_of(d, "band", EGOS, F.md5(col("node").cast("string")), col("node")).select(col("node").alias("ego"), "band"))


def ego_betweenness(t: Tables) -> DataFrame:
    """Betweenness of sampled people within their own neighbourhoods: each pair of neighbours that are no co-authors counts one over
    the number of two-step paths between them there."""
    both = t.once("arcs", lambda t: graph.both_ways(edge_table(t)))
    near = t.once("near", lambda t: egos(t).join(both, col("ego") == col("u")).select("ego", col("v").alias("n")))
    inside = t.once("inside", lambda _: near.join(both, col("n") == col("u")).select("ego", "u", "v").join(near.select("ego", col("n").alias("v")), ["ego", "v"]))
    pairs = near.select("ego", col("n").alias("u")).join(near.select("ego", col("n").alias("v")), "ego").filter("u < v").join(inside, ["ego", "u", "v"], "left_anti")
    two = inside.select("ego", "u", col("v").alias("w")).join(inside.select("ego", col("u").alias("w"), "v"), ["ego", "w"]).filter("u < v").groupBy("ego", "u", "v").agg(F.count("*").alias("paths"))
    x = pairs.join(two, ["ego", "u", "v"], "left").groupBy("ego").agg(F.sum(1.0 / (1 + F.coalesce("paths", F.lit(0)))).alias("b"))
    return egos(t).join(x, "ego", "left").select("ego", "band", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def betweenness_agreement(t: Tables) -> DataFrame:
    """Ego and exact betweenness of the sampled people, by band of degrees: their means and how they correlate over all."""
    exact = graph.betweenness(edge_table(t), None, graph.arcs_once(t))
    x = ego_betweenness(t).join(exact.select(col("node").alias("ego"), col("betweenness").alias("exact")), "ego")
    whole = x.agg(F.corr("betweenness", "exact").alias("corr"))
    return x.groupBy("band").agg(F.count("*").alias("egos"), F.avg("betweenness").alias("ego_mean"), F.avg("exact").alias("exact_mean")).crossJoin(F.broadcast(whole))


def propagate(u: np.ndarray, v: np.ndarray, weight: np.ndarray, rounds: int = 50) -> dict[int, int]:
    """Communities by weighted label propagation: nodes in order of id take the label that most weight around them has, the
    smallest of equal ones, until none changes."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in zip(u.tolist(), v.tolist(), weight.tolist(), strict=True):
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {n: n for n in sorted(near)}
    for _ in range(rounds):
        moved = False
        for n in label:
            votes: dict[int, float] = {}
            for m, w in near[n]:
                votes[label[m]] = votes.get(label[m], 0.0) + w
            best = min(votes, key=lambda x: (-votes[x], x))
            if votes[best] > votes.get(label[n], 0.0):
                label[n], moved = best, True
        if not moved:
            break
    return label


def circles(t: Tables) -> DataFrame:
    """The strongest co-authors of each sampled person in communities: (ego, node, community). A group has at most so many
    nodes."""
    e = edge_table(t)
    ends = e.select("u", "v", "papers").unionByName(e.select(col("v").alias("u"), col("u").alias("v"), "papers"))
    near = first_of(egos(t).join(ends, col("ego") == col("u")), "ego", AROUND, col("papers").desc(), col("v")).select("ego", col("v").alias("n"))
    among = e.join(near.select("ego", col("n").alias("u")), "u").join(near.select("ego", col("n").alias("v")), ["ego", "v"]).select("ego", "u", "v", "papers")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = propagate(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["papers"].to_numpy().astype(float))
        return pd.DataFrame({"ego": pdf["ego"].iloc[0], "node": list(label), "community": list(label.values())})

    return among.groupBy("ego").applyInPandas(run, "ego long, node long, community long")


DEGREES = "deg AS MATERIALIZED (SELECT u AS node, count(*) AS degree FROM arcs GROUP BY 1)"
ALL = f"""{EDGES}, {_unrolled_power(POWER_ROUNDS)}, {_unrolled_ranks(RANK_ROUNDS).split(ARCS + ', ')[1]}, {_unrolled_cores(CORE_ROUNDS).split(ARCS + ', ')[1]}, {DEGREES},
ms AS MATERIALIZED (SELECT node, round(degree::DOUBLE, 6) AS degree, round(r{RANK_ROUNDS}.rank, 6) AS pagerank, round(core::DOUBLE, 6) AS core, round(score, 6) AS eigenvector FROM deg LEFT JOIN r{RANK_ROUNDS} USING (node) LEFT JOIN k{CORE_ROUNDS} USING (node) LEFT JOIN x{POWER_ROUNDS} USING (node))"""
PLACE = "CASE WHEN {0} IS NULL THEN 0 ELSE rank() OVER (ORDER BY {0} DESC NULLS LAST) END"


def _mean_rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


def _agree(a: str, b: str) -> str:
    both = f"(SELECT * FROM ms WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"SELECT '{a}' AS a, '{b}' AS b, (SELECT corr(ra, rb) FROM (SELECT {_mean_rank(a)} AS ra, {_mean_rank(b)} AS rb FROM {both})) AS rho, (SELECT count(*) FROM (SELECT node FROM {both} ORDER BY {a} DESC, node LIMIT 50) JOIN (SELECT node FROM {both} ORDER BY {b} DESC, node LIMIT 50) USING (node)) AS common"


def _scope(name: str, where: str) -> str:
    e = f"(SELECT DISTINCT a.person AS u, b.person AS v FROM sm a JOIN sm b ON a.pid = b.pid AND a.person < b.person WHERE {where})"
    nodes = f"(SELECT count(DISTINCT x) FROM (SELECT unnest([u, v]) AS x FROM {e}))"
    return f"SELECT '{name}' AS scope, {nodes} AS nodes, count(*) AS edges, 2 * count(*) / {nodes} AS mean_degree FROM {e}"


NEAR = f"""{EDGES}, {ARCS}, {DEGREES},
ego AS MATERIALIZED (SELECT node AS ego, floor(log2(degree)) AS band FROM deg QUALIFY row_number() OVER (PARTITION BY floor(log2(degree)) ORDER BY md5(node::VARCHAR), node) <= {EGOS}),
nr AS MATERIALIZED (SELECT ego, v AS n FROM ego JOIN arcs ON u = ego),
ins AS MATERIALIZED (SELECT a.ego, arcs.u, arcs.v FROM nr a JOIN arcs ON arcs.u = a.n JOIN nr b ON b.ego = a.ego AND b.n = arcs.v),
two AS MATERIALIZED (SELECT a.ego, a.u, b.v, count(*) AS paths FROM ins a JOIN ins b ON b.ego = a.ego AND b.u = a.v AND a.u < b.v GROUP BY 1, 2, 3)"""

QUERIES = {
    "node_numbers": Query("node:l number:l", numbered, "SELECT node, row_number() OVER (ORDER BY node) - 1 AS number FROM (SELECT DISTINCT u AS node FROM arcs)", f"{EDGES}, {ARCS}"),
    "node_table": Query(
        "person:l name:s records:l first:l last:l degree:l", node_table,
        "SELECT person, name, records, first, last, coalesce(n, 0) AS degree FROM persons JOIN (SELECT person, count(*) AS records, min(year) AS first, max(year) AS last FROM slots JOIN pubs USING (pid) WHERE NOT on_bin GROUP BY 1) USING (person) LEFT JOIN outs ON node = person", f"{EDGES}, {ARCS}",
    ),
    "degree_ranks": Query("person:l degree:l rank:l", degree_ranks, f"SELECT person, n AS degree, {PLACE.format('n')} AS rank FROM persons LEFT JOIN outs ON node = person", f"{EDGES}, {ARCS}"),
    "centrality_table": Query(
        "node:l " + " ".join(f"{m}:d {m}_rank:l" for m in MEASURES), centrality_table, "SELECT *, " + ", ".join(f"{PLACE.format(m)} AS {m}_rank" for m in MEASURES) + " FROM ms", ALL,
    ),
    "central_people": Query(
        "measure:s rank:l node:l name:s value:d", central,
        f"SELECT measure, row_number() OVER (PARTITION BY measure ORDER BY value DESC, node) AS rank, node, name, value FROM (SELECT * FROM ms UNPIVOT (value FOR measure IN ({', '.join(MEASURES)}))) JOIN (SELECT person AS node, name FROM persons) USING (node) QUALIFY rank <= 10", ALL,
    ),
    "author_centrality": Query(
        "node:l degree_rank:l degree_share:d pagerank_rank:l pagerank_share:d", percentiles,
        "SELECT node, degree_rank, 1 - (degree_rank - 1) / n AS degree_share, pagerank_rank, 1 - (pagerank_rank - 1) / n AS pagerank_share FROM (SELECT node, rank() OVER (ORDER BY degree DESC) AS degree_rank, rank() OVER (ORDER BY pagerank DESC) AS pagerank_rank, count(*) OVER ()::DOUBLE AS n FROM ms)", ALL,
    ),
    "measure_agreement": Query("a:s b:s rho:d common:l", agreement, " UNION ALL ".join(_agree(a, b) for a, b in PAIRS), ALL),
    "bin_effect": Query(
        "scope:s nodes:l edges:l mean_degree:d", scopes, " UNION ALL ".join([_scope("with bins", "true"), _scope("without bins", "NOT a.on_bin AND NOT b.on_bin"), _scope("journals", "NOT a.on_bin AND NOT b.on_bin AND a.kind = 'journal'")]),
        "sm AS (SELECT s.pid, person, on_bin, kind FROM slots s JOIN pubs p ON p.pid = s.pid WHERE n_authors BETWEEN 2 AND 50)",
    ),
    "core_sizes": Query(
        "k:l nodes:l edges:l chosen:b", core_sizes,
        f"SELECT k, nodes, edges, coalesce(k = min(k) FILTER (edges <= {BUDGET}) OVER (), false) AS chosen FROM (SELECT k, sum(n) OVER (ORDER BY k DESC) AS nodes, sum(coalesce(e, 0)) OVER (ORDER BY k DESC) AS edges FROM (SELECT core AS k, count(*) AS n FROM k{CORE_ROUNDS} GROUP BY 1) LEFT JOIN (SELECT least(a.core, b.core) AS k, count(*) AS e FROM edges JOIN k{CORE_ROUNDS} a ON a.node = u JOIN k{CORE_ROUNDS} b ON b.node = v GROUP BY 1) USING (k))",
        f"{EDGES}, {_unrolled_cores(CORE_ROUNDS)}",
    ),
    "ego_betweenness": Query(
        "ego:l band:l betweenness:d", ego_betweenness,
        "SELECT ego, band, coalesce(b, 0) AS betweenness FROM ego LEFT JOIN (SELECT p.ego, sum(1.0::DOUBLE / (1 + coalesce(paths, 0))) AS b FROM (SELECT a.ego, a.n AS u, b.n AS v FROM nr a JOIN nr b ON a.ego = b.ego AND a.n < b.n WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.ego = a.ego AND ins.u = a.n AND ins.v = b.n)) p LEFT JOIN two ON two.ego = p.ego AND two.u = p.u AND two.v = p.v GROUP BY 1) USING (ego)", NEAR,
    ),
    "betweenness_agreement": Query("band:l egos:l ego_mean:d exact_mean:d corr:d", betweenness_agreement),
    "circles": Query("ego:l node:l community:l", circles),
}
