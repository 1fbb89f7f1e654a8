"""The collaboration graph: edges, degrees, communities, and the iterative measures.

Iterative operators send a value a node to blocks of arcs (see rounds); for more nodes than that is bounded to they keep state in
DataFrames, and write it to the shared folder each round. Closeness works in such rounds, betweenness sends a compressed
adjacency to the executors, behind a check of its size, and divides the sources among tasks."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.portable import bucket, count_if
from tessera.operators import rounds
from tessera.operators.components import min_labels
from tessera.operators.joins import ADJ, adjacency, arcs, teams
from tessera.operators.neighbourhoods import Lists, listed, per_start, walk
from tessera.operators.rounds import Arcs, arcs_of, arcs_of_teams
from tessera.operators.teams import Block, Homes
from tessera.plans.staging import drop, stage
from tessera.plans.tables import Query, Tables
from tessera.sources import storage

col = F.col
#: 16 bytes an edge in the adjacency that is broadcast.
MAX_BROADCAST_EDGES = 20_000_000


def edges(t: Tables) -> DataFrame:
    """Undirected weighted edges u < v."""
    return arcs(teams(t)).filter("a < b").groupBy(col("a").alias("u"), col("b").alias("v")).agg(F.count("*").alias("papers"))


EDGES = f"{ADJ}, edges AS MATERIALIZED (SELECT a AS u, b AS v, sum(papers) AS papers FROM adj WHERE a < b GROUP BY 1, 2)"


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(col("v").alias("u"), col("u").alias("v")))


def degrees(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("u", "v")).alias("node"), *[c for c in e.columns if c == "papers"]).groupBy("node").agg(F.count("*").alias("degree"))


def pairs(t: Tables) -> DataFrame:
    """(u, v), u < v, a row for each paper of the two: what arcs are made of."""
    return arcs(t.once("teams", teams)).filter("a < b").select(col("a").alias("u"), col("b").alias("v"))


def arcs_once(t: Tables) -> Arcs | None:
    """The arcs of the co-author graph, made when they are first asked for."""
    return t.kept("arcs_of_teams", lambda t: arcs_of_teams(t.once("teams", teams)))


def pagerank(e: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, max_rounds: int = 200, g: Arcs | None = None) -> DataFrame:
    """(node, rank); ranks sum to one. Stops when the sum of changes is within tolerance."""
    if g := g or arcs_of(e):
        return g.rows(rank=rounds.ranks(g, damping, tolerance, max_rounds))
    arcs = stage(both_ways(e.select("u", "v").distinct()), "arcs")
    out = stage(arcs.groupBy("u").agg(F.count("*").alias("out")), "out")
    n = out.count()
    rank = stage(out.select(col("u").alias("node"), F.lit(1.0 / max(n, 1)).alias("rank")), "rank")
    for _ in range(max_rounds):
        sent = rank.join(out, rank.node == out.u).select("u", (col("rank") / col("out")).alias("x")).join(arcs, "u").groupBy(col("v").alias("node")).agg(F.sum("x").alias("x"))
        nxt = stage(sent.select("node", (F.lit((1 - damping) / max(n, 1)) + damping * col("x")).alias("rank")), "rank")
        change = nxt.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(col("rank") - col("old")))).first()[0] or 0.0
        drop(rank)
        rank = nxt
        if change <= tolerance:
            return rank
    raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")


def largest_component(e: DataFrame) -> DataFrame:
    """The edges of the component with most nodes; of several, that with the smallest node."""
    labels = stage(min_labels(e.select(col("u").alias("a"), col("v").alias("b"))), "labels")
    top = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(col("n").desc(), "label").limit(1).select("label")
    inside = labels.join(F.broadcast(top), "label").select(col("node").alias("u"))
    return e.join(inside, "u", "left_semi")


def with_all_nodes(e: DataFrame, measured: DataFrame, value: str) -> DataFrame:
    """A row for every node of e; null where a measure of the largest component says nothing."""
    return degrees(e).select("node").join(measured.select("node", value), "node", "left")


def eigenvector(e: DataFrame, tolerance: float = 1e-9, max_rounds: int = 1000, g: Arcs | None = None) -> DataFrame:
    """(node, score) by power iteration on A + I over the largest component, scaled to unit length."""
    if g := g or arcs_of(e):
        inside = rounds.largest(g)
        return g.rows(score=rounds.principal(g, inside, tolerance, max_rounds), inside=inside).filter("inside").drop("inside")
    arcs = stage(both_ways(largest_component(e.select("u", "v").distinct())), "arcs")
    x = stage(arcs.select(col("u").alias("node")).distinct().withColumn("score", F.lit(1.0)), "vector")
    if x.isEmpty():
        return x
    written, scale = x, 1.0
    for _ in range(max_rounds):
        pulled = x.join(arcs, x.node == arcs.u).groupBy(col("v").alias("node")).agg(F.sum("score").alias("s"))
        raw = stage(pulled.join(x, "node").select("node", (col("s") + col("score")).alias("score"), col("score").alias("old")), "vector")
        norm = raw.agg(F.sqrt(F.sum(col("score") ** 2))).first()[0]
        change = raw.agg(F.sum(F.abs(col("score") / norm - col("old")))).first()[0]
        drop(written)
        x, written = raw.select("node", (col("score") / norm).alias("score")), raw
        if change <= tolerance:
            return x
    raise RuntimeError(f"the vector did not settle in {max_rounds} rounds")


def kcore(e: DataFrame, max_rounds: int = 500, g: Arcs | None = None) -> DataFrame:
    """(node, core): each round sets a node's bound to the largest h such that h neighbours have bounds of h or more;
    from degrees downwards this settles at the core numbers."""
    if g := g or arcs_of(e):
        return g.rows(core=rounds.cores(g, max_rounds).astype(np.int64))
    arcs = stage(both_ways(e.select("u", "v").distinct()), "arcs")
    bound = written = stage(arcs.groupBy(col("u").alias("node")).agg(F.count("*").alias("degree")).select("node", col("degree").alias("core")), "core")
    for _ in range(max_rounds):
        seen = arcs.join(bound, arcs.v == bound.node).groupBy("u", "core").agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("u").orderBy(col("core").desc()).rangeBetween(Window.unboundedPreceding, 0))
        h = seen.withColumn("k", F.least("core", at_least)).groupBy(col("u").alias("node")).agg(F.max("k").alias("h"))
        nxt = stage(h.join(bound, "node").select("node", F.least("h", "core").alias("core"), (col("h") < col("core")).alias("moved")), "core")
        moved = not nxt.filter("moved").isEmpty()
        drop(written)
        bound, written = nxt.select("node", "core"), nxt
        if not moved:
            return bound
    raise RuntimeError(f"cores did not settle in {max_rounds} rounds")


class _Paths:
    """Breadth-first search over a compressed adjacency of one component: nodes, where the neighbours of each begin, all of them."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, to: np.ndarray):
        self.ids, self.first, self.to, self.size = ids, first, to, np.diff(first)

    def _out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many neighbours each has, and those neighbours."""
        n = self.size[nodes]
        return n, self.to[np.repeat(self.first[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def dependencies(self, source: int) -> np.ndarray:
        """Brandes' accumulation: what each node carries of the shortest paths from a source. A level is found from the side with
        fewer arcs, the last level's nodes or all that are left; arcs to other levels carry nothing, as values there count 0."""
        count = len(self.ids)
        dist, paths, delta = np.full(count, -1, np.int16), np.zeros(count), np.zeros(count)
        dist[source], paths[source] = 0, 1
        level, steps, arcs_left = np.array([source]), [], len(self.to) - self.size[source]
        left = count - 1
        while left and len(level):
            d, down = len(steps) + 1, self.size[level].sum() <= arcs_left
            nodes = level if down else np.flatnonzero(dist < 0)
            n, ends = self._out(nodes)
            if down:
                found = np.bincount(ends, np.repeat(paths[nodes], n), count)
                found[dist >= 0] = 0
                level = np.flatnonzero(found)
                paths[level] = found[level]
            else:
                found = np.add.reduceat(np.where(dist == d - 1, paths, 0)[ends], np.cumsum(n) - n)
                level = nodes[found > 0]
                paths[level] = found[found > 0]
            dist[level] = d
            steps.append((down, nodes, n, ends))
            left, arcs_left = left - len(level), arcs_left - self.size[level].sum()
        for d in range(len(steps), 0, -1):
            down, nodes, n, ends = steps[d - 1]
            carried = np.zeros(count)
            on = dist == d
            carried[on] = (1 + delta[on]) / paths[on]
            if down:
                delta[nodes] += paths[nodes] * np.add.reduceat(carried[ends], np.cumsum(n) - n)
            else:
                up = np.bincount(ends, np.repeat(carried[nodes], n), count)
                delta += np.where(dist == d - 1, paths * up, 0)
        delta[source] = 0
        return delta


def _component(e: DataFrame, g: Arcs | None) -> tuple[Arcs, np.ndarray, bool]:
    """Arcs, which of their nodes are in the largest component, and whether all nodes of e are among them."""
    if g := g or arcs_of(e):
        return g, rounds.largest(g), True
    if g := arcs_of(largest_component(e.select("u", "v").distinct())):
        return g, np.ones(g.n, bool), False
    raise ValueError(f"more than {rounds.MAX_NODES} nodes are too many to send to every executor; take a k-core first (see kcore)")


def _compressed(e: DataFrame, g: Arcs | None):
    g, inside, _ = _component(e, g)
    if (n := int(g.degree[inside].sum(dtype=np.int64)) // 2) > MAX_BROADCAST_EDGES:
        raise ValueError(f"{n} edges are too many to send to every executor; take a k-core first (see kcore)")
    first, to = g.whole(inside)
    return e.sparkSession.sparkContext.broadcast(_Paths(g.ids[inside], first, to))


def _picked(nodes: np.ndarray, most: int | None) -> np.ndarray:
    """All nodes, or so many by the order of their md5."""
    if most is None or most >= len(nodes):
        return nodes
    return np.array(heapq.nsmallest(most, nodes.tolist(), key=lambda n: hashlib.md5(str(n).encode()).digest()))


#: Tasks that add up what the tasks of sources found; only they make a row a node.
ADDERS = 12


def _summed(e: DataFrame, graph, sources: np.ndarray, of, name: str) -> DataFrame:
    """(node, name): what ``of(paths, source)`` gives each node, added over the sources, which are divided among tasks."""

    def run(batches):
        g, total, at = graph.value, None, 0
        for batch in batches:
            for s in batch["source"]:
                d, at = of(g, int(np.searchsorted(g.ids, s))), s
                total = d if total is None else total + d
        if total is not None:
            yield pd.DataFrame({"at": [at % ADDERS], "x": [total.tobytes()]})

    def add(batches):
        total = None
        for batch in batches:
            for x in batch["x"]:
                d = np.frombuffer(x)
                total = d if total is None else total + d
        if total is not None:
            yield pd.DataFrame({"node": graph.value.ids, "x": total})

    spark = e.sparkSession
    rows = spark.createDataFrame(pd.DataFrame({"source": sources}), "source long").repartition(max(1, min(256, len(sources) // 8)))
    return rows.mapInPandas(run, "at long, x binary").repartition(ADDERS, "at").mapInPandas(add, "node long, x double").groupBy("node").agg(F.sum("x").alias(name))


def betweenness(e: DataFrame, sources: int | None = 32_768, g: Arcs | None = None) -> DataFrame:
    """(node, betweenness) on the largest component, normalised; from all sources or a hash sample of so many, scaled to
    all. Nodes elsewhere get null."""
    graph = _compressed(e, g)
    n = len(graph.value.ids)
    picked = _picked(graph.value.ids, sources)
    found = _summed(e, graph, picked, lambda g, s: g.dependencies(s), "x")
    scale = n / max(len(picked), 1) / max((n - 1) * (n - 2), 1)
    x = found.select("node", (col("x") * scale).alias("betweenness"))
    return g.rows().join(x, "node", "left") if g else with_all_nodes(e, x, "betweenness")


def betweenness_in_parts(e: DataFrame, folder: str, sources: int | None = 32_768, batch: int = 1024, most: int | None = None) -> DataFrame | None:
    """betweenness by batches of sources, each written below a folder before the next. A run that broke off goes on with the
    batches that are missing; None while some are (``most`` batches a run)."""
    spark = e.sparkSession
    graph = _compressed(e, None)
    n, picked = len(graph.value.ids), _picked(graph.value.ids, sources)
    parts = [f"{folder}/part-{i:05d}" for i in range(-(-len(picked) // batch))]
    todo = [i for i, p in enumerate(parts) if not storage.status(spark, f"{p}/_SUCCESS")]
    for i in todo[:most]:
        _summed(e, graph, picked[i * batch : (i + 1) * batch], lambda g, s: g.dependencies(s), "x").write.mode("overwrite").parquet(parts[i])
    if len(todo) > (len(todo) if most is None else most):
        return None
    scale = n / max(len(picked), 1) / max((n - 1) * (n - 2), 1)
    found = spark.read.schema("node long, x double").parquet(*parts).groupBy("node").agg((F.sum("x") * scale).alias("betweenness"))
    return with_all_nodes(e, found, "betweenness")


def closeness(e: DataFrame, pivots: int | None = 1024, g: Arcs | None = None) -> DataFrame:
    """(node, closeness) on the largest component: one over the mean distance to the others, estimated from the distances to
    all nodes or to a hash sample of pivots, which are searched side by side. Nodes elsewhere get null."""
    g, inside, whole = _component(e, g)
    picked = np.searchsorted(g.ids, _picked(g.ids[inside], pivots))
    total = rounds.distances(g, picked, int(inside.sum()))
    others = np.full(g.n, float(len(picked)))
    others[picked] -= 1  # a pivot's distance to itself says nothing
    found = g.rows(closeness=pa.array(others / np.maximum(total, 1), mask=~inside | (total == 0)))
    return found if whole else with_all_nodes(e, found, "closeness")


def triangles(e: DataFrame) -> DataFrame:
    """(node, triangles): each triangle is found once, from its node of least degree, so hubs open no wedges; no row is made for
    a wedge, as blocks of nodes walk the lists of those next to them (see neighbourhoods)."""
    d = degrees(e)
    du, dv = d.select(col("node").alias("u"), col("degree").alias("du")), d.select(col("node").alias("v"), col("degree").alias("dv"))
    with_degree = e.select("u", "v").join(du, "u").join(dv, "v")
    up = (col("du") < col("dv")) | ((col("du") == col("dv")) & (col("u") < col("v")))
    out = with_degree.select(F.when(up, col("u")).otherwise(col("v")).alias("a"), F.when(up, col("v")).otherwise(col("u")).alias("b"))
    lists = listed(out.withColumn("papers", F.lit(1)).repartitionByRange("a"), "papers")

    def work(lists: Lists):
        own, other = np.zeros(len(lists.node), np.int64), np.zeros(len(lists.ids), np.int64)
        ends: list[tuple[int, int]] = []

        def each(batch: pa.RecordBatch):
            mark = np.zeros(len(lists.ids), bool)
            for a, near in per_start(batch, "b"):
                _, v, at = lists.of(near)
                at_near = lists.places(near)
                mark[at_near] = True
                to = lists.to[at]
                hit = mark[to]
                mark[at_near] = False
                if n := int(hit.sum()):
                    ends.append((a, n))
                    own[:] += np.bincount(np.repeat(v, lists.size[v])[hit], minlength=len(own))
                    other[:] += np.bincount(to[hit], minlength=len(other))
            return iter(())

        def end():
            node = np.concatenate([np.array([a for a, _ in ends], np.int64), lists.node, lists.ids])
            n = np.concatenate([np.array([n for _, n in ends], np.int64), own, other])
            yield pa.RecordBatch.from_pydict({"node": node[n > 0], "n": n[n > 0]})

        return each, end

    return walk(lists, lists, work, "node long, n long").groupBy("node").agg(F.sum("n").alias("triangles"))


def people_of_teams(t: Tables) -> Homes:
    """The teams of all years by blocks of their people, made when they are first asked for."""
    return t.kept("homes_of_all", lambda t: Homes(t.once("teams", teams).withColumn("year", F.lit(0)), 0))


def triangles_of(t: Tables) -> DataFrame:
    """The same of the co-author graph: blocks of people make the lists of those next to them from teams (see teams), so that no row
    is made for an edge either. Everyone's degree is sent to all tasks, 12 bytes a person; for too many people it works by edges."""
    home = people_of_teams(t)
    if len(home.ids) > rounds.MAX_NODES:
        return triangles(edges(t))
    sent = t.spark.sparkContext.broadcast((home.ids, home.degree))

    def work(block: Block):
        of, rank, up, mark, found = None, None, [], None, []
        total: list[tuple[np.ndarray, np.ndarray]] = []

        def add():
            """Of the lists at hand."""
            if found:
                n = np.bincount(np.concatenate(found), minlength=len(of.ids))
                some = np.flatnonzero(n)
                total.append((of.ids[some], n[some]))
                found.clear()

        held = 0
        for lists, _, own, near, _, _, _ in block.each():
            if of is not lists:
                add()
                ids, degree = sent.value
                known = degree[np.minimum(np.searchsorted(ids, lists.ids), max(len(ids) - 1, 0))]
                of, rank, mark = lists, np.empty(len(known), np.int64), np.zeros(len(known), bool)
                rank[np.lexsort((lists.ids, known))] = np.arange(len(known))
                kept = rank[lists.to] > rank[np.repeat(lists.at, lists.size)]
                up = np.split(lists.to[kept], np.cumsum(np.add.reduceat(np.append(kept, False), lists.first, dtype=np.int64))[:-1]) if len(lists.at) else []
            over = near[rank[near] > rank[own]]
            if len(over) < 2:
                continue
            ends = [up[i] for i in np.searchsorted(lists.at, over).tolist()]
            to = np.concatenate(ends)
            mark[over] = True
            hit = np.flatnonzero(mark[to])
            mark[over] = False
            if len(hit):
                via = over[np.searchsorted(np.cumsum([len(x) for x in ends]), hit, side="right")]
                found += [np.full(len(hit), own), via, to[hit]]
                held += len(hit)
            if held > 1_000_000:
                add()
                held = 0
        add()
        for node, n in total:
            yield pa.RecordBatch.from_pydict({"node": node, "n": n})

    return home.walk(work, "node long, n long", 1).groupBy("node").agg(F.sum("n").alias("triangles"))


def _ego(t: Tables, k: int = 20) -> DataFrame:
    """The k strongest neighbours of the person with most papers in common with others, and the edges among them."""
    e = stage(edges(t), "edges")
    ends = e.select("u", "v", "papers").unionByName(e.select(col("v").alias("u"), col("u").alias("v"), "papers"))
    centre = ends.groupBy("u").agg(F.sum("papers").alias("s")).orderBy(col("s").desc(), "u").limit(1).select("u")
    near = ends.join(F.broadcast(centre), "u").orderBy(col("papers").desc(), "v").limit(k).select(col("v").alias("p"))
    return e.join(F.broadcast(near.withColumnRenamed("p", "u")), "u").join(F.broadcast(near.withColumnRenamed("p", "v")), "v")


def _first_contact(t: Tables) -> DataFrame:
    """New neighbours by year, and the degree as of each year."""
    new = adjacency(t).groupBy("a", "b").agg(F.min("year").alias("year")).groupBy("a", "year").agg(F.count("*").alias("new"))
    return new.withColumn("degree", F.sum("new").over(Window.partitionBy("a").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def _components(t: Tables) -> DataFrame:
    """Sizes of the components."""
    labels = min_labels(edges(t).select(col("u").alias("a"), col("v").alias("b")))
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def _scopes(t: Tables) -> DataFrame:
    of = {"all": "true", "journal": "kind = 'journal'", "no preprints": "kind <> 'preprint'", "open": "has_oa"}
    s = t.slots.filter("NOT on_bin").join(t.pubs.select("pid", "kind", "has_oa"), "pid")
    one = lambda n, c: s.filter(c).agg(F.lit(n).alias("scope"), F.countDistinct("pid").alias("papers"), F.countDistinct("person").alias("people"))
    out = [one(n, c) for n, c in of.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# The iterative measures in SQL, a table a round; the rounds are many more than the tables need to settle.
LABEL_ROUNDS, RANK_ROUNDS, POWER_ROUNDS, CORE_ROUNDS = 12, 40, 60, 60
ARCS = "arcs AS MATERIALIZED (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges), outs AS MATERIALIZED (SELECT u AS node, count(*) AS n FROM arcs GROUP BY 1)"


def _unrolled(first: str, step: str, rounds: int) -> str:
    """CTEs of which each but the first is made from the one before."""
    return ", ".join([ARCS, first.format(i=0), *[step.format(i=i, j=i - 1) for i in range(1, rounds + 1)]])


def _unrolled_labels(rounds: int) -> str:
    return _unrolled("l{i} AS MATERIALIZED (SELECT node, node AS label FROM outs)", "l{i} AS MATERIALIZED (SELECT node, least(any_value(l.label), min(o.label)) AS label FROM l{j} l JOIN arcs ON arcs.u = l.node JOIN (SELECT node AS other, label FROM l{j}) o ON o.other = arcs.v GROUP BY 1)", rounds)


def _unrolled_ranks(rounds: int) -> str:
    return _unrolled("r{i} AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM outs) AS rank FROM outs)", "r{i} AS MATERIALIZED (SELECT arcs.v AS node, 0.15::DOUBLE / (SELECT count(*) FROM outs) + 0.85::DOUBLE * sum(rank / n) AS rank FROM r{j} r JOIN outs USING (node) JOIN arcs ON arcs.u = r.node GROUP BY 1)", rounds)


def _unrolled_power(rounds: int) -> str:
    step = "y{i} AS MATERIALIZED (SELECT x.node, any_value(x.score) + sum(o.score) AS score FROM x{j} x JOIN arcs ON arcs.u = x.node JOIN x{j} o ON o.node = arcs.v GROUP BY 1), x{i} AS MATERIALIZED (SELECT node, score / (SELECT sqrt(sum(score * score)) FROM y{i}) AS score FROM y{i})"
    largest = f"{_unrolled_labels(LABEL_ROUNDS)}, "
    first = "x{i} AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS score FROM l" + str(LABEL_ROUNDS) + " WHERE label = (SELECT label FROM l" + str(LABEL_ROUNDS) + " GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1))"
    return largest + ", ".join([first.format(i=0), *[step.format(i=i, j=i - 1) for i in range(1, rounds + 1)]])


def _unrolled_cores(rounds: int) -> str:
    """A node's next bound is the largest h such that h neighbours have bounds of h or more."""
    step = "k{i} AS MATERIALIZED (SELECT node, max(least(core, r)) AS core FROM (SELECT arcs.u AS node, k.core, row_number() OVER (PARTITION BY arcs.u ORDER BY k.core DESC) AS r FROM arcs JOIN k{j} k ON k.node = arcs.v) GROUP BY 1)"
    return _unrolled("k{i} AS MATERIALIZED (SELECT node, n AS core FROM outs)", step, rounds)


LEVELS = 8


def _unrolled_distances(levels: int, pivots: int = 1024) -> str:
    """(p, node, d) in table dist: breadth-first levels from the pivots of the largest component; the levels are more than the
    tables need."""
    label = f"l{LABEL_ROUNDS}"
    out = [_unrolled_labels(LABEL_ROUNDS), f"lc AS MATERIALIZED (SELECT node FROM {label} WHERE label = (SELECT label FROM {label} GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1))"]
    out += [f"pv AS MATERIALIZED (SELECT node AS p FROM lc ORDER BY md5(node::VARCHAR) LIMIT {pivots})", "b0 AS MATERIALIZED (SELECT p, p AS node FROM pv)"]
    for i in range(1, levels + 1):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM b{j} WHERE b{j}.p = x.p AND b{j}.node = x.node)" for j in range(max(0, i - 2), i))
        out.append(f"b{i} AS MATERIALIZED (SELECT p, node FROM (SELECT DISTINCT b.p, arcs.v AS node FROM b{i - 1} b JOIN arcs ON arcs.u = b.node) x WHERE {seen})")
    return ", ".join([*out, "dist AS (" + " UNION ALL ".join(f"SELECT p, node, {i} AS d FROM b{i}" for i in range(1, levels + 1)) + ")"])


QUERIES = {
    "coauthor_edges": Query("u:l v:l papers:l", edges, "SELECT * FROM edges", EDGES),
    "degree": Query("node:l degree:l", lambda t: degrees(edges(t)), "SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1", EDGES),
    "first_contact_degree": Query("a:l year:l new:l degree:l", _first_contact, "SELECT a, year, new, sum(new) OVER (PARTITION BY a ORDER BY year) AS degree FROM (SELECT a, year, count(*) AS new FROM (SELECT a, b, min(year) AS year FROM adj GROUP BY 1, 2) GROUP BY 1, 2)", ADJ),
    "ego_edges": Query("u:l v:l papers:l", _ego, "SELECT u, v, papers FROM ends JOIN near a ON a.p = u JOIN near b ON b.p = v WHERE u < v", EDGES + ", ends AS MATERIALIZED (SELECT u, v, papers FROM edges UNION ALL SELECT v, u, papers FROM edges), near AS MATERIALIZED (SELECT v AS p FROM ends WHERE u = (SELECT u FROM ends GROUP BY u ORDER BY sum(papers) DESC, u LIMIT 1) ORDER BY papers DESC, v LIMIT 20)"),
    "communities": Query("venue:s year:l members:l first:l", lambda t: t.authored.groupBy("venue", "year").agg(F.countDistinct("person").alias("members"), F.min("person").alias("first")).filter("members >= 3"), "SELECT venue, year, count(DISTINCT person) AS members, min(person) AS first FROM authored GROUP BY 1, 2 HAVING count(DISTINCT person) >= 3"),
    "scope_probe": Query("scope:s papers:l people:l", _scopes, " UNION ALL ".join(f"SELECT '{n}' AS scope, count(DISTINCT pid) AS papers, count(DISTINCT person) AS people FROM slots JOIN pubs USING (pid) WHERE NOT on_bin AND {c}" for n, c in (("all", "true"), ("journal", "kind = 'journal'"), ("no preprints", "kind <> 'preprint'"), ("open", "has_oa")))),
    "triangles": Query("node:l triangles:l", triangles_of, "SELECT node, count(*) AS triangles FROM (SELECT unnest([x.u, x.v, y.v]) AS node FROM e2 x JOIN e2 y ON y.u = x.v JOIN e2 z ON z.u = x.u AND z.v = y.v) GROUP BY 1", EDGES + ", e2 AS MATERIALIZED (SELECT u, v FROM edges)"),
    "components": Query("label:l size:l", _components, f"SELECT label, count(*) AS size FROM l{LABEL_ROUNDS} GROUP BY 1", f"{EDGES}, {_unrolled_labels(LABEL_ROUNDS)}"),
    "pagerank": Query("node:l rank:d", lambda t: pagerank(pairs(t)), f"SELECT node, rank FROM r{RANK_ROUNDS}", f"{EDGES}, {_unrolled_ranks(RANK_ROUNDS)}"),
    "eigenvector": Query("node:l score:d", lambda t: eigenvector(pairs(t)), f"SELECT node, score FROM x{POWER_ROUNDS}", f"{EDGES}, {_unrolled_power(POWER_ROUNDS)}"),
    "kcore": Query("node:l core:l", lambda t: kcore(pairs(t)), f"SELECT node, core FROM k{CORE_ROUNDS}", f"{EDGES}, {_unrolled_cores(CORE_ROUNDS)}"),
    "betweenness_sampled": Query("node:l betweenness:d", lambda t: betweenness(pairs(t), g=arcs_once(t))),
    "closeness_sampled": Query(
        "node:l closeness:d", lambda t: closeness(pairs(t)),
        "SELECT outs.node, c.closeness FROM outs LEFT JOIN (SELECT node, ((SELECT count(*) FROM pv) - (node IN (SELECT p FROM pv))::INT)::DOUBLE / sum(d) AS closeness FROM dist GROUP BY 1) c USING (node)", f"{EDGES}, {_unrolled_distances(LEVELS)}",
    ),
}
