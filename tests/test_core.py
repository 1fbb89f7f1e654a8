"""Known answers, and every query against its SQL."""

import math

import duckdb
import numpy as np
import pytest

from tessera.functions.portable import jaro_winkler_of
from tessera.operators import graph, learning, tools
from tessera.plans.registry import all_queries
from tessera.plans.tables import Tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.fixture(scope="module")
def tables(spark, sf):
    return Tables(spark, sf)


@pytest.mark.parametrize("name", [n for n, q in all_queries().items() if q.sql])
def test_against_sql(tables, duck, name):
    q = all_queries()[name]
    assert plain(map(tuple, q.on(tables).collect())) == plain(duck.sql(q.sql).fetchall())


def edge_table(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "u long, v long")


def barbell():
    clique = lambda xs: [(a, b) for a in xs for b in xs if a < b]
    return clique(range(5)) + clique(range(5, 10)) + [(0, 10), (10, 5)]


def test_barbell(spark):
    e = edge_table(spark, [*barbell(), (11, 12)])
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    inside = lambda values: {n: v for n, v in values.items() if n not in (11, 12)}
    assert max(inside(between), key=between.get) == 10 and between[11] is None and between[12] is None
    near = {r["node"]: r["closeness"] for r in graph.closeness(e).collect()}
    assert max(inside(near), key=near.get) == 10 and near[11] is None
    power = {r["node"]: r["score"] for r in graph.with_all_nodes(e, graph.eigenvector(e), "score").collect()}
    assert power[11] is None and math.isclose(sum(v * v for v in inside(power).values()), 1, abs_tol=1e-6) and power[0] > power[1] > power[10]
    core = {r["node"]: r["core"] for r in graph.kcore(e).collect()}
    assert core == {**dict.fromkeys(range(10), 4), 10: 2, 11: 1, 12: 1}
    rank = {r["node"]: r["rank"] for r in graph.pagerank(e).collect()}
    assert math.isclose(sum(rank.values()), 1, abs_tol=1e-6) and math.isclose(rank[11], 1 / 13, abs_tol=1e-6)
    assert {r["node"]: r["triangles"] for r in graph.triangles(e).collect()} == dict.fromkeys(range(10), 6)
    from tessera.operators.components import min_labels

    labels = {r["node"]: r["label"] for r in min_labels(e.selectExpr("u AS a", "v AS b")).collect()}
    assert labels == {**dict.fromkeys(range(11), 0), 11: 11, 12: 11}


def test_betweenness_in_parts(spark, tmp_path):
    """A run that is broken off and taken up again gives what one run gives."""
    e = edge_table(spark, [*barbell(), (11, 12)])
    folder = str(tmp_path / "parts")
    assert graph.betweenness_in_parts(e, folder, None, 4, most=1) is None
    whole = {r["node"]: r["betweenness"] for r in graph.betweenness(e, None).collect()}
    got = {r["node"]: r["betweenness"] for r in graph.betweenness_in_parts(e, folder, None, 4).collect()}
    assert got.keys() == whole.keys() and all(got[k] == whole[k] or math.isclose(got[k], whole[k]) for k in whole)


def test_lollipop(spark):
    e = edge_table(spark, [(10, 20), (10, 30), (20, 30), (30, 40), (40, 50), (50, 60), (60, 70)])
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert max(between, key=between.get) == 40 and math.isclose(between[40], 2 * 9 / 30)


def test_statistics():
    assert math.isclose(learning.t_quantile(0.975, 10), 2.228139, abs_tol=1e-5)
    slope, low, high = learning.growth_interval([(2000 + i, 100 * 1.1**i) for i in range(8)])
    assert math.isclose(slope, math.log(1.1), abs_tol=1e-9) and low <= slope <= high
    assert math.isclose(jaro_winkler_of("MARTHA", "MARHTA"), 0.961111, abs_tol=1e-5)
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert learning.agglomerate(d, 0.5).tolist() == [0, 0, 2] and len(set(learning.agglomerate(d, 0.86))) == 1


def test_bcubed(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 0)], "t int, c int")
    r = learning.bcubed(df, "t", "c").first()
    assert (r["precision"], r["recall"]) == (0.5, 1.0)


@pytest.mark.parametrize("sql", ["DROP VIEW p", "SELECT 1; DROP VIEW p", "CREATE TABLE x AS SELECT 1", "INSERT INTO p SELECT 1", "SELECT * FROM parquet.`/tmp/x`", "SET a=b", "SELECT java_method('a','b')", "WITH a AS (SELECT 1) INSERT INTO p SELECT * FROM a", "/* SELECT */ DROP VIEW p"])
def test_guard_refuses(spark, sql):
    spark.range(3).createOrReplaceTempView("p")
    with pytest.raises(Exception) as e:
        tools.guarded_sql(spark, sql, seconds=60)
    assert isinstance(e.value, tools.Refused) or "PARSE" in str(e.value)
    assert spark.table("p").count() == 3


def test_guard_views(spark):
    spark.range(3).createOrReplaceTempView("p")
    assert tools.guarded_sql(spark, "WITH a AS (SELECT id FROM p) SELECT count(*) FROM a", seconds=60, views={"p"})[0][0][0] == 3
    with pytest.raises(tools.Refused):
        tools.guarded_sql(spark, "SELECT * FROM p", seconds=60, views={"q"})


def test_guard_answers(spark):
    spark.range(500).createOrReplaceTempView("p")
    rows, more = tools.guarded_sql(spark, "SELECT id, ';' AS x FROM p", cap=10, seconds=60)
    assert len(rows) == 10 and more


def test_tools_refuse(spark, sf):
    t = Tables(spark, sf)
    for call in (lambda: tools.count_papers(t, kind="x"), lambda: tools.count_papers(t, first=2000, last=1999), lambda: tools.timeseries(t, "x")):
        with pytest.raises(tools.Refused):
            call()
    assert sum(r["papers"] for r in tools.count_papers(t).collect()) == t.pubs.count()


def test_blocks_of_equal_people():
    """Clustering each set of venues once, with the number of people that have it, is clustering all people."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        kinds, n = rng.integers(2, 8), rng.integers(1, 5, 8)
        points = rng.random((kinds, 3))
        distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        of = np.repeat(np.arange(kinds), n[:kinds])
        cut = float(rng.uniform(0.1, 1.2))
        whole = learning.agglomerate(distance[np.ix_(of, of)], cut)
        once = learning.agglomerate(distance, cut, n[:kinds])[of]
        pairs = lambda x: x[:, None] == x[None]
        assert (pairs(whole) == pairs(once)).all()


def test_cluster_blocks(spark, sf, tables):
    """Every person of a shared name is in one cluster, named by its smallest member; equal venues are together."""
    got = {r["person"]: r["cluster"] for r in all_queries()["cluster_blocks"].on(tables).collect()}
    people = {r["person"]: r for r in tables.persons.filter("page_kind = 'numbered'").collect()}
    assert set(got) == {r["person"] for r in tables.authored.select("person").distinct().collect()} & set(people)
    venues = {}
    for r in tables.authored.select("person", "venue").distinct().collect():
        venues.setdefault(r["person"], set()).add(r["venue"])
    for p, c in got.items():
        assert got[c] == c <= p and people[c]["name"] == people[p]["name"]
        for q in got:
            assert people[q]["name"] != people[p]["name"] or venues[p] != venues[q] or got[q] == c


def test_models(tables):
    """Boosted trees score every pair that is held out, between 0 and 1, and better than chance on the venues."""
    rows = all_queries()["venue_model"].on(tables).collect()
    ones, zeros = [r["p"] for r in rows if r["y"]], [r["p"] for r in rows if not r["y"]]
    assert ones and zeros and all(0 <= r["p"] <= 1 for r in rows)
    assert sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros)) > 0.5


def test_split_bins(tables):
    """Each paper on a bin is in one cluster; a cluster's links are all within the cut; outcomes follow the scores."""
    from tessera.operators import disambiguation

    rows = all_queries()["split_bins"].on(tables).collect()
    on = tables.slots.filter("on_bin").groupBy("person").count().collect()
    for r in on:
        assert sum(x["papers"] for x in rows if x["person"] == r["person"]) == r["count"]
    assert {r["outcome"] for r in rows} <= {"accepted", "uncertain", "new"} and all((r["score"] or 0) < disambiguation.CEILING for r in rows if r["outcome"] == "new")
    d = np.array([[0, 0.2, 0.9, 0.3], [0.2, 0, 0.3, 0.9], [0.9, 0.3, 0, 0.9], [0.3, 0.9, 0.9, 0]])
    assert disambiguation.complete(d, 0.5).tolist() == [0, 0, 2, 3] and len(set(disambiguation.complete(d, 0.95).tolist())) == 1
    merged = all_queries()["merged_bins"].on(tables).collect()
    assert sum(m["papers"] for m in merged) == sum(r["papers"] for r in rows) and len(merged) <= len(rows)


def test_circles(spark, tables):
    """Label propagation finds the two cliques of a barbell, whatever the order of its edges; every circle is around a sampled
    person."""
    from tessera.operators import centrality

    edges = barbell()
    for turn in (edges, edges[::-1]):
        u, v = (np.array(x) for x in zip(*turn, strict=True))
        label = centrality.propagate(u, v, np.ones(len(u)))
        assert len({label[i] for i in range(5)}) == 1 == len({label[i] for i in range(5, 10)}) and label[0] != label[5]
    rows = all_queries()["circles"].on(tables).collect()
    assert {r["ego"] for r in rows} <= {r["ego"] for r in centrality.egos(tables).collect()} and all(r["ego"] != r["node"] for r in rows)


def test_ranks_with_gaps(spark):
    from tessera.operators.centrality import ranked

    df = spark.createDataFrame([(0, 5.0), (1, float("nan")), (2, 7.0), (3, 1.0), (4, None)], "i int, v double")
    assert {r["i"]: r["rank"] for r in ranked(df, "v", "rank").collect()} == {0: 2, 1: 0, 2: 1, 3: 3, 4: 0}


def test_separation(spark):
    from tessera.functions import measures

    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    r = measures.separation(df, "s", "y").first()
    assert (r["pairs"], r["positives"], r["auc"]) == (4, 2, 0.875) and math.isclose(r["ap"], (1 + 2 / 3) / 2)
    c = measures.confusion(df, df.s >= 0.8, "y").first()
    assert (c["tp"], c["fp"], c["fn"], c["recall"]) == (2, 1, 0, 1.0)
    same = spark.createDataFrame([(0, 5), (0, 5), (1, 6)], "t int, c int")
    assert measures.adjusted_rand(same, "t", "c").first()["ari"] == 1.0


def test_answers(spark):
    """Scored answers, cited sources, grounded numbers, cuts at sentences, folded names, abbreviations."""
    from pyspark.sql import functions as F

    from tessera.functions import text as X

    assert X.answer_right("number", "There are 1,234 papers.", "1234") and not X.answer_right("number", "About 1,235.", "1234") and not X.answer_right("number", None, "1")
    assert X.answer_right("names", "Jos\u00e9 Garc\u00eda and Bo", "Bo;Jose Garcia") and not X.answer_right("names", "Bo", "Bo;Al")
    assert X.answer_right("venue", "In VLDB, 2020", "vldb 2020") and not X.answer_right("venue", "VLDB 12020", "vldb 2020")
    df = spark.createDataFrame([("see [1] and [3]", 3), ("see [4]", 3), ("no source", 3)], "a string, n int")
    assert [r[0] for r in df.select(X.citations_valid(F.col("a"), F.col("n"))).collect()] == [True, False, False]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.numbers(F.lit("1,200 of 3.5 million, 2k"))) == [1200.0, 3.5e6, 2000.0]
    assert one(X.grounded(F.lit(12.3), F.array(F.lit(0.123)))) and not one(X.grounded(F.lit(13.0), F.array(F.lit(0.123)))) and one(X.grounded(F.lit(123500.0), F.array(F.lit(123456.0))))
    assert one(X.cut(F.lit("One two. Three four five six."), 12)) == "One two. [...]" and one(X.cut(F.lit("a  b"), 12)) == "a b"
    assert one(X.fold(F.lit("Stra\u00dfe \u00c9t\u00e9"))) == "straeete"
    pairs = [("Proc. Int. Conf.", "Proceedings of the International Conference", True), ("Int. Proc.", "Proceedings International", False), ("J. ACM", "Journal of the ACM", True)]
    for short, full, want in pairs:
        assert one(X.abbreviates(F.lit(short), F.lit(full))) is want


def test_catalogue(spark, tables, tmp_path):
    from tessera.operators import catalog
    from tessera.sources import storage

    for name in catalog.TOOLS:
        s = catalog.schema(name)["parameters"]
        assert s["type"] == "object" and set(s["required"]) <= set(s["properties"])
    assert catalog.schema("papers_timeseries")["parameters"]["properties"]["metric"]["enum"] == list(catalog.METRICS)
    assert catalog.person(tables, "7") == 7
    for key in ("nobody at all", 10**9, "cold widget"):
        with pytest.raises(tools.Refused):
            catalog.person(tables, key)
    assert sum(r["papers"] for r in catalog.call(tables, "count_papers").collect()) == tables.pubs.count()
    storage.write_json(spark, str(tmp_path / "links" / "metrics.json"), {"auc": 0.7})
    assert [tuple(r) for r in catalog.model_cards(tables, str(tmp_path)).collect()] == [("links", "auc", "0.7")]
    assert [r["rank"] for r in catalog.search_papers(tables, "the and", 3).collect()] == [1, 2, 3]
    assert catalog.paper(tables, key=1).count() == 1


def test_nearest(spark):
    """Blocks of queries and of vectors give what one product gives."""
    from tessera.operators import dense

    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 8)).round(2)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, e array<double>").repartition(3)
    unit = v / np.sqrt((v**2).sum(axis=1, keepdims=True))
    want = {}
    for i in range(0, 700, 50):
        s = np.round(unit @ unit[i], 6)
        want[i] = sorted((-x, j) for j, x in enumerate(s) if j != i)[:5]
    for block in (4, 4096):
        got = {}
        for r in dense.nearest(frame.filter("id % 50 = 0").withColumnRenamed("id", "item_id"), frame, 5, True, block).collect():
            got.setdefault(r["item_id"], []).append((-r["score"], r["id"]))
        assert {k: sorted(x) for k, x in got.items()} == want
    assert dense.nearest(frame.limit(0).withColumnRenamed("id", "item_id"), frame, 5).count() == 0


def test_ranks(spark):
    from pyspark.sql import functions as F

    from tessera.functions import ranks

    df = spark.createDataFrame([(i % 7, i) for i in range(50)] + [(None, 99)], "v int, i int").repartition(5)
    got = ranks.before(df, [F.col("i")], {"n": F.lit(1), "s": F.col("i")}).orderBy("i").collect()
    assert [int(r["n"]) for r in got] == list(range(51)) and [int(r["s"]) for r in got[:5]] == [0, 0, 1, 3, 6]
    p = {r["i"]: r["p"] for r in ranks.percent_rank(df.filter("v IS NOT NULL"), "v", "p").collect()}
    below = sorted(i % 7 for i in range(50))
    assert all(abs(p[i] - below.index(i % 7) / 49) < 1e-9 for i in range(50))


def test_staging(spark):
    import os

    from tessera.plans import staging

    with staging.scope(spark) as keep:
        a, b = staging.stage(spark.range(3), "a"), staging.stage(spark.range(4), "b")
        keep.append(b)
    there = lambda df: os.path.exists(df._staged_at.removeprefix("file:"))
    assert not there(a) and there(b) and b.count() == 4
    staging.drop(b)
    assert not there(b)


def test_guard_query(spark, sf):
    got = {r["statement"]: r["outcome"] for r in all_queries()["sql_guard"](spark, sf).collect()}
    assert got["SELECT count(*) FROM pubs"] == "ok" and sorted(got.values()).count("refused") == 4


def test_evaluation(spark):
    from tessera.functions import evaluation

    mean, low, high = evaluation.bootstrap([0, 1] * 50, resamples=500)
    assert mean == 0.5 and 0.35 < low < 0.5 < high < 0.65
    assert evaluation.sign_test(5, 0) == 2 / 32 and evaluation.sign_test(3, 3) == 1.0 == evaluation.sign_test(0, 0)
    df = spark.createDataFrame([("the cat sat", "the cat lay"), (None, "x"), ("a b c", "c a b")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(evaluation.rouge_l("a", "b")).collect()] == [0.666667, 0.0, 0.666667]
