"""Two steps over a graph by blocks, against all paths."""

from collections import Counter

import pytest

from tessera.operators import graph, joins, neighbourhoods
from tessera.plans.tables import Tables


@pytest.mark.parametrize("arcs, held", [(10**6, 10**6), (60, 10**6), (60, 400)])
def test_candidates_by_blocks(spark, sf, monkeypatch, arcs, held):
    monkeypatch.setattr(neighbourhoods.walk, "__defaults__", (arcs, held))
    t = Tables(spark, sf)
    near: dict = {}
    for r in joins.neighbours(t)[0].collect():
        near.setdefault(r["a"], {})[r["b"]] = r["papers"]
    want: Counter = Counter()
    strength: Counter = Counter()
    for (a,) in joins.anchors(t).collect():
        for via, p in near.get(a, {}).items():
            for b, q in near[via].items():
                if b != a and b not in near[a]:
                    want[a, b] += 1
                    strength[a, b] = max(strength[a, b], min(p, q))
    got = joins.candidates(t).select("a", "b", "common", "strength").collect()
    assert len(got) == len(want)
    assert {(r["a"], r["b"]): (r["common"], r["strength"]) for r in got} == {k: (n, strength[k]) for k, n in want.items()}


def test_no_row_for_a_path(spark, sf):
    """What is dealt to tasks is lists, and none of the joins meets on the person between."""
    plan = joins.candidates(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "via" not in plan and "MapInArrow" in plan


def test_triangles_by_blocks(spark, monkeypatch):
    """Two cliques with a node in common, in one block and in many pieces; no task is dealt a wedge."""
    monkeypatch.setattr(neighbourhoods.walk, "__defaults__", (4, 6))
    clique = lambda xs: [(a, b) for a in xs for b in xs if a < b]
    e = spark.createDataFrame(clique(range(5)) + clique([0, 5, 6, 7]) + [(7, 8)], "u long, v long")
    found = graph.triangles(e)
    assert {r["node"]: r["triangles"] for r in found.collect()} == {0: 9, **dict.fromkeys(range(1, 5), 6), **dict.fromkeys(range(5, 8), 3)}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
