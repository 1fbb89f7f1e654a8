"""Link candidates of all people, against slow versions."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from tessera.operators import learning
from tessera.operators.joins import AS_OF
from tessera.plans.registry import all_queries
from tessera.plans.tables import Tables


@pytest.fixture(scope="module")
def slow(spark, sf):
    of, papers = defaultdict(list), Counter()
    for r in Tables(spark, sf).authored.select("pid", "person", "year").collect():
        of[r["pid"], r["year"]].append(r["person"])
        papers[r["person"]] += r["year"] <= AS_OF
    near, later = defaultdict(Counter), set()
    for (_, year), people in of.items():
        for a in people:
            for b in people:
                if a != b and year <= AS_OF:
                    near[a][b] += 1
                elif a != b and year <= AS_OF + 2:
                    later.add((a, b))
    anchors = {p for p, n in papers.items() if n >= 3}
    found = {}
    for a in anchors:
        for via in near[a]:
            for b in near[via]:
                if b != a and b not in near[a]:
                    found.setdefault((a, b), []).append(via)
    return near, later, anchors, found


def rows(spark, sf, name):
    return all_queries()[name](spark, sf).collect()


def test_candidates(spark, sf, slow):
    near, later, anchors, found = slow
    got = {(r["a"], r["b"]): r for r in rows(spark, sf, "two_hop_candidates")}
    assert set(got) == set(found) and len({a for a, _ in found}) > len(anchors) / 40
    for (a, b), via in found.items():
        r = got[a, b]
        assert r["common"] == len(via) and r["strength"] == max(min(near[a][v], near[v][b]) for v in via)
        assert math.isclose(r["adamic"], sum(1 / math.log(max(len(near[v]), 2)) for v in via), abs_tol=1e-5)
        assert math.isclose(r["allocation"], sum(1 / len(near[v]) for v in via), abs_tol=1e-5)
    for r in rows(spark, sf, "link_features"):
        a, b = r["a"], r["b"]
        both = len(near[a]) * len(near[b])
        assert (r["attachment"], r["y"]) == (both, int((a, b) in later))
        assert math.isclose(r["jaccard"], len(found[a, b]) / (len(near[a]) + len(near[b]) - len(found[a, b])), abs_tol=1e-5)


def test_measures(spark, sf, slow):
    near, later, anchors, found = slow
    new = {(a, b) for a, b in later if a in anchors and b not in near[a]}
    want = Counter("distance 2" if p in found else "farther" if near[p[1]] else "newcomer" for p in new)
    assert {r["origin"]: r["links"] for r in rows(spark, sf, "new_link_origin")} == dict(want)
    bins = defaultdict(list)
    for (a, b), via in found.items():
        n = len(via)
        bins[min(9, math.floor(n / (len(near[a]) + len(near[b]) - n) * 50 + 1e-9))].append(int((a, b) in later))
    got = {r["bin"]: (r["pairs"], round(r["came"], 5)) for r in rows(spark, sf, "calibration")}
    assert got == {k: (len(v), round(sum(v) / len(v), 5)) for k, v in bins.items()}
    ranked = defaultdict(list)
    for r in rows(spark, sf, "two_hop_candidates"):
        ranked[r["a"]].append((-r["adamic"], hashlib.md5(f"{r['a']}-{r['b']}".encode()).hexdigest(), (r["a"], r["b"]) in later))
    hit = [[y for *_, y in sorted(x)] for x in ranked.values()]
    hit = [x for x in hit if any(x)]
    (m,) = rows(spark, sf, "rank_metrics")
    assert m["queries"] == len(hit) and math.isclose(m["mrr"], sum(1 / (x.index(True) + 1) for x in hit) / len(hit), abs_tol=1e-5)
    assert math.isclose(m["p5"], sum(sum(x[:5]) for x in hit) / 5 / len(hit), abs_tol=1e-5)


def test_trees_score_all_test_anchors(spark, sf, slow):
    test = lambda a: int(hashlib.md5(str(a + 1).encode()).hexdigest()[:8], 16) % 10 < 3
    got = {(r["a"], r["b"]) for r in learning.link_model(Tables(spark, sf), rounds=1).select("a", "b").collect()}
    assert got == {p for p in slow[3] if test(p[0])}
