"""The near-duplicate stage against Jaccard similarities of all pairs."""

import random
from collections import defaultdict

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tessera.llm import near_copies
from tests.llm.conftest import DOCS, hard_rows


def shingled(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(texts, threshold=0.8):
    sets = [shingled(t) for t in texts]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) / len(a | b) >= threshold):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def varied_rows():
    """Hard rows, near copies from 0.7 to 1, and texts that share half of their words and no more."""
    rng = random.Random(8)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    rows = hard_rows()
    for g in range(60):
        base = text(rng.choice([30, 60, 200, 1000]))
        for k in range(3):
            w = list(base)
            for i in rng.sample(range(len(w)), int(k * len(w) * rng.choice([0.008, 0.016, 0.025]))):
                w[i] = f"x{rng.randrange(9999)}"
            rows.append((1000 + 10 * g + k, " ".join(w), "en", "web", 0))
    common = text(60)
    rows += [(3000 + i, " ".join(common + text(40)), "en", "web", 0) for i in range(60)]
    return rows


def test_stage_against_all_pairs(spark, tmp_path):
    rows = varied_rows()
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/d")
    root = groups([r[1] for r in rows])
    ids = defaultdict(list)
    for r, g in zip(rows, root, strict=True):
        ids[g].append(r[0])
    got = [r["doc_id"] for r in dict(cp.STAGES)["near-duplicates"](spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()]
    least = [min((i for i in x if i is not None), default=None) for x in ids.values()]
    key = lambda i: (i is None, i or 0)
    assert sorted(got, key=key) == sorted(least, key=key)


def test_blocks(spark, tmp_path):
    rows = [(i, r[1]) for i, r in enumerate(varied_rows())]
    spark.createDataFrame(rows, "row long, text string").withColumn("doc_id", F.col("row")).write.parquet(f"{tmp_path}/d")
    for threshold in (0.8, 0.7):
        got, want = defaultdict(set), defaultdict(set)
        for r in near_copies.near_copies(spark.read.parquet(f"{tmp_path}/d"), threshold=threshold, block=7).collect():
            got[r["root"]].add(r["row"])
        for (i, _), g in zip(rows, groups([t for _, t in rows], threshold), strict=True):
            want[g].add(i)
        assert set(map(frozenset, got.values())) == set(map(frozenset, want.values()))
