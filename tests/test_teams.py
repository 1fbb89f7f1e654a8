"""Two steps from teams: small blocks and groups of anchors give the rows of the SQL, and no candidate is dealt to another task."""

import gc
import hashlib
import time

import duckdb
import numpy as np
import pytest

from tessera.functions.hashing import md5_of_pairs
from tessera.operators import links, teams
from tessera.plans import staging
from tessera.plans.registry import all_queries
from tessera.plans.tables import Tables

NAMES = ["capped_candidates", "new_link_origin", "kept_after_cap", "calibration", "rank_metrics", "pair_details", "link_suggestions", "negative_sample"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in ("region", "nation", "customer", "part", "orders", "lineitem", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def same(got, want):
    key = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("sizes", [(500_000, 8_000_000, 500_000), (300, 1_000, 50)])
def test_small_blocks(spark, sf, con, monkeypatch, sizes):
    for name, x in zip(("ARCS", "HELD", "PACKED"), sizes, strict=True):
        monkeypatch.setattr(teams, name, x)
    t = Tables(spark, sf)
    for name in NAMES:
        q = all_queries()[name]
        same([tuple(r) for r in q.on(t).collect()], con.sql(q.sql).fetchall())


@pytest.mark.parametrize("name", ["capped_candidates", "new_link_origin", "kept_after_cap", "calibration", "negative_sample"])
def test_no_candidate_is_dealt(spark, sf, name):
    plan = all_queries()[name].on(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Join" not in plan


def test_blocks():
    """A team is sent to fewer blocks, where there are more than enough."""
    assert [teams.blocks(n) for n in (0, 1, 3 * teams.ARCS)] == [1, 1, 3]
    assert teams.blocks(20 * teams.ARCS) == 20 and teams.blocks(200 * teams.ARCS) == 100


def test_staged_leaves_no_shuffle(spark):
    """What a table was made by goes with the writing of it."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString().count("shuffle_")
    setting = spark.conf.get(staging.CLEANUP)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    before = files()
    made = staging.stage(spark.range(1000).repartition(7, "id"), "few")
    for _ in range(50):
        if (left := files()) <= before:
            break
        time.sleep(0.1)
    assert left <= before and made.count() == 1000 and spark.conf.get(staging.CLEANUP) == setting


@pytest.mark.parametrize("sizes", [(500_000, 8_000_000, 500_000), (300, 1_000, 50)])
def test_triangles(spark, sf, con, monkeypatch, sizes):
    """From teams, with no row for an edge."""
    for name, x in zip(("ARCS", "HELD", "PACKED"), sizes, strict=True):
        monkeypatch.setattr(teams, name, x)
    written, kept, t = [], staging.new_path, Tables(spark, sf)
    monkeypatch.setattr(staging, "new_path", lambda spark, name: written.append(name) or kept(spark, name))
    for name in ("triangles", "local_clustering"):
        q = all_queries()[name]
        same([tuple(r) for r in q.on(t).collect()], con.sql(q.sql).fetchall())
    assert sorted(written) == ["homes", "teams"]


def test_md5_of_pairs():
    x = np.random.default_rng(0)
    a = np.concatenate([x.integers(0, 10 ** x.integers(1, 19, 300)), [0, 9, 10, 99, 10**18, 2**62, -7]]).astype(np.int64)
    b = x.permutation(a)
    high, low = md5_of_pairs(a, b)
    assert [f"{p:016x}{q:016x}" for p, q in zip(high.tolist(), low.tolist(), strict=True)] == [hashlib.md5(f"{p}-{q}".encode()).hexdigest() for p, q in zip(a, b, strict=True)]


@pytest.mark.parametrize("name", ["pair_details", "link_suggestions"])
def test_said_where_found(spark, sf, con, monkeypatch, name):
    """No join of pairs; by joins, where people are too many to be sent, the same."""
    q = all_queries()[name]
    assert "Join" not in q.on(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(links, "MAX_SENT", 0)
    same([tuple(r) for r in q.on(Tables(spark, sf)).collect()], con.sql(q.sql).fetchall())
