"""What is being served: the state of a root, whether its tables answer, and the queries that are asked first."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from tessera.plans import serving
from tessera.sources import storage

#: Asked on every opening, so that files are listed and plans made before the first question.
WARM = ("overview", "growth_by_kind", "team_stats", "metadata_shares", "homonyms", "affiliation", "newcomers", "cohort_survival", "position_bands", "concentration", "publisher_share", "venue_profiles", "treemap_topk", "team_quantiles", "survival", "dataset_facts", "leaderboards")


def status(spark: SparkSession, root: str) -> dict:
    """The state of a serving root: its version and generation, what the build says of it, and what is being built."""
    building = [e.name.removesuffix(".building") for e in storage.listed(spark, root) if e.name.endswith(".building")]
    found = storage.current(spark, root)
    if not found:
        return {"state": "building" if building else "empty", "building": building}
    folder, generation = found
    return {"state": "ready", "version": folder.rsplit("/", 1)[-1], "generation": generation, "building": building, "meta": storage.read_json(spark, f"{folder}/_meta.json") or {}}


def health(spark: SparkSession, root: str) -> dict[str, bool]:
    """Whether each required table of the current version is there and can be read."""
    found = storage.current(spark, root)
    tables = serving.tables(spark, found[0]) if found else {}
    needed = [n for n, (_, _, required, _) in serving.STEPS.items() if required and n != "pubs_base"]
    return {n: n in tables and len(tables[n].take(1)) == 1 for n in needed}


def warm(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = WARM) -> dict[str, float]:
    """Runs the first queries and returns their seconds; one that fails has -1 and does not stop the others."""
    from tessera.plans.registry import all_queries

    known, out = all_queries(), {}
    for name in names:
        began = time.time()
        try:
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            out[name] = round(time.time() - began, 3)
        except Exception:
            out[name] = -1.0
    return out
