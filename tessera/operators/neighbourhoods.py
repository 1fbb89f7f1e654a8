"""Two steps over a graph, block by block, without a row for each path.

Nodes are dealt into blocks by ranges of their ids. A block gets the lists of the nodes next to its own, each list once, and
walks them in numpy; what is shuffled is at most a list a block and neighbour, never a path. Where the lists of a block are more
than a task should hold they are cut into pieces by their targets: a piece sees all paths to its targets, so its counts are whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.staging import stage

col = F.col
#: Arcs that start in a block; arcs in the lists that one task holds.
ARCS, HELD = 1_000_000, 8_000_000


def listed(arcs: DataFrame, *values: str) -> DataFrame:
    """A row a node of arcs (a, b, values), which are dealt by ranges of a, with arrays of b and of each value; written."""
    near = arcs.groupBy("a").agg(F.collect_list(F.struct("b", *values)).alias("near"))
    return stage(near.select("a", *[col(f"near.{c}").alias(c) for c in ("b", *values)]), "lists")


class Lists:
    """The lists that a block walks: targets as places in ``ids``, weights of each list's node by its whole degree."""

    def __init__(self, batches: list[pa.RecordBatch]):
        joined = lambda of, kind: np.concatenate([np.zeros(0, kind), *[of(x).to_numpy(zero_copy_only=False) for x in batches]])
        node, degree = joined(lambda x: x.column("a"), np.int64), joined(lambda x: x.column("degree"), np.int32)
        size = joined(lambda x: pc.list_value_length(x.column("b")), np.int64)
        flat, self.papers = joined(lambda x: x.column("b").flatten(), np.int64), joined(lambda x: x.column("papers").flatten(), np.int32)
        order = np.argsort(node, kind="stable")
        self.node, self.degree = node[order], degree[order]
        self.adamic, self.allocation = 1.0 / np.log(np.maximum(self.degree, 2)), 1.0 / np.maximum(self.degree, 1)
        ends = np.cumsum(size)
        self.first, self.size = (ends - size)[order], size[order]
        self.ids, to = np.unique(flat, return_inverse=True)
        self.to = to.astype(np.int32)

    def of(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the nodes next to one: where their lists are (those that have one here), and the places of all they lead to."""
        at = np.searchsorted(self.node, near)
        have = np.flatnonzero(at < len(self.node))
        have = have[self.node[at[have]] == near[have]]
        v = at[have]
        n = self.size[v]
        return have, v, np.repeat(self.first[v] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Of those ids that are targets here."""
        at = np.searchsorted(self.ids, ids)
        ok = at < len(self.ids)
        at, ids = at[ok], ids[ok]
        return at[self.ids[at] == ids]


def _spread(df: DataFrame, k: int) -> np.ndarray:
    """k numbers that a hash exchange deals to k different partitions (all but a few, when some of them get none)."""
    ids = df.sparkSession.range(40 * k)
    own = [r[0] for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(k))).agg(F.min("id")).collect()]
    return np.array([*own, *range(40 * k, 41 * k)][:k])


def walk(lists: DataFrame, starts: DataFrame, work: Callable[[Lists], tuple[Callable, Callable]], schema: str, arcs: int = ARCS, held: int = HELD) -> DataFrame:
    """What ``work`` makes of each block: it gets the lists and gives a function from a batch of starts to record batches, and one
    that is called at the block's end. lists and starts are written tables: a, b (array), papers (array), starts also others."""
    n = starts.agg(F.sum(F.size("b"))).first()[0] or 0
    k = max(1, -(-n // arcs))
    bounds = np.array(starts.approxQuantile("a", [i / k for i in range(1, k)], 0.001) if k > 1 else [])
    labels = _spread(starts, k)
    number = F.pandas_udf(lambda a: pd.Series(labels[np.searchsorted(bounds, a.to_numpy(), side="right")], dtype="int64"), T.LongType())
    of = starts.withColumn("block", number("a"))
    need = stage(of.select("block", F.explode("b").alias("a")).distinct(), "need")
    load = need.join(lists.select("a", F.size("b").alias("n")), "a").groupBy("block").agg(F.sum("n").alias("n")).collect()
    pieces = {r["block"]: -(-r["n"] // held) for r in load if r["n"] > held}
    cut = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in pieces.items() for x in p]), col("block")), F.lit(1)) if pieces else F.lit(1)
    dealt = lambda df: df.withColumn("pieces", cut.cast("long")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), col("pieces") - 1)))
    others = [c for c in starts.columns if c not in ("a", "b", "papers")]
    given = dealt(need.join(lists.select("a", "b", "papers"), "a")).withColumn("degree", F.size("b"))
    if pieces:
        near = F.filter(F.arrays_zip("b", "papers"), lambda x: F.pmod(x["b"], col("pieces")) == col("piece"))
        given = given.withColumn("near", near).withColumns({"b": col("near.b"), "papers": col("near.papers")})
    given = given.select("block", "piece", F.lit(0).alias("kind"), "a", "degree", "b", "papers", *[F.lit(None).cast(starts.schema[c].dataType).alias(c) for c in others])
    asked = dealt(of).select("block", "piece", F.lit(1).alias("kind"), "a", F.size("b").alias("degree"), "b", "papers", *others)
    parts = k + sum(v - 1 for v in pieces.values())
    rows = given.unionByName(asked).repartition(parts, *["block", "piece"][: 1 + bool(pieces)]).sortWithinPartitions("block", "piece", "kind", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, each, end = None, [], None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("block", "piece", "kind")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                at, kind, part = tuple(key[:2, lo]), key[2, lo], batch.slice(lo, hi - lo)
                if at != now:
                    if end:
                        yield from end()
                    now, have, each, end = at, [], None, None
                if kind == 0:
                    have.append(part)
                else:
                    if each is None:
                        each, end = work(Lists(have))
                        have = []
                    yield from each(part)
        if end:
            yield from end()

    return rows.mapInArrow(run, schema)


def per_start(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """(a, the arrays of the names) of each row."""
    a, out = batch.column("a").to_numpy(), []
    for c in names:
        x = batch.column(c)
        out.append((x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(x).to_numpy(zero_copy_only=False)).astype(np.int64))])))
    for i in range(len(a)):
        yield a[i], *[v[o[i] : o[i + 1]] for v, o in out]
