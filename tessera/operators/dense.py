"""Dense similarity: a hashed encoder, and exact nearest neighbours by blocked matrix products.

The queries are a stated set. They go to the executors in blocks of at most ``BLOCK`` vectors; a task multiplies a block
with its vectors, some at a time, and keeps the best of each query, so that it gives away k rows a query whatever it
reads. There is no join of queries with vectors."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

col = F.col
DIM = 64
#: Query vectors sent at a time: 2 MB at 64 dimensions of 8 bytes.
BLOCK = 4096
#: Vectors multiplied at a time with a block.
ROWS = 256


@functools.lru_cache(1 << 18)
def _place(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def _encoded(lists: pa.Array, dim: int = DIM) -> pa.Array:
    codes = lists.flatten().dictionary_encode()
    place = np.array([_place(w, dim) for w in codes.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out = np.bincount(row * dim + place[codes.indices.to_numpy(zero_copy_only=False)] if len(row) else row, minlength=len(lists) * dim).reshape(-1, dim).astype(float)
    out /= np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-300)
    offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _encode(lists: pa.Array) -> pa.Array:
    return _encoded(lists)


def encode(words: Column) -> Column:
    """The unit vector of a list of distinct words, each counted in a dimension that its md5 gives; zero without words."""
    return _encode(F.coalesce(words, F.array().cast("array<string>")))


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(Ids, unit vectors) of so many queries at a time; the driver holds one block."""
    ids, vectors = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == block:
            yield np.array(ids), _unit(np.array(vectors, float))
            ids, vectors = [], []
    if ids:
        yield np.array(ids), _unit(np.array(vectors, float))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-300)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(Ids, unit vectors) of ROWS rows at a time."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        if len(ids):
            vectors = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
            for i in range(0, len(ids), ROWS):
                yield ids[i : i + ROWS], _unit(vectors[i : i + ROWS])


def _best(shared, k: int, others_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, q = shared.value
        best, who = np.full((len(items), k), -np.inf), np.full((len(items), k), np.iinfo(np.int64).max)
        for ids, vectors in _batches(batches):
            score = np.round(q @ vectors.T, 6)
            if others_only:
                score[items[:, None] == ids[None, :]] = -np.inf
            both, names = np.hstack([best, score]), np.hstack([who, np.broadcast_to(ids, score.shape)])
            order = np.lexsort((names, -both), axis=1)[:, :k]
            best, who = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        row, rank = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(items[row]), pa.array(who[row, rank]), pa.array(best[row, rank])], names=["item_id", "id", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, others_only: bool = False, block: int = BLOCK) -> DataFrame:
    """(item_id, id, score): the k vectors (id, e) of largest cosine for each query (item_id, e); ties by id."""
    out = None
    for part in _blocks(queries.select("item_id", "e"), block):
        found = vectors.select("id", "e").mapInArrow(_best(queries.sparkSession.sparkContext.broadcast(part), k, others_only), "item_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], "item_id long, id long, score double")
    w = Window.partitionBy("item_id").orderBy(col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(col("rank") <= k).drop("rank")


def _above(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, q, least = shared.value
        n = np.zeros(len(items), np.int64)
        for _, vectors in _batches(batches):
            n += (np.round(q @ vectors.T, 6) > least[:, None]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(n)], names=["item_id", "n"])

    return run


def ranks_of(queries: DataFrame, vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item_id, rank): one more than the vectors that are nearer to a query (item_id, e, score) than a score."""
    out = None
    rows = queries.select("item_id", "e", "score")
    ids, e, least = [], [], []

    def count(part):
        return vectors.select("id", "e").mapInArrow(_above(queries.sparkSession.sparkContext.broadcast(part)), "item_id long, n long")

    parts = []
    for r in rows.toLocalIterator():
        ids.append(r[0]), e.append(r[1]), least.append(r[2])
        if len(ids) == block:
            parts.append((np.array(ids), _unit(np.array(e, float)), np.array(least)))
            ids, e, least = [], [], []
    if ids:
        parts.append((np.array(ids), _unit(np.array(e, float)), np.array(least)))
    for part in parts:
        out = count(part) if out is None else out.unionByName(count(part))
    if out is None:
        return queries.sparkSession.createDataFrame([], "item_id long, rank long")
    return out.groupBy("item_id").agg((F.sum("n") + 1).alias("rank"))
