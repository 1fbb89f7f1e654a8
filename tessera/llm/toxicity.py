"""A factorization machine over hashed terms.

Terms are a document's distinct lower-cased words and the first 4, 5 and 6 bytes of longer words, hashed to 31 bits, so
that inflected forms share a term. The score is ``sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>)``: the pair term
learns what two terms mean together, which additive weights miss. It is evaluated in linear time as half of
``|sum v|^2 - sum |v|^2``.

Training sees at most ``SAMPLE`` labelled rows (the least hashes of doc_id) and at most ``TERMS`` terms, those found in
``MIN_DOCS`` or more of them with the strongest association; so its memory and the model that is broadcast are bounded
whatever the corpus. Scoring reads every text whole.

Nulls and edge cases: a null or empty text has no terms and scores sigmoid(w0). Labels that are null are ignored; of
repeated labels the largest counts. Without labels of both kinds every score is the share of ones (0.5 without any).
An empty table gives an empty result. Only doc_id and text are looked at; of other columns only one with the name of the
score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytescan import ALPHANUMERIC, LOWER, Texts, runs

SAMPLE = 12_000
TERMS = 1 << 15
MIN_DOCS = 4
RANK = 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3


def terms(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(Text, term) of the distinct terms of a run of texts."""
    size, text = t.end - t.start, t.text_of_word()
    who, what = [text], [t.word_hashes()]
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        who.append(text[at])
        what.append(t.prefix_hashes(n, at))
    key = np.unique((np.concatenate(who).astype(np.uint64) << np.uint64(31)) | (np.concatenate(what) >> np.uint64(33)))
    return (key >> np.uint64(31)).astype(np.int64), (key & np.uint64((1 << 31) - 1)).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _terms(texts: pa.Array) -> pa.Array:
    out = []
    for _, data, offsets in runs(texts):
        run = Texts(LOWER[data], offsets, ALPHANUMERIC)
        who, what = terms(run)
        out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(len(run) + 1)).astype(np.int32)), pa.array(what)))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


@dataclass
class Model:
    bias: float
    ids: np.ndarray  # sorted terms
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, n: int, who: np.ndarray, what: np.ndarray) -> np.ndarray:
        """For n texts with the terms what[i] in text who[i]."""
        if not len(self.ids) or not len(what):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.ids, what), len(self.ids) - 1)
        known = self.ids[at] == what
        at, who = at[known], who[known]
        out = self.bias + np.bincount(who, self.linear[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(who, v, n) ** 2 - np.bincount(who, v * v, n))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, rank: int = RANK, rounds: int = 16, batch: int = 128, rate: float = 0.25, l2: float = 2e-5, seed: int = 7) -> Model:
    """AdaGrad on the log loss, over shuffled batches; the same input gives the same model. ``flat`` holds the terms of all
    texts, one after the other."""
    n = len(y)
    share = float(y.mean()) if n else 0.5
    none = np.empty(0, np.int32)
    if share in (0.0, 1.0) or not n:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), none, np.empty(0), np.empty((0, rank)))
    ids, docs = np.unique(flat, return_counts=True)
    often = docs >= MIN_DOCS
    ids, docs = ids[often], docs[often]
    found, times = np.unique(flat[np.repeat(y > 0, lengths)], return_counts=True)
    ones = np.zeros(len(ids), np.int64)
    both = np.isin(found, ids, assume_unique=True)
    ones[np.searchsorted(ids, found[both])] = times[both]
    odds = np.log((ones + 0.5) / (docs - ones + 0.5)) - np.log(share / (1 - share))
    use = np.sort(np.argsort(-np.abs(odds) * np.sqrt(docs), kind="stable")[:TERMS])
    ids = ids[use]
    if not len(ids):
        return Model(float(np.log(share / (1 - share))), none, np.empty(0), np.empty((0, rank)))
    ends = np.cumsum(lengths)
    col_parts, who_parts = [], []
    for s in range(0, len(flat), 1 << 18):  # a part at a time, to keep the driver small
        part = flat[s : s + (1 << 18)]
        at = np.minimum(np.searchsorted(ids, part), len(ids) - 1)
        known = np.flatnonzero(ids[at] == part)
        col_parts.append(at[known].astype(np.int32))
        who_parts.append(np.searchsorted(ends, s + known, side="right").astype(np.int32))
    col, who = np.concatenate(col_parts or [none]), np.concatenate(who_parts or [none])
    first = np.searchsorted(who, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(ids)), rng.normal(0, 0.01, (len(ids), rank))
    b, gw, gv, gb = float(np.log(share / (1 - share))), np.full(len(ids), 1e-2), np.full((len(ids), rank), 1e-2), 1e-2
    for _ in range(rounds):
        order = rng.permutation(n)
        for s in range(0, n, batch):
            rows = order[s : s + batch]
            size = first[rows + 1] - first[rows]
            local = np.repeat(np.arange(len(rows)), size)
            at = col[np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            vs = np.stack([np.bincount(local, v[at, f], len(rows)) for f in range(rank)], axis=1)
            sq = np.bincount(local, (v[at] ** 2).sum(axis=1), len(rows))
            p = _sigmoid(b + np.bincount(local, w[at], len(rows)) + 0.5 * ((vs**2).sum(axis=1) - sq))
            g = p - y[rows]
            touched, slot = np.unique(at, return_inverse=True)
            dw = np.bincount(slot, g[local], len(touched)) / len(rows) + l2 * w[touched]
            dv = np.stack([np.bincount(slot, g[local] * (vs[local, f] - v[at, f]), len(touched)) for f in range(rank)], axis=1) / len(rows) + l2 * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= 0.1 * rate * dv / np.sqrt(gv[touched])
            gb += g.mean() ** 2
            b -= 0.1 * rate * g.mean() / np.sqrt(gb)
    return Model(b, ids, w, v)


def held_out() -> Column:
    """True for the rows whose labels no model may see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _packed(model: Model) -> pa.RecordBatch:
    parts = [model.ids.astype(np.int32), model.linear.astype(np.float64), model.factors.astype(np.float64)]
    return pa.RecordBatch.from_arrays([pa.array([model.bias]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["bias", "ids", "linear", "factors"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (toxic, terms), as one row."""
    held = list(batches)
    y = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held]) if held else np.empty(0)
    lists = [b.column(1) for b in held]
    lengths = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in lists]) if held else np.empty(0, np.int64)
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]) if held else np.empty(0, np.int32)
    del held, lists
    yield _packed(fit(flat, lengths, y.astype(float)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels`` (doc_id, toxic) from the texts of docs, by a bounded sample. One task of an executor fits it, so
    that only the model comes to the driver."""
    pick = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(*pick).limit(sample)  # at most `sample` pairs of numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", _terms(F.coalesce("text", F.lit(""))).alias("terms"))
    best = rows.orderBy(*pick, F.xxhash64("terms")).limit(sample).select(F.col("toxic").cast("double"), "terms")
    made = best.coalesce(1).mapInArrow(_fitted, "bias double, ids binary, linear binary, factors binary").collect()
    if not made:
        return fit(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0))
    ids, linear, factors = (np.frombuffer(made[0][i + 1], kind) for i, kind in enumerate((np.int32, np.float64, np.float64)))
    return Model(made[0]["bias"], ids, linear, factors.reshape(-1, RANK))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS rows of 1 + RANK numbers

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in runs(texts):
            run = Texts(LOWER[data], offsets, ALPHANUMERIC)
            out.append(_sigmoid(shared.value.margins(len(run), *terms(run))))
        return pa.array(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(name, scores(F.coalesce(F.col(text), F.lit(""))))
