"""Near copies of texts: groups connected by pairs whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Links are found in three steps, each of which leaves less to the next; every one is checked on the whole sets, shingles
being told apart by 64-bit hashes, and texts of equal sets are merged before anything else.

* Fingerprints: SimHash over the five-word shingles, linked by anchor points (``simhash.links``). They find copies that
  differ in at most 3 bits, but cannot serve alone: at 0.8 some 10 of 64 bits differ on average, and a radius of 16, which
  a few pairs of a hundred need, has more anchors in reach than there are texts.
* Bands: MinHash, ``BANDS`` bands of ``ROWS`` minima each. A pair at 0.8 shares no band with probability (1 - 0.8^4)^32 <
  5e-8, a closer pair with less; nothing else is approximate. The members of a bucket are compared with one of them.
* Buckets that still hold several components are compared whole. Where the minima rule out that two members are similar
  (at 0.8 the share of equal minima is below ``LIKELY`` by seven standard deviations) they are; the members that are left
  bring their sets, and of the links among them only a spanning forest is kept. Large buckets are dealt out as pairs of
  blocks, whose size bounds the sets in a task.

Nulls and edge cases: a text of fewer than five words is one shingle. Null and empty texts are copies of each other.
Rows are told apart by their column ``row``. Repeated rows and null doc_ids are kept. An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.operators.components import min_labels
from tessera.plans.staging import stage

SEED = 42
WORDS = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 4
LIKELY = 0.55
#: Members of a block, and shingles of a block with their sets.
BLOCK = 2048
SHINGLES = 1 << 20

_A, _B = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_A |= np.uint64(1)


def hashed(text: bytes, words: int = WORDS) -> bytes:
    """The hashes of the shingles of one text in UTF-8, repeats included, 8 bytes each."""
    parts = text.lower().split()
    digest = xxhash.xxh64_digest
    n = max(1, len(parts) - words + 1) if parts else 0
    return b"".join([digest(b" ".join(parts[i : i + words]), SEED) for i in range(n)])


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text in UTF-8."""
    return np.unique(np.frombuffer(hashed(text, words), ">u8").astype(np.uint64))


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the hash functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1024):
        np.minimum(least, (own[i : i + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, sizes, bands, signs, fps = [], [], [], [], []
        for t in batch.column(2):
            raw = hashed(t.as_buffer().to_pybytes() if t.is_valid else b"")
            fps.append(simhash.majority(raw))
            own = np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))
            sets.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            sizes.append(len(own))
            least = minima(own)
            bands.append(_bands(least).view(np.int64) if len(own) else None)
            signs.append((least & np.uint64(255)).astype(np.uint8).tobytes())
        made = [pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["row", "doc_id", "set", "n", "bands", "sign", "fp"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingles(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t.as_buffer().to_pybytes() if t.is_valid else b"").view(np.int64) for t in texts], pa.list_(pa.int64()))


def _checked(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar enough."""
    pairs = stage(pairs.filter("a <> b").distinct(), "pairs")
    left = pairs.join(texts.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(texts.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stage(both.filter(common / (F.size("x") + F.size("y") - common) >= threshold).select("a", "b"), "links")


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the members of blocks i and j."""
    return np.flatnonzero(pdf["block"] == pdf["i"]), np.flatnonzero(pdf["block"] == pdf["j"])


def _hopeful(threshold: float):
    """Members of a bucket's blocks i and j that have a partner in another component whom sizes and minima do not rule out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        label, n = pdf["label"].to_numpy(), pdf["n"].to_numpy()
        sign = np.frombuffer(b"".join(pdf["sign"]), np.uint8).reshape(len(pdf), -1)
        hope = np.zeros(len(pdf), bool)
        for k in range(0, len(left), 32):
            a = left[k : k + 32]
            ok = label[a, None] != label[None, right]
            ok &= np.minimum(n[a, None], n[None, right]) >= threshold * np.maximum(n[a, None], n[None, right]) - 1e-6
            x, y = np.nonzero(ok)
            for c in range(0, len(x), 1 << 16):
                p, q = a[x[c : c + (1 << 16)]], right[y[c : c + (1 << 16)]]
                like = (sign[p] == sign[q]).mean(axis=1) >= LIKELY - (THRESHOLD - min(THRESHOLD, threshold))
                hope[p[like]] = hope[q[like]] = True
        return pdf.loc[hope, ["band", "i", "j", "block", "set", "label"]]

    return run


def _forest(threshold: float):
    """Links between the components in a bucket's blocks i and j, on whole sets: no more than there are members."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        ids, label, block, first, second = column("set"), column("label").copy(), column("block"), column("i"), column("j")
        lists = table.column("shingles").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        number = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        begin = np.cumsum(n) - n
        mark = np.zeros(len(number) + 1, bool)
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        out = []
        for a in left.tolist():
            own = number[begin[a] : begin[a] + n[a]]
            others = right[(label[right] != label[a]) & (np.minimum(n[right], n[a]) >= threshold * np.maximum(n[right], n[a]) - 1e-6)]
            if not len(others):
                continue
            mark[own] = True
            size = n[others]
            at = np.repeat(begin[others] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            common = np.add.reduceat(mark[number[at]], np.cumsum(size) - size, dtype=np.int64)
            mark[own] = False
            for b in others[common / (n[a] + size - common) >= threshold].tolist():
                if label[a] != label[b]:
                    out.append((ids[a], ids[b]))
                    label[label == label[b]] = label[a]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def near_copies(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, root) for docs, a written table with ``row``, ``doc_id`` and a text; root is the same within a group."""
    spread = docs.select("row", "doc_id", F.col(text).cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = stage(spread.mapInArrow(_sketched, f"row long, doc_id {kind}, set long, n long, bands array<long>, sign binary, fp long"), "sketches")
    sets = stage(rows.groupBy("set").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("sign").alias("sign"), F.first("fp").alias("fp")), "sets")
    placed = stage(rows.select("set", "n", F.explode("bands").alias("band")).groupBy("band", "set").agg(F.first("n").alias("n")), "placed")
    met = stage(placed.groupBy("band").agg(F.count("*").alias("many"), F.sum("n").alias("shingles")).filter("many > 1"), "met")
    open_ = stage(placed.join(met, "band").select("band", "set", "many", "shingles"), "buckets")
    need = sets.join(open_.select("set").distinct(), "set").select("row", "set")
    texts = stage(spread.join(need, "row").select("set", _shingles("text").alias("shingles")), "shingles")

    centres = stage(sets.filter("n > 0").groupBy("fp").agg(F.min("set").alias("centre")), "centres")
    linked = simhash.links(centres.select("fp"))
    ends = linked.join(centres.select(F.col("fp").alias("a"), F.col("centre").alias("x")), "a").join(centres.select(F.col("fp").alias("b"), F.col("centre").alias("y")), "b")
    alike = sets.join(centres, "fp").select(F.col("set").alias("a"), F.col("centre").alias("b")).unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    edges = _checked(alike, texts, threshold)

    def named(of: DataFrame, last: bool) -> DataFrame:
        """The members of the buckets that still hold several components. Of two members, the star has seen the pair."""
        labels = stage(min_labels(edges).withColumnRenamed("node", "set"), "labels")
        every = stage(of.drop("label").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set")), "named")
        mixed = stage(every.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band"), "mixed")
        return stage((every.filter("many > 2") if last else every).join(mixed, "band"), "buckets")

    open_ = named(open_, last=False)
    star = stage(open_.groupBy("band").agg(F.min(F.struct(F.xxhash64("set"), F.col("set"), F.col("label"))).alias("s")).select("band", F.col("s.set").alias("centre"), F.col("s.label").alias("its")), "stars")
    pairs = open_.join(star, "band").filter("label <> its").select(F.least("set", "centre").alias("a"), F.greatest("set", "centre").alias("b"))
    edges = edges.unionByName(_checked(pairs, texts, threshold))

    open_ = named(open_, last=True)
    c = F.ceil(F.greatest(F.col("many") / F.lit(block), F.col("shingles") / F.lit(SHINGLES))).cast("int")
    wide = open_.join(sets.select("set", "n", "sign"), "set").withColumn("c", c).withColumn("block", F.pmod(F.xxhash64("set"), F.col("c")).cast("int"))
    dealt = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "label", "n", "sign")
    hopeful = stage(dealt.groupBy("band", "i", "j").applyInPandas(_hopeful(threshold), "band long, i int, j int, block int, set long, label long"), "hopeful")
    whole = hopeful.join(texts, "set").groupBy("band", "i", "j").applyInArrow(_forest(threshold), "a long, b long")
    edges = edges.unionByName(stage(whole.distinct(), "links"))
    labels = min_labels(edges)
    return rows.select("row", "doc_id", "set").join(labels, rows.set == labels.node, "left").select("row", "doc_id", F.coalesce("label", "set").alias("root"))
