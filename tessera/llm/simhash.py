"""SimHash fingerprints and exact near-duplicate linking by anchor points.

Two fingerprints link when at most ``threshold`` of their 64 bits differ; a document's component is what it reaches
over links. Anchors: the fingerprint is cut into fields, so that two linked fingerprints differ in at most
``threshold // fields`` bits of one field. In a field the anchors are the words of a Hamming code (covering radius 1)
times the field's bits beyond it (radius 0). A fingerprint is replicated to every anchor within covering radius plus
the field's threshold and compared there; as the anchor nearest to one of the two is among them, no link is lost.

Equal fingerprints are merged before anything else, so copies cost nothing. At an anchor, only a spanning forest of
the links is emitted, never all pairs. Anchors with many fingerprints are dealt out as pairs of blocks.

Nulls and edge cases: a null or empty text has fingerprint 0 and links like any other. Rows with a null doc_id get
the smallest doc_id of their component (null if it has none). Repeated rows stay and get equal results. An empty
table gives an empty result. Other columns travel in one struct, so their names cannot clash; columns ``root`` and
``component_id`` are replaced.
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

from tessera.llm.columns import packed, unpacked
from tessera.operators.components import min_labels
from tessera.plans.staging import stage

SEED = 42
WORDS = 3
BITS = 64
BLOCK = 4096


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of one text in UTF-8."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    stop, at = [], -1
    for p in parts:
        at += len(p) + 1
        stop.append(at)
    n = max(1, len(parts) - words + 1)
    begin = [0] + [e + 1 for e in stop[: n - 1]]
    stop = stop[len(stop) - n :]
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(joined[b:e], SEED) for b, e in zip(begin, stop, strict=True)]))


def majority(hashes: bytes) -> int:
    """The bits that more than half of the 8-byte big-endian hashes have."""
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    out = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts), np.uint64, len(texts))
    return pa.array(out.view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the signed 64-bit column ``fp``."""
    return docs.withColumn("fp", _fingerprints(F.col(text).cast("binary")))


# Anchors


def _fields(threshold: int, fields: int) -> list[tuple[int, int]]:
    """(Shift, width) of each field."""
    edges = [BITS * i // fields for i in range(fields + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _syndromes(word: np.ndarray, n: int) -> np.ndarray:
    """The Hamming syndrome of the lowest n bits: the xor of the positions, from 1, of set bits."""
    out = np.zeros(len(word), np.uint64)
    for i in range(n):
        out ^= ((word >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def anchors(fps: np.ndarray, threshold: int = 3, fields: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(Indices of fingerprints, anchor ids) for every anchor that each is replicated to."""
    spare = threshold // fields
    one = np.uint64(1)
    index = np.arange(len(fps))
    for f, (shift, width) in enumerate(_fields(threshold, fields)):
        m = (width + 1).bit_length() - 1
        n = (1 << m) - 1  # length of the code
        field = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        # every word within `spare` of the field, each moved to its nearest code word: together, all anchors in reach
        near = [(field, index)]
        for _ in range(spare):
            near += [(w ^ (one << np.uint64(b)), i) for w, i in near for b in range(width)]
        word, who = (np.concatenate(x) for x in zip(*near, strict=True))
        syndrome = _syndromes(word, n)
        word = np.where(syndrome > 0, word ^ (one << (np.maximum(syndrome, one) - one)), word)
        keys = np.unique((who.astype(np.uint64) << np.uint64(48)) | word)  # fields are narrower than 48 bits
        yield (keys >> np.uint64(48)).astype(np.int64), (keys & np.uint64((1 << 48) - 1)) | np.uint64(f << (width + 1))


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(every), 1 << 14):
            fps = every[at : at + (1 << 14)]
            for who, anchor in anchors(fps.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fps[who])], names=["anchor", "fp"])


# Comparison at an anchor


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def labels(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return up
            self.up = up = nxt


def forest(fps: np.ndarray, threshold: int = 3, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (positions in fps followed by right) that span the components of the link graph on fps, or of its links
    between fps and right. Memory is linear: 256 rows are compared at a time."""
    both = fps if right is None else np.concatenate([fps, right])
    found = _Forest(len(both))
    if len(both) < 2:
        return found.edges
    for pivot in range(min(4, len(fps))):  # most of a dense group hangs on few pivots
        for j in np.flatnonzero(np.bitwise_count(both ^ fps[pivot]) <= threshold):
            if j != pivot and (right is None or j >= len(fps)):
                found.join(pivot, int(j))
    base = 0 if right is None else len(fps)
    other = both[base:]
    for i in range(0, len(fps), 256):
        rows = fps[i : i + 256]
        label = found.labels()
        low = 0 if right is not None else i
        for j in range(low, len(other), BLOCK):
            cols = other[j : j + BLOCK]
            open_ = label[i : i + len(rows), None] != label[None, base + j : base + j + len(cols)]
            if open_.any():
                a, b = np.nonzero(open_ & (np.bitwise_count(rows[:, None] ^ cols[None, :]) <= threshold))
                if len(a):
                    pair = np.unique(np.stack([label[i + a], label[base + j + b]]), axis=1, return_index=True)[1]
                    for p in pair:
                        found.join(int(i + a[p]), int(base + j + b[p]))
                    label = found.labels()
    return found.edges


def _links(batches: Iterator[pd.DataFrame], threshold: int = 3) -> Iterator[pd.DataFrame]:
    """Rows (anchor, left block, right block, block, fp) come sorted by the first three; links within each such group."""

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy().view(np.uint64)
        key = rows[["anchor", "i", "j"]].to_numpy()
        new = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(rows)]
        size = np.repeat(end - begin, end - begin)
        group = np.cumsum(new) - 1
        out: list[tuple[np.ndarray, np.ndarray]] = []
        small = int(min(16, size.max(initial=0)))
        for step in range(1, small):  # groups of up to 16 all at once
            ok = (group[step:] == group[:-step]) & (size[step:] <= 16)
            at = np.flatnonzero(ok)
            at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= threshold]
            out.append((fps[at], fps[at + step]))
        block = rows["block"].to_numpy()
        for b, e in zip(begin, end, strict=True):
            if e - b > 16:
                left = block[b:e] == key[b, 1]
                if key[b, 1] == key[b, 2]:
                    mine, right = np.unique(fps[b:e]), None
                else:
                    mine, right = np.unique(fps[b:e][left]), np.unique(fps[b:e][~left])
                both = mine if right is None else np.concatenate([mine, right])
                if edges := forest(mine, threshold, right):
                    x = np.array(edges)
                    out.append((both[x[:, 0]], both[x[:, 1]]))
        a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.uint64)
        b_ = np.concatenate([x for _, x in out]) if out else np.empty(0, np.uint64)
        return pd.DataFrame({"a": a.view(np.int64), "b": b_.view(np.int64)}).drop_duplicates()

    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < 1 << 16:
            continue
        all_rows = pd.concat(held, ignore_index=True)
        last = all_rows[["anchor", "i", "j"]].iloc[-1]
        open_ = (all_rows[["anchor", "i", "j"]] == last).all(axis=1).to_numpy()
        if not open_.all():
            yield linked(all_rows[~open_].reset_index(drop=True))
        held, rows = [all_rows[open_].reset_index(drop=True)], int(open_.sum())
    if held:
        yield linked(pd.concat(held, ignore_index=True))


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints ``fp``.

    Replicas that are alone at their anchor are dropped by a count that combines before its shuffle. Where more than
    ``block`` fingerprints meet, the bits outside the anchor's field tell them apart: cut into one piece more than bits may
    differ, two that link agree in one piece at least, so that the fingerprints are compared per anchor, piece and its
    value, and no link is lost. What is still crowded then is cut into c blocks by a hash; each goes to the c tasks that
    pair it."""
    placed = stage(distinct.select("fp").mapInArrow(_replicated, "anchor long, fp long"), "anchors")
    met = stage(placed.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "met")
    crowded = met.filter(F.col("n") > block)
    shared = placed.join(met, "anchor")
    if not crowded.isEmpty():
        pieces = stage(placed.join(crowded.select("anchor"), "anchor").select(_pieces(), "fp"), "pieces")
        again = pieces.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
        shared = shared.filter(F.col("n") <= block).unionByName(pieces.join(again, "anchor").select("anchor", "fp", "n"))
    c = F.ceil(F.col("n") / F.lit(block)).cast("int")
    cut = shared.select("anchor", "fp", c.alias("c")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    dealt = cut.select(
        "anchor", "fp", "block", F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("c") - 1))).alias("other")
    ).select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    sorted_ = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")
    return sorted_.mapInPandas(_links, "a long, b long")


def _pieces(threshold: int = 3, fields: int = 2):
    """For a replica at an anchor: an id for each piece of the bits outside the anchor's field, with the piece's value."""
    f = F.shiftright("anchor", BITS // fields + 1)
    width = BITS // fields
    other = F.when(f == 0, F.shiftrightunsigned("fp", width)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << width) - 1)))
    size = width // (threshold + 1)
    ids = [F.xxhash64("anchor", F.lit(i), F.shiftright(other, i * size).bitwiseAND(F.lit((1 << size) - 1))) for i in range(threshold + 1)]
    return F.explode(F.array(*ids)).alias("anchor")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs, which have ``doc_id`` and ``fp``, with the component: ``root``, its smallest fingerprint in signed order, and
    ``component_id``."""
    per = docs.groupBy("fp").agg(F.min("doc_id").alias("m"))
    nodes = stage(per, "fingerprints")
    edges = stage(links(nodes), "links")
    labels = min_labels(edges)  # (node, label) of fingerprints with a link
    joined = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "m", F.coalesce("label", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("m").alias("component_id"))
    of_fp = joined.join(least, "root").select("fp", "root", "component_id")
    found = packed(docs).withColumn("fp", F.col("doc.fp")).join(of_fp, "fp")
    return unpacked(found, docs, root=F.col("root"), component_id=F.col("component_id"))
