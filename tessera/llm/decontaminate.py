"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of the benchmark (``n`` consecutive words of an item; an item of fewer words is one window) form a hash
set that goes to the executors. They hash the windows of every document, look each up, compare the words of each hit
with those of the benchmark, and mark the words it covers.

The set is a few flat arrays: equal windows are one entry, which names the texts that hold it; equal texts are one, which
names its items. So it takes ``BYTES_A_WINDOW`` and the window's share of the text, however many items share a window. It
is broadcast in blocks of at most ``max_windows`` windows, counted beforehand: a larger benchmark takes several passes,
one after the other, of which only the hits are written, and a text of more windows than that is split. Every Python worker
holds one block.

Nulls and edge cases: a null text has no words. An item without words is never hit; a null item_id counts as the id
"null"; repeated ids count once. Repeated documents get equal results. An empty benchmark hits nothing. Other columns
travel in one struct, so their names cannot clash; a column with the name of ``hits`` is replaced.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytescan import ALPHANUMERIC, LOWER, UPPER, Texts, runs, span_hashes
from tessera.llm.columns import packed, unpacked
from tessera.plans.staging import stage

N = 10
MAX_WINDOWS = 500_000
#: Hash, begin, end, first text, text: with some 7 bytes of words, some 20 MB a block.
BYTES_A_WINDOW = 8 + 8 + 8 + 8 + 4

RANGES = T.ArrayType(T.StructType().add("b", "integer").add("e", "integer"))
HITS = T.StructType().add("n_words", "long").add("ranges", RANGES).add("items", T.ArrayType(T.StringType()))
_TYPE = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))])
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Windows:
    """The distinct windows of one length, by hash: entry i has the bytes words[begin[i]:end[i]] and stands in the texts
    texts[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    texts: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 entry of each hash."""
        return np.searchsorted(self.hashes, wanted, "left"), np.searchsorted(self.hashes, wanted, "right")


@dataclass
class Index:
    words: bytes
    by_length: dict[int, Windows]
    items: list[list[str]]  # of each text

    def nbytes(self) -> int:
        return len(self.words) + sum(a.nbytes for w in self.by_length.values() for a in vars(w).values())


def _entries(words: bytes, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray) -> Windows:
    order = np.lexsort((text, hashes))
    hashes, begin, end, text = hashes[order], begin[order], end[order], text[order]
    same = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    kind = np.zeros(len(hashes), np.int64)  # tells windows apart that only have equal hashes
    seen: dict[tuple[int, bytes], int] = {}
    for i in same.tolist():
        h = int(hashes[i])
        for j in (i - 1, i):
            kind[j] = seen.setdefault((h, words[begin[j] : end[j]]), len(seen) + 1)
    order = np.lexsort((text, kind, hashes))
    hashes, begin, end, text, kind = hashes[order], begin[order], end[order], text[order], kind[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (kind[1:] != kind[:-1])][: len(hashes)]
    once = new | np.r_[True, text[1:] != text[:-1]][: len(hashes)]
    first = np.flatnonzero(new[once])
    return Windows(hashes[new], begin[new], end[new], np.r_[first, once.sum()], text[once].astype(np.int32))


def index(items: list[tuple[str, str | None]], n: int = N) -> Index:
    """The windows of (id, text) pairs."""
    of: dict[str, dict[str, None]] = {}
    for name, text in items:
        of.setdefault(text or "", {})[name] = None
    parts: dict[int, list[tuple]] = defaultdict(list)
    blob, size = [], 0
    for base, data, offsets in runs(pa.array(list(of), pa.string())):
        run = Texts(LOWER[data], offsets, ALPHANUMERIC)
        words, counts = run.word_hashes(), run.counts()
        joined, begin, end = run.joined()
        whole = run.window_starts(n)
        for length in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            at = whole if length == n else run.first[:-1][counts == length]
            text = base + np.searchsorted(run.first, at, side="right") - 1
            parts[length].append((span_hashes(words, at, at + length), size + begin[at], size + end[at + length - 1], text))
        blob.append(joined.tobytes())
        size += len(joined)
    words = b"".join(blob)
    return Index(words, {k: _entries(words, *(np.concatenate(x) for x in zip(*v, strict=True))) for k, v in sorted(parts.items())}, [list(x) for x in of.values()])


def blocks(items: Iterator[tuple[str, str | None]], n: int = N, max_windows: int = MAX_WINDOWS) -> Iterator[list[tuple[str, str]]]:
    """The items in parts of at most so many windows; a longer text comes in pieces that overlap by n - 1 words."""
    held, windows = [], 0
    for name, text in items:
        found = _WORD.findall((text or "").encode().translate(bytes(LOWER)).decode())
        pieces = max(1, -(-max(1, len(found) - n + 1) // max_windows))
        for i in range(pieces):
            piece = text or "" if pieces == 1 else " ".join(found[i * max_windows : (i + 1) * max_windows + n - 1])
            more = max(1, min(len(found) - i * max_windows, max_windows + n - 1) - n + 1)
            if held and windows + more > max_windows:
                yield held
                held, windows = [], 0
            held.append((name, piece))
            windows += more
    yield held


def _scanner(table):
    """The UDF text -> HITS for a broadcast index."""

    def scan(texts: pa.Array) -> pa.Array:
        known: Index = table.value
        n_words, ranges, items = [], [], []
        for _, data, offsets in runs(texts):
            run = Texts(LOWER[data], offsets, ALPHANUMERIC)
            words, own = run.word_hashes(), None
            n_words.append(run.counts())
            hits, found = defaultdict(list), defaultdict(list)
            for length, windows in known.by_length.items():
                at = run.window_starts(length)
                hashes = span_hashes(words, at, at + length)
                low, high = windows.find(hashes)
                near = np.flatnonzero(low < high)
                if not len(near):
                    continue
                if own is None:
                    joined, begin, end = run.joined()
                    own = joined.tobytes()
                owner = np.searchsorted(run.first, at[near], side="right") - 1
                for p, lo, hi, i in zip(at[near].tolist(), low[near].tolist(), high[near].tolist(), owner.tolist(), strict=True):
                    mine = own[begin[p] : end[p + length - 1]]
                    for e in range(lo, hi):  # more than one only where hashes collide
                        if known.words[windows.begin[e] : windows.end[e]] == mine:
                            first = p - int(run.first[i])
                            hits[i].append((first, first + length))
                            found[i].append(windows.texts[windows.first[e] : windows.first[e + 1]])
            ranges += [_merged(hits[i]) if i in hits else [] for i in range(len(run))]
            items += [sorted({x for t in np.unique(np.concatenate(found[i])) for x in known.items[t]}) if i in found else [] for i in range(len(run))]
        count = np.concatenate(n_words) if n_words else np.empty(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array([[{"b": b, "e": e} for b, e in r] for r in ranges], _TYPE[1].type), pa.array(items, _TYPE[2].type)], fields=list(_TYPE))

    return F.arrow_udf(scan, HITS)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(ranges):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


@F.arrow_udf(RANGES)
def _united(lists: pa.Array) -> pa.Array:
    return pa.array([[{"b": b, "e": e} for b, e in _merged([(r["b"], r["e"]) for part in x or [] for r in part])] for x in lists.to_pylist()], _TYPE[1].type)


@F.arrow_udf(T.LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    counts = [Texts(data, offsets, ALPHANUMERIC | UPPER).counts() for _, data, offsets in runs(texts)]
    return pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64), pa.int64())


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N, max_windows: int = MAX_WINDOWS, hits: str = "hits") -> DataFrame:
    """docs with the column ``hits``: its words, the hit ranges of words, merged, and the ids of the items that were hit.
    Where the benchmark takes several blocks, docs has to be a written table."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text").distinct()
    parts = blocks(((r["id"], r["text"]) for r in items.toLocalIterator()), n, max_windows)
    first, second = next(parts), next(parts, None)
    value = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))
    rows = packed(docs)
    if second is None:
        return unpacked(rows.withColumn("h", _scanner(spark.sparkContext.broadcast(index(first, n)))(value)), docs, **{hits: F.col("h")})
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    found = []
    for part in itertools.chain([first, second], parts):
        table = spark.sparkContext.broadcast(index(part, n))
        found.append(stage(keyed.select("row", _scanner(table)(value).alias("h")).filter(F.size("h.items") > 0), "hits"))
        table.destroy()
    lists = functools.reduce(DataFrame.unionByName, found).groupBy("row").agg(F.collect_list("h.ranges").alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("items"))
    merged = lists.select("row", _united("ranges").alias("ranges"), "items")
    none = F.coalesce("ranges", F.array().cast(RANGES)), F.coalesce("items", F.array().cast("array<string>"))
    return unpacked(keyed.join(merged, "row", "left"), docs, **{hits: F.struct(_n_words(value).alias("n_words"), none[0].alias("ranges"), none[1].alias("items"))})


def n_hit(hits: str = "hits"):
    return F.aggregate(F.col(f"{hits}.ranges"), F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["b"])


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    out = []
    for value, cut in zip(texts, ranges.to_pylist(), strict=True):
        if not value.is_valid or not cut:
            out.append(value.as_py())
            continue
        data = np.frombuffer(value.as_py().encode(), np.uint8)
        t = Texts(LOWER[data], np.array([0, len(data)]), ALPHANUMERIC)
        keep = np.ones(len(data), bool)
        for r in cut:
            keep[t.start[r["b"]] : t.end[r["e"] - 1]] = False
        out.append(data[keep].tobytes().decode())
    return pa.array(out, pa.string())


def remove_spans(scanned: DataFrame, text: str = "text", hits: str = "hits") -> DataFrame:
    """Cuts the hit ranges out of the texts; whatever stands between other words stays."""
    return scanned.withColumn(text, _without(F.col(text), F.col(f"{hits}.ranges")))


def remove_documents(scanned: DataFrame, hits: str = "hits") -> DataFrame:
    """Keeps the documents without a hit."""
    return scanned.filter(F.size(f"{hits}.items") == 0)
