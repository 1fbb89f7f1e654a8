"""Removal of long repeated passages by De Bruijn compaction.

A window is ``WINDOW`` consecutive words of a document. Words go that are covered by a window whose words also stand in
a document with a smaller doc_id.

Edges: of the ``WINDOW - K + 1`` k-mers of a window, the one with the least hash, leftmost in a tie, is the window's edge
(a sparse De Bruijn graph: all windows of equal words have equal edges, and an edge is a row for some twenty windows
instead of one a word). Windows that follow each other on one edge form an occurrence: (edge, span), the span being a
128-bit hash of all the words that these windows cover, with document and position as its coordinates, and the span that
follows it in the document as its way on. An edge seen in one document only ends there. Of the others:

* occurrences with equal edge and span are one path, whose source is its occurrence in the smallest document;
* a path is joined to the one that follows it if all its occurrences go on to that one, which has no other way in, and
  both sources stand next to each other: no branch lies between them. Runs of such paths are compacted to one, so that a
  passage of thousands of words costs one row a copy; every later document loses all of its words;
* only where an edge branches (several spans) do windows count singly, and only those of each path's source: its words
  are read again at the coordinates, and the windows of the paths, again as 128-bit hashes of their words, compared.

Verification: the words of every compacted path are read again at its source's coordinates and hashed with BLAKE2b; a
document loses a passage only if its own words there give the same digest. No pairs of documents are ever formed.

What aggregates yield is written before it is joined back: a join that starts from two plain exchanges can be split where
one key has very many rows.

Nulls and edge cases: a null or short text has no window. Rows with a null doc_id lose nothing and make no other lose
words. Repeated doc_ids are equal, not smaller: they take nothing from each other. An empty table gives an empty result.
Other columns travel in one struct, so their names cannot clash; a column ``spans`` is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytescan import NOT_SPACE, Texts, runs, span_hashes
from tessera.llm.columns import packed, unpacked
from tessera.plans.staging import stage

WINDOW = 50
K = 12
#: Parts into which the rows of a branching edge are dealt.
PARTS = 16


def least_positions(x: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values of x, the position of the least, leftmost in a tie."""
    n = len(x) - w + 1
    at, value, done = np.arange(len(x)), x, 1
    while done < w:
        step = min(done, w - done)
        a, b = value[:-step], value[step:]
        at, value, done = np.where(b < a, at[step:], at[:-step]), np.minimum(a, b), done + step
    return at[:n]


def word_digests(t: Texts, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the words first:first + n joined by spaces, as two columns."""
    joined, begin, end = t.joined()
    data, digest = joined.tobytes(), xxhash.xxh3_128_digest
    raw = b"".join([digest(data[b:e]) for b, e in zip(begin[first].tolist(), end[first + n - 1].tolist(), strict=True)])
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def occurrences(t: Texts, window: int = WINDOW, k: int = K):
    """Arrays (edge, span, second half of span, next span or 0, text, first word, windows) for a run of texts."""
    at = t.window_starts(window)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(7))
    words = t.word_hashes()
    i = np.arange(len(words) - k + 1)
    edges = span_hashes(words, i, i + k)
    least = least_positions(edges, window - k + 1)[at]
    new = np.r_[True, least[1:] != least[:-1]]
    first = at[new]
    n = np.diff(np.r_[np.flatnonzero(new), len(at)])
    text = np.searchsorted(t.first, first, side="right") - 1
    span, half = word_digests(t, first, n - 1 + window)
    following = np.where(np.r_[text[1:] == text[:-1], False], np.r_[span[1:], 0], 0)
    return edges[least[new]].view(np.int64), span, half, following, text, first - t.first[text], n


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for base, data, offsets in runs(batch.column(2)):
            edge, span, half, following, text, first, n = occurrences(Texts(data, offsets, NOT_SPACE))
            if len(edge):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(edge), pa.array(span), pa.array(half), pa.array(following), pa.array(row[base + text]), pa.array(doc[base + text]), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int16))],
                    names=["edge", "span", "half", "following", "row", "doc", "first", "n"],
                )


def _of_lists(lists: pa.Array, t: Texts, base: int) -> tuple[np.ndarray, pa.Array]:
    """For the lists that come with the texts of a run: the text of each element, and the elements."""
    own = lists.slice(base, len(t))
    return np.repeat(np.arange(len(t)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), own.flatten()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of the paths listed with each text."""
    for batch in batches:
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        for base, data, offsets in runs(batch.column(1)):
            t = Texts(data, offsets, NOT_SPACE)
            of, flat = _of_lists(batch.column(2), t, base)
            edge, span, half, first, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(t.first[of] + first, n) + j
            window, rest = word_digests(t, at, np.full(len(at), WINDOW))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(edge, n)), pa.array(window), pa.array(rest), pa.array(np.repeat(span, n)), pa.array(np.repeat(half, n)), pa.array(np.repeat(doc[base + of], n)), pa.array(j.astype(np.int16))],
                names=["edge", "window", "rest", "span", "half", "doc", "j"],
            )


def _seal(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of the words of the paths listed with each text."""
    for batch in batches:
        for base, data, offsets in runs(batch.column(0)):
            t = Texts(data, offsets, NOT_SPACE)
            of, flat = _of_lists(batch.column(1), t, base)
            first, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            joined, begin, end = t.joined()
            raw, at = joined.tobytes(), t.first[of] + first
            seals = [_seal(raw[b:e]) for b, e in zip(begin[at].tolist(), end[at + n + WINDOW - 2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(flat.field(i) for i in range(4)), pa.array(n), pa.array(seals, pa.binary())], names=[*KEY, "m", "n", "seal"])


KEY = ["edge", "span", "half"]


def compacted(paths: DataFrame) -> DataFrame:
    """(edge, span, half, doc, row, first, n) of the first path of each run without branches; n counts the windows of the run.

    paths has these columns, the number ``c`` of its occurrences, and ``following``, the span that all of them go
    on to or null."""
    into = paths.select(F.col("span").alias("following"), F.struct("row", "first", "c", "edge").alias("to"))
    onward = paths.filter("following IS NOT NULL").join(into, "following")
    joint = onward.filter("to.row = row AND to.first = first + n AND to.c = c").select(F.col("row"), F.col("to.first").alias("first"), F.col("to.edge").alias("edge"), F.lit(True).alias("joint"))
    marked = stage(paths.select(*KEY, "doc", "row", "first", "n"), "marked").join(joint.distinct(), ["row", "first", "edge"], "left")
    along = Window.partitionBy("row").orderBy("first", "edge", "span", "half")
    run = F.sum(F.when(F.col("joint"), 0).otherwise(1)).over(along)
    return marked.withColumn("run", run).groupBy("row", "run").agg(F.min(F.struct("first", *KEY, "doc")).alias("head"), F.sum("n").alias("n")).select("head.*", "row", F.col("n").cast("int").alias("n"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row, spans) for documents with words to remove; docs, a written table, has row, doc_id and text. A span is (first
    word, windows, and either the digest of its words or the offsets of the windows that are repeated)."""
    long = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("row", "doc_id", "text")
    found = stage(long.mapInArrow(_occurrences, "edge long, span long, half long, following long, row long, doc long, first int, n short"), "occurrences")
    shared = stage(found.groupBy("edge").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("edge"), "edges")
    kept = stage(found.join(shared, "edge", "left_semi"), "repeated")
    onward = F.when(F.min("following") == F.max("following"), F.nullif(F.min("following"), F.lit(0)))
    paths = kept.groupBy(*KEY).agg(F.min(F.struct("doc", "row", "first", "n")).alias("p"), F.count("*").alias("c"), F.max("doc").alias("hi"), onward.alias("following"))
    paths = stage(paths.select(*KEY, "p.*", "c", "hi", "following"), "paths")

    branching = stage(paths.groupBy("edge").agg(F.count("*").alias("k")).filter("k > 1").select("edge", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")), "branching")
    own = paths.withColumn("part", F.pmod("span", F.lit(PARTS)).cast("int")).join(branching, ["edge", "part"], "left_semi")
    read = own.groupBy("row").agg(F.first("doc").alias("doc"), F.collect_list(F.struct(*KEY, "first", "n")).alias("paths"))
    single = stage(docs.select("row", "text").join(read, "row").select("doc", "text", "paths").mapInArrow(_windows, "edge long, window long, rest long, span long, half long, doc long, j short"), "windows")
    least = stage(single.groupBy("edge", "window", "rest").agg(F.min("doc").alias("m"), F.max("doc").alias("hi")).filter("m < hi").drop("hi"), "least")
    partly = stage(single.join(least, ["edge", "window", "rest"]).filter("m < doc").groupBy(*KEY).agg(F.collect_set("j").alias("offsets")), "partly")

    heads = stage(compacted(paths.filter("doc < hi")), "heads")
    listed = heads.groupBy("row").agg(F.collect_list(F.struct(*KEY, "doc", "first", "n")).alias("paths"))
    sealed = stage(docs.select("row", "text").join(listed, "row").select("text", "paths").mapInArrow(_sources, "edge long, span long, half long, m long, n int, seal binary"), "sealed")

    whole = kept.drop("n").join(sealed, KEY).filter("doc > m").select("row", "first", "n", "seal", F.lit(None).cast("array<smallint>").alias("offsets"))
    some = kept.join(partly, KEY).join(paths.select(*KEY, F.col("doc").alias("m")), KEY).filter("doc = m")
    some = some.select("row", "first", F.col("n").cast("int").alias("n"), F.lit(None).cast("binary").alias("seal"), "offsets")
    return whole.unionByName(some).groupBy("row").agg(F.collect_list(F.struct("first", "n", "seal", "offsets")).alias("spans"))


_RESULT = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")


def _kept(texts: pa.Array, spans: pa.Array):
    """For each text: its run, its number in the run, and a mask of the words that stay."""
    for base, data, offsets in runs(texts):
        t = Texts(data, offsets, NOT_SPACE)
        text, flat = _of_lists(spans, t, base)
        mark = np.zeros(len(t.start) + 1, np.int64)
        if len(flat):
            joined, begin, end = t.joined()
            raw = joined.tobytes()
            first = t.first[text] + flat.field(0).to_numpy(zero_copy_only=False)
            n = flat.field(1).to_numpy(zero_copy_only=False)
            last = first + n + WINDOW - 2
            seals, offs = flat.field(2).to_pylist(), flat.field(3)
            same = [s is not None and s == _seal(raw[b:e]) for s, b, e in zip(seals, begin[first].tolist(), end[last].tolist(), strict=True)]
            whole = np.array(same, bool)
            np.add.at(mark, first[whole], 1)
            np.add.at(mark, last[whole] + 1, -1)
            each = np.repeat(first, offs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + offs.flatten().to_numpy(zero_copy_only=False)
            np.add.at(mark, each, 1)
            np.add.at(mark, each + WINDOW, -1)
        yield base, t, np.cumsum(mark)[:-1] == 0


@F.arrow_udf(_RESULT)
def _digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
    words, removed, digests = [], [], []
    for _, t, keep in _kept(texts, spans):
        data, off = t.data.tobytes(), t.offsets.tolist()
        words.append(t.counts())
        total = np.r_[0, np.cumsum(keep)]
        kept = total[t.first[1:]] - total[t.first[:-1]]
        removed.append(t.counts() - kept)
        for i in range(len(t)):
            if kept[i] == t.first[i + 1] - t.first[i]:
                text = b" ".join(data[off[i] : off[i + 1]].split())
            else:
                at = np.flatnonzero(keep[t.first[i] : t.first[i + 1]]) + t.first[i]
                text = b" ".join([data[b:e] for b, e in zip(t.start[at].tolist(), t.end[at].tolist(), strict=True)])
            digests.append(hashlib.sha256(text).hexdigest())
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(join(words), pa.int64()), pa.array(join(removed), pa.int64()), pa.array(digests, pa.string())], names=["n_words", "n_removed", "kept_sha256"])


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for _, t, keep in _kept(texts, spans):
        for i in range(len(t)):
            at = np.flatnonzero(keep[t.first[i] : t.first[i + 1]]) + t.first[i]
            out.append(b" ".join(t.word(j) for j in at).decode())
    return pa.array(out, pa.string())


def with_spans(documents: DataFrame) -> DataFrame:
    """documents, a written table, with ``spans``, null where nothing repeats."""
    rows = packed(documents).withColumn("row", F.monotonically_increasing_id())
    spans = repeated_spans(rows.select("row", "doc.doc_id", "doc.text"))
    return unpacked(rows.join(spans, "row", "left"), documents, spans=F.col("spans"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of documents with spans."""
    return found.select("doc_id", _digest(F.coalesce("text", F.lit("")), "spans").alias("d")).select("doc_id", "d.*")


def remove(found: DataFrame) -> DataFrame:
    """Texts without their repeated passages, kept words joined by one space."""
    return found.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_cut(F.coalesce("text", F.lit("")), "spans"))).drop("spans")
