"""Mixing sources to target weights by hash-threshold histograms.

Targets: sources, ordered by code point with null last, take the weights in turn and share ``epochs`` times all words;
a target stops at ``max_repeats`` times its source's size and the excess goes to the others by weight until none is
above. A source takes all its documents ``floor(target / size)`` times and those below a hash threshold once more, so
thresholds are nested: a larger target takes what a smaller one takes. The threshold is found from sums of words per
source and hash bucket: only the bucket in which the budget ends is refined, by the next bits of the hash, until one
hash value is left. Nothing is sorted, and no more than a row per source and bucket is ever brought together.

Nulls and edge cases: a null text has size 0; null is a source of its own. The hash is of doc_id and text, so reruns
agree and repeated rows share their fate. A source of size 0 has target 0. An empty table gives an empty result. Other
columns travel in one struct, so their names cannot clash; a column ``copies`` is replaced, where the result has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.columns import kept, packed, unpacked
from tessera.llm.ranking import lookup, ranked
from tessera.plans.staging import stage

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MAX_REPEATS = 2
#: Bits of the hash that each histogram resolves.
LEVELS = (12, 10, 10)
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text: str = "text"):
    """The size column: the number of words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(key, source, source_size) with ``target``. Each round asks for three sums over the sources."""
    order = [F.col("source").asc_nulls_last()]
    weighted = ranked(totals, order).withColumn("w", lookup(list(weights), F.col("rank") % len(weights), "double"))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.lit(level) * F.col("w") >= cap
        row = weighted.agg(F.sum(F.when(above, cap)).alias("fixed"), F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        if not row["w"]:
            break
        nxt = (epochs * total - (row["fixed"] or 0.0)) / row["w"]
        if nxt <= level:
            break
        level = nxt
    return weighted.select("key", "source_size", F.least(F.lit(level) * F.col("w"), cap).alias("target"))


def thresholds(sizes: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, max_repeats: float = MAX_REPEATS, levels=LEVELS) -> DataFrame:
    """(key, source_size, target, threshold) of each source; sizes has key, source, size and the hash ``h`` below 2**32."""
    totals = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = stage(targets(totals, weights, epochs, max_repeats), "targets")
    state = goal.filter("source_size > 0").select(
        "key", (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")
    )
    left = sum(levels)
    for bits in levels:
        inside = F.shiftright("h", left) == F.col("prefix")
        left -= bits
        bucket = F.shiftright("h", left)
        sums = sizes.select("key", "size", "h").join(state, "key").filter(inside).groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        ends = sums.join(state, "key").withColumn("upto", F.col("below") + upto).filter("upto > budget")
        state = stage(ends.groupBy("key").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), "upto", "budget")).alias("s")).select("key", F.col("s.budget").alias("budget"), F.col("s.bucket").alias("prefix"), F.col("s.below").alias("below"), F.col("s.upto").alias("upto")), "thresholds")
    nearer = (F.col("upto") - F.col("budget")) <= (F.col("budget") - F.col("below"))
    threshold = state.select("key", (F.col("prefix") + nearer.cast("long")).alias("threshold"))
    return stage(goal.join(threshold, "key", "left"), "mix")


def decided(rows: DataFrame, known: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """rows, which have key and h, with source_size, target and copies. Each row is decided where it is: sources are few, so
    that Spark broadcasts what is known of them, unless they are too many for that."""
    base = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    copies = F.floor(base) + F.coalesce((F.col("h") < F.col("threshold")).cast("long"), F.lit(0))
    return rows.join(known, "key").withColumn("copies", F.least(copies, F.lit(int(max_repeats)))).drop("threshold")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _hash(doc_id: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 32)


def narrow(docs: DataFrame) -> DataFrame:
    """What mixing needs of documents: doc_id, key, source, size, and the hash of doc_id and text."""
    return docs.select("doc_id", _key(F.col("source")).alias("key"), "source", sized(docs).alias("size"), _hash(F.col("doc_id"), F.col("text")).alias("h"))


def mixed(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """docs with ``copies``: how often the mix takes each."""
    known = thresholds(stage(narrow(docs), "sizes"), weights, epochs, max_repeats)
    rows = packed(docs).withColumns({"key": _key(F.col("doc.source")), "h": _hash(F.col("doc.doc_id"), F.col("doc.text"))})
    return unpacked(decided(rows, known, max_repeats), docs, copies=F.col("copies"))


def take(docs: DataFrame, **settings) -> DataFrame:
    """docs, each as often as the mix takes it."""
    rows = mixed(docs, **settings).filter("copies > 0")
    return packed(rows).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("doc.copies").cast("int")))).select(*kept(docs, name="doc"))
