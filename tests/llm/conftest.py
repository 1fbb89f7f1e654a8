import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def hard_rows():
    """Nulls, empty and long texts, copies and near copies, shared passages, repeated and null ids."""
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = text(70), text(30_000)
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, "One"), (5, "one two"), (6, long), (7, long + " tail"), (8, passage), (9, text(40) + "\n" + passage + "\t" + text(30))]
    rows += [(10, text(20) + " " + passage[: len(passage) // 2 * 2] + " x"), (11, passage.upper()), (12, "a " * 300), (13, "a " * 180 + "b"), (None, passage), (None, None), (9, passage + " same id"), (14, "\x00 nul \x0b vt")]
    base = text(150).split()
    for i in range(40):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(base)) for i in range(25)] + [(200, " ".join(base))]
    sources = ["web", "Äther", None, "books", "web", "web"]
    return [(d, t, "en", sources[i % 6], len(t or "")) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def hard(spark, hard_dir):
    return spark.read.parquet(f"{hard_dir}/documents.parquet")


@pytest.fixture(scope="session")
def hard_dir(spark, tmp_path_factory):
    """The tables of a data folder, built around the hard rows."""
    d = str(tmp_path_factory.mktemp("tables"))
    rows = hard_rows()
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{d}/documents.parquet")
    bench = [(1, " ".join(rows[7][1].split()[5:25])), (2, "one two"), (None, "nul vt"), (3, None), (4, ""), (2, rows[20][1]), (5, "absent words only here")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 3 == 0)) for r in rows if r[0]] + [(None, 1, 1), (4, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(i, f"http://x/{i}", t) for i, (_, t, *_rest) in enumerate(rows)] + [(3, "u", "x" * 200), (3, "u", "x" * 200), (None, None, "x" * 200), (90, None, "é" * 50), (91, None, "é" * 50), (92, None, "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, hard_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{hard_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
