"""Sources, sinks, the serving build and the rebuild stream on small worlds."""

import gzip

from pyspark.sql import functions as F

from tessera.plans import serving
from tessera.sources import files
from tessera.streaming.rebuild import on_new_snapshot

REPORT = "=== sizes\nname  n  share\n----  -  -----\na b  1,234  5.5%\nc  2  n/a\n\nloose note\n=== next\nx  y\n--  --\n1  2\n"
RAW = "key string, type string, publtype string, mdate string, title string, authors array<string>, author_orcids array<string>, year int, journal string, booktitle string, ee array<string>, has_oa boolean, urls array<string>"


def world(spark):
    person = lambda key, names, kind=None, urls=(): (f"homepages/{key}", "www", kind, "2025-01-01", None, names, [None] * len(names), None, None, None, [], None, list(urls))
    paper = lambda key, title, authors, year, journal=None, book=None, ee=(): (key, "article" if journal else "inproceedings", None, "2026-08-31", title, authors, [None] * len(authors), year, journal, book, list(ee), True, [])
    title = "A long enough title about repeated publications"
    rows = [person("a", ["Ann Ash", "A. Ash"], urls=["https://orcid.org/1"]), person("b", ["Bo Bell 0001"]), person("c", ["Bo Bell"], "disambiguation")]
    rows += [paper("journals/x/1", title, ["Ann Ash", "Bo Bell 0001"], 2020, "X", ee=["https://doi.org/10.1000/1"]), paper("journals/corr/1", title.upper(), ["A. Ash", "Bo Bell"], 2019, "CoRR"), paper("conf/y/1", "Short", ["Bo Bell 0001", "Zed"], 2021, book="Y")]
    return spark.createDataFrame(rows, RAW)


def test_serving(spark):
    _, t, failed = serving.build(world(spark))
    assert not failed
    pubs = {r["key"]: r for r in t["pubs"].collect()}
    assert pubs["journals/x/1"]["has_twin"] and pubs["journals/corr/1"]["is_preprint"] and not pubs["conf/y/1"]["has_twin"]
    assert pubs["journals/x/1"]["doi_prefix"] == "10.1000" and pubs["conf/y/1"]["sid"] == "conf/y" and pubs["conf/y/1"]["n_unidentified"] == 0 and pubs["journals/corr/1"]["n_unidentified"] == 1
    assert pubs["journals/x/1"]["alphabetical"] and not pubs["conf/y/1"]["alphabetical"] is None
    kinds = {r["name"]: r["page_kind"] for r in t["persons"].collect()}
    assert kinds == {"Ann Ash": "regular", "Bo Bell 0001": "numbered", "Bo Bell": "disambiguation"}
    assert {r["person_id"] for r in t["persons"].collect()} == {1, 2, 3} and {r["pid"] for r in t["pubs"].collect()} == {1, 2, 3}
    assert {r["n_pubs"] for r in t["person_stats"].collect()} == {1, 2} and {r["link_host"] for r in t["pubs"].collect()} == {"doi.org", None}
    words = {r["word"] for r in t["word_year"].collect()}
    assert "about" in words and "repeated" in words and "the" not in words and "a" not in words
    assert t["slots"].count() == 6 and t["slots"].filter("on_bin").count() == 1
    papers = {r["papers"] for r in t["career"].collect()}
    assert papers == {1, 2} and {r["n_coauthors"] for r in t["person_degree"].collect()} == {1}


def test_reports(spark, tmp_path):
    (tmp_path / "r.txt").write_text(REPORT)
    got = [(r["title"], r["row"], r["cells"]) for r in files.report_sections(spark, str(tmp_path / "r.txt")).collect()]
    assert got == [("sizes", 0, ["name", "n", "share"]), ("sizes", 1, ["a b", "1,234", "5.5%"]), ("sizes", 2, ["c", "2", "n/a"]), ("next", 0, ["x", "y"]), ("next", 1, ["1", "2"])]
    cells = spark.createDataFrame([("1,234",), ("5.5%",), ("n/a",)], "x string").select(files.number("x")).collect()
    assert [r[0] for r in cells] == [1234.0, 5.5, None]


def test_tsv_and_communities(spark, tmp_path):
    p = tmp_path / "edges.tsv.gz"
    p.write_bytes(gzip.compress(b"# Nodes: 3 Edges: 2\n") + gzip.compress(b"1\t2\t5\n1\t3\t1\n"))
    rows = files.read_checked(spark, str(p), "u long, v long, papers long")
    assert sorted(map(tuple, rows.collect())) == [(1, 2, 5), (1, 3, 1)]
    files.write_communities(spark.createDataFrame([("a", i) for i in (3, 1, 2)] + [("b", 9)], "community string, node long"), str(tmp_path / "c"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["1\t2\t3"]
    files.write_tsv(rows, str(tmp_path / "t"))
    assert files.read_tsv(spark, str(tmp_path / "t"), "u long, v long, papers long").count() == 2
    text = spark.createDataFrame([('{"b":[1],"a":[0,2]}',)], "x string").select(files.inverted_text("x")).first()[0]
    assert text == "a b a"


def test_rebuild(spark, tmp_path):
    seen = []
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    for n in (3, 4):
        spark.range(n).withColumn("x", F.lit(n)).coalesce(1).write.mode("append").parquet(source)
        on_new_snapshot(spark, source, "id long, x int", mark, lambda df, g: seen.append((g, df.count()))).awaitTermination()
    assert seen == [(0, 3), (1, 4)]


def test_versions(spark, tmp_path):
    """A build becomes current when it is whole; the same snapshot isn't built again; readers take up the next one."""
    from tessera.sources import storage
    from tessera.streaming.rebuild import Reader, follow_snapshots

    raw, root, mark = str(tmp_path / "raw"), str(tmp_path / "root"), str(tmp_path / "mark")
    reader = Reader(spark, root)
    assert reader.fresh() == {}
    seen = []
    for _ in range(2):
        world(spark).coalesce(1).write.mode("append").parquet(raw)
        follow_snapshots(spark, raw, RAW, mark, root).awaitTermination()
        seen.append((reader.fresh()["slots"].count(), reader.generation))
    assert [g for _, g in seen] == [1, 2] and seen[1][0] > seen[0][0]
    folder, _, failed = serving.build(spark.read.schema(RAW).parquet(raw), root)
    assert storage.current(spark, root) == (folder, 2) and not failed
    assert [e.name for e in storage.listed(spark, root) if e.is_folder] == [folder.rsplit("/", 1)[-1]]
    assert storage.read_json(spark, f"{folder}/_meta.json")["last_full_year"] == 2025
    from tessera.plans import status

    now = status.status(spark, root)
    assert (now["state"], now["generation"], now["meta"]["records"]) == ("ready", 2, 12) and all(status.health(spark, root).values())
    assert status.status(spark, str(tmp_path / "nothing")) == {"state": "empty", "building": []} and not any(status.health(spark, str(tmp_path / "nothing")).values())
    with_half = f"{root}/serve-x.building"
    spark.range(1).write.parquet(with_half)
    assert storage.newest(spark, root, "serve-") == storage.status(spark, folder).path
    assert storage.clean(spark, root, "serve-") == ["serve-x.building"]


def test_storage(spark, tmp_path):
    from tessera.sources import storage

    path = str(tmp_path / "x.json")
    for v in ({"b": 1, "a": [1.5, None]}, {"b": 2}):
        storage.write_json(spark, path, v)
        assert storage.read_json(spark, path) == v
    assert storage.read_json(spark, str(tmp_path / "none")) is None and storage.listed(spark, str(tmp_path / "none")) == []
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(2).write.parquet(str(tmp_path / "b"))
    import pytest

    with pytest.raises(FileExistsError):
        storage.move(spark, str(tmp_path / "a"), str(tmp_path / "b"))


def test_snapshots(spark, tmp_path):
    """Manifest, files with different columns, batches that are taken up again, abstracts, arrays, logs, catalogs."""
    import json

    import numpy as np

    from tessera.functions.portable import tokens
    from tessera.operators import dense
    from tessera.sources import snapshots, storage

    (tmp_path / "m.json").write_text(json.dumps({"date": "2026-01-01", "files": [{"url": "s/1", "records": 3, "bytes": 10}, {"url": "s/2", "records": 1, "bytes": 5}]}))
    assert [tuple(r) for r in snapshots.manifest(spark, str(tmp_path / "m.json")).collect()] == [("2026-01-01", "s/1", 3, 10), ("2026-01-01", "s/2", 1, 5)]
    words = lambda n: json.dumps({f"w{i}": [i] for i in range(n)})
    spark.createDataFrame([("W1", "https://doi.org/10.1/A", words(25), "t"), ("W2", None, words(25), "t")], "id string, doi string, abstract_inverted_index string, title string").coalesce(1).write.parquet(str(tmp_path / "w1"))
    spark.createDataFrame([("W3", "https://doi.org/10.1/b", words(5), 7), ("W0", "https://doi.org/10.1/a", words(30), 7)], "id string, doi string, abstract_inverted_index string, cited_by_count int").coalesce(1).write.parquet(str(tmp_path / "w2"))
    files = [str(tmp_path / "w1"), str(tmp_path / "w2")]
    assert snapshots.read_by_name(spark, *files).count() == 4
    wanted, out = spark.createDataFrame([("10.1/a",), ("10.1/B",)], "doi string"), str(tmp_path / "parts")
    first = snapshots.fetch(spark, files, wanted, out, batch=1, most=1)
    assert (first["batches_done"], first["complete"], first["works_kept"]) == (1, False, 1)
    stamp = storage.status(spark, f"{out}/part-0000").modified
    last = snapshots.fetch(spark, files, wanted, out, batch=1)
    assert (last["batches_done"], last["complete"], last["works_kept"]) == (2, True, 3) and storage.status(spark, f"{out}/part-0000").modified == stamp
    works = spark.read.parquet(f"{out}/part-0000", f"{out}/part-0001")
    assert [(r["doi"], r["id"], r["abstract"].split(" ")[29]) for r in snapshots.long_abstracts(works).collect()] == [("10.1/a", "W0", "w29")]
    assert snapshots.from_arrays(spark, a=np.arange(3), b=np.array([0.5, 1, 2])).agg({"a": "sum", "b": "sum"}).first()[0] is not None
    texts = spark.createDataFrame([(i, f"word text{'abc'[i % 3]}") for i in range(7)], "id long, text string")
    encode = lambda c: dense.encode(F.array_distinct(tokens(c)))
    target = str(tmp_path / "vectors")
    assert snapshots.encode_missing(texts.filter("id < 3"), encode, target, 2) == 3
    assert snapshots.encode_missing(texts, encode, target, 2) == 4 and spark.read.parquet(target).select("id").distinct().count() == 7
    log = spark.createDataFrame([("2026-01-01 10:00:00", 1), ("2026-01-03 10:00:00", 2), ("2026-01-04 00:00:01", 3)], "t string, n int").select(F.to_timestamp("t").alias("ts"), "n")
    snapshots.append_log(log, str(tmp_path / "log"))
    assert sorted(r["n"] for r in snapshots.read_log(spark, str(tmp_path / "log"), "ts timestamp, n int", 2, "2026-01-04").collect()) == [2, 3]
    assert snapshots.attach(spark, out, "x_") == ["x_part_0000", "x_part_0001"]


def test_publish(spark, tmp_path):
    import hashlib

    import pytest

    from tessera.sources import publish, storage

    root, stats = str(tmp_path / "root"), {"snapshot": "a", "nodes": 3, "edges": 2}
    table = spark.createDataFrame([(1, 2)], "u long, v long").coalesce(1)
    with pytest.raises(ValueError):
        publish.publish({"edges": table}, root, "graph-1", stats, stats | {"edges": 5})
    assert storage.current(spark, root) is None
    for n in (1, 2):
        manifest = publish.publish({"edges": table, "lines": table}, root, f"graph-{n}", stats, stats, lambda d, p: files.write_tsv(d, p))
        assert storage.current(spark, root) == (f"{root}/graph-{n}", n)
    assert [e.name for e in storage.listed(spark, root) if e.is_folder] == ["graph-2"]
    for f in manifest["files"]:
        raw = (tmp_path / "root" / "graph-2" / f["name"]).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (f["bytes"], f["sha256"])
    assert len(manifest["files"]) == 2


def test_reports_read(spark, tmp_path):
    """Readers of whole reports, notes between tables, and the comparison of published with computed values."""
    text = "[ 0.1 min] start\n=== Network overview (x)\ngraph  nodes  pct\n-----  -----  ---\nall  1,200  5.5\nnone  7  n/a\n\n=== Distances between authors\nhops  pct\n----  ---\n1  0.5\n\nmean distance 5.63, median 6, 90th percentile 7\n=== Power-law fits (d)\ndistribution  xmin  alpha\n------------  ----  -----\npapers  13  2.14 \u00b1 0.01\n"
    (tmp_path / "r.txt").write_text(text)
    report = files.network_report(spark, str(tmp_path / "r.txt"))
    assert {(r["key"], r["column"]): r["number"] for r in report["overview"].collect()} == {("all", "nodes"): 1200, ("all", "pct"): 5.5, ("none", "nodes"): 7, ("none", "pct"): None}
    assert [tuple(r) for r in report["distances"].collect()] == [(5.63, 6.0, 7.0)] and report["weights"].count() == 0
    assert [tuple(r) for r in files.power_law_report(spark, str(tmp_path / "r.txt")).collect()] == [("papers", 13.0, 2.14, 0.01)]
    one = lambda rows: spark.createDataFrame(rows, "name string, key string, value double")
    got = {r["name"]: (r["values"], r["missing"], r["ok"]) for r in files.compared(one([("a", "1", 2.0), ("a", "2", 3.0), ("b", "1", 1.0), ("c", "x", None)]), one([("a", "1", 2.0005), ("a", "2", 3.0)]), 1e-3).collect()}
    assert got == {"a": (2, 0, True), "b": (1, 1, False)}


def test_single_file(spark, tmp_path):
    df = spark.range(4).select("id", (F.col("id") * 2).alias("d")).repartitionByRange(2, "id")
    files.write_single_tsv(df, str(tmp_path / "g.tsv.gz"), ["Nodes: 4 Edges: 4", "u v"])
    assert gzip.decompress((tmp_path / "g.tsv.gz").read_bytes()).decode().splitlines() == ["# Nodes: 4 Edges: 4", "# u v", "0\t0", "1\t2", "2\t4", "3\t6"]
    assert files.read_checked(spark, str(tmp_path / "g.tsv.gz"), "u long, v long").count() == 4


def test_texts_stream(spark, tmp_path):
    from tessera.streaming.rebuild import follow_texts

    source, mark, target = (str(tmp_path / n) for n in ("in", "mark", "out"))
    for n in (2, 3):
        spark.range(n).select((F.col("id") + 10 * n).alias("id"), F.lit("x").alias("text")).coalesce(1).write.mode("append").parquet(source)
        follow_texts(spark, source, "id long, text string", mark, target, lambda c: F.array(F.lit(1.0))).awaitTermination()
    assert spark.read.parquet(target).count() == 5


def test_warm(spark, sf):
    from tessera.plans import status
    from tessera.plans.registry import all_queries

    assert set(status.WARM) <= set(all_queries())
    got = status.warm(spark, sf, ("overview", "no such query"))
    assert got["overview"] > 0 and got["no such query"] == -1.0
