"""Every query against a slow version, on the hard rows and on the smallest table."""

from collections import Counter, defaultdict

import pytest

from tessera.llm.queries import QUERIES
from tests.llm import brute


def table(spark, d, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{d}/{name}.parquet").select(*columns).collect()]


def run(spark, d, prefix):
    return [tuple(r) for r in next(f for n, f in QUERIES.items() if n.startswith(prefix))(spark, d).collect()]


@pytest.fixture(params=["hard", "small"])
def where(request, hard_dir, sf):
    return hard_dir if request.param == "hard" else sf


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_decontaminate(spark, where):
    docs, items = table(spark, where, "documents", "doc_id", "text"), table(spark, where, "benchmark", "item_id", "text")
    assert Counter(run(spark, where, "op4_")) == Counter(brute.decontaminate(docs, items))


def test_substring_dedup(spark, where):
    assert Counter(run(spark, where, "op9_")) == Counter(brute.substring_dedup(table(spark, where, "documents", "doc_id", "text")))


def test_simhash(spark, where):
    assert Counter(run(spark, where, "op10_")) == Counter(brute.simhash(table(spark, where, "documents", "doc_id", "text")))


def test_mixing(spark, where):
    docs = table(spark, where, "documents", "doc_id", "source", "text")
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += len(brute.words(t))
    goal = brute.targets(dict(sizes))
    got = run(spark, where, "op6_")
    assert len(got) == len(docs)
    by = Counter((d, len(brute.words(t)), s) for d, s, t in docs)
    source_of = {}
    for d, size, total, target, taken in got:
        match = [s for (i, n, s), c in by.items() if c > 0 and i == d and n == size and sizes[s] == total and abs(goal[s] - target) < 1e-6 * max(1, target)]
        assert match and taken in (0, size, 2 * size)
        by[(d, size, match[0])] -= 1
        source_of.setdefault(match[0], []).append((size, taken))
    for s, rows in source_of.items():
        assert abs(sum(t for _, t in rows) - goal[s]) <= max(n for n, _ in rows)
    assert sorted(map(str, got)) == sorted(map(str, run(spark, where, "op6_")))


def test_sharding(spark, where):
    docs = table(spark, where, "documents", "doc_id", "text")
    got = run(spark, where, "op8_")
    assert Counter(r[:3] for r in got) == Counter((d, len((t or "").encode()) + 1, brute.crc(t)) for d, t in docs)
    shards = defaultdict(list)
    for _, size, _, law, shard, slot, grown in got:
        assert law == "bytes" and 0 <= shard < 8 and grown is None
        shards[shard].append((slot, size))
    total, largest = sum(r[1] for r in got), max(r[1] for r in got)
    for rows in shards.values():
        assert sorted(s for s, _ in rows) == list(range(len(rows)))
        assert abs(sum(n for _, n in rows) - total / 8) <= largest + total / 8 * 1e-3


def test_toxicity(spark, where):
    import zlib

    got = run(spark, where, "op5_")
    docs = table(spark, where, "documents", "doc_id")
    assert Counter(r[0] for r in got) == Counter(d for (d,) in docs)
    for d, held, score, predicted in got:
        assert held == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= score <= 1 and predicted == int(score >= 0.3)


def test_warc(spark, where):
    pages = table(spark, where, "pages", "page_id", "html")
    first, want = {}, []
    for page, html in pages:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    for page, html in pages:
        data = (html or "").encode()
        to = first.get(html or "") if len(data) >= 100 else None
        to = None if to == page else to
        want.append((page, len(data), brute.sha(data), "response" if to is None else "revisit", to))
    assert Counter(run(spark, where, "op2_")) == Counter(want)


def test_warc_pushdown(spark, where):
    """Predicates on headers reach the reader, and payloads that are not asked for are not read."""
    from tessera.llm import warc
    from tessera.plans.staging import new_path

    path = new_path(spark, "archive")
    warc.write(spark.read.parquet(f"{where}/pages.parquet").select("page_id", "url", "html"), path)
    one = warc.read(spark, path).filter("record_type = 'response' AND page_id = '5'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "= response" not in plan and "= 5" not in plan
    assert [r["page_id"] for r in one.collect()] == ["5"]
    assert all(r["payload"] is None for r in warc.read(spark, path, payload=False).collect())


HARD_PII = [
    "a@b.c%d@e.f x..y@z.co-m.uk. @no.pe a@b a@@b.c é@ü.de mail:ü.x@y.zz",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.0003.255 1.2.3 9.9.9.9é 1.1.1.1.",
    "4111 1111 1111 1111 4111-1111-1111-1111, 4111  1111 41111111111111112 378282246310005 0000000000000000",
    "+1 (555) 010-9999 +1+2 +12 34 56 78 90 12 34 56 +4930 12345678- +1 2 é😀+33 1 23 45 67 89",
    "call 555-123-4567 now; order 555-123-4567; me (at) site (dot) com; card 4111.1111.1111.1111; fe80:0:0:0:1:2:3:4",
    "5" * 5000, "a" * 3_000 + "@", "a@" * 3000, "+" * 2000 + "1", "1.2.3.4 " * 800, None, "",
    "é1.2.3.4 4111 1111 1111 1111, x@y.zz " * 5000, "12 34  " * 20000, "4111 1111 1111 1111  4111 1111 1111 1111 1 4111111111111111-",
]


def test_pii(spark, where, hard_dir):
    from tessera.llm import pii

    docs = table(spark, where, "documents", "doc_id", "text")
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)] + [(1000 + i, t) for i, t in enumerate(HARD_PII)], "id long, text string")
    texts = {r["id"]: r["text"] for r in frame.collect()}
    for r in pii.spans(frame).collect():
        want = brute.pii(texts[r["id"]])
        base = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        assert base == [(k, b, e) for k, name in enumerate(pii.STRICT) for b, e in sorted(want[name])], texts[r["id"]][:80]
        everything = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert set(base) <= set(everything) and everything == sorted(everything)
    got = run(spark, where, "op3_")
    by = Counter()
    for d, t in docs:
        f = brute.pii(t)
        by[(d, *[len(f[k]) for k in pii.STRICT], brute.sha(",".join(f"{k}:{b}:{e}" for k in pii.STRICT for b, e in sorted(f[k]))))] += 1
    assert Counter(r[:6] for r in got) == by


def test_pii_learns(spark):
    """Loose candidates with cues are taken, those with counter-evidence are left; redaction covers them."""
    from pyspark.sql import functions as F

    from tessera.llm import pii

    texts = [(i, f"x{i} please call 555-123-{1000 + i} today, or mail a{i}@b.com") for i in range(60)] + [(100 + i, f"order 155-000-{1000 + i}x7 page") for i in range(60)]
    frame = spark.createDataFrame(texts, "id long, text string")
    rows = {r["id"]: r["spans"] for r in pii.spans(frame).collect()}
    assert all(len(rows[i]) == 2 for i in range(60)) and not any(rows[100 + i] for i in range(60))
    red = pii.spans(frame).join(frame, "id").withColumn("r", pii.redact()).filter("id = 3").first()["r"]
    assert red == "x3 please call <phone> today, or mail <email>"


def test_licenses(spark, where):
    from tessera.llm import licenses

    docs = table(spark, where, "documents", "doc_id", "text")
    extra = [t for _, t in licenses.TEMPLATES] + ["x\n" + licenses.TEMPLATES[3][1].replace(". ", ".\n") + "\n\nmore", "Released under MIT License.", licenses.TEMPLATES[5][1] * 2, "all rights reserved all rights reserved"]
    extra += ["Foo is great. Released under the MIT License. Enjoy.", "# Licensed under the\n# Apache License,\n# Version 2.0.\ncode()", "code\n\n" + licenses.TEMPLATES[3][1] + "\n\n" + next(t for n, t in licenses.TEMPLATES if "as is" in t.lower() and n == "MIT") + "\n\nmore code"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in docs] + extra)], "id long, text string")
    found = licenses.scan(frame).collect()
    assert all(found[-k]["licenses"] for k in (1, 2, 3)) and len(found) == len(docs) + len(extra)
    for r in found:
        want = brute.licenses(r["text"], licenses.TEMPLATES)
        assert {x["license"]: round(x["dice"], 9) for x in r["licenses"]} == {k: round(v, 9) for k, v in want.items()}, r["text"][:80]
