"""Each stage of the pipeline against slow versions."""

from collections import Counter, defaultdict

import corpus_pipeline as cp
from tests.llm import brute
from tests.llm.test_near_copies import groups as all_pairs


def rows(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])


def test_stages(spark, hard, hard_dir):
    docs = rows(hard)
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "near-duplicates", "decontamination", "mixing", "sharding"]

    kept = stages["toxicity"](spark, hard, hard_dir)
    assert kept.columns == hard.columns and not Counter(map(key, rows(kept))) - Counter(map(key, docs))

    one = rows(stages["near-duplicates"](spark, hard, hard_dir))
    groups = defaultdict(list)
    for r, g in zip(docs, all_pairs([r["text"] for r in docs]), strict=True):
        groups[g].append(r["doc_id"])
    assert not Counter(map(key, one)) - Counter(map(key, docs))
    assert Counter(r["doc_id"] for r in one) == Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())

    items = [tuple(r) for r in spark.read.parquet(f"{hard_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = rows(stages["decontamination"](spark, hard, hard_dir))
    hits = brute.decontaminate([(r["doc_id"], r["text"]) for r in docs], items)
    assert Counter(map(key, clean)) == Counter(key(r) for r, h in zip(docs, hits, strict=True) if not h[-1])

    mixed = rows(stages["mixing"](spark, hard, hard_dir))
    sizes, got = defaultdict(int), defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len(brute.words(r["text"]))
    for r in mixed:
        got[r["source"]] += len(brute.words(r["text"]))
    for s, goal in brute.targets(dict(sizes)).items():
        assert abs(got[s] - goal) <= max(len(brute.words(r["text"])) for r in docs if r["source"] == s)

    dealt = rows(stages["sharding"](spark, hard, hard_dir))
    assert Counter(map(key, dealt)) == Counter(map(key, docs)) and {r["shard"] for r in dealt} <= set(range(8))


def test_run(spark, hard_dir, empty_dir):
    out = rows(cp.run(spark, hard_dir))
    assert out and {"shard", "slot"} <= set(out[0])
    assert rows(cp.run(spark, empty_dir)) == []


def test_spans(spark, hard, hard_dir):
    """Cutting the hit words out leaves a text without hits on what was hit, and others untouched."""
    from tessera.llm import decontaminate

    bench = spark.read.parquet(f"{hard_dir}/benchmark.parquet")
    scanned = decontaminate.scan(hard, bench)
    before = {(r["doc_id"], r["text"]) for r in scanned.filter("size(hits.items) = 0").collect()}
    after = rows(decontaminate.remove_spans(scanned))
    assert before <= {(r["doc_id"], r["text"]) for r in after}
    assert sorted(sum(len(x) for x in [r["text"] or ""]) for r in after) <= sorted(len(r["text"] or "") for r in rows(hard))
    blocks = decontaminate.scan(hard, bench, max_windows=40)
    pick = lambda df: Counter((r["doc_id"], r["text"], str(r["hits"])) for r in df.collect())
    assert pick(blocks) == pick(scanned)
