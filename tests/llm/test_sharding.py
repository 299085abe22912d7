import zlib
from collections import Counter

from conftest import MEDIUM

from churnlens.llm import sharding
from llm.cases import awkward, none


def check(docs, shards=16):
    rows = sharding.shard_documents(docs, shards).collect()
    texts = [r["text"] or "" for r in docs.select("text").collect()]
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts)
    loads = Counter(r["shard"] for r in rows)
    sizes = [loads[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(loads) <= set(range(shards))
    for s in loads:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(loads[s]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    return rows


def test_equal_texts_stay_together(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = check(docs)
    by = {}
    for r in rows:
        by.setdefault((r["size"], r["text_crc32"]), Counter())[r["shard"]] += 1
    groups = [c for c in by.values() if sum(c.values()) > 1]
    assert len(groups) > 20 and sum(len(c) > 1 for c in groups) <= len(groups) // 50


def test_a_group_of_a_third_of_all_rows_fills_whole_shards(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2 if i % 30 < 4 else i}x") for i in range(3000)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    hot = Counter(r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot"))
    assert sum(hot.values()) == 1000 and len(hot) <= 7


def test_awkward_rows(spark):
    check(awkward(spark))
    check(awkward(spark), shards=5)
    assert sharding.shard_documents(none(spark)).count() == 0


def test_propagation_cuts_few_links(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = check(docs)
    df = spark.createDataFrame([((r["size"] << 32) | r["text_crc32"], r["shard"], r["doc_id"] % 16) for r in rows], "link long, shard int, start int")
    cut, before = sharding.edge_cut(df, "link").first(), sharding.edge_cut(df, "link", "start").first()
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if (a["size"], a["text_crc32"]) == (b["size"], b["text_crc32"])]
    assert cut["linked_pairs"] == len(pairs) and cut["cut_pairs"] == sum(a["shard"] != b["shard"] for a, b in pairs)
    assert cut["cut_pairs"] <= 0.02 * len(pairs) < before["cut_pairs"]


def test_more_parts_change_no_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 1)
    check(spark.createDataFrame([(i, f"t{i // 3}") for i in range(700)], "doc_id long, text string"))
