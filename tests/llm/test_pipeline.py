import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from conftest import MEDIUM

from churnlens.llm import mixing, near_copies, simhash
from churnlens.sources import staging
from llm.cases import CLASHES, TEXTS, awkward, clashing, none


def sets(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def planted(n=40, seed=1):
    """Documents with exact copies, near copies of a few replaced words, and a large group of near copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    rows, i = [], 0
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 300))]
        for c in range(300 if g == 0 else rng.randrange(1, 5)):
            w = list(base)
            if c and rng.random() < 0.7:
                for _ in range(max(1, len(w) // 100)):
                    w[rng.randrange(len(w))] = rng.choice(vocabulary) + "q"
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_one_of_each_near_copy_stays(spark):
    rows = planted()
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own = {i: sets(t) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(own)
    for a in ids:
        for b in ids[:a]:
            if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    classes = {}
    for i in ids:
        classes.setdefault(find(i), []).append(i)
    kept = Counter(find(r["doc_id"]) for r in got)
    assert kept.keys() == classes.keys() and all(n == 1 for n in kept.values())
    assert {r["doc_id"] for r in got} == set(classes)


def star(n, seed=3, words=260):
    """A text and n copies of it at 0.8 to 0.85 of its shingles, nearly all of them farther than that from one another."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    own, out = sets(" ".join(base)), [" ".join(base)]
    while len(out) <= n:
        w = list(base)
        for i in rng.sample(range(words), 5):
            w[i] = f"z{rng.randrange(10**6)}"
        t = sets(" ".join(w))
        if 0.8 <= len(own & t) / len(own | t) <= 0.85:
            out.append(" ".join(w))
    return out


def test_copies_near_their_base_alone_are_one_class(spark):
    rows = [(g * 1000 + i, t) for g in range(2) for i, t in enumerate(star(300 - 150 * g, seed=g))]
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1000]


def test_cut_and_extended_copies_are_found(spark):
    rng, rows = random.Random(5), []
    for g in range(60):
        base = [f"v{rng.randrange(3000)}" for _ in range(264)]
        # a block cut from or put to the end, by as much as 0.8 allows
        copy = base[: 264 - 52 + g % 9] if g % 2 else base + [f"y{rng.randrange(10**6)}" for _ in range(65 - g % 9)]
        assert len(sets(" ".join(base)) & sets(" ".join(copy))) >= 0.8 * len(sets(" ".join(base)) | sets(" ".join(copy)))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [2 * g for g in range(60)]


def test_strangers_and_awkward_rows(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{random.Random(i * 99 + j).randrange(5000)}" for j in range(120))) for i in range(200)], "doc_id long, text string")
    assert near_copies.one_of_each(docs).count() == 200
    got = near_copies.one_of_each(awkward(spark)).collect()
    texts = Counter(r["text"] for r in got)
    assert texts["one"] == 1 and sum(n for t, n in texts.items() if not (t or "").strip()) <= 2
    assert set(TEXTS) - {"", None, " \t\n\x0b\f\r "} <= set(texts)
    assert near_copies.one_of_each(none(spark)).count() == 0


def test_mixed_rows_are_those_that_mix_takes(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix(docs).collect() if r["size"]}
    got = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert got == Counter({i: n for i, n in taken.items() if n})
    assert mixing.mixed(none(spark)).count() == 0 and mixing.mixed(awkward(spark)).count() > 0


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, MEDIUM).write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, before, now))
        if name != "packing":
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
    kept = {r["doc_id"] for r in seen[0][2].collect()}
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1 and words[i] >= 20)
    assert sum(i not in kept for i, q in labels.items() if q == 0) >= 0.9 * sum(q == 0 for q in labels.values())
    text = {r["doc_id"]: r["text"] for r in seen[2][2].collect()}
    assert len(text) == seen[2][1].count() and not any(re.search(r"[\w.]+@[\w-]+\.\w+|\+\d \(\d{3}\)", t) for t in text.values())
    packed = seen[4][2].selectExpr("sum(length) n", "count(distinct sequence_id) s").first()
    assert packed["n"] > 0.97 * packed["s"] * 2048


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    for i, docs in enumerate((awkward(spark), none(spark))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, MEDIUM).write.parquet(f"{tmp_path}/{i}{name}")
            docs = spark.read.parquet(f"{tmp_path}/{i}{name}")


def test_users_columns_come_back_untouched(spark, tmp_path):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = clashing(spark)
        got = stage(spark, docs, MEDIUM)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES), name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing(spark), MEDIUM).count() > 0


def test_quality_rules_need_no_count_of_characters(spark):
    got = corpus_pipeline.quality_rules(spark, clashing(spark).drop("n_chars"), MEDIUM)
    assert got.count() == 12 and "n_chars" not in got.columns


def test_a_crowd_of_near_copies_is_one_class(spark):
    """5,000 texts within three replaced words of one another's base, among strangers that share a passage with it."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 5001):
        w = list(base)
        for j in rng.sample(range(150), rng.randrange(1, 4)):
            w[j] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    strangers = [(10_000 + i, " ".join(base[:60] + [f"s{rng.randrange(10**7)}" for _ in range(90)])) for i in range(500)]
    got = {r["doc_id"] for r in near_copies.one_of_each(spark.createDataFrame(rows + strangers, "doc_id long, text string")).collect()}
    own = sets(rows[0][1])
    far = {i for i, t in rows if len(own & sets(t)) < 0.8 * len(own | sets(t))}
    assert 0 in got and {i for i, _ in strangers} <= got and len(got) == 501 and not far


def test_near_copies_of_long_texts_stage_less_than_the_texts(spark, tmp_path, monkeypatch):
    rng, rows = random.Random(7), []
    for g in range(100):
        w = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(3000)]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join([*w[:-100], *(f"y{g}x{i}" for i in range(100))]))]
    folders = iter(range(1000))
    monkeypatch.setattr(staging, "scratch", lambda _: f"{tmp_path}/{next(folders)}")
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [2 * g for g in range(100)]
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1.2 * sum(len(t) for _, t in rows)


def test_maps_of_unlike_lengths_never_rule_out_similar_sets(spark):
    rng, sets, pairs = random.Random(9), [], []
    for n in (3, 480, 511, 512, 513, 600, 1024, 1100, 3000):
        base = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
        # by as many of either as 0.8 allows, and strangers of the same size
        sets += [base, base + [rng.randrange(-(2**63), 2**63) for _ in range(n // 4)], base[: -(-4 * n // 5)], [rng.randrange(-(2**63), 2**63) for _ in range(n)]]
        at = len(sets) - 4
        pairs += [(at, at + 1), (at, at + 2), (at, at + 3)]
    arrays = [near_copies.np.array(sorted(s), near_copies.np.int64) for s in sets]
    maps = spark.createDataFrame([(i, len(s), near_copies.parity(s).tolist()) for i, s in enumerate(arrays)], "id long, size int, bits array<long>")
    got = {(r["a"], r["b"]) for r in near_copies._unlike_left_out(spark.createDataFrame(pairs, "a long, b long"), maps, 0.8).collect()}
    assert {p for p in pairs if p[1] % 4 != 3} <= got
    assert not {p for p in pairs if p[1] % 4 == 3 and len(sets[p[0]]) > 400} & got


@pytest.mark.parametrize("rows", [0, 10**6])
def test_rows_are_met_beyond_what_is_broadcast(spark, rows):
    rng = random.Random(13)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(3000)] + [0, -1, 2**63 - 1, -(2**63)]
    held = [*keys[::2], *(rng.randrange(-(2**63), 2**63) for _ in range(3000)), None, 0, 0]
    df = spark.createDataFrame(list(enumerate(held)), "block long, k long")
    table = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "of long, at long")
    got = near_copies.among(df, "k", table.select(near_copies.F.col("of").alias("k")), rows)
    assert sorted(got.columns) == ["block", "k"] and sorted(r["block"] for r in got.collect()) == [i for i, k in enumerate(held) if k in set(keys)]
    at = {k: i for i, k in enumerate(keys)}
    assert sorted((r["block"], r["k"], r["at"]) for r in near_copies.beside(df, "k", table, "of", rows).fillna(-7, ["k", "at"]).collect()) == sorted((i, -7 if k is None else k, at.get(k, -7)) for i, k in enumerate(held))


def test_classes_are_the_same_beyond_what_is_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(planted(12, seed=4) + [(5, "same id and text " * 9)] * 3, "doc_id long, text string")
    small = sorted(map(tuple, near_copies.one_of_each(docs).collect()))
    monkeypatch.setattr(near_copies, "BROADCAST_KEYS", 0)
    for f in (near_copies.among, near_copies.beside):
        monkeypatch.setattr(f, "__defaults__", (0,))
    assert sorted(map(tuple, near_copies.one_of_each(docs).collect())) == small


def test_near_fingerprints_are_one_class_whatever_their_shingles(spark):
    """Pairs within two bits whose five-word shingles are less alike than 0.8: fingerprints alone tell that they are near."""
    rng, rows = random.Random(17), []
    while len(rows) < 20:
        w = [f"v{rng.randrange(3000)}" for _ in range(150)]
        other = list(w)
        for i in rng.sample(range(0, 150, 6), 5):
            other[i] = f"z{rng.randrange(10**6)}"
        a, b = " ".join(w), " ".join(other)
        share = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
        if share < 0.8 and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 2:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    strangers = [(100 + i, " ".join(f"v{rng.randrange(3000)}" for _ in range(150))) for i in range(50)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows + strangers, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in got) == [*range(0, 20, 2), *range(100, 150)]
