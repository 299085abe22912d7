import random

import numpy as np
import xxhash
from conftest import MEDIUM

from churnlens.llm import simhash
from churnlens.operators.components import components
from llm.cases import awkward, none


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    """Component by union of all pairs within two bits."""
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in u}


def check(docs, got):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"] or "") for r in rows]
    roots, named = brute(fps), {}
    for r, f in zip(rows, fps, strict=True):
        if r["doc_id"] is not None:
            named[roots[f]] = min(named.get(roots[f], r["doc_id"]), r["doc_id"])
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted(((r["doc_id"], f"{f:016x}", named.get(roots[f])) for r, f in zip(rows, fps, strict=True)), key=key)
    assert sorted((tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()), key=key) == want


def test_all_links_are_found(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    check(docs, simhash.near_duplicates(docs))


def test_awkward_rows(spark):
    check(awkward(spark), simhash.near_duplicates(awkward(spark)))
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_golay_code_is_perfect_and_keys_meet():
    _, _, errors = simhash._code()
    assert (errors[1:] > 0).all()
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 4000)
    w = v ^ (1 << rng.integers(0, 23, 4000)) ^ (1 << rng.integers(0, 23, 4000))
    a, b = simhash.golay_keys(v), simhash.golay_keys(w)
    assert {int((r >= 0).sum()) for r in a} == {1, 6}
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


def test_large_groups_link_without_pairs(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        x = rng.choice(sorted(fps)[-40:])
        fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r["node"] & (2**64 - 1): r["root"] for r in components(simhash.near_pairs(df)).collect()}
    got, want = {}, {}
    for f, r in brute(fps).items():
        got.setdefault(roots.get(f, f"alone{f}"), []).append(f)
        want.setdefault(r, []).append(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, want.values())) > 300


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 7)]
    roots = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert roots == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)}
