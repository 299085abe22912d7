"""Token alignment against a plain version over every row, awkward texts, and both ways of joining counts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL

from churnlens.llm import alignment, queries
from tests.llm import cases

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a\t b", "  two  spaces", "x\r\n y\x85z 　 b", "a▁b c", "\x00 \x1c\x1d !\x1c \x1f\n", "<|endoftext|> <s> </s><0x41>", "é" * 300, "日本語 テキスト\n\n\n  中文", "\n", "\n a", " ", "a \n b᠎\n c", "é 😀", "aaaa " * 50]


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(A, B)


def tokens(both, text):
    """Ids and ends of both sides over the whole text, or None where bytes differ."""
    if not text:
        return None
    a, b, own = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text), f" {text}".encode()
    if b"".join(both.a_bytes[i] for i in a) != own or b"".join(both.b_bytes[i] for i in b) != own:
        return None
    return a, b, np.cumsum([len(both.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(both.b_bytes[i]) for i in b]).tolist()


def plain(both, texts):
    """The contract's columns of every text, by walking both sides' bytes."""
    links, heads = [], []
    for text in texts:
        found, own, groups = tokens(both, text), Counter(), []
        if found:
            a, b, end_a, end_b = found
            owner_a = [i for i, (s, e) in enumerate(zip([0, *end_a], end_a, strict=False)) for _ in range(s, e)]
            owner_b = [i for i, (s, e) in enumerate(zip([0, *end_b], end_b, strict=False)) for _ in range(s, e)]
            own.update((a[i], b[j]) for i, j in set(zip(owner_a, owner_b, strict=True)))
            at_a, at_b = ({e: k + 1 for k, e in enumerate(end)} for end in (end_a, end_b))
            i = j = 0
            for cut in sorted(set(end_a) & set(end_b)):
                groups.append(",".join(map(str, a[i : at_a[cut]])) + "|" + ",".join(map(str, b[j : at_b[cut]])))
                i, j = at_a[cut], at_b[cut]
        links.append(own)
        heads.append((len(found[0]), len(found[1]), len(groups), own.total(), hashlib.sha256(";".join(groups).encode()).hexdigest()) if found else (0, 0, 0, 0, ""))
    counts = Counter(pair for own in links for pair in own)
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [(*head[:4], sum(t for p, t in own.items() if counts[p] == top[p[0]]), sum(t * counts[p] for p, t in own.items()), head[4]) for head, own in zip(heads, links, strict=True)]


def shown(df):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]


def test_query_equals_plain_version(spark, both):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_token_alignment(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for doc, want in zip(docs, plain(both, [d.text for d in docs]), strict=True):
        r = got[doc.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want


def test_awkward_rows(spark, both):
    docs = cases.awkward(spark)
    texts = [r.text if len(r.text or "") < 10_000 else r.text[-3000:] for r in docs.collect()] + ODD
    short = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(shown(alignment.align(short, A, B))) == sorted(plain(both, texts))
    whole = alignment.align(docs, A, B).collect()
    assert len(whole) == docs.count() and max(r.n_a for r in whole) > 30_000
    assert alignment.align(cases.none(spark), A, B).collect() == []


def test_joins_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(shown(alignment.align(docs, A, B))) == sorted(shown(alignment.align(docs, A, B, broadcast_pairs=0)))


def test_chunks_tile_texts(both):
    for text in ODD + [t for t in cases.TEXTS if t]:
        assert "".join(alignment.chunks(f" {text}")) == f" {text}"
    whole = [both.ids([f" {t}"]) for t in ODD]
    parts = [both.ids(both.part(f" {t}")) for t in ODD]
    for one, cut in zip(whole, parts, strict=True):
        assert [sum(side, []) for side in cut] == [side[0] for side in one]


def test_pointers_meet_at_common_ends():
    end_a, end_b = np.array([2, 4, 6, 9, 10]), np.array([1, 3, 5, 6, 7, 10])
    assert alignment.terminals(end_a, end_b).tolist() == [2, 2, 2, 4, 4]
    many = np.arange(1, 5000) * 2
    assert set(alignment.terminals(many, np.append(many[:-1] - 1, many[-1])).tolist()) == {len(many) - 1}
