import zlib

import numpy as np
import public_tokenizers
from conftest import MEDIUM
from tokenizers import Tokenizer

from churnlens.llm import packing
from llm.cases import awkward, none

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, got):
    tok = Tokenizer.from_file(PATH)
    ids = {}
    for r in docs.collect():
        v = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(r["doc_id"], []).append(v)
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert pieces.keys() == ids.keys()
    for k, vs in ids.items():
        want = sorted((s, n, zlib.crc32(v[s : s + n].tobytes()), len(v)) for v in vs for s, n in zip(np.cumsum([0, *packing.cuts(len(v))]).tolist(), packing.cuts(len(v)), strict=False))
        assert sorted(pieces[k]) == want
        assert all(sum(packing.cuts(len(v))) == len(v) for v in vs)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return sum(r["length"] for r in got) / (len(bins) * packing.CAPACITY)


def test_pieces_are_the_tokenizers_ids_and_sequences_nearly_full(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert check(docs, packing.pack(docs, PATH).collect()) > 0.99


def test_awkward_rows(spark):
    check(awkward(spark), packing.pack(awkward(spark), PATH).collect())
    assert packing.pack(none(spark), PATH).count() == 0


def test_last_bins_are_filled():
    sizes = np.array([1, 2, 3] * 900 + [1000, 700, 120])
    bins = packing.fill(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert [sum(sizes[b]) for b in bins[:-1]] == [2048] * (len(bins) - 1)
