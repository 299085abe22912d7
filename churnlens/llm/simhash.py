"""Operator 1: SimHash fingerprints, near ones found by Golay-code fuzzy hashing.

A 64-bit fingerprint has three segments of at most 23 bits, each a word of the perfect (23, 12) Golay code. A
segment's keys are the indices of the codewords to which it and its 23 one-bit neighbours decode: one key, or six.
Segments that differ in two bits or fewer have a common neighbour, hence a common key. Two errors in three segments
leave one segment without any, so fingerprints within two bits agree in that segment and share a key of the next.
Each distinct fingerprint gives up to 18 such keys. What shares a key is joined through the few bit patterns next to it and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import staged, text_of
from churnlens.operators.components import components

SEED, BITS, MAX_BITS = 42, 64, 2
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code.
GENERATOR = 0b110001110101
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority of the bits of the XXH64 of each shingle of blank-separated words, A-Z lower-cased."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    h = np.array([digest(view[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    counts = np.concatenate([np.bincount(c, minlength=256) @ BYTE_BITS for c in h.astype("<u8").view(np.uint8).reshape(-1, 8).T])
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long. Null text counts as empty, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of a word's high 12 and low 11 bits, and each syndrome's error of weight three or less."""

    def rest(v: int) -> int:
        for b in range(22, 10, -1):
            if v >> b & 1:
                v ^= GENERATOR << (b - 11)
        return v

    high = np.array([rest(v << 11) for v in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[rest(e)] = e
    return high, np.arange(1 << 11, dtype=np.int64), errors


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices of each 23-bit word and its one-bit neighbours, with -1 for repeats."""
    high, _, errors = _code()
    v = words.astype(np.int64)[:, None] ^ np.concatenate(([0], 1 << np.arange(23)))
    v ^= errors[high[v >> 11] ^ (v & 0x7FF)]
    index = np.sort(v >> 11, axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    return index


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: a segment's number and bits with each Golay key of the segment after it."""
    u, rows, keys = fps.view(np.uint64), [], []
    parts = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    for i, part in enumerate(parts):
        index = golay_keys(parts[(i + 1) % len(parts)])
        r, c = np.nonzero(index >= 0)
        rows.append(r)
        keys.append((i << 36) | (part[r] << 12) | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def near_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges a, b over distinct fingerprints (column fp) that connect exactly what links of max_bits or fewer connect.

    A key's group tells in which bits its fingerprints differ at all. Each fingerprint is then listed under itself and under
    its one-bit neighbours in the bits that differ in its groups: two fingerprints within two bits are listed together,
    others are not, and no pairs of a group are made. A list has at most 65 fingerprints; all are tied to its least.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the segments are laid out for two differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                rows, keys = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    shared = staged(keys.groupBy("key").agg(F.expr("bit_or(fp) ^ bit_and(fp)").alias("differ")).where("differ <> 0"))
    differing = keys.join(shared, "key").groupBy("fp").agg(F.bit_or("differ").alias("differ"))
    bits = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - ((i == 63) << 64)).cast("long") for i in range(BITS)))
    listed = differing.select("fp", F.explode(F.filter(bits, lambda x: x.bitwiseAND(F.col("differ")) == x)).alias("flip"))
    lists = listed.groupBy(F.expr("fp ^ flip").alias("pattern")).agg(F.array_sort(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    tied = lists.select(F.get("fps", F.lit(0)).alias("a"), F.explode(F.slice("fps", 2, BITS + 1)).alias("b"))
    return tied.where(f"bit_count(a ^ b) <= {max_bits}").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links of two bits or fewer.

    Empty and null texts have fingerprint zero and link like any other. Repeated rows are kept; of equal fingerprints
    one stands for all, so copies are never paired. A null doc_id is kept and never names a component unless nothing
    else does. An empty table gives no rows; other columns are not read.
    """
    own = staged(fingerprints(docs, shingle))
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_pairs(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
