"""Operator 11: aligning the tokens of two tokenizers over the same text.

Tokens of A and B whose bytes overlap belong together, and what is joined that way is a group. Groups are found by pointer
jumping: every token points to the token overlapping it that ends farthest right (at an equal end, the one of A), and the
pointers of all tokens of a batch are doubled together until they stand still, each then at the last token of its group.

Neither tokenizer has a token that goes on from a character that is no white space into a blank or a line's end, so a
text falls there into chunks that can be encoded alone; a chunk is encoded and aligned once for each worker's table. The
counts of id pairs are Spark's: exploded, counted, joined back to their documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import sized, staged

#: Chunks, and characters of chunks, that a worker's table holds before it becomes the old one, from which chunks come back as they are met.
TABLE_CHUNKS, TABLE_CHARS = 250_000, 8_000_000
#: Characters of texts that are aligned together.
BATCH_CHARS = 1_000_000
#: Pairs of ids up to which their counts are broadcast (three numbers each); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000

ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.list_(pa.int64()))])
ROWS_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"

_CHUNK = re.compile("[ \n]+[^ \n]*")
_ODD = re.compile("[^\\S \n]|᠎")
# a blank after other white space starts no chunk
_ODD_CHUNK = re.compile("[ \n]+(?:[^ \n]*(?:[^\\S \n]|᠎)[ \n]+)*[^ \n]*")


# a word and marks: A cuts it after the word, whatever version of Unicode its pattern goes by
_PLAIN = re.compile("( [A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")


def chunks(spaced: str) -> list[str]:
    """The parts of a blank and a text that can be encoded alone; joined they are the whole."""
    return (_ODD_CHUNK if _ODD.search(spaced) else _CHUNK).findall(spaced)


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of B that overlaps each token of A, by the byte offsets at which tokens end."""
    return np.searchsorted(end_b, np.concatenate(([0], end_a[:-1])), "right"), np.searchsorted(end_b, end_a, "left")


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For each token of A the last token of A in its group, by pointer jumping over the tokens of both sides."""
    n = len(end_a)
    last_b, last_a = overlaps(end_a, end_b)[1], np.searchsorted(end_a, end_b, "left")
    to = np.concatenate((np.where(end_b[last_b] > end_a, n + last_b, np.arange(n)), last_a))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n]
        to = further


class Aligner:
    """Both tokenizers, the bytes of their ids, and what is known of chunks."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores already
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that A's vocabulary writes as themselves
        hidden = [x for x in range(256) if x not in set(shown)]
        byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        self.a_text, self.b_text = list(map(str, range(len(self.a_bytes)))), list(map(str, range(len(self.b_bytes))))
        #: whether chunks may be encoded alone: no token of either side runs into a blank or a line's end
        self.parted = not any(re.search("[^\\s][ \n]", x.decode(errors="replace")) for x in (*self.a_bytes, *self.b_bytes))
        self.lead = self.b.encode("a")
        self.letters = {x: c for c, x in byte_of.items()}
        self.marks: dict[str, list[int]] = {"": []}
        self.table: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.chars = 0

    def part(self, spaced: str) -> list[str]:
        return chunks(spaced) if self.parted and len(self.lead) == 1 else [spaced]

    def _merged(self, s: str) -> list[int]:
        """A's ids of what its pattern keeps together."""
        return [t.id for t in self.a.model.tokenize("".join([self.letters[x] for x in s.encode()]))]

    def ids(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both sides' ids of texts that begin with a blank or a line's end."""
        a: list = [_PLAIN.fullmatch(p) for p in parts]
        rest = [i for i, m in enumerate(a) if m is None]
        for i, e in zip(rest, self.a.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            a[i] = e.ids
        for i, m in enumerate(a):
            if not isinstance(m, list):
                word, marks = m.groups()
                if marks not in self.marks:
                    self.marks[marks] = self._merged(marks)
                a[i] = self._merged(word) + self.marks[marks]
        # B puts a blank before a text: that stands for the text's own; a lone blank or line's end follows a letter, taken off again
        plain = [p[0] == " " != p for p in parts]
        b = self.b.encode([p[1:] if own else f"a{p}" for p, own in zip(parts, plain, strict=True)], num_threads=1)
        return a, [x if own else x[1:] for x, own in zip(b, plain, strict=True)]

    def learn(self, parts: list[str]) -> None:
        """Put parts into the table: (groups as text, pairs of linked ids, tokens of A, tokens of B), or None where bytes differ."""
        sides, kept = self.ids(parts), []
        for part, a, b in zip(parts, *sides, strict=True):
            own = part.encode()
            if b"".join([self.a_bytes[i] for i in a]) == own == b"".join([self.b_bytes[i] for i in b]):
                kept.append((part, a, b))
            else:
                self.table[part] = None
        if not kept:
            return
        ids_a, ids_b = (np.array(list(chain.from_iterable(k[side] for k in kept)), np.int64) for side in (1, 2))
        end_a, end_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        first, last = overlaps(end_a, end_b)
        many = last - first + 1
        links = np.concatenate(([0], np.cumsum(many)))
        at_b = np.repeat(first - links[:-1], many) + np.arange(links[-1])
        pairs = ((np.repeat(ids_a, many) << 16) | ids_b[at_b]).astype(np.int32)
        # a group's last token of A is its own terminal; the token of B that ends there is the one overlapping it last
        tails = np.flatnonzero(terminals(end_a, end_b) == np.arange(len(end_a)))
        cut_a, cut_b = (tails + 1).tolist(), (last[tails] + 1).tolist()
        at, g, i, j = links.tolist(), 0, 0, 0
        for part, a, b in kept:
            stop, first_i, first_j, groups = i + len(a), i, j, []
            while i < stop:
                to_i, to_j = cut_a[g], cut_b[g]
                groups.append(f"{','.join([self.a_text[x] for x in a[i - first_i : to_i - first_i]])}|{','.join([self.b_text[x] for x in b[j - first_j : to_j - first_j]])}")
                g, i, j = g + 1, to_i, to_j
            self.table[part] = (";".join(groups), pairs[at[first_i] : at[stop]].tobytes(), len(a), len(b))

    def whole(self, spaced: str) -> tuple | None:
        """As the table's entry, of a text that is encoded in one."""
        if spaced not in self.table:
            self.learn([spaced])
        return self.table[spaced]

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, n_links, groups_sha256 and the array of pair << 32 | times, for each text."""
        if len(self.table) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.old, self.table, self.chars = self.table, {}, 0
        parts = [self.part(f" {t}") if t else [] for t in texts]
        new = {p for own in parts for p in own} - self.table.keys()
        self.chars += sum(map(len, new))
        self.table |= {p: self.old[p] for p in new & self.old.keys()}
        if new := list(new - self.table.keys()):
            self.learn(new)
        for given, own in zip(texts, parts, strict=True):
            found = [self.table[p] for p in own]
            if None in found:
                found = [one] if (one := self.whole(f" {given}")) else []
            if not found:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            groups, pairs, n_a, n_b = zip(*found, strict=True)
            text, links = ";".join(groups), np.frombuffer(b"".join(pairs), np.int32)
            kinds, times = np.unique(links, return_counts=True)
            yield sum(n_a), sum(n_b), text.count(";") + 1, len(links), hashlib.sha256(text.encode()).hexdigest(), (kinds.astype(np.int64) << 32) | times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One for each worker process, kept over its tasks."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (pair of ids << 32 | times) of each document, staged.

    A pair is A's id << 16 | B's id. row is unique. Texts that are null, empty, or whose bytes either side's tokens
    change have no tokens: zeros, no links and an empty groups_sha256. Null and repeated doc_ids are rows of their own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, first = aligner(a, b), TaskContext.get().partitionId() << 33
        for ids, texts in _batches(batches):
            n_a, n_b, groups, links, digests, pairs = zip(*both.rows(texts), strict=True)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in pairs])))
            columns = [np.arange(first, first + len(ids)), ids, n_a, n_b, groups, links, digests]
            first += len(ids)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, ROWS, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(pairs), pa.int64()))], schema=ROWS)

    return staged(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, ROWS_DDL))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best of each linked pair of ids: the documents that hold it, and whether n is the highest of the pair's id of A.

    An id of A meets at most B's vocabulary, which bounds the window's groups.
    """
    pairs = rows.select(F.explode("links").alias("link")).groupBy(F.shiftright("link", 32).cast("int").alias("pair")).agg(F.count("*").alias("n"))
    top = pairs.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("top"))
    return pairs.withColumn("a", F.shiftright("pair", 16)).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a: str, b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; rows as in aligned. An empty table gives no rows.

    n_best: links whose pair is its A id's most frequent in the corpus; count_sum: documents that hold the pair, summed over links.
    """
    rows = aligned(docs, a, b)
    counts = sized(staged(pair_counts(rows)), broadcast_pairs)
    links = rows.select("row", F.explode("links").alias("link")).select("row", F.shiftright("link", 32).cast("int").alias("pair"), F.col("link").bitwiseAND((1 << 32) - 1).alias("times"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
