"""Operator 9: harmonic packing of tokenised documents into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class k takes pieces of (capacity/(k+1), capacity/k]
tokens and each of its bins holds exactly k of them. A document is cut so that nearly all its tokens lie
in pieces that fill their class's bins to the end: whole sequences first, then for what is left the
largest capacity // k that fits, until at most capacity // FINE tokens remain, which waste at most one part
in FINE. Every task fills its own bins and needs no other task; what its last bins hold is too little to fill
them, and those few pieces are packed together by a second, bounded pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import staged, text_of

CAPACITY = 2048
#: Pieces of capacity // FINE tokens or fewer are not cut further.
FINE = 16
#: Tasks whose last pieces are packed together; bounds the rows of one group.
TASKS_TOGETHER = 64
#: Words kept in a worker's table of ids before it starts anew.
CACHE_WORDS = 1_000_000
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, sequence_id long, offset long"


class WordIds(dict):
    """Little-endian ids of each blank-separated word, as the tokenizer gives them.

    The tokenizer drops blanks and never joins what they part, so a text's ids are those of its words in turn.
    Plain Latin words go straight to the vocabulary's merge model; anything else takes the whole tokenizer.
    """

    plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def part(self, s: str) -> bytes:
        mapped = s if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if m := self.plain.fullmatch(word):
            ids = self.part(m[1].lower()) + (self.part(m[2]) if m[2] else b"")
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_tables: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table for each worker process, kept over its tasks."""
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    while rest > capacity // FINE:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out + [rest] * (rest > 0)


def fill(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: each time the longest piece that still fits, so that only the last bins have room."""
    by_size: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        by_size.setdefault(int(sizes[i]), []).append(i)
    lengths, out = sorted(by_size, reverse=True), []
    while lengths:
        room, here = capacity, []
        for s in lengths:
            while by_size[s] and s <= room:
                here.append(by_size[s].pop())
                room -= s
        out.append(here)
        lengths = [s for s in lengths if by_size[s]]
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Null and repeated doc_ids are packed as rows of their own.
    Sequences are at most capacity long; sequence ids are unique but not gapless. Other columns are not read.
    An empty table gives no rows. The pieces are staged in the shared folder, so texts are tokenised once.
    """
    end = np.array([end_id], "<u4").tobytes()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task, made = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        bins: dict[int, list[tuple]] = {}
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in PIECES]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = table.of(text.as_py()) + end
                n, start = len(ids) // 4, 0
                for length in cuts(n, capacity):
                    own = ids[4 * start : 4 * (start + length)]
                    k = capacity // length
                    here = bins.setdefault(k, [])
                    here.append((doc_id, start, length, zlib.crc32(own), n, task))
                    start += length
                    if len(here) == k:
                        at = 0
                        for piece in here:
                            out.append((*piece, (task << 36) | made, at))
                            at += piece[2]
                        made += 1
                        bins[k] = []
                if len(out) > 20_000:
                    yield flush()
        out += [(*piece, None, None) for k in sorted(bins) for piece in bins[k]]
        yield flush()

    def join_up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["task", "length", "doc_id", "start", "ids_crc32"], ignore_index=True)
        first = ((1 << 26) | int(group["task"].iloc[0]) // TASKS_TOGETHER) << 36
        sizes, sequence, offset = group["length"].to_numpy(), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for i, members in enumerate(fill(sizes, capacity)):
            sequence[members] = first | i
            offset[members] = np.cumsum(sizes[members]) - sizes[members]
        return group.assign(sequence_id=sequence, offset=offset)

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    pieces = staged(texts.mapInArrow(place, PIECES_DDL))
    # ids travel as text: pandas would turn longs with nulls among them into doubles
    rest = pieces.where("sequence_id is null").withColumn("doc_id", F.col("doc_id").cast("string"))
    last = rest.groupBy(F.expr(f"task div {TASKS_TOGETHER}")).applyInPandas(join_up, PIECES_DDL.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return pieces.where("sequence_id is not null").unionByName(last).drop("task")
