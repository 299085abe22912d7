"""Operator 5: language by compression. The language whose zstandard raw-content dictionary makes a text smallest wins."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import held_out, text_of

#: Bounds of the fit: documents drawn for each language, slices of a document and characters of each, and bytes of a dictionary.
SAMPLE_DOCS, SLICES, SLICE_CHARS, DICTIONARY_BYTES = 400, 8, 250, 110_000
#: Most languages that can be told apart; more are an error, not a silent cut.
MAX_LANGUAGES = 1_000
#: zstandard level of every text. Held out at sf0.1: level 3 0.972, 5 0.988, 7 0.993, 12 0.995 at four times the time of 7.
LEVEL = 7
#: A margin of fewer bits than this for each 1,000 bytes, and of fewer than 8 x 2, is narrow.
NARROW_BYTES, NARROW_SHARE = 2, 0.002
LETTER = re.compile(r"[^\W\d_]")
REST = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text in lower case with one blank for all between letters: marks, numbers and case tell no language."""
    return REST.sub(" ", text.lower()).encode()



def spread(text: Column) -> Column:
    """SLICES slices at equal steps over the whole text; a text no longer than they are together is taken whole."""
    step = F.ceil(F.length(text) / SLICES).cast("int")
    size = F.least(step, F.lit(SLICE_CHARS))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substr(text, i * step + 1, size)), "")


def fit(docs: DataFrame, folds: int = 3, fold: int = 1) -> dict[str, bytes]:
    """A raw-content dictionary for each lang, from a bounded sample of rows outside the held-out fold.

    The sample is about SAMPLE_DOCS rows of least id hash of each lang, so reruns agree: rows whose hash, as a share of all
    hashes, is under that number's share of the lang's rows. Null texts and langs teach nothing.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    known = rows.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}  # a row per language
    if len(n) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not n:
        return {}
    share = F.element_at(F.create_map(*(F.lit(x) for lang, k in sorted(n.items()) for x in (lang, min(1.0, SAMPLE_DOCS / k)))), F.col("lang"))
    order = F.xxhash64("doc_id")
    drawn = known.where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).select("lang", order.alias("h"), spread(F.col("text")).alias("part")).distinct()
    out: dict[str, bytearray] = {lang: bytearray() for lang in n}
    for r in drawn.orderBy("lang", "h", "part").toLocalIterator():  # about SAMPLE_DOCS rows of a language
        held = out[r["lang"]]
        if len(held) < DICTIONARY_BYTES:
            held += letters(r["part"]) + b" "
    return {k: bytes(v[:DICTIONARY_BYTES]) for k, v in out.items() if v}


class Sizes:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def of(self, data: bytes) -> list[int]:
        return [len(c.compress(data)) for c in self.compressors]


def decide(langs: list[str], sizes: list[int], n: int) -> tuple[str, float, bool]:
    """The smallest size's language (ties: first by name), its share of likelihood with sizes as code lengths, and whether it is narrow."""
    least = min(sizes)
    scale = 8 * math.log(2) / max(1.0, math.sqrt(n / 50))
    score = 1 / sum(math.exp(-scale * (s - least)) for s in sizes)
    rest = sorted(sizes)[1:2]
    return langs[sizes.index(least)], score, bool(rest) and rest[0] - least < max(NARROW_BYTES, NARROW_SHARE * n)


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each whole text.

    lang_pred is `und` with score 0 where the text is null, has no letter, or no language was learned. rejected marks those
    and predictions whose margin is narrow; a user who wants no doubtful language drops them. Repeated rows and null ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(dictionaries) if dictionaries else None
        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py()
                if sizes and LETTER.search(text):
                    data = letters(text)
                    rows.append(decide(sizes.langs, sizes.of(data), len(data)))
                else:
                    rows.append(("und", 0.0, True))
            lang, score, narrow = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """fit and classify over one table, with held_out for the rows that the fit may not see (null id: false)."""
    return classify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
