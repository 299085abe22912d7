"""What the training-data operators share: staged tables, text columns, distributed numbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.sources.staging import BROADCAST_ROWS, sized, staged  # noqa: F401  the operators take them from here

#: White space as the operators know it: blank and the bytes 9 to 13.
BLANK = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\f\r"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has already: columns made on the way never meet a user's."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def without_blanks(s: Column) -> Column:
    """s without BLANKS. Replacing one byte at a time runs over bytes; translate would look up every character by itself."""
    for blank in BLANKS:
        s = F.replace(s, F.lit(blank), F.lit(""))
    return s


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text (null: 0): each word with the blanks about it becomes one mark."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]*+[^{BLANK}]++[{BLANK}]*+", "x")
    return F.length(without_blanks(marks)).cast("long")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value made once: what a lambda takes from outside is made anew for every element."""
    return F.get(F.transform(F.array(value), then), 0)


#: Elements of an array that are scanned together.
SCANNED = 256


def blocks(xs: Column, size: int = SCANNED) -> Column:
    """xs cut into arrays of size elements."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(xs), F.lit(size)), lambda i: i < F.size(xs)), lambda i: F.slice(xs, i + 1, F.lit(size)))


def scan(xs: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states, of type kind, that step(state, x) goes through, the one before each element of xs.

    An array that grows element by element is copied each time, so states are gathered in blocks: first those at the blocks' beginnings, then those within.
    """
    more = lambda a, x, state: F.struct(state.cast(kind).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out"))
    empty = lambda s: F.struct(s.cast(kind).alias("s"), F.array().cast(f"array<{kind}>").alias("out"))

    def within(parts: Column) -> Column:
        begins = F.aggregate(parts, empty(start), lambda a, part: more(a, part, F.aggregate(part, a["s"], lambda s, x: step(s, x).cast(kind))), lambda a: a["out"])
        return let(begins, lambda b: F.flatten(F.transform(parts, lambda part, i: F.aggregate(part, empty(F.get(b, i)), lambda a, x: more(a, x, step(a["s"], x)), lambda a: a["out"]))))

    return let(blocks(xs), within)


def clusters(spans: Column) -> Column:
    """Spans (start, end and more), sorted by start, cut into arrays that no span crosses: what crosses a span is in its own array."""

    def cut(s: Column) -> Column:
        far = scan(s, F.lit(-1), lambda a, x: F.greatest(a, x["end"]), "bigint")
        first = lambda f: F.filter(F.transform(s, lambda x, i: F.when(x["start"] >= F.get(f, i), i + 1)), lambda i: i.isNotNull())
        begins = let(far, first)
        return let(begins, lambda b: F.transform(b, lambda i, k: F.slice(s, i, F.coalesce(F.get(b, k + 1), F.size(s) + 1) - i)))

    return let(spans, cut)


def hash_unit(*cols: Column) -> Column:
    """A double in (0, 1) from the MD5 of the columns' text; the same in any engine that has MD5."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("-")) for c in cols)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the id as text leaves the remainder fold (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
