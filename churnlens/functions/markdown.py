"""Prose that a Markdown renderer shows as exactly its own characters: no link, image, markup or structure can come of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.functions.code import code_span, visible
from churnlens.functions.exprs import let

# What a renderer may turn into a link or a sign, marks of a sentence about a word, marks that have a meaning, and what opens a block.
LINKISH = r"(?i)://|//|www\.|mailto:|xmpp:|@|\.\p{L}{2}|:[a-z0-9_+-]*[a-z][a-z0-9_+-]*:|:[+-]1:|:100:|:1234:"
PEEL = r"""(?s)^([(\[{"']*)(.*?)([)\]},;:.!?"']*)$"""
SPECIAL, HEADING = r"([\\`*_\[\]<>|~&$])", r"([\\`*_\[\]<>|~&$#])"
CLOSERS = {")": "(", "]": "[", "}": "{"}
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _escaped(s: Column, heading: bool) -> Column:
    return F.regexp_replace(s, HEADING if heading else SPECIAL, r"\\$1")


def _count(s: Column, mark: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))


def _word(token: Column, cell: bool, heading: bool) -> Column:
    """A word; if it could hold a link it is a code span, with the sentence's marks about it outside."""

    def kept(p: Column) -> Column:
        """(core, trail): a closing bracket that the word itself opened belongs to it."""

        def step(a: Column, _: Column) -> Column:
            mark = F.left(a["trail"], F.lit(1))
            own = F.greatest(*((mark == close) & (_count(a["core"], open_) > _count(a["core"], close)) for close, open_ in CLOSERS.items()))
            return F.when(own, F.struct(F.concat(a["core"], mark).alias("core"), F.substring(a["trail"], 2, 1 << 30).alias("trail"))).otherwise(a)

        # once a mark stays outside none behind it can come in, as nothing changes any more
        return F.aggregate(F.sequence(F.lit(0), F.length(p["trail"])), F.struct(p["core"].alias("core"), p["trail"].alias("trail")), step)

    def span(p: Column) -> Column:
        bare = (p["core"] == "") | ~p["core"].rlike(LINKISH)
        lead = F.when(bare, "").otherwise(p["lead"])
        held = F.when(bare, F.struct(token.alias("core"), F.lit("").alias("trail"))).otherwise(kept(p))
        return let(held, lambda h: F.concat(_escaped(lead, heading), code_span(h["core"], cell), _escaped(h["trail"], heading)))

    parts = F.struct(*(F.regexp_extract(token, PEEL, g).alias(n) for g, n in ((1, "lead"), (2, "core"), (3, "trail"))))
    return F.when(token.rlike(LINKISH), let(parts, span)).otherwise(_escaped(token, heading))


def prose(value: Column, cell: bool = False, heading: bool = False) -> Column:
    """Text on one line that shows as it is, safe also at a line's start (operator 128); null and blank values as a dash."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS, " "), "[ \\t]+", " ")
    own = F.regexp_replace(F.regexp_replace(let(flat, visible), "[ \\t]+", " "), r"(?U)^\s+|\s+$", "")

    def shown(own: Column) -> Column:
        pieces = F.regexp_extract_all(own, F.lit(r"(?U)\S+|\s+"), F.lit(0))
        words = F.array_join(F.transform(pieces, lambda t: F.when(t.rlike(r"(?U)^\s"), t).otherwise(_word(t, cell, heading))), "")
        # no word could hold a link where the whole text could not
        joined = F.when(own.rlike(LINKISH), words).otherwise(_escaped(own, heading))
        guarded = F.regexp_replace(F.regexp_replace(joined, r"^([#+=>-])", r"\\$1"), r"^([0-9]+)([.)])", r"$1\\$2")
        return F.when(F.coalesce(own, F.lit("")) == "", "—").otherwise(guarded)

    return let(own, shown)


def linked(value: Column, url: Column, cell: bool = False) -> Column:
    """A link whose text is a code span of value, or the span alone where url is null or empty."""
    span = code_span(value, cell)
    return F.when(F.coalesce(url, F.lit("")) == "", span).otherwise(F.concat(F.lit("["), span, F.lit("]("), url, F.lit(")")))


def table_row(*cells: Column) -> Column:
    """A row of a table from cells that are made safe for it already."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
