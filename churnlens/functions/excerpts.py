"""The source block of a briefing: a file whole, by one function or clipped, and from the rendered text back to the lines it shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.functions.exprs import clip, let, token_estimate

# How a source block, the mark of what was left out, and the three notes are written; the lines about a function.
BLOCK = r"(?dms)^## Source — `([^`]+)`\n\n_([^\n]*)_\n\n```[^\n]*\n(.*?)\n```\n(?=\n+## |\n*\z)"
OMITTED = r"\n\n\.\.\. \[[^\]]*: \d+ characters omitted\] \.\.\.\n\n"
WHOLE, PART, TRIMMED = r"^whole file, (\d+) lines$", r"^lines (\d+)-(\d+) — ", r"^file trimmed to fit the budget; (\d+) lines total$"
AROUND = 15
#: What ends a line where a whole file's lines are counted.
ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

RANGES = "array<struct<lo:bigint,hi:bigint>>"


def breaks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """Lines of a text; an end of line at its end opens none."""
    n = F.size(F.split(text, ENDS, -1))
    return F.when(text.rlike(f"(?:{ENDS})\\z") | (text == ""), n - 1).otherwise(n)


def source_block(path: Column, text: Column, budget: int, name: Column | None = None, first: Column | None = None, last: Column | None = None, fence: str = "") -> Column:
    """The rendered block: the file if its estimate is within budget; else the function name, first to last, with lines about it, or, where that is
    null, the file, clipped to the budget."""
    lines = F.split(text, "\n", -1)
    whole = F.struct(F.concat(F.lit("whole file, "), line_count(text), F.lit(" lines")).alias("note"), text.alias("body"))
    rest = F.struct(F.concat(F.lit("file trimmed to fit the budget; "), F.size(lines), F.lit(" lines total")).alias("note"), clip(text, budget).alias("body"))
    if name is not None:
        lo, hi = F.greatest(F.lit(0), first - 1 - AROUND), F.least(F.size(lines), last + AROUND)
        body = clip(F.array_join(F.slice(lines, (lo + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int")), "\n"), budget)
        note = F.concat(F.lit("lines "), lo + 1, F.lit("-"), hi, F.lit(" — the most complex function `"), name, F.lit(f"` with {AROUND} lines of context; the file is "), F.size(lines), F.lit(" lines and did not fit the budget"))
        rest = F.when(name.isNotNull() & first.isNotNull() & last.isNotNull(), F.struct(note.alias("note"), body.alias("body"))).otherwise(rest)
    own = F.when(token_estimate(text) <= budget, whole).otherwise(rest)
    return let(own, lambda o: F.concat(F.lit("## Source — `"), path, F.lit("`\n\n_"), o["note"], F.lit(f"_\n\n```{fence}\n"), o["body"], F.lit("\n```\n\n")))


def shown(rendered: Column) -> Column:
    """(path, ranges) of the lines that a rendered briefing shows of its file, or null where no block can be read (operator 57).

    A line that the cut goes through is not shown: the head's last and the tail's first. An excerpt that runs to the file's last end of line
    has an empty line behind it, which does not count.
    """
    part = lambda g: F.regexp_extract(rendered, BLOCK, g)
    number = lambda note, p, g: F.nullif(F.regexp_extract(note, p, g), F.lit("")).cast("long")

    def ranges(b: Column) -> Column:
        note, ended = b["note"], F.endswith(b["body"], F.lit("\n"))
        lo = F.coalesce(number(note, PART, 1), F.when(note.rlike(TRIMMED), F.lit(1)))
        hi = F.coalesce(number(note, PART, 2), number(note, TRIMMED, 1)) - ended.cast("int")
        parts = F.split(F.when(ended, F.substring(b["body"], F.lit(1), F.length(b["body"]) - 1)).otherwise(b["body"]), OMITTED, -1)
        span = lambda a, z: F.struct(a.cast("long").alias("lo"), z.cast("long").alias("hi"))

        def cut(p: Column) -> Column:
            head, tail = breaks(F.get(p, 0)), breaks(F.get(p, 1))
            two = F.array_compact(F.array(F.when(head > 0, span(lo, lo + head - 1)), F.when(tail > 0, span(hi - tail + 1, hi))))
            return F.when(F.size(p) == 1, F.array(span(lo, hi))).when(F.size(p) == 2, two)

        whole = number(note, WHOLE, 1)
        return F.when(whole.isNotNull(), F.array(span(F.lit(1), whole))).when(lo.isNotNull(), let(parts, cut))

    block = F.when(rendered.rlike(BLOCK), F.struct(part(1).alias("path"), part(2).alias("note"), part(3).alias("body")))
    return let(block, lambda b: let(F.when(b.isNotNull(), ranges(b)).cast(RANGES), lambda r: F.when(r.isNotNull(), F.struct(b["path"].alias("path"), r.alias("ranges")))))
