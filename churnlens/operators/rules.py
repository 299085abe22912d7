"""A table of line rules run over texts: gates, frames, excuses, whole-file rules, structural rules, caps, one hit a line and group.

Rules are data, one constant of the plan, so that a plan of hundreds of them is as small as one of two. A text meets only the
rules of its language whose literals it holds (every match of a pattern needs one of them), and a line only the patterns whose literals it holds.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.patterns import java_pattern, required_literals
from churnlens.operators import handlers

CAP = 5
#: Characters of a line that a hit shows.
SNIPPET = 200


@dataclass(frozen=True)
class Rule:
    """One rule; patterns are regular expressions in Python's dialect, null where a test is not made.

    kind `line`: lines that match pattern, in texts that match require, whose frame of `window` lines (and `window_before`
    before it, all moved by `window_offset`) matches present_within and not absent_within, and with no absent_before in the line and the
    `absent_before_window` lines above. kind `absent`: the line of the first anchor that no absent_before excuses, in texts that match
    require and nowhere match absent. kind `module`: the structural rule named by handler. Of the hits of one group on one line the rule of
    least ord stays. raw reads comments too.
    """

    id: str
    ord: int
    lang: str | None = None
    kind: str = "line"
    pattern: str | None = None
    require: str | None = None
    present_within: str | None = None
    absent_within: str | None = None
    window: int = 1
    window_before: int = 0
    window_offset: int = 0
    absent_before: str | None = None
    absent_before_window: int = 1
    anchor: str | None = None
    absent: str | None = None
    handler: str | None = None
    group: str | None = None
    note: str | None = None
    confidence: str | None = None
    raw: bool = False


@dataclass(frozen=True)
class Boundary:
    """A rule that names the boundary a line calls across, in texts that match require."""

    id: str
    ord: int
    label: str
    pattern: str
    lang: str | None = None
    require: str | None = None
    literals: list[str] = field(default_factory=list)


#: Whether ^ and $ of each pattern stand for the bounds of lines: all but a line's own pattern see many lines.
MANY_LINES = {"require", "present_within", "absent_within", "absent_before", "anchor", "absent"}
_PATTERNS = (*sorted(MANY_LINES), "pattern")
_RULE = "id string, ord int, lang string, kind string, pattern string, require string, present_within string, absent_within string, window int, window_before int, window_offset int, absent_before string, absent_before_window int, anchor string, absent string, `group` string, note string, raw boolean, literals array<string>"
_BOUNDARY = "id string, ord int, label string, pattern string, lang string, require string, literals array<string>"


def rules_from(table: DataFrame) -> list[Rule]:
    """Rules from a table with the columns of Rule, some or all; a catalog is small."""
    known = {f.name for f in fields(Rule)} & set(table.columns)
    return sorted((Rule(**{k: v for k, v in r.asDict().items() if k in known and v is not None}) for r in table.collect()), key=lambda r: r.ord)


def _sound(rule: Rule | Boundary) -> bool:
    """Whether all patterns compile; a rule with one that does not is left out, as one bad pattern must not sink a scan."""
    try:
        for name in _PATTERNS:
            if p := getattr(rule, name, None):
                re.compile(p)
    except re.error:
        return False
    return True


def _constant(rules: list, ddl: str) -> Column:
    """The rules as one constant array, with patterns in Java's dialect and the literals of the one that finds lines."""
    rows = []
    for r in rules:
        row = asdict(r)
        found = r.pattern or getattr(r, "anchor", None)
        row["literals"] = required_literals(found) if found else []
        for name in _PATTERNS:
            if row.get(name):
                row[name] = java_pattern(row[name], name in MANY_LINES)
        rows.append(row)
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_colons(ddl)}>>")


def _colons(ddl: str) -> str:
    return ", ".join(":".join(part.rsplit(" ", 1)) for part in ddl.split(", "))


def _met(rules: Column, text: Column, lang: Column | None) -> Column:
    """The rules of a text's language that its literals allow; the lower-case text is made once."""

    def allowed(low: Column) -> Column:
        def one(r: Column) -> Column:
            held = (F.size(r["literals"]) == 0) | F.exists(r["literals"], lambda x: F.contains(low, x))
            return held if lang is None else (r["lang"].isNull() | F.coalesce(r["lang"] == lang, F.lit(False))) & held

        return F.filter(rules, one)

    return F.get(F.transform(F.array(F.lower(text)), allowed), 0)


def _has(text: Column, pattern: Column) -> Column:
    """Whether a pattern of the rule is found; it is compiled anew only when another comes."""
    return F.regexp_instr(text, pattern) > 0


def _unless_null(pattern: Column, test: Column) -> Column:
    return F.when(pattern.isNull(), F.lit(True)).otherwise(test)


def _part(lines: Column, begin: Column, end: Column) -> Column:
    """The lines from begin to end, both from 1, end exclusive, as far as they exist."""
    first = F.greatest(F.lit(1), begin)
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), F.least(end, F.size(lines) + 1) - first)), "\n")


def _excused(r: Column, lines: Column, i: Column) -> Column:
    above = _part(lines, i - F.greatest(F.lit(1), r["absent_before_window"]), i + 1)
    return F.when(r["absent_before"].isNull(), F.lit(False)).otherwise(_has(above, r["absent_before"]))


def _line_hits(r: Column, lines: Column) -> Column:
    """Numbers of the lines that a line rule hits in order, CAP at most."""
    holds = lambda x: (F.size(r["literals"]) == 0) | F.exists(r["literals"], lambda a: F.contains(F.lower(x), a))
    numbered = F.filter(F.transform(lines, lambda x, i: F.when(holds(x) & _has(x, r["pattern"]), i + 1)), lambda i: i.isNotNull())

    def stays(i: Column) -> Column:
        at = i + r["window_offset"]
        frame = _part(lines, at - r["window_before"], at + F.greatest(r["window"], F.lit(1)))
        return _unless_null(r["present_within"], _has(frame, r["present_within"])) & _unless_null(r["absent_within"], ~_has(frame, r["absent_within"])) & ~_excused(r, lines, i)

    return F.slice(F.filter(numbered, stays), 1, CAP)


def _absent_hit(r: Column, text: Column, lines: Column) -> Column:
    """The line of the first anchor that nothing above excuses, or none: anchors are what stands between the parts they split a text into."""
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    parts, anchors = F.split(text, r["anchor"], -1), F.regexp_extract_all(text, r["anchor"], F.lit(0))
    start = F.struct(F.lit(1).alias("line"), F.lit(0).alias("hit"))

    def step(acc: Column, pair: Column) -> Column:
        line = acc["line"] + breaks(F.coalesce(pair["part"], F.lit("")))
        fits = (acc["hit"] == 0) & pair["anchor"].isNotNull() & ~_excused(r, lines, line)
        return F.struct((line + breaks(F.coalesce(pair["anchor"], F.lit("")))).alias("line"), F.when(fits, line).otherwise(acc["hit"]).alias("hit"))

    many = F.aggregate(F.arrays_zip(parts.alias("part"), anchors.alias("anchor")), start, step, lambda acc: acc["hit"])
    first = F.regexp_instr(text, r["anchor"])
    one = F.when(first > 0, 1 + breaks(F.substring(text, F.lit(1), first - 1))).otherwise(0)
    line = F.when(r["absent_before"].isNull(), one).otherwise(many)
    return F.when(_unless_null(r["absent"], ~_has(text, r["absent"])) & (line > 0), F.array(line.cast("int"))).otherwise(F.array().cast("array<int>"))


def _snippet(lines: Column, line_no: Column, keep: int = SNIPPET) -> Column:
    return F.substring(F.trim(F.get(lines, line_no - 1)), 1, keep)


def run_rules(docs: DataFrame, rules: list[Rule], text: str = "text", lang: str | None = None, raw: str | None = None, told: bool = False) -> DataFrame:
    """doc_id, line_no, rule, snippet: of each line the first rule, by ord, that hits it in each group; with told also group and note.

    Null texts have no lines. With lang, a rule with a language is run on texts of that language alone. text is code with its
    comments blanked where raw names the column with them, which rules with raw read and snippets show; doc_id is a key.
    """
    known = [r for r in rules if _sound(r)]
    own = docs.select("doc_id", F.col(text).alias("code"), F.col(raw or text).alias("raw"), *([F.col(lang).alias("lang")] if lang else []))
    own = own.withColumns({"lines": F.split("code", "\n", -1), "raw_lines": F.split("raw", "\n", -1)})
    of_lang = F.col("lang") if lang else None
    met = own.where(F.col("code").isNotNull()).select("doc_id", "code", "raw", "lines", "raw_lines", F.explode(_met(_constant([r for r in known if r.kind != "module"], _RULE), F.col("raw"), of_lang)).alias("r"))
    r = F.col("r")
    seen = met.withColumns({"t": F.when(r["raw"], F.col("raw")).otherwise(F.col("code")), "l": F.when(r["raw"], F.col("raw_lines")).otherwise(F.col("lines"))})
    gated = seen.where(_unless_null(r["require"], _has(F.col("t"), r["require"])))
    at = F.when(r["kind"] == "absent", _absent_hit(r, F.col("t"), F.col("l"))).otherwise(_line_hits(r, F.col("l")))
    hits = gated.select("doc_id", "r", "raw_lines", F.explode(at).alias("line_no")).select(
        "doc_id", "line_no", r["group"].alias("group"), r["ord"].alias("ord"), r["id"].alias("rule"), r["note"].alias("note"), _snippet(F.col("raw_lines"), F.col("line_no")).alias("snippet")
    )
    if modules := [m for m in known if m.kind == "module" and m.handler in handlers.HANDLERS]:
        def led(m: Rule) -> Column:
            own_leads = F.slice(handlers.HANDLERS[m.handler](F.col("code"), F.col("lines"), m.lang or "typescript"), 1, CAP)
            named = F.transform(own_leads, lambda x: F.struct(x["line_no"].alias("line_no"), F.lit(m.group).cast("string").alias("group"), F.lit(m.ord).alias("ord"), F.lit(m.id).alias("rule"), F.coalesce(x["note"], F.lit(m.note)).alias("note")))
            return F.when(of_lang == m.lang, named) if lang and m.lang else named

        each = [led(m) for m in modules]
        found = own.where(F.col("code").isNotNull()).select("doc_id", "raw_lines", F.explode(F.flatten(F.array_compact(F.array(*each)))).alias("h"))
        hits = hits.unionByName(found.select("doc_id", "h.line_no", "h.group", "h.ord", "h.rule", "h.note", _snippet(F.col("raw_lines"), F.col("h.line_no")).alias("snippet")))
    # hits alone are shuffled, never texts
    first = hits.groupBy("doc_id", "group", "line_no").agg(F.min_by(F.struct("rule", "note", "snippet"), "ord").alias("s"))
    return first.select("doc_id", "line_no", "s.rule", "s.snippet", *(["group", "s.note"] if told else []))


# Lines that are imports, which call nothing.
IMPORT_LINE = r"""^\s*(?:import\b|from\s+[\w.]+\s+import\b|export\s+[^=]*\bfrom\s+['"])"""


def boundaries(docs: DataFrame, rules: list[Boundary], text: str = "text", lang: str = "lang", gate: str | None = None) -> DataFrame:
    """doc_id, line_no, rule, label, snippet: of each line that is no import the first rule, by ord, whose pattern it matches.

    A rule with a require is open in texts whose gate column matches it (text without the imports of its own packages, see
    functions.code.without_own_imports; by default text itself); a null gate opens none.
    """
    own = docs.select("doc_id", F.col(text).alias("code"), F.col(gate or text).alias("gate"), F.col(lang).alias("lang"), F.split(text, "\n", -1).alias("lines"))
    met = own.select("doc_id", "gate", "lines", F.explode(_met(_constant([r for r in rules if _sound(r)], _BOUNDARY), F.col("code"), F.col("lang"))).alias("r"))
    r = F.col("r")
    open_ = met.where(_unless_null(r["require"], F.coalesce(_has(F.col("gate"), r["require"]), F.lit(False))))
    holds = lambda x: F.exists(r["literals"], lambda a: F.contains(F.lower(x), a)) | (F.size(r["literals"]) == 0)
    bare = lambda x: F.rtrim(x, F.lit("\r"))
    fits = lambda x: (F.trim(bare(x)) != "") & ~bare(x).rlike(java_pattern(IMPORT_LINE)) & _has(bare(x), r["pattern"])
    at = F.filter(F.transform("lines", lambda x, i: F.when(holds(x) & fits(x), i + 1)), lambda i: i.isNotNull())
    hits = open_.select("doc_id", r["ord"].alias("ord"), r["id"].alias("rule"), r["label"].alias("label"), "lines", F.explode(at).alias("line_no"))
    first = hits.select("doc_id", "line_no", "ord", "rule", "label", _snippet(F.col("lines"), F.col("line_no"), 120).alias("snippet")).groupBy("doc_id", "line_no").agg(F.min_by(F.struct("rule", "label", "snippet"), "ord").alias("s"))
    return first.select("doc_id", "line_no", "s.rule", "s.label", "s.snippet")
