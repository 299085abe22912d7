"""Program text as columns: comments blanked, names, versions, Markdown spans. Native expressions but for one scanner."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from churnlens.functions.exprs import let

#: Pieces of C-like text in the order they are tried: line comment, closed and open block comment, strings by their quote, runs of
#: other characters. Loops are unrolled so that a long string costs no depth.
C_TOKENS = r"""//[^\n]*|(?s:/\*.*?\*/)|(?s:/\*.*)|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*["\\]?|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*['\\]?|`[^`\\]*(?:\\[\s\S][^`\\]*)*[`\\]?|[^/"'`]+|/"""
#: Pieces of a YAML line: a comment after a blank, quoted scalars with what may stand before them, runs of plain characters.
YAML_TOKENS = r"""^#.*|[ \t]#.*|(?:^|[ \t:\-\[{,])'[^']*(?:''[^']*)*'?|(?:^|[ \t:\-\[{,])"[^"\\]*(?:\\.[^"\\]*)*["\\]?|[^ \t:\-\[{,]+|[ \t:\-\[{,]"""


def _spaces(text: Column) -> Column:
    """A blank for each character but line feeds."""
    return F.regexp_replace(text, r"[^\n]", " ")


def _by_line(text: Column, one) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), one), "\n")


def blank_c(text: Column) -> Column:
    """Text with // and /* */ comments as blanks; strings stay, and an open string ends with its line (operator 45)."""
    pieces = F.regexp_extract_all(text, F.lit(C_TOKENS), F.lit(0))
    return F.array_join(F.transform(pieces, lambda t: F.when(t.rlike(r"\A/[/*]"), _spaces(t)).otherwise(t)), "")


def blank_yaml(text: Column) -> Column:
    """Text with # comments as blanks: those at a line's start or after a blank, outside quoted scalars (operator 47)."""

    def line(x: Column) -> Column:
        pieces = F.regexp_extract_all(x, F.lit(YAML_TOKENS), F.lit(0))
        comment = lambda t, i: t.rlike(r"\A[ \t]#") | ((i == 0) & t.startswith("#"))
        # the blank before a comment is kept as it is
        put = lambda t: F.when(t.startswith("#"), _spaces(t)).otherwise(F.concat(F.left(t, F.lit(1)), _spaces(F.substring(t, 2, 1 << 30))))
        return F.array_join(F.transform(pieces, lambda t, i: F.when(comment(t, i), put(t)).otherwise(t)), "")

    return _by_line(text, line)


def blank_properties(text: Column) -> Column:
    """Text with lines that begin with # or ! as blanks (operator 47)."""
    return _by_line(text, lambda x: F.when(x.rlike(r"^\s*[#!]"), F.regexp_replace(x, ".", " ")).otherwise(x))


_PYTHON = re.compile(r"""(?P<comment>\#[^\n]*)|(?P<triple>\"\"\"|''')|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<line>\n)""")
_STARTS = re.compile(r"[ \t]*[rbuRBU]{0,2}\Z")
_GOES_ON = re.compile(r"(?:[=,\\+\-*/%|&^<>~@]|\b(?:and|or|not|in|is))\s*\Z")
_SHOWN = re.compile(r"[^\n]")


def python_blanked(text: str) -> str:
    """Python text with comments and docstrings as blanks; other strings stay.

    A triple quote that begins a line is a docstring unless a bracket is open or the last line of code goes on.
    """
    out, at, depth = [], 0, 0
    last = code = ""  # the last line with code, and what this one has so far
    told = False  # whether this line began with a docstring that it also closed, and counts as nothing else

    def put(upto: int, hide: bool = False) -> str:
        nonlocal at
        piece = text[at:upto]
        at = upto
        out.append(_SHOWN.sub(" ", piece) if hide else piece)
        return piece

    pos = 0
    while m := _PYTHON.search(text, pos):
        kind, pos = m.lastgroup, m.end()
        if kind == "comment":
            code += put(m.start())
            put(pos, hide=True)
        elif kind == "triple":
            line = text.rfind("\n", 0, m.start()) + 1
            doc = depth == 0 and bool(_STARTS.fullmatch(text, line, m.start())) and not _GOES_ON.search(last)
            pos = _closing(text, pos, m[0], raw=doc)
            piece = put(pos, hide=doc)
            first, more, _ = piece.partition("\n")
            if doc:
                last, told = m[0], not more
            elif more:
                last, code = (code + first).rstrip(), ""
            else:
                code += first
        else:
            code += put(m.start() if kind == "line" else pos)
            depth = depth + 1 if kind == "open" else max(0, depth - 1) if kind == "close" else depth
        if kind == "line":
            last = code.rstrip() if code.strip() and not told else last
            code, told = "", False
            put(pos)
    put(len(text))
    return "".join(out)


def _closing(text: str, at: int, quote: str, raw: bool) -> int:
    """Where the string that began before `at` ends; a docstring's backslashes are plain, and so are those of later lines of any string."""
    first = text.find("\n", at)
    while not raw and at < (len(text) if first < 0 else first):
        if text[at] == "\\":
            at += 2
        elif text.startswith(quote, at):
            return at + 3
        else:
            at += 1
    end = text.find(quote, at)
    return len(text) if end < 0 else end + 3


@F.pandas_udf(StringType())
def blank_python(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """python_blanked over Arrow batches (operator 46); null stays null."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else python_blanked(t))


#: Controls, marks that turn the direction of text, overrides and isolates.
INVISIBLE = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\u061c\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]"


def visible(text: Column) -> Column:
    r"""Text with invisible characters as \uXXXX."""
    shown = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(INVISIBLE), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0")))).otherwise(c))
    return F.when(text.rlike(INVISIBLE), F.array_join(shown, "")).otherwise(text)


def code_span(value: Column, cell: bool = False) -> Column:
    """A Markdown code span that shows value as it is, on one line; null and blank values as a dash (operator 128)."""
    flat = F.regexp_replace(F.regexp_replace(value, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", " ")

    def span(text: Column) -> Column:
        longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))
        fence = F.when(text.contains("`"), F.repeat(F.lit("`"), longest + 1)).otherwise("`")
        pad = F.when(text.rlike("^[` ]|[` ]\\z"), " ").otherwise("")
        shown = F.replace(text, F.lit("|"), F.lit("\\|")) if cell else text
        return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "—").otherwise(let(fence, lambda f: F.concat(f, pad, shown, pad, f)))

    return let(let(flat, visible), span)


def package_name(name: Column) -> Column:
    """A Python package's name in its normal form (operator 130)."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def _version(text: Column, pattern: str) -> Column:
    """Major, minor and patch of a match as a struct a, b, c of longs; a part that is left open or a wildcard is null. The match is made once."""
    parts = F.split(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"[x*]", ""), r"\.")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    return F.struct(*(number(i).alias(n) for i, n in enumerate("abc")))


def satisfies(version: Column, wanted: Column) -> Column:
    """Whether a version lies in an npm range (operator 130): comparators, ^, ~, wildcards and ||; null where either is not understood.

    The version is read once and each token once, into a struct that all comparisons then use.
    """
    part = r"^v?([0-9]+(?:\.(?:[0-9]+|x|\*))?(?:\.(?:[0-9]+|x|\*))?)(?:-[0-9A-Za-z.-]+)?$"
    at = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    zero = F.lit(0).cast("long")

    def fits(own: Column, op: Column, v: Column) -> Column:
        a, b, c = v["a"], v["b"], v["c"]
        b0, c0 = F.coalesce(b, zero), F.coalesce(c, zero)
        low = at(a, b0, c0)
        caret = F.when(a > 0, at(a + 1, zero, zero)).when(b0 > 0, at(zero, b0 + 1, zero)).otherwise(at(zero, zero, c0 + 1))
        tilde = F.when(b.isNull(), at(a + 1, zero, zero)).otherwise(at(a, b0 + 1, zero))
        within = lambda high: (own >= low) & (own < high)
        return (
            F.when(op == ">=", own >= low).when(op == ">", own > low).when(op == "<=", own <= low).when(op == "<", own < low)
            .when(op == "^", within(caret)).when((op == "~") | b.isNull() | c.isNull(), within(tilde)).otherwise(own == low)
        )

    def one(own: Column, token: Column) -> Column:
        """`yes`, `no`, or `odd` for what is no comparator."""
        op = F.regexp_extract(token, r"^(>=|<=|>|<|=|\^|~)?", 1)
        split = F.struct(op.alias("op"), F.regexp_replace(token, r"^(>=|<=|>|<|=|\^|~)", "").alias("rest"))
        read = lambda t: F.struct(t["op"].alias("op"), t["rest"].rlike(part).alias("known"), _version(t["rest"], part).alias("v"))
        told = lambda t: F.when(~t["known"], "odd").when(F.coalesce(fits(own, t["op"], t["v"]), F.lit(False)), "yes").otherwise("no")
        return F.when(token.isin("*", "x"), "yes").otherwise(let(let(split, read), told))

    def judged(own: Column) -> Column:
        alternatives = F.transform(F.split(wanted, r"\|\|"), lambda alt: F.transform(F.filter(F.split(alt, r"\s+"), lambda t: t != ""), lambda t: one(own, t)))
        met = F.transform(alternatives, lambda alt: F.when(F.array_contains(alt, "odd"), "odd").when(F.array_contains(alt, "no"), "no").otherwise("yes"))
        first = F.get(F.filter(met, lambda x: x != "no"), F.lit(0))
        known = own["a"].isNotNull() & wanted.isNotNull() & ~wanted.rlike(" - |:|/")
        return F.when(known, let(first, lambda x: F.when(x.isNull(), False).when(x == "yes", True)))

    return let(_version(F.trim(version), r"^v?([0-9]+\.[0-9]+\.[0-9]+)"), judged)


# How lines import from and export to other files, and how each language reads a setting with a fallback of its own.
IMPORTS = [r"""^\s*import\s+.*?\s+from\s+['"]([^'"]+)['"]""", r"""^\s*(?:const|let|var)\s+.*?=\s*require\s*\(\s*['"]([^'"]+)['"]""", r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"]
EXPORTS = [r"^\s*export\s+(?:async\s+)?(?:function|const|class|let|var)\s+(\w+)", r"^\s*export\s*\{\s*([^}]+)\}", r"^\s*(?:async\s+)?def\s+(\w+)", r"^\s*class\s+(\w+)"]
SETTING_READS = {
    "python": [r"""\.(?:get|pop)\(\s*['"]{setting}['"]\s*,""", r"""\bgetattr\(\s*[^,()]+,\s*['"]{setting}['"]\s*,""", r"""\bgetenv\(\s*['"]{setting}['"]\s*,"""],
    "typescript": [r"""\.?\bget\w*\s*(?:<[^>()]*>)?\(\s*['"`]{setting}['"`]\s*,""", r"""process\.env(?:\.{setting}\b|\[\s*['"`]{setting}['"`]\s*\])\s*(?:\?\?|\|\|)"""],
    "java": [r"""\.get\w*\(\s*"{setting}"\s*,""", r"\$\{{setting}:"],
    "yaml": [r"\$\{{setting}:"],
    "properties": [r"\$\{{setting}:"],
}


def captured(text: Column, patterns: list[str]) -> Column:
    """What lines capture, once each in order: a line's first pattern that matches tells, by its first group that is not empty (operator 56)."""

    def line(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for p in reversed(patterns):
            groups = [F.nullif(F.regexp_extract(x, p, i + 1), F.lit("")) for i in range(re.compile(p).groups)]
            out = F.when(x.rlike(p), F.coalesce(*groups)).otherwise(out)
        return out

    return F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), line), lambda t: t.isNotNull()))


def exported(text: Column) -> Column:
    """Names that lines export, once each in order (operator 56): of a list in braces each name, by its first where it is given another."""
    names = F.flatten(F.transform(captured(text, EXPORTS), lambda c: F.transform(F.split(c, ","), lambda n: F.trim(F.substring_index(F.trim(n), " as ", 1)))))
    return F.array_distinct(F.filter(names, lambda n: n.rlike(r"(?U)^[^\W\d]\w*$")))


def reads_with_fallback(blanked: Column, setting: Column, lang: str | None, reads: dict[str, list[str]] = SETTING_READS) -> Column:
    """Whether text without comments reads a setting and gives a fallback there; null where the language has no such forms, false for what is no name (operator 55)."""
    forms = reads.get(lang or "")
    if not forms:
        return F.lit(None).cast("boolean")
    name = F.trim(F.coalesce(setting, F.lit("")))
    out = F.lit(False)
    for form in forms:
        before, *after = form.split("{setting}")
        pattern = F.concat(F.lit(f"(?im){before}"), *(F.concat(F.lit("\\Q"), name, F.lit(f"\\E{part}")) for part in after))
        out = out | F.regexp_like(blanked, pattern)
    return F.when(name.rlike(r"^[\w.\-:/\[\]@]+$"), F.coalesce(out, F.lit(False))).otherwise(False)


def record_hash(values: dict[str, Column], kept: dict[str, list[str]] | None = None) -> Column:
    """SHA-256 of a record as JSON with sorted keys and no blanks (operator 114). kept names the fields that count of the structs in an array column."""
    fields = []
    for name in sorted(values):
        inner = sorted((kept or {}).get(name, []))
        value = F.transform(values[name], lambda s: F.struct(*(s[f].alias(f) for f in inner))) if inner else values[name]
        fields.append(value.alias(name))
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
