"""Regular expressions of rule catalogs: from Python's dialect to Java's, and the literals that a match cannot do without."""

from __future__ import annotations

import re
from re import _parser as parser

#: Literals shorter than this say too little to be looked for.
LEAST_LITERAL = 2


def java_pattern(pattern: str, lines: bool = False) -> str:
    """The pattern as Java reads it. With lines, ^ and $ stand for the bounds of lines.

    Only \\n ends a line, as in Python; named groups lose their P, \\Z its newline, and brackets and && inside a class their meaning.
    """
    out, i, inside, first = [], 0, False, False  # first: nothing has come yet that the class holds
    while i < len(pattern):
        two, c = pattern[i : i + 2], pattern[i]
        if c == "\\":
            out.append("\\z" if two == "\\Z" and not inside else two)
            i, first = i + 2, False
            continue
        if inside:
            if c == "]" and not first:
                inside = False
            out.append("\\" + c if c == "[" or (c == "]" and first) or two == "&&" else c)
            first = first and c == "^" and out[-2] == "["
        elif c == "[":
            inside = first = True
            out.append(c)
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(f"\\k<{pattern[i + 4 : end]}>")
            i = end + 1
            continue
        else:
            out.append(c)
        i += 1
    return ("(?dm)" if lines else "(?d)") + "".join(out)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets either of which every match meets, the one that tells more: longer at its shortest, then smaller."""
    if a is None or b is None:
        return a or b
    return max((a, b), key=lambda s: (min(map(len, s)), -len(s)))


def _needed(parsed) -> frozenset[str] | None:
    best, run = None, ""

    def close() -> None:
        nonlocal best, run
        if len(run) >= LEAST_LITERAL:
            best = _better(best, frozenset([run]))
        run = ""

    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            run += chr(arg).lower()
            continue
        # a group that always holds the same letters carries the run on
        if name == "SUBPATTERN" and all(str(o) == "LITERAL" and a < 128 for o, a in arg[3]):
            run += "".join(chr(a).lower() for _, a in arg[3])
            continue
        close()
        if name == "SUBPATTERN":
            best = _better(best, _needed(arg[3]))
        elif name == "BRANCH":
            parts = [_needed(p) for p in arg[1]]
            if all(parts):
                best = _better(best, frozenset().union(*parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            best = _better(best, _needed(arg[2]))
        elif name == "ATOMIC_GROUP":
            best = _better(best, _needed(arg))
    close()
    return best


def required_literals(pattern: str) -> list[str]:
    """Lower-case literals of which every match holds one, whatever its case; empty where none can be told."""
    found = _needed(parser.parse(pattern))
    return sorted(found) if found else []
