"""Answers as JSON rows put into one shape: fences taken off, unambiguous forms repaired, and each repair told. Nothing is invented or dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.functions.exprs import let

# A path with its lines, what comes before a commit's name, other names of a type, and keys that only later stages write.
PATH_LINES = r"(?s)^(.+?):([0-9]+(?:-[0-9]+)?)\z"
COMMIT_PREFIX = r"(?i)^(?:commit|sha)\s*[:=]\s*"
TYPES = {"git": "commit", "sha": "commit"}
OWNED = ["key", "content_hash", "catalog_evidence", "evidence_hashes", "check", "history", "confidence_claimed"]

MAP, LIST = "map<string,variant>", "array<variant>"
_NONE = "array<string>"


def _kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID, OBJECT, ARRAY and so on."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(_kind(v) == kind, F.lit(False))


def _text(v: Column) -> Column:
    """The string a variant is, or null."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _gone(v: Column) -> Column:
    return v.isNull() | _is(v, "VOID")


def _without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def _with(m: Column, key: str, value: Column) -> Column:
    return F.map_concat(_without(m, key), F.create_map(F.lit(key), value))


def _variant(s: Column) -> Column:
    return s.cast("string").cast("variant")


def _step(state: Column, change: Callable[[Column], tuple[Column, Column, Column]]) -> Column:
    """state (m, told) after change(m) = (whether, new m, what is told)."""

    def then(s: Column) -> Column:
        when, m, told = change(s["m"])
        return F.when(F.coalesce(when, F.lit(False)), F.struct(m.cast(MAP).alias("m"), F.concat(s["told"], F.array(told)).alias("told"))).otherwise(s)

    return let(state, then)


def _lines(m: Column) -> Column:
    """The lines that a place names: a whole number, or a string of one or two."""

    def one(v: Column) -> Column:
        whole = F.when(_is(v, "BIGINT"), F.try_variant_get(v, "$", "bigint").cast("string"))
        told = F.trim(_text(v))
        return F.coalesce(whole, F.when(told.rlike(r"^[0-9]+(-[0-9]+)?\z"), told))

    return F.coalesce(one(m["lines"]), one(m["line"]))


def _evidence(v: Column, where: Column) -> Column:
    """(value, told) of one piece of evidence."""
    say = lambda *parts: F.concat(where, *(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))

    def named(m: Column) -> tuple:
        own = _text(m["type"])
        to = F.coalesce(*(F.when(F.lower(F.trim(own)) == k, F.lit(t)) for k, t in TYPES.items()))
        return to.isNotNull(), _with(m, "type", _variant(to)), say(".type ", own, " -> ", to)

    def joined(m: Column) -> tuple:
        ref = m["ref"]
        inner = F.when(_is(ref, "OBJECT"), ref.cast(MAP)).when(_gone(ref), m)
        path, lines = F.trim(_text(inner["file"])), _lines(inner)
        to = F.concat(path, F.lit(":"), lines)
        bare = F.when(_gone(ref), _without(m, "file", "line", "lines")).otherwise(m)
        return (_text(m["type"]) == "code") & (path != "") & lines.isNotNull(), _with(bare, "ref", _variant(to)), say(".ref joined into ", to)

    def moved(m: Column) -> tuple:
        return (_text(m["type"]) == "commit") & _gone(m["ref"]) & _is(m["sha"], "STRING"), _with(_without(m, "sha"), "ref", m["sha"]), say(".sha moved to ref")

    def bared(m: Column) -> tuple:
        own = F.trim(_text(m["ref"]))
        to = F.regexp_replace(own, COMMIT_PREFIX, "")
        return (_text(m["type"]) == "commit") & own.rlike(COMMIT_PREFIX), _with(m, "ref", _variant(to)), say(".ref ", _text(m["ref"]), " -> ", to)

    state = F.struct(v.cast(MAP).alias("m"), F.array().cast(_NONE).alias("told"))
    for change in (named, joined, moved, bared):
        state = _step(state, change)
    done = let(state, lambda s: F.struct(F.to_variant_object(s["m"]).alias("value"), s["told"].alias("told")))
    return F.when(_is(v, "OBJECT"), done).otherwise(F.struct(v.alias("value"), F.array().cast(_NONE).alias("told")))


def _all(values: Column, one: Callable[[Column, Column], Column]) -> Column:
    """(values, told) of an array's values in turn."""
    each = F.transform(values, lambda v, i: one(v, i))
    return let(each, lambda e: F.struct(F.transform(e, lambda x: x["value"]).alias("values"), F.flatten(F.transform(e, lambda x: x["told"])).alias("told")))


def _finding(v: Column, i: Column) -> Column:
    """(value, told) of one finding: its location, then its evidence; keys that are not its own go untold."""
    where = F.concat(F.lit("findings["), i, F.lit("]"))

    def located(m: Column) -> tuple:
        own = F.trim(_text(m["location"]))
        split = own.rlike(PATH_LINES)
        path, lines = F.regexp_extract(own, PATH_LINES, 1), F.regexp_extract(own, PATH_LINES, 2)
        to = F.when(split, F.to_variant_object(F.struct(path.alias("file"), lines.alias("lines")))).otherwise(F.to_variant_object(F.struct(own.alias("file"))))
        return own != "", _with(m, "location", to), F.concat(where, F.lit(".location "), own, F.lit(" -> "), F.when(split, F.concat(path, F.lit(", "), lines)).otherwise(own))

    def proven(s: Column) -> Column:
        held = s["m"]["evidence"]
        every = _all(held.cast(LIST), lambda e, j: _evidence(e, F.concat(where, F.lit(".evidence["), j, F.lit("]"))))
        done = let(every, lambda x: F.struct(_with(s["m"], "evidence", F.to_variant_object(x["values"])).alias("m"), F.concat(s["told"], x["told"]).alias("told")))
        return F.when(_is(held, "ARRAY"), done).otherwise(s)

    def bare(s: Column) -> Column:
        needs = s["m"]["preconditions"]
        open_ = F.transform(needs.cast(LIST), lambda p: F.when(_is(p, "OBJECT"), F.to_variant_object(_without(p.cast(MAP), "confirmation"))).otherwise(p))
        m = F.when(_is(needs, "ARRAY"), _with(s["m"], "preconditions", F.to_variant_object(open_))).otherwise(s["m"])
        return F.struct(F.to_variant_object(_without(m, *OWNED)).alias("value"), s["told"].alias("told"))

    state = _step(F.struct(v.cast(MAP).alias("m"), F.array().cast(_NONE).alias("told")), located)
    done = let(let(state, proven), bare)
    return F.when(_is(v, "OBJECT"), done).otherwise(F.struct(v.alias("value"), F.array().cast(_NONE).alias("told")))


def answer(raw: Column) -> Column:
    """The object that an answer's text holds, as a variant, or null: a fence about it is taken off."""
    own = F.regexp_replace(raw, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(own, r"^[^\n]*\n", ""), r"(?s)(.*)```.*$", "$1")
    doc = F.try_parse_json(F.when(F.startswith(own, F.lit("```")), inner).otherwise(own))
    return F.when(_is(doc, "OBJECT"), doc)


def shaped(doc: Column, stamps: dict[str, Column], defaults: dict[str, Column] | None = None) -> Column:
    """(doc, told) of an answer in its one shape (operator 132): doc as JSON text with keys in order, told the repairs in order.

    `hypotheses` becomes `findings` where there are none; stamps are set, defaults where the key is missing; the repairs are kept in
    the doc as `normalised`. A null doc gives null.
    """

    def renamed(m: Column) -> tuple:
        return ~F.map_contains_key(m, F.lit("findings")) & _is(m["hypotheses"], "ARRAY"), _with(_without(m, "hypotheses"), "findings", m["hypotheses"]), F.lit("renamed top-level hypotheses to findings")

    def found(s: Column) -> Column:
        held = s["m"]["findings"]
        done = let(_all(held.cast(LIST), _finding), lambda x: F.struct(_with(s["m"], "findings", F.to_variant_object(x["values"])).alias("m"), F.concat(s["told"], x["told"]).alias("told")))
        return F.when(_is(held, "ARRAY"), done).otherwise(s)

    def stamped(s: Column) -> Column:
        m = _without(s["m"], "normalised", "validated_with")
        for key, value in (defaults or {}).items():
            m = F.map_concat(_missing(m, key, value), m)
        for key, value in stamps.items():
            m = _with(m, key, _variant(value))
        m = F.when(F.size(s["told"]) > 0, _with(m, "normalised", F.to_variant_object(s["told"]))).otherwise(m)
        return F.struct(F.to_json(F.to_variant_object(m)).alias("doc"), s["told"].alias("told"))

    state = _step(F.struct(doc.cast(MAP).alias("m"), F.array().cast(_NONE).alias("told")), renamed)
    return F.when(doc.isNotNull(), let(let(state, found), stamped))


def _missing(m: Column, key: str, value: Column) -> Column:
    """The key with its value where m lacks it, else nothing."""
    return F.when(F.map_contains_key(m, F.lit(key)), F.create_map().cast(MAP)).otherwise(F.create_map(F.lit(key), _variant(value)))
