"""Checks of documents as a table: every error of a row in one pass, in the order of the checks."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """One check of a field, named by its path (`a.b` for a field in a struct, `list[].b` for a field of each element of a list).

    rule: `present` (not null), `text` (holds more than blanks), `one_of` (among values), `known` (all elements of a list among values), `some` (a list with
    an element), `most` (a list of at most n), `matches` (a pattern), `between` (n to m), `unknown_keys` (a map or struct list of keys among values),
    `expression` (a condition of the row in SQL that must be true). optional: a null passes. when: a condition in SQL without which the check is not made.
    """

    field: str
    rule: str
    values: tuple[str, ...] = ()
    pattern: str | None = None
    n: float | None = None
    m: float | None = None
    optional: bool = False
    when: str | None = None
    message: str | None = None


def checks_from(table: DataFrame) -> list[Check]:
    """Checks from a table with the columns of Check, some or all, in the order of its column ord; such a table is small."""
    known = {f.name for f in fields(Check)} & set(table.columns)
    rows = sorted(table.collect(), key=lambda r: r["ord"])
    return [Check(**{k: tuple(v) if k == "values" else v for k, v in r.asDict().items() if k in known and v is not None}) for r in rows]


def _fails(check: Check, value: Column) -> Column:
    """Whether a value breaks a check; a null does, unless the check is optional."""
    among = lambda x: F.coalesce(x.cast("string").isin(*check.values), F.lit(False))
    broken = {
        "present": lambda: F.lit(False),
        "text": lambda: F.trim(value.cast("string")) == "",
        "one_of": lambda: ~among(value),
        "known": lambda: F.exists(value, lambda x: ~among(x)),
        "unknown_keys": lambda: F.exists(value, lambda x: ~among(x)),
        "some": lambda: F.size(value) == 0,
        "most": lambda: F.size(value) > check.n,
        "matches": lambda: ~value.cast("string").rlike(check.pattern),
        "between": lambda: (value < check.n) | (value > check.m),
    }[check.rule]()
    return F.when(value.isNull(), F.lit(not check.optional)).otherwise(F.coalesce(broken, F.lit(True)))


#: What is said of each rule's failure.
SAYS = {"present": "is missing", "text": "must be a non-empty string", "one_of": "is not one of {values}", "known": "contains something not in {values}", "unknown_keys": "has a key that is not one of {values}", "some": "must be a non-empty list", "most": "has more than {n} elements", "matches": "is not of the form {pattern}", "between": "is not between {n} and {m}", "expression": "does not hold: {field}"}


def _said(check: Check) -> str:
    return check.message or SAYS[check.rule].format(values=", ".join(check.values), n=check.n, m=check.m, pattern=check.pattern, field=check.field)


def _errors(check: Check) -> Column:
    """An array of (at, message) of one check on a row; at is where the error is."""
    error = lambda at: F.struct(at.alias("at"), F.lit(_said(check)).alias("message"))
    none = F.array().cast("array<struct<at:string,message:string>>")
    if check.rule == "expression":
        found = F.when(~F.coalesce(F.expr(check.field), F.lit(False)), F.array(error(F.lit("")))).otherwise(none)
    elif "[]" in check.field:
        of, _, rest = check.field.partition("[]")
        each = F.transform(F.col(of), lambda x, i: F.when(_fails(check, _deep(x, rest)), error(F.concat(F.lit(f"{of}["), i.cast("string"), F.lit(f"]{rest}")))))
        found = F.coalesce(F.filter(each, lambda e: e.isNotNull()), none)
    else:
        found = F.when(_fails(check, F.col(check.field)), F.array(error(F.lit(check.field)))).otherwise(none)
    return F.when(F.coalesce(F.expr(check.when), F.lit(False)), found).otherwise(none) if check.when else found


def _deep(x: Column, path: str) -> Column:
    for name in filter(None, path.split(".")):
        x = x.getField(name)
    return x


def errors(checks: list[Check]) -> Column:
    """All errors of a row, an array of (at, message) in the order of the checks (operators 133 and 137)."""
    return F.concat(*map(_errors, checks)) if checks else F.array().cast("array<struct<at:string,message:string>>")


def problems(rows: DataFrame, checks: list[Check], keys: list[str]) -> DataFrame:
    """keys, n, at, message: a row for each error, numbered from 1 within its row. Rows are read once and never shuffled."""
    told = rows.select(*keys, F.posexplode(errors(checks)).alias("_n", "_e"))
    return told.select(*keys, (F.col("_n") + 1).alias("n"), F.col("_e")["at"].alias("at"), F.col("_e")["message"].alias("message"))


def set_problems(rows: DataFrame, key: str, refers: str) -> DataFrame:
    """key, problem of rows that break what holds between rows (operator 137): a key that repeats, or a reference to itself, to a row that is not there,
    or to a row that refers on. Counts are combined before they are shuffled."""
    known = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_times"), F.max(refers).alias("_on"))
    own = rows.join(known.select(F.col("_key").alias(key), "_times"), key, "left")
    to = known.select(F.col("_key").alias("_to"), "_on")
    both = own.join(to, F.col(refers) == F.col("_to"), "left")
    problem = (
        F.when(F.col(key).isNull(), "has no key")
        .when(F.col("_times") > 1, "key repeats")
        .when(F.col(refers) == F.col(key), "refers to itself")
        .when(F.col(refers).isNotNull() & F.col("_to").isNull(), "refers to nothing")
        .when(F.col("_on").isNotNull(), "refers to a row that refers on")
    )
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL").distinct()
