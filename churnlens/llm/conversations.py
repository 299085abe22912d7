"""Operator 13: repair of damaged conversations by a run-length dynamic programme.

Every row of a conversation is a symbol of role and fault. Equal symbols in a row are one run; a run is crossed by the binary powers of its
symbol's min-plus matrix over the grammar's states, which are made once and kept. That gives the cheapest cost from each run's start to the
conversation's end, and the choices are then unrolled from the front, at each row the ASCII-least letter among the cheapest.

Faults, order and counts are Spark's windows and sums. The programme sees one symbol a row, never a text. The repaired text is hashed while it
streams by behind its own audit, so that no task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import BLANKS, staged

#: States of the grammar (s?(ua)+)?: nothing yet, after system, after user, after assistant; a conversation may end in ENDS.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: What may follow, by the initials of roles.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
INF = 1 << 60
#: Runs of conversations whose audits a worker keeps.
AUDITS = 200_000


def step_choices(symbol: str) -> list[list[tuple[str, int, int, str]]]:
    """For each state the ways to take one row: letter, cost, next state, initial that it gets ('' if deleted).

    A symbol is a lower-case initial (s, u, a, or o for any other), in capitals where the row is truncated; x must go.
    """
    initial, extra = symbol.lower(), TRUNCATED * symbol.isupper()
    out = []
    for state in range(4):
        here = [("D", DELETE, state, "")]
        if symbol != "x":
            here += [("K", KEEP + extra, to, i) for i, to in NEXT[state].items() if i == initial]
            here += [("R", REROLE + extra, to, i) for i, to in NEXT[state].items() if i in ROLES]
        out.append(here)
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product."""
    return np.minimum((a[:, :, None] + b[None]).min(1), INF)


def _inserts() -> np.ndarray:
    """The cheapest way from each state to each by inserting alone."""
    one = np.full((4, 4), INF)
    np.fill_diagonal(one, 0)
    for state in range(4):
        for initial, to in NEXT[state].items():
            if initial in ROLES:
                one[state, to] = INSERT
    return times(times(one, one), times(one, one))


INSERTS = _inserts()
FINAL = times(INSERTS, np.where(np.isin(np.arange(4), ENDS), 0, INF)[:, None])


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> np.ndarray:
    """The cost of crossing 2**k rows of one symbol, inserts before each included; from state to state."""
    if k:
        return times(half := power(symbol, k - 1), half)
    row = np.full((4, 4), INF)
    for state, choices in enumerate(step_choices(symbol)):
        for _, cost, to, _ in choices:
            row[state, to] = min(row[state, to], cost)
    return times(INSERTS, row)


def cross(symbol: str, n: int, after: np.ndarray) -> np.ndarray:
    """Costs to the end from before n rows of a symbol, from those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = times(power(symbol, k), after)
    return after


@lru_cache(maxsize=AUDITS)
def repair(runs: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """Cost and audit of a conversation's runs (symbol, rows)."""
    ends = [FINAL]
    for symbol, n in reversed(runs):
        ends.append(cross(symbol, n, ends[-1]))
    ends.reverse()
    state, audit, left = START, [], int(ends[0][START, 0])
    cost = left
    for at, (symbol, n) in enumerate(runs):
        choices = [[c[:3] for c in here] for here in step_choices(symbol)]
        behind = [ends[at + 1]]  # costs with so many rows of the run to go
        while len(behind) <= n and (len(behind) < 3 or not _alike(behind)):
            behind.append(times(power(symbol, 0), behind[-1]))
        for row in range(n):
            (here, more), (after, more_after) = _behind(behind, n - row), _behind(behind, n - row - 1)
            letter = "I"
            while letter == "I":
                best = [c for c in choices[state] if c[1] + int(after[c[2], 0]) + more_after == left]
                best += [("I", INSERT, to) for to in _insertable(state) if INSERT + int(here[to, 0]) + more == left]
                letter, paid, state = min(best)
                audit.append(letter)
                left -= paid
    return cost, "".join(audit) + "I" * (left // INSERT)


def _insertable(state: int) -> list[int]:
    return [to for initial, to in NEXT[state].items() if initial in ROLES]


def _alike(behind: list[np.ndarray]) -> bool:
    """Whether the last two rows added the same to every state as the two before the last: costs go up by a fixed step of two rows."""
    gain = behind[-1] - behind[-3]
    return bool((gain == gain[START]).all())


def _behind(behind: list[np.ndarray], to_go: int) -> tuple[np.ndarray, int]:
    """Costs behind a row with so many of its run to go, and what is to be added to each."""
    if to_go < len(behind):
        return behind[to_go], 0
    over = -(-(to_go - len(behind) + 1) // 2)
    return behind[to_go - 2 * over], over * int((behind[-1] - behind[-3])[START, 0])


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of a table's rows after the stated damage; null roles and texts are one blank."""
    def null_blank(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(null_blank(rows["conv_id"]), F.lit(":"), null_blank(rows["turn"])).cast("binary")) % 20
    role, text = null_blank(rows["role"]), null_blank(rows["text"])
    hurt = rows.select(
        rows["conv_id"].cast("long").alias("conv_id"),
        rows["turn"].cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        fate.alias("fate"),
    ).where("fate <> 0")
    return hurt.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn, role, text, symbol, fault, illegal, new_turn of conversation rows (conv_id, turn, role, text, copy).

    at counts a conversation's rows from 1 by turn (nulls first), role and text; rows equal in all three are alike. Windows spill; a text that
    repeats is compared by role and MD5.
    """
    by = Window.partitionBy("conv_id")
    ordered = rows.withColumn("at", F.row_number().over(by.orderBy(F.asc_nulls_first("turn"), "role", "text", "copy")))
    same = F.struct("role", F.md5(F.col("text").cast("binary")))
    seen = ordered.withColumn("times", F.row_number().over(Window.partitionBy("conv_id", same).orderBy("at")))
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("times") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    marked = seen.withColumns({"fault": fault, "initial": initial})
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    in_order = by.orderBy("at")
    before = F.lag("initial").over(in_order)
    turn_before = F.lag("turn").over(in_order)
    return marked.select(
        "conv_id", "at", "turn", "role", "text", symbol.alias("symbol"), "fault",
        (before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & (turn_before.isNull() | (turn_before != F.col("turn")))).alias("new_turn"),
    )


def _conversations(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """The rows of a sorted partition as tuples, batch by batch."""
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, cost, audit from conv_id, symbol in order. Of a conversation its runs are held."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["conv_id", "cost", "audit"])

    for conv_id, rows in groupby(_conversations(batches, 2), key=lambda r: r[0]):
        runs = tuple((symbol, sum(1 for _ in same)) for symbol, same in groupby(r[1] for r in rows))
        out.append((conv_id, *repair(runs)))
        if len(out) >= 5000:
            yield flush()
    if out:
        yield flush()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, at, role, text of the repaired conversations, from a conversation's audit (at 0) and its rows (conv_id, at, role, text, audit)."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "at", "role", "text"])

    for conv_id, rows in groupby(_conversations(batches, 5), key=lambda r: r[0]):
        audit, state, at = iter(next(rows)[4]), START, 0
        held = 0
        # the audit's end stands for the rows' end: only inserts are left then
        for letter in audit:
            role = text = None
            if letter != "I":
                _, _, role, text, _ = next(rows)
            if letter == "D":
                continue
            if letter == "K":
                state = NEXT[state][role[:1]]
            else:
                ((initial, state),) = ((i, to) for i, to in NEXT[state].items() if i in ROLES)
                role, text = ROLES[initial], text or ""
            at += 1
            out.append((conv_id, at, role, text))
            held += len(text)
            if held > 1 << 22 or len(out) >= 5000:
                yield flush()
                held = 0
    if out:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, repaired_sha256 of repaired rows as they stream by."""
    out: list[tuple[int, str]] = []

    def flush() -> pa.RecordBatch:
        ids, digests = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])

    for conv_id, rows in groupby(_conversations(_repaired(batches), 4), key=lambda r: r[0]):
        digest = hashlib.sha256()
        for _, at, role, text in rows:
            digest.update(f"{chr(10) if at > 1 else ''}{role}:{text}".encode())
        out.append((conv_id, digest.hexdigest()))
        if len(out) >= 5000:
            yield flush()
    if out:
        yield flush()


def audits(marked: DataFrame) -> DataFrame:
    """conv_id, cost, audit of conversations as `faults` marks them."""
    return marked.select("conv_id", "symbol", "at").repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "symbol").mapInArrow(_audits, "conv_id long, cost long, audit string")


def _behind_audits(marked: DataFrame, found: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    heads = found.select("conv_id", F.lit(0).alias("at"), nothing.alias("role"), nothing.alias("text"), "audit")
    return heads.unionByName(marked.select("conv_id", "at", "role", "text", nothing.alias("audit"))).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, at, role, text of conversations put right at the least cost; rows: conv_id, turn, role, text (nulls: one blank).

    The result's roles begin with the initials of (s?(ua)+)? in turn. A conversation of which nothing is left has no rows.
    """
    marked = staged(faults(_as_rows(rows)))
    return _behind_audits(marked, audits(marked)).mapInArrow(_repaired, "conv_id long, at long, role string, text string")


def _as_rows(rows: DataFrame) -> DataFrame:
    blank = lambda name: F.coalesce(rows[name].cast("string"), F.lit(" ")).alias(name)
    return rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), blank("role"), blank("text"), F.lit(0).alias("copy"))


def audit_repairs(rows: DataFrame, damage: bool = True) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, of its rows after the stated damage (or as they are).

    rows: conv_id, turn, role, text; null roles and texts are one blank, a null conv_id is a conversation of its own, rows of one turn are in the
    order of role and text. Faults count once a row, the first of blank, duplicate (role and text seen earlier) and truncated. gaps beyond a long
    is null. A conversation with no row left has zeros, an empty audit and the hash of nothing. Other columns are not read; an empty table gives no rows.
    """
    marked = staged(faults(damaged(rows) if damage else _as_rows(rows)))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_if("new_turn"))
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    sums = marked.groupBy("conv_id").agg(gaps.try_cast("long").alias("gaps"), F.max("turn").alias("_last"), count("blank"), count("duplicate"), count("truncated"), F.count_if("illegal").alias("illegal"))
    found = staged(audits(marked))
    texts = _behind_audits(marked, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    ids = rows.select(rows["conv_id"].cast("long").alias("id")).distinct()
    out = ids
    for n, part in enumerate((sums, found, texts)):
        key = f"id{n}"
        out = out.join(part.withColumnRenamed("conv_id", key), F.col("id").eqNullSafe(F.col(key)), "left").drop(key)
    zero = F.lit(0).cast("long")
    whole = [F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("_last").isNull(), zero).otherwise(F.col("gaps")).alias("gaps")
    return out.select(F.col("id").alias("conv_id"), gaps, *whole, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
