"""Conversation repair against a plain version of every row, a plain search for audits, and awkward conversations."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from churnlens.llm import conversations, queries

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, at long, symbol string, audit string, fate int, copy int, id long, cost long"


def best(symbols):
    """(cost, audit) by trying every letter at every row and state; two inserts in a row come back to where they began, so three are enough."""

    @lru_cache(None)
    def go(i, last, inserts=3):
        wanted = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        ways = [(0, "")] if i == len(symbols) and last in ("", "a") else []
        if inserts:
            ways += [(5 + cost, f"I{audit}") for cost, audit in (go(i, new, inserts - 1) for new in wanted if new != "s")]
        if i < len(symbols):
            own, fault = symbols[i]
            extra = 5 * (fault == "truncated")
            steps = [(last, 2, "D")]
            if fault not in ("blank", "duplicate"):
                steps += [(own, extra, "K")] * (own in wanted) + [(new, 1 + extra, "R") for new in wanted if new != "s"]
            for new, paid, letter in steps:
                cost, audit = go(i + 1, new)
                ways.append((paid + cost, letter + audit))
        return min(ways, default=(9**9, ""))

    return go(0, "")


def best_forward(symbols):
    """(cost, audit) by the least (cost, audit) that leads to each state, row by row."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        for _ in range(3):
            for last, (cost, audit) in list(states.items()):
                for new in follow[last].replace("s", ""):
                    states[new] = min(states.get(new, (9**9, "")), (cost + 5, f"{audit}I"))
        return states

    states = inserted({"": (0, "")})
    for own, fault in symbols:
        after, extra = {}, 5 * (fault == "truncated")
        for last, (cost, audit) in states.items():
            ways = [(last, 2, "D")]
            if fault not in ("blank", "duplicate"):
                ways += [(new, extra, "K") for new in follow[last] if new == own] + [(new, 1 + extra, "R") for new in follow[last] if new != "s"]
            for new, paid, letter in ways:
                after[new] = min(after.get(new, (9**9, "")), (cost + paid, audit + letter))
        states = inserted(after)
    return min(states[s] for s in ("", "a") if s in states)


def plain(rows, damage=True):
    """The contract's row for each conv_id, from (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        groups[conv] += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort()
        seen, faults = set(), []
        for _, _, role, text in own:
            end = text.rstrip(" \t\n\x0b\f\r")[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        turns = {t for known, t, _, _ in own if known}
        initials = [r[:1] for _, _, r, _ in own]
        cost, audit = best_forward(list(zip(initials, faults, strict=True)))
        left, last, lines = iter(own), "", []
        for letter in audit:
            role, text = (None, "") if letter == "I" else next(left)[2:]
            if letter == "D":
                continue
            last = role[:1] if letter == "K" else "a" if last == "u" else "u"
            lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def shown(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = shown(queries.op13_conversation_repair(spark, MEDIUM))
    assert got == plain(rows) and len(got) == len({r[0] for r in rows})
    assert {letter for r in got.values() for letter in r[6]} >= set("DKR")


@pytest.mark.parametrize("kinds", ["sua", "suao", "u", "ao"])
def test_audits_are_the_cheapest_and_least(kinds):
    rng = random.Random(kinds)
    for n in [*range(9), 30, 60] * 12:
        some = [(rng.choice(kinds), rng.choice(["", "", "truncated", "blank"])) for _ in range(n)]
        some = [x for x in some for _ in range(rng.choice([1, 1, 1, 3]))]
        runs = []
        for own, fault in some:
            symbol = "x" if fault == "blank" else own.upper() if fault else own
            if runs and runs[-1][0] == symbol:
                runs[-1][1] += 1
            else:
                runs.append([symbol, 1])
        assert conversations.repair(tuple(map(tuple, runs))) == best_forward(some) == (best(tuple(some)) if n < 9 else best_forward(some))


@pytest.mark.parametrize("symbol", "suaoSUAOx")
def test_long_runs(symbol):
    fault = "blank" if symbol == "x" else "truncated" if symbol.isupper() else ""
    for before in ((), (("s", 1),), (("u", 3), ("A", 2))):
        rows = [(s.lower(), "truncated" if s.isupper() else "") for s, n in before for _ in range(n)] + [(symbol.lower(), fault)] * 300
        assert conversations.repair((*before, (symbol, 300))) == best_forward(rows)
    cost, audit = conversations.repair(((symbol, 100_000),))
    assert len(audit.replace("I", "")) == 100_000 and cost > 0


def test_awkward_rows(spark):
    rng = random.Random(3)
    texts = ["Yes.", "Yes.", "No", "", " \n", None, "Why?!  ", "x" * 20_000 + ".", "漢字。", "é."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    rows = [(rng.choice([None, 1, 2, 3, *range(4, 60)]), rng.choice([None, -3, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += [(70, t, None, None) for t in range(3)] + [(71, None, "user", "Hm."), (71, None, "user", "Hm.")] + [(72, -(2**63), "user", "A."), (72, 2**63 - 1, "assistant", "B.")]
    table = spark.createDataFrame([(*r, 1, "s", "K", 0, 0, 7, 8) for r in rows], SCHEMA)
    for damage in (True, False):
        want = plain(rows, damage)
        want[72] = (None if want[72][0] > 2**63 - 1 else want[72][0], *want[72][1:])
        assert shown(conversations.audit_repairs(table, damage)) == want
    assert shown(conversations.audit_repairs(table.limit(0))) == {}


def test_repaired_texts(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi"), (1, 2, "user", "Hi!"), (1, 3, "assistant", "Yes."), (2, 0, "user", " "), (3, 0, "system", "Be kind."), (3, 1, "user", "Who?")]
    got = conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "at").collect()
    lines = {c: [f"{r.role}:{r.text}" for r in got if r.conv_id == c] for c in (1, 2, 3)}
    assert lines[1] == ["user:Hi!", "assistant:Yes."] and lines[2] == [] and lines[3] == ["user:Be kind.", "assistant:Who?"]


def test_one_long_conversation(spark):
    """A conversation of 30,000 rows beside a small one, whole and in order."""
    rows = [(5, i, ("user", "assistant")[i % 7 % 2], f"Line {i}{'.' if i % 5 else ''}") for i in range(30_000)] + [(6, 0, "user", "A."), (6, 1, "assistant", "B.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("x", F.lit(1))
    assert shown(conversations.audit_repairs(table)) == plain(rows)
