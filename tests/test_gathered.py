"""What ranges meet, as lists in place of pairs."""

import random

from churnlens.operators import evidence, findings, intervals


def test_ranges_gather_lists_without_pairs(spark):
    rng = random.Random(4)
    span = lambda n: (lo := rng.randrange(-3, 3000), lo + rng.choice([-1, 0, 1, 5, 40, 300, 2500]) % n)
    asked = [(k, k % 2, *span(4000)) for k in range(300)]
    held = [(p % 2, p, *span(400)) for p in range(400)]
    left, right = spark.createDataFrame(asked, "k long, path int, lo long, hi long"), spark.createDataFrame(held, "path int, v int, lo long, hi long")
    rows = intervals.gathered(left, right, ["path"], ["k"], "v").collect()
    got = {}
    for r in rows:
        got.setdefault(r["k"], set()).update(r["met"])
    want = {k: {v for q, v, c, d in held if q == p and a <= d and c <= b and a <= b and c <= d} for k, p, a, b in asked}
    assert got == {k: w for k, w in want.items() if w}
    assert len(rows) < 2000 < sum(map(len, want.values()))
    assert intervals.gathered(left.limit(0), right, ["path"], ["k"], "v").collect() == []


def test_blame_is_the_same_by_numbers_and_by_names(spark, monkeypatch):
    asked = spark.createDataFrame([(k, "p", k, k + 50) for k in range(100)] + [(7, "q", 1, 3), (8, "q", 5, 4)], "key long, path string, lo long, hi long")
    blame = spark.createDataFrame([("p", n, f"{n % 40:040x}") for n in range(1, 120)] + [("q", 2, "f" * 40), ("q", 3, None)], "path string, line long, sha string")
    told = lambda: {r["key"]: r["shas"] for r in evidence.introduced(asked, blame, ["key"]).collect()}
    numbers = told()
    assert numbers[0] == [f"{n:040x}" for n in range(1, 40)] and "f" * 40 in numbers[7] and 8 in numbers
    monkeypatch.setattr(evidence, "BROADCAST_ROWS", 1)
    assert told() == numbers


def test_meetings_are_counted_in_one_deal(spark):
    ranges = [(o % 7, o % 3, o % 11, o % 11 + o % 5 - 1) for o in range(200)] + [(None, 1, 1, 2), (1, None, 1, 2), (1, 1, None, 2)]
    told = intervals.meetings(spark.createDataFrame(ranges, "o long, p long, lo long, hi long"), "o", "p", "lo", "hi")
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    own = {r for r in ranges if None not in r and r[2] <= r[3]}
    assert {(r["owner"], r["path"], r["lo"], r["hi"]): r["others"] for r in told.collect()} == {(o, p, a, b): sum(q == p and w != o and a <= d and c <= b for w, q, c, d in own) for o, p, a, b in own}


def test_pairs_of_single_ranges_are_not_dealt_out_again(spark):
    ranges = [(o % 60, o % 4, o % 37, o % 37 + o % 9 - 1) for o in range(300)] + [(100 + o, 9, o, o + 3) for o in range(50)]
    told = findings.overlaps(spark.createDataFrame(ranges, "o long, p long, lo long, hi long"), "o", "p", "lo", "hi")
    own = sorted({r for r in ranges if r[2] <= r[3]})
    want = {}
    for i, (o, p, a, b) in enumerate(own):
        for w, q, c, d in own[i + 1 :]:
            if q == p and w != o and a <= d and c <= b:
                key = (p, min(o, w), max(o, w))
                want[key] = want.get(key, 0) + 1
    got = told.collect()
    assert {(r["path"], r["owner_a"], r["owner_b"]): r["meetings"] for r in got} == want and len(got) == len(want)
    alone = findings.overlaps(spark.createDataFrame([(o, 1, o, o + 3) for o in range(50)], "o long, p long, lo long, hi long"), "o", "p", "lo", "hi")
    assert alone.where("meetings = 1").count() == 49 + 48 + 47


def test_evidence_is_read_once(spark):
    """References are taken apart once and staged, not again for each question that is asked of them."""
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    sha = "a" * 40
    cited = table([(1, 1, "code", "p:2-3", None), (1, 2, "commit", sha[:12], "introduced"), (2, 1, "commit", sha[:12], "changed"), (2, 2, None, "x", None)], "finding long, i int, type string, ref string, role string")
    refs, none = table([("A1@p:2",)], "ref string"), table([], "finding long, path string")
    told = evidence.resolved(cited, none, table([("p", 9)], "path string, n_lines long"), refs, refs, table([(sha,)], "sha string"), table([(sha, "p")], "sha string, path string"), table([("p", 3, sha)], "path string, line long, sha string"))
    assert "([0-9]+)(?:-" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["finding"], r["i"]): r["problem"] for r in told.collect()} == {(1, 1): None, (1, 2): None, (2, 1): None, (2, 2): "type is unknown"}
