"""Ranges that meet, diffs, blame output, briefings and answers on known answers and against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from churnlens.functions import excerpts, shape
from churnlens.operators import evidence, findings, intervals


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def ranges():
    rng = random.Random(11)
    out = [(rng.choice("pqr"), rng.randrange(6), lo := rng.randrange(-5, 200), lo + rng.choice([0, 0, 1, 3, 8, 40, 900, -2])) for _ in range(300)]
    return [*out, *out[:20], ("p", 9, 5, 1 << 40), (None, 1, 1, 2), ("p", None, 1, 2), ("q", 1, None, 2)]


def test_ranges_meet(spark, ranges):
    table = spark.createDataFrame(ranges, "path string, owner long, lo long, hi long")
    own = {r for r in ranges if None not in r and r[2] <= r[3]}
    meets = lambda a, b: a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3]
    want = sorted((*r, sum(meets(r, o) for o in own if o[1] != r[1])) for r in own)
    assert rows(intervals.meetings(table, "owner", "path", "lo", "hi")) == want
    left, right = sorted(own)[::2], sorted(own)[1::3]
    a = spark.createDataFrame(left, "path string, a long, lo long, hi long")
    b = spark.createDataFrame(right, "path string, b long, x long, y long")
    got = rows(intervals.meet(a, b, ["path"], right_range=("x", "y")).select("path", "a", "lo", "hi", "b", "x", "y"))
    assert got == sorted((*p, *q[1:]) for p in left for q in right if meets(p, q))
    pairs = {}
    for p in own:
        for q in own:
            if meets(p, q) and p[1] < q[1]:
                pairs[p[0], p[1], q[1]] = pairs.get((p[0], p[1], q[1]), 0) + 1
    assert rows(findings.overlaps(table, "owner", "path", "lo", "hi")) == sorted((*k, n) for k, n in pairs.items())
    assert rows(intervals.meetings(table.limit(0), "owner", "path", "lo", "hi")) == []


def test_commits_of_ranges(spark, ranges):
    rng = random.Random(2)
    blame = [("p", n, rng.choice(["a", "b", evidence.ZERO_SHA])) for n in range(1, 150)] + [("q", n, "c") for n in range(1, 40)]
    asked = [(i, *r[:1], *r[2:]) for i, r in enumerate(ranges) if None not in r]
    want = []
    for i, path, lo, hi in asked:
        if shas := sorted({s for p, n, s in blame if p == path and lo <= n <= hi and s != evidence.ZERO_SHA}):
            want.append((i, shas))
    got = evidence.introduced(spark.createDataFrame(asked, "key long, path string, lo long, hi long"), spark.createDataFrame(blame, "path string, line long, sha string"), ["key"])
    assert sorted((r.key, r.shas) for r in got.collect()) == want


A, B = "a" * 40, "0123456789abcdef0123456789abcdef01234567"
BLAME = f"{A} 1 1 2\nauthor Ann O\nauthor-time 5\nsummary First: {B} 1 1\nfilename x.py\n\tdef f():\n{A} 2 2\n\t\t{B} 9 9 no head\n{B} 3 3 1\nauthor Bo\nsummary\nfilename x.py\n\t\n{A} 9 4 1\n\tlast"


def test_blame_output(spark):
    table = spark.createDataFrame([("x.py", BLAME), ("e", ""), ("n", None), ("y", "fatal: no such path")], "path string, text string")
    first = f"First: {B} 1 1"
    assert rows(evidence.blamed(table).select("path", "line", "sha", "author", F.coalesce("summary", F.lit("-")), "code")) == [
        ("x.py", 1, A, "Ann O", first, "def f():"), ("x.py", 2, A, "Ann O", first, f"\t{B} 9 9 no head"), ("x.py", 3, B, "Bo", "-", ""), ("x.py", 4, A, "Ann O", first, "last"),
    ]


DIFF = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -3,4 +3,4 @@ def f():
 a
--- removed
+++ added
 b
+c
@@ -20 +21,0 @@
-gone
\\ No newline at end of file
diff --git a/old b/old
deleted file mode 100644
--- a/old
+++ /dev/null
@@ -1,2 +0,0 @@
-one
-two
diff --git a/new b/new
--- /dev/null
+++ b/new
@@ -0,0 +1 @@
+only"""


def test_diff_hunks(spark):
    table = spark.createDataFrame([("s", DIFF), ("e", ""), ("n", None), ("b", "Binary files a/x and b/x differ")], "sha string, diff string")
    got = [tuple(r)[1:] for r in evidence.hunks(table, ["sha"]).orderBy("sha", "hunk", F.coalesce("new_line", "old_line"), "kind").collect()]
    # the first hunk ends short of what its head counts
    assert sorted(got, key=str) == sorted([
        ("x.py", 1, "context", 3, 3, "a"), ("x.py", 1, "removed", 4, None, "-- removed"), ("x.py", 1, "added", None, 4, "++ added"), ("x.py", 1, "context", 5, 5, "b"), ("x.py", 1, "added", None, 6, "c"),
        ("x.py", 2, "removed", 20, None, "gone"), ("old", 3, "removed", 1, None, "one"), ("old", 3, "removed", 2, None, "two"), ("new", 4, "added", None, 1, "only"),
    ], key=str)


def test_briefings_show_what_was_rendered(spark):
    short, long = "a\nb\n", "".join(f"line {i} of it\n" for i in range(200))
    cases = [
        (short, None, None, [(1, 2)]), ("a\r\nb\x0cc", None, None, [(1, 3)]), ("", None, None, [(1, 0)]), (long, None, None, [(1, 9), (198, 200)]), (long, 50, 52, [(35, 43), (65, 67)]), (long, 1, 2, [(1, 10), (15, 17)]),
        (long.replace("\n", "")[:900], None, None, []), (short + "```\n" + short, None, None, [(1, 5)]),
    ]
    table = spark.createDataFrame([(i, t, a, b) for i, (t, a, b, _) in enumerate(cases)], "i int, t string, a long, b long")
    rendered = F.concat(F.lit("# H\n\n"), excerpts.source_block(F.lit("src/a b.py"), F.col("t"), 50, F.when(F.col("a").isNotNull(), "f"), F.col("a"), F.col("b"), "py"), F.lit("## Next\n"))
    got = {r.i: r.s for r in table.select("i", excerpts.shown(rendered).alias("s")).collect()}
    for i, (text, _, _, want) in enumerate(cases):
        assert got[i]["path"] == "src/a b.py"
        if want and len(text) < 600:
            assert [tuple(x) for x in got[i]["ranges"]] == want, i
        # every line said to be shown is whole in the text that was rendered
    shown = {r.i: (r.s["ranges"], r.r) for r in table.select("i", excerpts.shown(rendered).alias("s"), rendered.alias("r")).collect()}
    for i, (text, *_) in enumerate(cases):
        for lo, hi in shown[i][0]:
            assert "\n".join(text.split("\n")[lo - 1 : hi]) in shown[i][1]
    assert [len(shown[i][0]) for i in (3, 4, 5)] == [2, 2, 2] and shown[6][0] == []
    odd = ["", "no block", "## Source — `a`\n\n_lines of it_\n\n```\nx\n```\n", "## Source — `a`\n\n_whole file, 3 lines_\n\nno fence\n", None, "## Source — `a`\n\n_file trimmed to fit the budget; 9 lines total_\n\n```\na\n\n... [x: 1 characters omitted] ...\n\nb\n\n... [x: 1 characters omitted] ...\n\nc\n```\n"]
    assert [r[0] for r in spark.createDataFrame([(o,) for o in odd], "t string").select(excerpts.shown(F.col("t"))).collect()] == [None] * len(odd)


ANSWERS = [
    ('{"hypotheses":[{"location":"a.py:4-9","key":"x","evidence":[{"type":" Git ","sha":"commit: abc"},{"type":"code","file":" b.py ","line":7,"n":1},{"type":"code","ref":{"file":"c.py","lines":"3-9"}},5]}, 3]}',
     {"findings": [{"location": {"file": "a.py", "lines": "4-9"}, "evidence": [{"type": "commit", "ref": "abc"}, {"type": "code", "ref": "b.py:7", "n": 1}, {"type": "code", "ref": "c.py:3-9"}, 5]}, 3]}, 7),
    ('```json\n{"findings":[{"location":"x.py"}],"file":"own"}\n```\n', {"findings": [{"location": {"file": "x.py"}}], "file": "own"}, 1),
    ('{"findings":[{"location":" ","evidence":[{"type":"code","file":"d","line":true},{"type":"code","file":"d","lines":"4-"},{"type":"commit","ref":"def"},{"type":"note"}],"preconditions":[{"setting":"s","confirmation":"x"},1]}]}',
     {"findings": [{"location": " ", "evidence": [{"type": "code", "file": "d", "line": True}, {"type": "code", "file": "d", "lines": "4-"}, {"type": "commit", "ref": "def"}, {"type": "note"}], "preconditions": [{"setting": "s"}, 1]}]}, 0),
    ('{"findings":{},"hypotheses":[1],"validated_with":1,"normalised":["old"]}', {"findings": {}, "hypotheses": [1]}, 0), ("[1]", None, None), ("no", None, None), (None, None, None), ("```\n", None, None), ("", None, None),
]


def test_answers_get_one_shape(spark):
    table = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(ANSWERS)], "i int, a string")
    got = {r.i: r.s for r in table.select("i", shape.shaped(shape.answer(F.col("a")), {"bundle_hash": F.lit("h")}, {"file": F.lit("f.py")}).alias("s")).collect()}
    for i, (_, want, repairs) in enumerate(ANSWERS):
        if want is None:
            assert got[i] is None
            continue
        doc = json.loads(got[i]["doc"])
        assert len(got[i]["told"]) == repairs and doc.pop("normalised", []) == got[i]["told"] and doc.pop("bundle_hash") == "h"
        assert doc == {"file": "f.py"} | want
        again = shape.shaped(shape.answer(F.lit(got[i]["doc"])), {"bundle_hash": F.lit("h")})
        assert spark.range(1).select(again["told"]).first()[0] == []
