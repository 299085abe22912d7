"""Known answers and edge cases of the column builders and operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from churnlens.functions import exprs
from churnlens.operators import evidence, findings, history, leads, rules, usage


def one(spark, ddl, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_wilson_known_answers(spark):
    rows = [(15, 21), (8, 21), (4, 9), (0, 21), (0, 0)]
    assert one(spark, "k int, n int", rows, *exprs.wilson(F.col("k"), F.col("n"))) == [(50, 86), (21, 59), (19, 73), (0, 15), (0, 100)]


def test_normalise(spark):
    for values, want in (([1.0, 3.0, 2.0], [0.05, 1.0, 0.525]), ([2.0, 2.0], [1.0, 1.0])):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert [round(r[0], 6) for r in df.select(exprs.normalised(F.col("v"), *history.extremes(df, "v"))).collect()] == want


def test_paths_and_globs(spark):
    paths = [("",), (None,), ("/a",), ("a\\b",), ("a/../b",), ("./a",), ("a//b",), ("a/b",), ("C:/x",)]
    canonical, climbs = "is not in canonical form (empty or '.' segment, or a trailing '/')", "climbs out of the repository with '..'"
    assert [r[0] for r in one(spark, "p string", paths, exprs.path_problem(F.col("p")))] == ["is empty", "is empty", "is absolute", "contains a backslash", climbs, canonical, canonical, None, "is absolute"]
    assert re.match(exprs.glob_pattern("*.p?"), "a.py") and not re.match(exprs.glob_pattern("*.p?"), "d/a.py")
    assert re.match(exprs.glob_pattern("**/x*.c", across=True), "a/b/xy.c") and re.match(exprs.glob_pattern("**/x*.c", across=True), "x.c")


@pytest.mark.parametrize(("value", "want"), [("42", (42, 42)), ("4-9", (4, 9)), ("9-4", (None, None)), ("0", (None, None)), ("4-", (None, None)), ("x", (None, None)), (None, (None, None)), ("99999999999999999999", (None, None))])
def test_ranges(spark, value, want):
    assert one(spark, "v string", [(value,)], *exprs.parse_range(F.col("v"))) == [want]


def test_confidence(spark):
    rows = [("high", "upheld"), ("high", "narrowed"), ("medium", "narrowed"), ("high", "refuted"), ("odd", "upheld"), ("high", "unchecked"), ("low", "narrowed"), ("high", "inconclusive"), ("high", "unheard of"), (None, None)]
    assert [r[0] for r in one(spark, "c string, s string", rows, exprs.effective_confidence(F.col("c"), F.col("s")))] == ["high", "medium", "low", "low", "low", "medium", "low", "medium", "medium", "low"]


def test_cache_states(spark):
    rows = [(None, False, False), (None, True, False), (3, False, False), (3, False, True), (3, True, True), (15, True, False), (15, False, False), (25, True, False)]
    got = one(spark, "a int, f boolean, r boolean", rows, usage.cache_state(F.col("a"), F.col("f"), 10, F.col("r")))
    assert [r[0] for r in got] == ["fresh", "failed", "cached", "fresh", "stale", "stale", "fresh", "failed"]


def test_values(spark):
    rows = [(None,), ("",), (" NULL ",), ("True",), ("-1.5",), ("250 ms",), ("3s",), ("inf",), ("a  B",), ("1.",)]
    got = [(r["type"], r["num"], r["infinite"], r["unit"], r["txt"]) for (r,) in one(spark, "v string", rows, exprs.normalised_value(F.col("v")))]
    assert got == [("none", None, False, None, None), ("text", None, False, None, ""), ("none", None, False, None, None), ("bool", None, False, None, "true"), ("number", -1.5, False, None, None), ("number", 0.25, False, "s", None), ("number", 3.0, False, "s", None), ("number", None, True, None, None), ("text", None, False, None, "a b"), ("text", None, False, None, "1.")]
    pairs = [("250ms", "0.25 s", True), ("1", "1 s", True), ("inf", "Infinity", True), ("inf", "1", False), ("true", "false", False), ("A b", "a  B", True), (None, "none", True), ("", None, False)]
    match = exprs.values_match(exprs.normalised_value(F.col("a")), exprs.normalised_value(F.col("b")))
    assert [r[0] for r in one(spark, "a string, b string, w boolean", pairs, match)] == [w for *_, w in pairs]


def test_gates_and_verdicts(spark):
    ddl = "p array<struct<needs: string, state: string, basis: string>>, s string, c array<struct<field: string, setting: string>>"
    rows = [([("changed", None, None)], "upheld", []), ([], "narrowed", [("preconditions", "x")]), ([], "upheld", [("preconditions", "x")]), ([("default", "unconfirmed", "not_checked")], "upheld", []),
            ([("default", "unconfirmed", "contradicted")], "narrowed", [("failure_mode", None)]), ([("default", "confirmed", "contradicted")], "refuted", []), (None, None, None), ([], "narrowed", [("preconditions", "x"), ("failure_mode", None)])]
    df = spark.createDataFrame(rows, ddl).withColumn("g", findings.gate(F.col("p"), F.col("s"), F.col("c")))
    got = [tuple(r) for r in df.select("g", findings.run_verdict(F.col("s"), F.col("g"), F.col("c"))).collect()]
    assert got == [("non_default_setting", "upheld_but_gated"), ("non_default_setting", "upheld_but_gated"), ("none", "upheld"), ("none", "upheld"), ("unconfirmed_default", "narrowed"), ("none", "refuted"), ("none", None), ("non_default_setting", "narrowed")]


def test_fences(spark):
    assert [r[0] for r in one(spark, "t string", [("a",), ("````",), ("`",), (None,)], exprs.fence_length(F.col("t")))] == [3, 5, 3, 3]


def test_duplicate_closure(spark):
    f = spark.createDataFrame([(k, i) for i, k in enumerate("edcba")] + [("z", 9)], "key string, ord int")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("e", "nobody"), ("d", "d"), ("z", None)], "key string, duplicate_of string")
    got = {tuple(r) for r in findings.duplicate_closure(f, links, "key", [F.col("ord")]).collect()}
    assert got == {("a", "c"), ("b", "c")}


def test_ranges_are_covered_in_one_pass(spark):
    rng = random.Random(4)
    need = [(k, lo, lo + rng.randrange(6)) for k in range(20) for lo in rng.sample(range(40), 4)]
    have = [(k, lo, lo + rng.randrange(9)) for k in range(18) for lo in rng.sample(range(40), rng.randrange(1, 9))]
    got = {r["k"]: (r["all_inside"], r["all_meet"], r["ranges"]) for r in findings.covered(spark.createDataFrame(need, "k long, lo long, hi long"), spark.createDataFrame(have, "k long, lo long, hi long"), "k").collect()}
    for k in range(20):
        own, there = {x[1:] for x in need if x[0] == k}, [x[1:] for x in have if x[0] == k]
        assert got[k] == (all(any(a <= lo and hi <= b for a, b in there) for lo, hi in own), all(any(a <= hi and lo <= b for a, b in there) for lo, hi in own), len(own))


def test_escape_and_clip(spark):
    assert one(spark, "t string", [("<a>&  ",)], exprs.escape_markup(F.col("t"))) == [("\\u003ca\\u003e\\u0026\\u2028\\u2029",)]
    text = one(spark, "t string", [("x" * 100,)], exprs.clip(F.col("t"), 10))[0][0]
    assert text.startswith("x" * 28 + "\n\n... [trimmed: 62 characters omitted] ...\n\n") and text.endswith("x" * 10)


def test_framed_leads_equal_window_frames(spark):
    docs = spark.createDataFrame([(1, "a\nb1\nc\nb2\nd\n"), (2, "b\n"), (3, ""), (4, None), (5, "b\na")], "doc_id long, text string")
    fast = leads.framed_leads(docs, "b", -1, 1, absent="a").select("doc_id", "line_no").collect()
    slow = leads.framed(leads.lines(docs), -1, 1).where("line RLIKE 'b' AND NOT frame RLIKE 'a'").select("doc_id", "line_no").collect()
    assert sorted(fast) == sorted(slow) == [(1, 4), (2, 1)]
    for hit in ("^$", r"\Ab", r"b\d\z", "(?<!x)c$", "^[^a]"):
        fast = leads.framed_leads(docs, hit, -1, 1).select("doc_id", "line_no").collect()
        slow = leads.framed(leads.lines(docs), -1, 1).where(F.col("line").rlike(hit)).select("doc_id", "line_no").collect()
        assert sorted(fast) == sorted(slow) and fast


def test_coupling_counts_small_baskets_only(spark):
    rows = [(c, p) for c in range(8) for p in ("a", "b")] + [(100, f"f{i}") for i in range(60)] + [(100, "a"), (101, "a"), (0, "a")]
    got = history.coupling(spark.createDataFrame(rows, "sha int, path string")).collect()
    assert [tuple(r) for r in got] == [("a", "b", 8, 8, 1.0)]


def test_overlaps_once_each(spark):
    rows = [("x", "p", 1, 30), ("y", "p", 25, 60), ("z", "p", 31, 31), ("y", "q", 1, 9), ("x", "p", 1, 30)]
    got = sorted(tuple(r) for r in findings.overlaps(spark.createDataFrame(rows, "o string, p string, lo long, hi long"), "o", "p", "lo", "hi").collect())
    assert got == [("p", "x", "y", 1), ("p", "y", "z", 1)]


def test_last_response_and_empty_tables(spark):
    ddl = "message long, pos long, tokens long"
    got = usage.last_response(spark.createDataFrame([(1, 1, 5), (1, 3, 7), (1, 2, 6), (None, 4, 1), (None, 5, 1)], ddl), "message", "pos").collect()
    assert sorted((r["message"] or 0, r["tokens"]) for r in got) == [(0, 1), (0, 1), (1, 7)]
    assert usage.last_response(spark.createDataFrame([], ddl), "message", "pos").count() == 0


def test_dependency_references(spark):
    refs = ["pypi:kombu@5.7.0a1:kombu/utils.py:318-332", "npm:@a/b@1.0:x.js:3", "npm:@a/b@2.0:x.js:3", "npm:@a/b@1.0:y.js:3", "npm:@a/b@1.0:x.js:4-2", "npm:@a/b@1.0:../x.js:1", "npm:gone@1:x:1", "npm:none", "", None, "npm:@a/b@1.0:x.js:9-11"]
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    packages = spark.createDataFrame([("pypi:kombu", "5.7.0a1", "available"), ("npm:@a/b", "1.0", "available"), ("npm:gone", "1", "missing")], "id string, version string, status string")
    files = spark.createDataFrame([("pypi:kombu", "kombu/utils.py", 400), ("npm:@a/b", "x.js", 10)], "id string, path string, n_lines long")
    got = {r["ref"]: (r["problem"], r["first"], r["last"]) for r in evidence.dependency_refs(df, packages, files).collect()}
    assert got["pypi:kombu@5.7.0a1:kombu/utils.py:318-332"] == (None, 318, 332) and got["npm:@a/b@1.0:x.js:3"] == (None, 3, 3)
    wrong = ["was read at another version", "no such file", "lines are outside the file", "climbs out of the repository with '..'", "is not an available dependency", *["is not a dependency reference"] * 3, "lines are outside the file"]
    assert [got[r][0] for r in refs[2:]] == wrong


def test_excerpts_fill_the_budget(spark):
    rng = random.Random(8)
    rows = [(p, rng.random(), lo, lo + rng.randrange(30), 120) for p in range(30) for lo in rng.sample(range(1, 110), rng.randrange(1, 9))]
    got = {}
    for r in evidence.excerpts(spark.createDataFrame(rows, "path long, rank double, lo long, hi long, n_lines long"), 40).collect():
        got.setdefault(r["path"], []).append((r["lo"], r["hi"]))
    for p in range(30):
        shown, stop = [], False
        for _, _, lo, hi, n in sorted(x for x in rows if x[0] == p):
            own = range(max(1, lo - 3), min(n, hi + 3) + 1)
            new = [x for x in own if x not in shown]
            room = 40 - len(shown)
            if not stop and len(new) > room:
                shown, stop = shown + (list(own[:room]) if room > 5 else []), True
            elif not stop:
                shown += new
        assert sorted(x for a, b in got.get(p, []) for x in range(a, b + 1)) == sorted(set(shown))
        assert all(a[1] + 1 < b[0] for a, b in zip(sorted(got.get(p, [])), sorted(got.get(p, []))[1:]))


def test_rules_of_a_table(spark):
    text = "try:\n  sleep(1)\nexcept:\n  x\n# ok\nsleep(2)\n" + "sleep(3)\n" * 9
    docs = spark.createDataFrame([(1, text, "py"), (2, "sleep(1)", "go"), (3, None, "py"), (4, "", "py")], "doc_id long, text string, lang string")
    ddl = "id string, ord int, lang string, kind string, pattern string, require string, absent_within string, window int, absent_before string, absent_before_window int, anchor string, absent string"
    table = spark.createDataFrame([
        ("wait", 2, "py", None, "sleep", None, None, None, "# ok", 1, None, None), ("lone", 1, None, None, "sleep", None, "except", 2, None, None, None, None),
        ("no_try", 3, None, "absent", None, None, None, None, None, None, "sleep", "try"), ("gated", 4, None, None, "x", "nowhere", None, None, None, None, None, None),
    ], ddl)
    got = [(r["doc_id"], r["line_no"], r["rule"]) for r in rules.run_rules(docs, rules.rules_from(table), lang="lang").collect()]
    assert sorted(got) == [(1, 2, "wait"), (1, 6, "lone"), (1, 7, "lone"), (1, 8, "lone"), (1, 9, "lone"), (1, 10, "lone"), (2, 1, "lone")]


SUBJECTS = [
    ("Add retry with exponential backoff and jitter", "resilience"), ("feat: honour Retry-After on 429", "feature"), ("Introduce rate limiting for partner API", "resilience"), ("chore: patch version bump", "refactor"), ("fix typo in README", "fix"),
    ("Handle 429 from upstream", "resilience"), ('Revert "add cache"', "fix"), ("Release 1.2.3", "feature"), ("Fehler behoben", "fix"), ("unbehoben lassen", "feature"), ("FEHLER BEHOBEN", "fix"), ("refactor: tidy imports", "refactor"), ("feat(api): retry with backoff", "feature"),
    ("fix(sync)!: retry storm on 429", "fix"), ("ci: fix flaky job", "refactor"), ("perf: stop leaking sockets", "feature"), ("Fix timeout on large releases", "fix"), ("Timeout crash in the importer", "fix"), (None, "feature"), ("note: moved things", "refactor"),
]


def test_kinds_of_commits(spark):
    got = one(spark, "t string, w string", SUBJECTS, exprs.commit_kind(F.col("t"), ["behoben", " "]))
    assert [(s, g[0]) for g, (s, _) in zip(got, SUBJECTS, strict=True)] == SUBJECTS


def test_remotes_paths_and_templates(spark):
    cases = [
        ("git@github.com:a/b.git", ("github.com", "https://github.com/a/b")), ("https://u:p@H.com:8443/a/b.git/", ("h.com", "https://h.com:8443/a/b")), ("ssh://git@h.com:22/a/b", ("h.com", "https://h.com/a/b")), ("http://h.com/a", ("h.com", "http://h.com/a")),
        ("ftp://h.com/a", None), ("https://h.com", None), ("/tmp/x", None), ("", None), (None, None), ("https://h.com/a(b", None), ("C:\\x", None),
    ]
    got = one(spark, "u string", [(u,) for u, _ in cases], exprs.remote(F.col("u")))
    assert [tuple(g[0]) if g[0] else None for g in got] == [w for _, w in cases]
    assert one(spark, "p string", [("a b/c+d~*é",), ("x",)], exprs.encoded_path(F.col("p"))) == [("a%20b/c%2Bd~%2A%C3%A9",), ("x",)]
    assert one(spark, "p string", [("{b}",)], exprs.filled_template("{a}/{b}/{c}", {"a": F.col("p"), "b": F.lit("B")})) == [("{b}/B/{c}",)]
