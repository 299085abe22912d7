"""Transcripts, reuse, document checks and evidence on known answers, batch and stream."""

import json
import os

from pyspark.sql import functions as F

from churnlens.operators import constraints, evidence, reuse, transcripts


def line(model="m-1", id_="a", at="2024-01-01T10:00:00Z", kind="assistant", request=None, **usage):
    message = {"model": model, "usage": usage} | ({"id": id_} if id_ else {})
    return json.dumps({"type": kind, "timestamp": at, "message": message} | ({"requestId": request} if request else {}))


LINES = [
    line(input_tokens=1, output_tokens=2), line(input_tokens=5, output_tokens=7, cache_creation_input_tokens=3, cache_read_input_tokens=4), "", "  ", "{broken", line(id_=None, input_tokens=1), line(id_=None, input_tokens=1), line(id_=None, request="r", input_tokens=2), line(id_=None, request="r", input_tokens=3),
    line(model="<synthetic>", id_="s"), line(kind="user", id_="u"), line(id_="b", input_tokens="9", output_tokens=True, cache_creation={"ephemeral_1h_input_tokens": 6}, cache_creation_input_tokens=99), line(id_="c", model="m-1-20240101", at="2024-01-02", input_tokens=10), line(id_="d", model="new", at="when?", input_tokens=10),
    "[]", "3", "null", json.dumps({"type": "assistant", "message": {"model": "m-1", "usage": 5}}), json.dumps({"type": "assistant", "message": {"model": 7, "usage": {}}}), line(id_="e", at="2024-01-01T12:00:00+03:00", input_tokens=1),
]


def table(spark, lines=LINES):
    return spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, pos long, line string")


def test_transcripts(spark):
    got = {(r.message, r.model): tuple(r[b] for b in transcripts.BUCKETS) for r in transcripts.entries(table(spark)).collect() if r.message}
    assert got == {("a", "m-1"): (5, 3, 0, 4, 7), ("r", "m-1"): (3, 0, 0, 0, 0), ("b", "m-1"): (0, 0, 6, 0, 0), ("c", "m-1-20240101"): (10, 0, 0, 0, 0), ("d", "new"): (10, 0, 0, 0, 0), ("e", "m-1"): (1, 0, 0, 0, 0)}
    assert transcripts.entries(table(spark)).where("message IS NULL").count() == 2
    assert [tuple(r) for r in transcripts.skipped(table(spark)).collect()] == [("s", 18, 1)]
    within = transcripts.entries(table(spark), since="2024-01-01T09:00:00", until="2024-01-01T10:00:00Z")
    assert sorted(r.message or "-" for r in within.collect()) == ["-", "-", "a", "b", "e", "r"]
    weights = {"m-1": dict.fromkeys(transcripts.BUCKETS, 0.5)}
    assert {r.model: (r.calls, r.weighted) for r in transcripts.tallies(transcripts.entries(table(spark)), weights).collect()} == {"m-1": (6, 16), "m-1-20240101": (1, 5), "new": (1, None)}
    assert transcripts.entries(table(spark, [])).collect() == []


def test_transcripts_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, lines in enumerate(([line(input_tokens=1), line(input_tokens=9)], ["{broken", line(id_="b", at="2024-01-01T10:30:00Z", input_tokens=2), line(id_=None), line(input_tokens=5)], [line(id_="z", at="2024-01-03T00:00:00Z", input_tokens=3)], [line(id_="y", at="2024-01-03T05:00:00Z")])):
        (folder / f"{i}.txt").write_text("\n".join(lines))
        os.utime(folder / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))  # files come by their age
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).withColumnRenamed("value", "line")
    run = transcripts.streamed_tallies(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((str(r.start), r.model, r.calls, r.input) for r in spark.table("told").collect()) == [("2024-01-01 10:00:00", "m-1", 2, 3), ("2024-01-03 00:00:00", "m-1", 1, 3)]


def test_what_is_reused(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, None), (6, "f")], "id int, hash string")
    before = spark.createDataFrame([(1, "a", True, "v3"), (2, "x", True, "v3"), (3, "c", True, "v2"), (4, "d", False, None), (5, None, True, "v3"), (9, "z", True, "v3")], "id int, hash string, validated boolean, validated_with string")
    assert dict(tuple(r) for r in reuse.result_actions(now, before, "v3").collect()) == {1: "reuse", 2: "changed", 3: "revalidate", 4: "reuse", 5: "changed", 6: "new"}
    findings = spark.createDataFrame([(k, f"c{k}") for k in range(9)], "key int, claim_hash string")
    ledger = spark.createDataFrame([(k, "old" if k == 1 else f"c{k}", "skeptic" if k != 2 else None, "upheld" if k != 3 else "unchecked") for k in range(1, 9)], "key int, claim_hash string, by string, status string")
    held = spark.createDataFrame([(k, "f", "h") for k in range(1, 9)] + [(4, "g", "h"), (8, "gone", "h")], "key int, path string, hash string")
    versions = spark.createDataFrame([(6, "p", "1"), (7, "q", "1")], "key int, package string, version string")
    cited = spark.createDataFrame([(k, "f") for k in range(9)] + [(5, "new")], "key int, path string")
    files = spark.createDataFrame([("f", "h"), ("g", "other")], "path string, hash string")
    packages = spark.createDataFrame([("p", "2", "available"), ("q", "1", "available")], "id string, version string, status string")
    got = dict(tuple(r) for r in reuse.verdict_actions(findings, ledger, held, versions, cited, files, packages).collect())
    assert got == {0: "not in the ledger", 1: "claim changed", 2: "no verdict", 3: "no verdict", 4: "a file changed", 5: "cites another file", 6: "a dependency changed", 7: None, 8: "a file changed"}


def test_checks_of_a_table(spark):
    checks = spark.createDataFrame(
        [(2, "a.b", "text", None, None, None, False, None), (1, "n", "between", None, 1.0, 5.0, True, None), (3, "list[].k", "one_of", ["x", "y"], None, None, False, None), (4, "list", "most", None, 2.0, None, False, None), (5, "n = 2", "expression", None, None, None, False, "a.b = 'q'"), (6, "list[].k", "matches", None, None, None, True, None)],
        "ord int, field string, rule string, values array<string>, n double, m double, optional boolean, when string",
    ).withColumn("pattern", F.lit("^[xy]$"))
    known = constraints.checks_from(checks)
    assert [c.field for c in known] == ["n", "a.b", "list[].k", "list", "n = 2", "list[].k"]
    rows = spark.createDataFrame([(1, 3, ("v",), [("x",)]), (2, 9, (" ",), [("x",), ("z",), (None,)]), (3, None, None, None), (4, 3, ("q",), [])], "id int, n int, a struct<b:string>, list array<struct<k:string>>")
    got = {}
    for r in constraints.problems(rows, known, ["id"]).orderBy("id", "n").collect():
        got.setdefault(r.id, []).append((r.n, r.at))
    assert got == {2: [(1, "n"), (2, "a.b"), (3, "list[1].k"), (4, "list[2].k"), (5, "list"), (6, "list[1].k")], 3: [(1, "a.b"), (2, "list")], 4: [(1, "n = 2"[:0])]}
    links = spark.createDataFrame([("a", "b"), ("b", None), ("c", "c"), ("d", "none"), ("e", "a"), ("f", None), ("f", None), (None, "b")], "key string, refers string")
    assert {(r.key, r.problem) for r in constraints.set_problems(links, "key", "refers").collect()} == {("c", "refers to itself"), ("d", "refers to nothing"), ("e", "refers to a row that refers on"), ("f", "key repeats"), (None, "has no key")}


def test_evidence(spark):
    sha, old = "abcdef0123" * 4, "abcd99" + "0" * 34
    cases = [
        ("code", "a.py:2-3", None, None), ("code", "a.py:9", None, "lines are outside the file"), ("code", "a.py", None, "is not path:line or path:start-end"), ("code", "../a.py:1", None, "climbs out of the repository with '..'"), ("code", "b.py:1", None, "no such file"), ("code", "a.py:3-2", None, "lines are outside the file"),
        ("commit", "ABCDEF01 told", "changed", None), ("commit", "abcdef", "introduced", None), ("commit", "abcd99", "introduced", "wrote none of the cited lines"), ("commit", "abcd99", "fixed", None), ("commit", "abcd99", None, "role is unknown"), ("commit", "ffff", "fixed", "no such commit"), ("commit", "xyz", "fixed", "is not a commit"), ("commit", "1234567", "fixed", "does not touch a cited file"),
        ("detector", "S05@a.py:2", None, None), ("detector", "S05@a.py:7", None, "no such hit"), ("detector", "x", None, "is not a hit's reference"), ("catalog", "edge", None, None), ("catalog", "none", None, "no such edge"), ("note", "x", None, "type is unknown"), (None, "x", None, "type is unknown"), ("code", " ", None, "ref is missing"), ("code", "a.py:1", "fixed", "role is for commits only"),
    ]
    cited = spark.createDataFrame([("f", i, *c[:3]) for i, c in enumerate(cases)] + [("g", 0, "commit", "1234567", "introduced")], "finding string, i int, type string, ref string, role string")
    one = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    got = evidence.resolved(
        cited, one("finding string, path string", ("f", "a.py"), ("g", "nowhere.py")), one("path string, n_lines long", ("a.py", 5)), one("ref string", ("S05@a.py:2",)), one("ref string", ("edge",)), one("sha string", (sha,), (old,), ("1234567" + "0" * 33,)),
        one("sha string, path string", (sha, "a.py"), (old, "a.py"), ("1234567" + "0" * 33, "c.py")), one("path string, line long, sha string", ("a.py", 2, sha), ("a.py", 5, old)),
    ).collect()
    assert {r.i: r.problem for r in got if r.finding == "f"} == {i: c[3] for i, c in enumerate(cases)}
    assert [r.problem for r in got if r.finding == "g"] == [None]
