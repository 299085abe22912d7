"""Runs against labels, and plans of what is to be checked, on known answers."""

from pyspark.sql import functions as F

from churnlens.operators import scoring


def test_records_against_labels(spark):
    run = spark.createDataFrame([("a", "upheld", "high"), ("b", "refuted", "low"), ("c", "narrowed", None), ("d", None, "odd"), ("e", "upheld", "low")], "key string, verdict string, confidence string")
    labels = spark.createDataFrame([("a", "wrong", "m", "low"), ("b", "correct", "p", "high"), ("c", "partially_correct", None, "low"), ("d", "wrong", "p", "low"), ("z", "wrong", "p", "low")], "key string, label string, labelled_by string, deserved string")
    got = {r["key"]: (r["state"], r["o"], r["s"]) for r in scoring.states(run, labels, "m").select("key", "state", scoring.outcome(F.col("verdict"), F.col("label")).alias("o"), scoring.confidence_step(F.col("confidence"), F.col("deserved")).alias("s")).collect()}
    assert got == {"a": ("excluded", "wrong direction", 2), "b": ("scored", "correct refuted", -2), "c": ("scored", "same", None), "d": ("scored", None, None), "e": ("unlabelled", None, None)}
    assert {r["state"] for r in scoring.states(run, labels, None).collect()} == {"scored", "unlabelled"}
    every = spark.createDataFrame([(v, x) for v in scoring.OUTCOMES for x in scoring.LABELS], "v string, x string")
    assert [r[0] for r in every.select(scoring.outcome(F.col("v"), F.col("x"))).collect()] == [o for row in scoring.OUTCOMES.values() for o in row]


def test_duplicates(spark):
    rows = [(True, "x", "x", "found"), (True, None, "x", "missed"), (True, "y", "x", "missed, false"), (True, "y", None, "false"), (True, None, None, None), (False, None, "x", None)]
    table = spark.createDataFrame(rows, "stated boolean, told string, label string, want string")
    assert [r[0] for r in table.select(scoring.duplicate_state(F.col("stated"), F.col("told"), F.col("label"))).collect()] == [r[3] for r in rows]


def test_what_a_briefing_showed(spark):
    records = spark.createDataFrame([(k, "a", k != "u") for k in "snexpu"], "key string, file string, readable boolean")
    facts = spark.createDataFrame([("s", "repo", "a", 2, 4), ("n", "repo", "a", 2, 40), ("e", "repo", "b", 1, 1), ("x", "dependency", "a", 1, 1), ("p", "repo", "a", 6, 6), ("p", "repo", "b", 1, 1), ("u", "repo", "a", 1, 1)], "key string, kind string, path string, lo long, hi long")
    shown = spark.createDataFrame([(k, lo, hi) for k in "snexpu" for lo, hi in ((1, 5), (3, 8))], "key string, first long, last long")
    got = {r["key"]: (r["outcome"], r["partly_elsewhere"]) for r in scoring.shown_states(records, facts, shown).collect()}
    assert got == {"s": ("shown", False), "n": ("not shown", False), "e": ("elsewhere", False), "x": ("not in repository", False), "p": ("shown", True), "u": ("unreadable", False)}


def test_plans(spark):
    findings = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1)], "key string, n int")
    reasons = spark.createDataFrame([("a", None), ("b", "claim changed"), ("c", None)], "key string, reason string")
    assert sorted((r.key, r.n, r.action) for r in scoring.planned(findings, reasons, ["n"]).collect()) == [("a", 1, "reuse"), ("a", 2, "skip"), ("b", 1, "check"), ("c", 1, "reuse"), ("d", 1, "check")]
