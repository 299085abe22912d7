"""Inert prose, reports and sweeps."""

from pathlib import Path

from pyspark.sql import functions as F

from churnlens.functions import markdown
from churnlens.operators import reports

PROSE = [
    ("plain words", "plain words"), ("a *b* _c_ <d> [e](f) ~g~ $h$ `i` &amp; \\", r"a \*b\* \_c\_ \<d\> \[e\](f) \~g\~ \$h\$ \`i\` \&amp; " + "\\\\"), ("see https://x.co/a_b now", "see `https://x.co/a_b` now"), ("(x.co),", "(`x.co`),"), ("call api.timeout(8000) first", "call `api.timeout(8000)` first"), ("mail a@b.", "mail `a@b`."),
    ("at 10:30:45 :tada: :+1:", "at 10:30:45 `:tada:` `:+1:`"), ("# head", r"\# head"), ("1. one", r"1\. one"), ("12) x", r"12\) x"), ("- item", r"\- item"), ("> q", r"\> q"), ("a\nb\r\nc\n", "a b c"), ("  ", "—"), (None, "—"), ("", "—"), ("tab\t\there", "tab here"), ("x\x00y", "x\\\\u0000y"), ("‮abc", "\\\\u202eabc"), ("'www.a.de'!", "'`www.a.de`'!"), ("e.g. this", "e.g. this"), ("f.py", "`f.py`"), ("...", "..."), ("//", "`//`"), ("ab`c.de`", "`` ab`c.de` ``"),
]


def test_prose_is_inert(spark):
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PROSE)], "i int, t string")
    got = [r[1] for r in sorted(table.select("i", markdown.prose(F.col("t"))).collect())]
    assert got == [w for _, w in PROSE]
    one = spark.createDataFrame([("a|b # c", "x.y|z", None), ("d", "e", "u")], "t string, s string, u string")
    assert [tuple(r) for r in one.select(markdown.prose(F.col("t"), cell=True, heading=True), markdown.linked(F.col("s"), F.col("u"), cell=True)).collect()] == [(r"a\|b \# c", r"`x.y\|z`"), ("d", "[`e`](u)")]


def test_report_and_sweep(spark, tmp_path):
    rows = [("r", f"k{i}", f"src/{i}.py", i, None if i % 2 else f"https://h/{i}", ["none", "unconfirmed_default"][i % 2], ["high", "low", "odd"][i % 3], float(i), f"Claim *{i}*", [("a.py:1", None, "see x.co"), ("b.py:2", "https://h/b", None)][: i % 3]) for i in range(6)] + [("s", "z", None, None, None, "none", None, None, None, None)]
    findings = spark.createDataFrame(rows, "repo string, key string, path string, line int, url string, gate string, confidence string, score double, claim string, evidence array<struct<ref:string,url:string,note:string>>")
    lines = reports.markdown(findings, "repo")
    reports.write_lines(lines, str(tmp_path / "md"), ["at"], "repo")
    text = {p.name: "".join(f.read_text() for f in sorted(p.glob("part-*"))) for p in Path(tmp_path / "md").glob("repo=*")}
    assert text["repo=r"].startswith("# Findings: r\n\n6 findings: 2 high, 2 low\n\n| id | where | confidence | claim |\n|-|-|-|-|\n| F01 | [`src/0.py:0`](https://h/0) | high | Claim \\*0\\* |\n| F02 | [`src/4.py:4`](https://h/4) | low |")
    assert "\n## F01 `src/0.py:0`\n\nClaim \\*0\\*\n\n\n## F02 `src/4.py:4`\n\nClaim \\*4\\*\n\n- `a.py:1`: see `x.co`\n" in text["repo=r"] and "Gate: `unconfirmed_default`\n\n" in text["repo=r"] and text["repo=s"].count("\n") == 12
    hits = spark.createDataFrame([("b", "y.py", 10, "x\ty"), ("a", "y.py", 2, None), ("b", "y.py", 9, "z")], "rule string, path string, line_no int, snippet string")
    reports.write_lines(reports.sweep(hits), str(tmp_path / "tsv"), ["rule", "path", "line_no"])
    assert "".join(f.read_text() for f in sorted((tmp_path / "tsv").glob("part-*"))) == "a\ty.py:2\t\nb\ty.py:9\tz\nb\ty.py:10\tx y\n"


def test_lines_are_made_once(spark):
    """A plain explode has its list made again to filter out empty ones, and an expression that is used again is read again."""
    findings = spark.createDataFrame([("r", "k", "p", 1, None, "none", "high", 1.0, "Claim", [])], "repo string, key string, path string, line int, url string, gate string, confidence string, score double, claim string, evidence array<struct<ref:string,url:string,note:string>>")
    plan = reports.markdown(findings, "repo")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "Claim" not in x and "size(" in x]
    span = spark.range(1).select(markdown.code_span(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert span.count("regexp_replace(regexp_replace(cast(id") == 1
