"""Known answers of the functions over program text, versions and raw logs."""

import re

import pytest
from pyspark.sql import functions as F

from churnlens.functions import code
from churnlens.operators import log


def one(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(column).collect()]


C = [
    ("a // b\nc", "a     \nc"), ("x /* y\nz */ w", "x     \n     w"), ("x /* open\nto the end", "x        \n          "), ('s = "// no" // yes', 's = "// no"       '),
    ("'a\\'// b' // c", "'a\\'// b'     "), ('"open // string\nx // y', '"open // string\nx     '), ("`a\n// b` // c", "`a\n// b`     "), ("a / b", "a / b"), ("", ""), (None, None), ('"' + "x" * 20000 + '" // c', '"' + "x" * 20000 + '"     '), ('"end\\', '"end\\'), ("/**/ a /***/", "     a      "),
]
YAML = [
    ("# all\na: b # c", "     \na: b    "), ("a: c#d", "a: c#d"), ("a: '# no' # yes", "a: '# no'      "), ("a: 'it''s # no' # y", "a: 'it''s # no'    "), ('a: "b \\" # no" # y', 'a: "b \\" # no"    '),
    ("it's # yes", "it's      "), ("a: 'open # no", "a: 'open # no"), ("#", " "), ("\t# x", "\t   "), ("[a, '#b'] #c", "[a, '#b']   "), ("", ""), (None, None), ("a: '" + "x" * 20000 + "' # c", "a: '" + "x" * 20000 + "'    "),
]
PY = [
    ('def f():\n    """Doc # x."""\n    return 1  # one\n', "def f():\n                  \n    return 1       \n"),
    ('x = """not a doc # kept\n"""\n"""doc"""', 'x = """not a doc # kept\n"""\n         '),
    ('cur.execute(\n    """SELECT # 1""")', 'cur.execute(\n    """SELECT # 1""")'),
    ("q = \\\n'''text'''\n'''doc\nmore'''\ny = 1", "q = \\\n'''text'''\n      \n       \ny = 1"),
    ("s = 'it\\'s # no' # yes", "s = 'it\\'s # no'      "), ("s = 'open # kept\n# gone", "s = 'open # kept\n      "), ("r'''raw doc'''\nx", "              \nx"), ("", ""), (None, None),
    ("x = [\n'''a'''\n]\n'''b'''", "x = [\n'''a'''\n]\n       "), ('"""never closed\nx = 1', "               \n     "), ("x = 1\n\n'''doc'''", "x = 1\n\n         "), ("x = a +  # goes on\n'''s'''", "x = a +           \n'''s'''"),
]


def test_comments_become_blanks(spark):
    for cases, column in ((C, code.blank_c(F.col("t"))), (YAML, code.blank_yaml(F.col("t"))), (PY, code.blank_python(F.col("t")))):
        got = one(spark, [a for a, _ in cases], column)
        for g, (given, want) in zip(got, cases, strict=True):
            assert g == want, given
            assert g is None or len(g) == len(given) and [i for i, c in enumerate(g) if c == "\n"] == [i for i, c in enumerate(given) if c == "\n"]
    assert one(spark, ["# a\nb=1\n ! c\nd # e", None], code.blank_properties(F.col("t"))) == ["   \nb=1\n    \nd # e", None]


RANGES = [
    ("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.3", "^0.0.3", True), ("0.0.4", "^0.0.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2", False), ("1.9.0", "~1", True),
    ("1.5.0", "1.x", True), ("1.5.0", "1.*", True), ("1.5.2", "1.5", True), ("1.5.0", "=1.5.0", True), ("v1.5.0", "1.5.0", True), ("1.5.0", ">=1.0.0 <1.5.0", False), ("1.5.0", "<1.0.0 || >1.4.0", True), ("1.0.0-rc1", "1.0.0", True), ("1.0.0", "1.0.0-rc1", True),
    ("3.0.0", "*", True), ("3.0.0", "", True), ("1.0.0", "latest", None), ("1.0.0", "1.0.0 || latest", True), ("1.0.0", "latest || 1.0.0", None), ("1.0.0", "1.0.0 - 2.0.0", None), ("1.0.0", "npm:x@1", None), ("1.0", "*", None), (None, "*", None), ("1.0.0", None, None), ("10.2.0", ">9.9.9", True),
]


def test_ranges_of_versions(spark):
    got = spark.createDataFrame(RANGES, "v string, r string, w boolean").select(code.satisfies(F.col("v"), F.col("r"))).collect()
    assert [(v, r, g[0]) for g, (v, r, _) in zip(got, RANGES, strict=True)] == RANGES


def test_names_and_spans(spark):
    assert one(spark, ["A__b.-C", "x", None], code.package_name(F.col("t"))) == ["a-b-c", "x", None]
    values = ["a", "a`b", "``", " a", "a\nb\n", "", None, "  ", "a|b", "‮x", "a\x00"]
    assert one(spark, values, code.code_span(F.col("t"))) == ["`a`", "``a`b``", "``` `` ```", "`  a `", "`a b`", "—", "—", "—", "`a|b`", "`\\u202ex`", "`a\\u0000`"]
    assert one(spark, ["a|b"], code.code_span(F.col("t"), cell=True)) == ["`a\\|b`"]


RECORDS = [
    "s1\x00Ann é\x002025-01-02T03:04:05+00:00\x00fix: a\tb \"q\"\n3\t1\tsrc/é.py\x000\t0\t\x00old.py\x00new\tname.py\x00-\t-\timg.png\x00",
    "s2\x00bot[bot]\x002025-01-03T00:00:00+00:00\x00bump",
    "\ns3\x00Bo\x002025-01-04T00:00:00+00:00\x00empty\n\n", "", "s4\x00short\n1\t1\tx",
    "s5\x00Cy\x00d\x00many\n" + "".join(f"{i}\t0\tf{i}.py\x00" for i in range(51)),
]


def test_raw_log(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(("\x1e" + "\x1e".join(RECORDS)).encode())
    got = {r["sha"]: r for r in log.parsed_log(log.read_log(spark, str(tmp_path / "log.txt"))).collect()}
    assert list(sorted(got)) == ["s1", "s2", "s3", "s5"]
    assert [tuple(f) for f in got["s1"]["files"]] == [(0, "src/é.py", 3, 1, False), (1, "new\tname.py", 0, 0, False), (2, "img.png", 0, 0, True)]
    assert (got["s1"]["author"], got["s1"]["subject"]) == ("Ann é", "fix: a\tb \"q\"") and got["s2"]["files"] == [] == got["s3"]["files"]
    assert len(got["s5"]["files"]) == 51
    touches = log.touches_of(log.parsed_log(spark.createDataFrame([(r,) for r in RECORDS], "record string")))
    assert touches.count() == 54 and touches.columns == ["sha", "pos", "path", "adds", "dels", "is_binary"]


@pytest.mark.parametrize("text", ["x = '''a\n# b\n'''\n", "def f(a,\n  b): # c\n  '''d\n  e''' ; g = 1\n  return h"])
def test_python_keeps_its_shape(text):
    out = code.python_blanked(text)
    assert len(out) == len(text) and re.sub(r"[^\n]", "", out) == re.sub(r"[^\n]", "", text)


def test_imports_exports_and_reads(spark):
    text = "import a, { b } from './x'\nconst y = require(\"../y\")\nfrom pkg.mod import z\nimport os\nimport os\nnot import me\n  import w from 'q'\n"
    assert one(spark, [text, "", None], code.captured(F.col("t"), code.IMPORTS)) == [["./x", "../y", "pkg.mod", "os", "q"], [], None]
    assert one(spark, ["export const a = 1\nexport { b, c }\nasync def f():\nclass G:\nexport async function h() {}"], code.captured(F.col("t"), code.EXPORTS)) == [["a", "b, c ", "f", "G", "h"]]
    reads = lambda lang, s: code.reads_with_fallback(F.col("t"), F.lit(s), lang)
    assert one(spark, ["c.get('a.b', 1)", "c.get('axb', 1)", "c.get('a.b')", "C.POP(\"A.B\" , 2)", None], reads("python", "a.b")) == [True, False, False, True, False]
    assert one(spark, ["process.env.RETRY ?? 3", "process.env['RETRY'] || 3", "process.env.RETRY"], reads("typescript", "RETRY")) == [True, True, False]
    assert one(spark, ["${x.y:5}", "${x.y}"], reads("yaml", "x.y")) == [True, False]
    assert one(spark, ["x"], reads("go", "x")) == [None] and one(spark, ["x.get('', 1)"], reads("python", " ")) == [False]
