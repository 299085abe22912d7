"""Index listings, languages of paths, capped edges and exported names on known answers."""

from pyspark.sql import functions as F

from churnlens.functions import code
from churnlens.operators import paths


def test_index_listing(spark):
    listing = "100644 aa 0\tsrc/a.py\x00100755 b1 1\twith tab\tand blank \x00100644 b2 2\twith tab\tand blank \x00120000 cc 0\té\nline\x00"
    table = spark.createDataFrame([("r", listing), ("e", ""), ("n", None), ("odd", "no tab here\x00100644 dd 0\t\x00")], "repo string, listing string")
    got = sorted(tuple(r) for r in paths.index_entries(table, ["repo"]).collect())
    assert got == [("r", "src/a.py", "100644", "aa", 0), ("r", "with tab\tand blank ", "100755", "b1", 1), ("r", "é\nline", "120000", "cc", 0)]


def test_languages(spark):
    names = ["a.py", "A.PY", "b/.py", "x.tar.gz", "none", "dot.", ".hidden.js", "d.py/none", None, "a.JS"]
    files = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, path string")
    known = {".py": "python", ".js": "javascript"}
    got = [tuple(r) for r in paths.with_language(files, known, {"javascript": "typescript"}, {"python"}).orderBy("i").select("lang", "rule_lang", "needs_leads").collect()]
    py, js, none = ("python", "python", True), ("javascript", "typescript", False), (None, None, False)
    assert got == [py, py, none, none, none, none, js, none, none, js]
    assert [tuple(r) for r in paths.with_language(files.limit(1), {}).select("lang", "needs_leads").collect()] == [(None, False)]


def test_edges_up_to_a_cap(spark):
    edges = spark.createDataFrame([("e", "inbound", i) for i in range(30)] + [("e", "outbound", i) for i in range(3)] + [("f", "inbound", 1)], "entity string, direction string, n int")
    assert sorted((r.entity, r.direction, r.n) for r in paths.capped_edges(edges, ["entity"], ["n"]).where("NOT kept").collect()) == [("e", "inbound", i) for i in range(25, 30)]
    assert sorted(tuple(r) for r in paths.cut_edges(edges, ["entity"]).collect()) == [("e", 5, 0), ("f", 0, 0)]


def test_exported_names(spark):
    text = "export const a = 1\n export { b as c , d,, 9x , é }\nasync def e():\n  class F:\nexport default g\nexport const a = 2\nconst h = 1"
    assert spark.createDataFrame([(text,), ("",), (None,)], "t string").select(code.exported(F.col("t"))).collect() == [(["a", "b", "d", "é", "e", "F"],), ([],), (None,)]
