"""Queries over diffs, blame output, briefings and answers, which Spark writes from the given tables as text and reads back. Each with SQL that never sees the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.functions import code, excerpts, markdown, shape
from churnlens.jobs.reference import query
from churnlens.operators import evidence, intervals, paths, reports
from churnlens.sources.tables import table


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS lo, CAST(l_linenumber + l_quantity AS BIGINT) AS hi FROM lineitem)
SELECT a.p AS path, a.o AS owner, a.lo, a.hi, count(b.o) AS others FROM r a LEFT JOIN r b ON a.p = b.p AND a.o <> b.o AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL""")
def q_range_meetings(spark, d):
    i = table(spark, d, "lineitem").withColumn("hi", F.col("l_linenumber") + F.col("l_quantity"))
    return intervals.meetings(i, "l_orderkey", "l_partkey", "l_linenumber", "hi")


# An order's items are the lines of its diff: kind by the part, first part of the diff the first three lines; a removed `-- x` looks like a header.
DIFFED = """i AS (SELECT l_orderkey AS sha, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem),
l AS (SELECT *, CASE WHEN n <= 3 THEN 1 ELSE 2 END AS hunk, CASE part % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'added' ELSE 'removed' END AS kind FROM i)"""


@query(f"""WITH {DIFFED}, c AS (SELECT *, sum((kind <> 'added')::INT) OVER w AS olds, sum((kind <> 'removed')::INT) OVER w AS news FROM l WINDOW w AS (PARTITION BY sha, hunk ORDER BY n))
SELECT sha, 'src/' || sha % 7 || '.py' AS path, CAST(hunk AS BIGINT) AS hunk, kind, CAST(CASE WHEN kind <> 'added' THEN 100 * hunk + sha % 10 + olds - 1 END AS BIGINT) AS old_line, CAST(CASE WHEN kind <> 'removed' THEN 100 * hunk + sha % 11 + news - 1 END AS BIGINT) AS new_line, '-- x' || part AS line FROM c""")
def q_diff_hunks(spark, d):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.get(F.array(F.lit(" "), F.lit("+"), F.lit("-")), (x["l_partkey"] % 3).cast("int")), F.lit("-- x"), x["l_partkey"]))
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sha")).agg(lines.alias("lines"))
    count = lambda ls, mark: F.size(F.filter(ls, lambda x: ~F.startswith(x, F.lit(mark)))).cast("string")

    def part(no: int, ls):
        head = F.concat(F.lit("@@ -"), 100 * no + F.col("sha") % 10, F.lit(","), count(ls, "+"), F.lit(" +"), 100 * no + F.col("sha") % 11, F.lit(","), count(ls, "-"), F.lit(" @@ def f():\n"))
        return F.when(F.size(ls) > 0, F.concat(head, F.array_join(ls, "\n"), F.lit("\n"))).otherwise("")

    name = F.concat(F.lit("src/"), F.col("sha") % 7, F.lit(".py"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nindex 1..2 100644\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"))
    text = F.concat(head, part(1, F.slice("lines", 1, 3)), part(2, F.slice("lines", 4, 1 << 20)), F.lit("\\ No newline at end of file"))
    return evidence.hunks(own.select("sha", text.alias("diff")), ["sha"])


@query("""WITH i AS (SELECT l_suppkey AS path, l_partkey AS part, l_partkey % 20 AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS line FROM lineitem)
SELECT path, line, left(sha256('c' || c), 40) AS sha, 'author ' || c AS author, 'Change ' || c AS summary, 'code ' || part AS code FROM i""")
def q_blame_lines(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("path")).agg(F.transform(ordered, lambda x: x["l_partkey"]).alias("parts"))
    commits = F.transform("parts", lambda p: p % 20)

    def entry(p, i):
        head = F.concat(F.left(F.sha2(F.concat(F.lit("c"), p % 20).cast("binary"), 256), F.lit(40)), F.lit(" "), i + 7, F.lit(" "), i + 1)
        # a commit's fields stand at its first line alone
        told = F.when(F.array_position(F.col("commits"), p % 20) == i + 1, F.concat(F.lit("\nauthor author "), p % 20, F.lit("\nauthor-mail <a@b>\nsummary Change "), p % 20, F.lit("\nfilename x"))).otherwise("")
        return F.concat(head, told, F.lit("\n\tcode "), p, F.lit("\n"))

    text = own.withColumn("commits", commits).select("path", F.array_join(F.transform("parts", entry), "").alias("text"))
    return evidence.blamed(text)


EXCERPT_SQL = """WITH b AS (SELECT doc_id, text, 50 AS budget, string_split(text, chr(10)) AS ls FROM documents),
f AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id % 7 END AS s, 1 + doc_id % 7 + doc_id % 5 AS e FROM b),
x AS (SELECT *, greatest(1, s - 15) AS a, least(len(ls), e + 15) AS z FROM f),
y AS (SELECT doc_id, text, budget, CASE WHEN s IS NULL THEN 1 ELSE a END AS lo, CASE WHEN s IS NULL THEN len(ls) ELSE z END AS hi, CASE WHEN s IS NULL THEN text ELSE array_to_string(ls[a:z], chr(10)) END AS body, len(ls) - CAST(text = '' OR ends_with(text, chr(10)) AS INT) AS whole FROM x),
c AS (SELECT *, left(body, CAST(floor(budget * 4 * 0.7) AS INT)) AS head, right(body, CAST(floor(budget * 4 * 0.25) AS INT)) AS tail, greatest(1, length(text) // 4) <= budget AS fits, length(body) <= budget * 4 AS short FROM y),
n AS (SELECT *, length(head) - length(replace(head, chr(10), '')) AS h, length(tail) - length(replace(tail, chr(10), '')) - CAST(ends_with(tail, chr(10)) AS INT) AS t, hi - CAST(ends_with(body, chr(10)) AS INT) AS last FROM c)
SELECT doc_id, 'src/' || doc_id || '.py' AS path, CASE WHEN fits THEN '1-' || whole WHEN short THEN lo || '-' || last ELSE concat_ws(',', CASE WHEN h > 0 THEN lo || '-' || (lo + h - 1) END, CASE WHEN t > 0 THEN (last - t + 1) || '-' || last END) END AS shown FROM n"""


@query(EXCERPT_SQL)
def q_excerpt_shown(spark, d):
    docs = table(spark, d, "documents")
    first = 1 + F.col("doc_id") % 7
    name = F.when(F.col("doc_id") % 3 == 0, "best")
    path = F.concat(F.lit("src/"), F.col("doc_id"), F.lit(".py"))
    rendered = F.concat(F.lit("# Hotspot\n\n"), excerpts.source_block(path, F.col("text"), 50, name, first, first + F.col("doc_id") % 5, "python"), F.lit("## Call sites\n\nNone.\n"))
    own = docs.select("doc_id", rendered.alias("briefing")).select("doc_id", excerpts.shown(F.col("briefing")).alias("s"))
    return own.select("doc_id", F.col("s")["path"].alias("path"), F.array_join(F.transform(F.col("s")["ranges"], lambda r: F.concat_ws("-", r["lo"], r["hi"])), ",").alias("shown"))


SHAPE_SQL = """WITH k AS (SELECT *, doc_id % 6 AS k, doc_id % 4 AS l FROM documents)
SELECT doc_id, CASE WHEN k = 5 THEN NULL ELSE '{"bundle_hash":"h' || doc_id || '","file":"' || source || '","findings":[{"evidence":[' || CASE k WHEN 0 THEN '{"ref":"abc","type":"commit"}' WHEN 1 THEN '{"note":"n","ref":"' || source || ':7","type":"code"}' WHEN 2 THEN '{"ref":"b.py:3-9","type":"code"}' WHEN 3 THEN '{"ref":"c.py:1","type":"code"}' ELSE '7' END || '],"location":' || CASE l WHEN 0 THEN '{"file":"a.py","lines":"4-9"}' WHEN 1 THEN '{"file":"a.py:x"}' WHEN 2 THEN '{"file":"a.py"}' ELSE '{"file":"z.py","lines":"1"}' END || '}],"hotspot_id":"H' || doc_id || '"'
|| CASE WHEN told = '' THEN '' ELSE ',"normalised":["' || replace(told, '|', '","') || '"]' END || '}' END AS doc, CASE WHEN k = 5 THEN NULL ELSE told END AS told
FROM (SELECT *, concat_ws('|', CASE WHEN doc_id % 2 = 1 THEN 'renamed top-level hypotheses to findings' END, CASE l WHEN 0 THEN 'findings[0].location a.py:4-9 -> a.py, 4-9' WHEN 1 THEN 'findings[0].location a.py:x -> a.py:x' WHEN 2 THEN 'findings[0].location a.py -> a.py' END,
CASE k WHEN 0 THEN 'findings[0].evidence[0].type Git -> commit|findings[0].evidence[0].sha moved to ref' WHEN 1 THEN 'findings[0].evidence[0].ref joined into ' || source || ':7' WHEN 2 THEN 'findings[0].evidence[0].ref joined into b.py:3-9' END) AS told FROM k)"""


@query(SHAPE_SQL)
def q_shape(spark, d):
    k, n = F.col("doc_id") % 6, F.col("doc_id") % 4
    proof = F.when(k == 0, '{"type":"Git","sha":"abc"}').when(k == 1, F.concat(F.lit('{"type":"code","note":"n","line":7,"file":"'), "source", F.lit('"}'))).when(k == 2, '{"type":"code","ref":{"file":"b.py","lines":" 3-9 "}}').when(k == 3, '{"type":"code","ref":"c.py:1"}').otherwise("7")
    where = F.when(n == 0, '"a.py:4-9"').when(n == 1, '"a.py:x"').when(n == 2, '" a.py "').otherwise('{"file":"z.py","lines":"1"}')
    doc = F.concat(F.lit('{"'), F.when(F.col("doc_id") % 2 == 1, "hypotheses").otherwise("findings"), F.lit('":[{"key":"x","location":'), where, F.lit(',"evidence":['), proof, F.lit("]}]"), F.when(k == 5, "").otherwise("}"))
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" ```json\n"), doc, F.lit("\n```\n"))).otherwise(doc)
    s = shape.shaped(shape.answer(raw), {"bundle_hash": F.concat(F.lit("h"), "doc_id")}, {"hotspot_id": F.concat(F.lit("H"), "doc_id"), "file": F.col("source")})
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.col("s")["doc"].alias("doc"), F.array_join(F.col("s")["told"], "|").alias("told"))


# Prose with marks and links made of the documents' own words; no brackets open inside a word, so that SQL can peel by pattern alone.
PROSE_LIKE = [(" the ", " *the* "), (". ", " (see x.co/a_b), "), (" de ", " :de_x: "), (" und ", " www.und! "), (" of ", " <of> 10:30:45 ")]


def _proved(text: str) -> str:
    for a, b in PROSE_LIKE:
        text = f"replace({text}, '{a}', '{b}')"
    return text


_LINKISH = "(?i)://|//|www\\.|mailto:|xmpp:|@|\\.\\p{L}{2}|:[a-z0-9_+-]*[a-z][a-z0-9_+-]*:|:[+-]1:|:100:|:1234:"
_ESCAPE = "regexp_replace({}, '([\\\\`*_\\[\\]<>|~&$])', '\\\\\\1', 'g')"
PROSE_SQL = f"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace({_proved('text')}, '\\r\\n|[\\n\\r]', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS x FROM documents),
w AS (SELECT doc_id, list_transform(regexp_extract_all(x, '\\S+'), lambda t: CASE WHEN regexp_matches(t, '{_LINKISH}') AND regexp_matches(regexp_extract(t, '^[(\\[{{"'']*(.*?)[)\\]}},;:.!?"'']*$', 1), '{_LINKISH}')
THEN {_ESCAPE.format("regexp_extract(t, '^([(\\[{\"'']*)', 1)")} || '`' || regexp_extract(t, '^[(\\[{{"'']*(.*?)[)\\]}},;:.!?"'']*$', 1) || '`' || {_ESCAPE.format("regexp_extract(t, '^[(\\[{\"'']*.*?([)\\]},;:.!?\"'']*)$', 1)")}
WHEN regexp_matches(t, '{_LINKISH}') THEN '`' || t || '`' ELSE {_ESCAPE.format('t')} END) AS ws FROM t)
SELECT doc_id, CASE WHEN len(ws) = 0 THEN '—' ELSE regexp_replace(regexp_replace(array_to_string(ws, ' '), '^([#+=>-])', '\\\\\\1'), '^([0-9]+)([.)])', '\\1\\\\\\2') END AS prose FROM w"""


@query(PROSE_SQL)
def q_md_prose(spark, d):
    text = F.col("text")
    for a, b in PROSE_LIKE:
        text = F.replace(text, F.lit(a), F.lit(b))
    return table(spark, d, "documents").select("doc_id", markdown.prose(text).alias("prose"))


@query("""WITH o AS (SELECT l_suppkey AS report, l_partkey AS part, l_orderkey AS ok, l_linenumber AS n, l_quantity AS q, l_extendedprice AS e, CASE l_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS c, l_returnflag AS f FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY CASE WHEN f = 'R' THEN 3 ELSE 1 END, part % 3, q DESC, 'p' || part, n, ok || '-' || part || '-' || e) AS no FROM o)
SELECT report, part, ok, n, e, CAST(no AS BIGINT) AS no FROM r""")
def q_finding_order(spark, d):
    i = table(spark, d, "lineitem")
    p = F.col("l_partkey")
    own = i.select(F.col("l_suppkey").alias("report"), p.alias("part"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("e"), F.concat(F.lit("p"), p).alias("path"), F.col("l_linenumber").alias("line"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_extendedprice").alias("key"), F.when(F.col("l_returnflag") == "R", "non_default_setting").otherwise("none").alias("gate"), F.when(p % 3 == 0, "high").when(p % 3 == 1, "medium").otherwise("low").alias("confidence"), F.col("l_quantity").alias("score"))
    return reports.ordered(own, "report").select("report", "part", "ok", "n", "e", F.col("no").cast("long").alias("no"))


@query("""WITH l AS (SELECT l_suppkey AS repo, count(*) AS n, count(*) FILTER (l_partkey % 3 = 0) AS high, count(*) FILTER (l_partkey % 3 = 1) AS medium, count(*) FILTER (l_partkey % 3 = 2) AS low, count(*) FILTER (l_partkey % 3 = 0) + count(*) FILTER (l_partkey % 3 = 2) AS proofs, count(*) FILTER (l_returnflag = 'R') AS gated FROM lineitem GROUP BY 1)
SELECT repo, n + 6 + 5 * n + proofs + 2 * gated AS lines, n + 6 AS top_lines, n || ' findings: ' || concat_ws(', ', CASE WHEN high > 0 THEN high || ' high' END, CASE WHEN medium > 0 THEN medium || ' medium' END, CASE WHEN low > 0 THEN low || ' low' END) AS told FROM l""")
def q_report_markdown(spark, d):
    i, p = table(spark, d, "lineitem"), F.col("l_partkey")
    proof = F.array(F.struct(F.lit("a.py:1").alias("ref"), F.lit(None).cast("string").alias("url"), F.lit("see *it*").alias("note")))
    none = F.slice(proof, 1, 0)
    own = i.select(
        F.col("l_suppkey").alias("repo"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_extendedprice").alias("key"), F.concat(F.lit("src/"), p, F.lit(".py")).alias("path"), F.col("l_linenumber").alias("line"), F.lit("https://h/x").alias("url"), F.when(F.col("l_returnflag") == "R", "non_default_setting").otherwise("none").alias("gate"),
        F.when(p % 3 == 0, "high").when(p % 3 == 1, "medium").otherwise("low").alias("confidence"), F.col("l_quantity").alias("score"), F.concat(F.lit("Claim_"), p).alias("claim"), F.when(p % 3 == 1, none).otherwise(proof).alias("evidence"),
    )
    lines = reports.markdown(own, "repo")
    return lines.groupBy("repo").agg(F.count("*").alias("lines"), F.count_if(F.col("section") < 2).alias("top_lines"), F.max(F.when(F.col("at") == 3, F.col("line"))).alias("told"))


@query("""WITH l AS (SELECT l_suppkey AS repo, l_partkey % 50 AS f, l_partkey AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, f ORDER BY n) AS r FROM l) SELECT repo, 'src/a b' || chr(9) || f AS path, CASE WHEN p % 2 = 0 THEN '100644' ELSE '120000' END AS mode, left(sha256(p::VARCHAR), 40) AS sha, CAST(p % 4 AS INTEGER) AS stage FROM k WHERE r = 1""")
def q_index_entries(spark, d):
    """Items of a supplier as its index: a path's first entry counts; a path may hold blanks and tabs."""
    ordered = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    entry = lambda x: F.concat(F.when(x["l_partkey"] % 2 == 0, "100644 ").otherwise("120000 "), F.left(F.sha2(x["l_partkey"].cast("string"), 256), F.lit(40)), F.lit(" "), x["l_partkey"] % 4, F.lit("\tsrc/a b\t"), x["l_partkey"] % 50, F.lit("\x00"))
    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("repo")).agg(F.array_join(F.transform(ordered, entry), "").alias("listing"))
    return paths.index_entries(own, ["repo"])


FILE_NAMES = [".py", ".PYI", ".js", ".tar.gz", "", ".", ".yml", "/.py", ".mts"]
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "javascript", ".mts": "typescript", ".yml": "yaml", ".gz": "archive"}


@query("""WITH f AS (SELECT p_partkey, p_partkey % 9 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 3 THEN 'archive' WHEN 6 THEN 'yaml' WHEN 8 THEN 'typescript' END AS lang,
CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'archive' WHEN 6 THEN 'yaml' WHEN 8 THEN 'typescript' END AS rule_lang, k = 6 AS needs_leads FROM f""")
def q_path_language(spark, d):
    name = F.concat(F.lit("a.b/c"), F.get(F.array(*map(F.lit, FILE_NAMES)), (F.col("p_partkey") % 9).cast("int")))
    return paths.with_language(table(spark, d, "part").select("p_partkey", name.alias("path")), LANGUAGES, {"javascript": "typescript"}, {"yaml"}).drop("path")


@query("""WITH e AS (SELECT l_suppkey AS entity, CASE WHEN l_quantity > 20 THEN 'inbound' ELSE 'outbound' END AS direction, l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)
SELECT *, row_number() OVER (PARTITION BY entity, direction ORDER BY l_partkey, l_orderkey, l_linenumber, l_extendedprice) <= 25 AS kept FROM e""")
def q_edges_kept(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.when(F.col("l_quantity") > 20, "inbound").otherwise("outbound").alias("direction"), "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return paths.capped_edges(e, ["entity"], ["l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"])


@query("SELECT l_suppkey AS entity, greatest(0, count(*) FILTER (l_quantity > 20) - 25) AS inbound, greatest(0, count(*) FILTER (l_quantity <= 20) - 25) AS outbound FROM lineitem GROUP BY 1")
def q_edges_cut(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.when(F.col("l_quantity") > 20, "inbound").otherwise("outbound").alias("direction"))
    return paths.cut_edges(e, ["entity"])


@query("""SELECT l_suppkey AS doc_id, CASE WHEN bool_or(l_partkey % 5 = 0) THEN 1 ELSE 0 END + CASE WHEN bool_or(l_partkey % 5 = 1) THEN 2 ELSE 0 END + CASE WHEN bool_or(l_partkey % 5 = 2) THEN 1 ELSE 0 END + CASE WHEN bool_or(l_partkey % 5 = 3) THEN 1 ELSE 0 END AS names,
bool_or(l_partkey % 5 = 1) AS listed FROM lineitem GROUP BY 1""")
def q_exports(spark, d):
    forms = F.array(*map(F.lit, ["export async function run() {", "export { one as first, two, 3x };", "async def job(x):", "class Thing:", "import { no } from 'x'"]))
    text = F.array_join(F.transform(F.collect_list(F.col("l_partkey")), lambda p: F.get(forms, (p % 5).cast("int"))), "\n")
    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(code.exported(text).alias("e"))
    return own.select("doc_id", F.size("e").alias("names"), F.array_contains("e", "one").alias("listed"))
