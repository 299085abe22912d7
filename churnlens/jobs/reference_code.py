"""Queries over program text, names and raw logs, which Spark derives from the given tables. Each with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import code
from churnlens.jobs.reference import query
from churnlens.operators import evidence, findings, log, rules
from churnlens.sources.tables import table

#: How a document's prose is made into text with comment marks, quotes and brackets: (from, to), in this order.
C_LIKE = [(", ", " // "), (" the ", ' /* "'), ("!!", " */ "), ("e. ", "' "), ("|", "`"), (" un ", " \\\" "), (" de ", "*/")]
YAML_LIKE = [(", ", ": '"), (". ", "'' #"), (" the ", ' # "'), (" de ", ' "'), ("!!", "\\\""), ("|", "{'"), ("en", "#n")]
PYTHON_LIKE = [(", ", ' """'), (". ", "\n'''"), ("!!", "("), (" the ", " # "), ("e\n", "=\n"), (" de ", ' "'), ("|", ")")]


def made(text: Column, rules: list[tuple[str, str]]) -> Column:
    for a, b in rules:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def made_sql(rules: list[tuple[str, str]]) -> str:
    out = "text"
    for pair in rules:
        a, b = ("'" + x.replace("'", "''") + "'" for x in pair)
        out = f"replace({out}, {a}, {b})"
    return out


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all({made_sql(C_LIKE)}, {_sql_text(code.C_TOKENS)}), lambda t: CASE WHEN starts_with(t, '//') OR starts_with(t, '/*') THEN regexp_replace(t, '[^\\n]', ' ', 'g') ELSE t END), '') AS blanked FROM documents")
def q_strip_c(spark, d):
    return table(spark, d, "documents").select("doc_id", code.blank_c(made(F.col("text"), C_LIKE)).alias("blanked"))


YAML_SQL = "lambda t, i: CASE WHEN i = 1 AND starts_with(t, '#') THEN repeat(' ', length(t)) WHEN regexp_matches(t, '^[ \\t]#') THEN t[1] || repeat(' ', length(t) - 1) ELSE t END"


@query(f"SELECT doc_id, array_to_string(list_transform(string_split({made_sql(YAML_LIKE)}, chr(10)), lambda x: array_to_string(list_transform(regexp_extract_all(x, {_sql_text(code.YAML_TOKENS)}), {YAML_SQL}), '')), chr(10)) AS blanked FROM documents")
def q_strip_yaml(spark, d):
    return table(spark, d, "documents").select("doc_id", code.blank_yaml(made(F.col("text"), YAML_LIKE)).alias("blanked"))


PROPERTIES_LIKE = [("\nE", "\n# E"), ("\nT", "\n  ! T")]


@query(f"SELECT doc_id, array_to_string(list_transform(string_split({made_sql(PROPERTIES_LIKE)}, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\\s*[#!]') THEN repeat(' ', length(x)) ELSE x END), chr(10)) AS blanked FROM documents")
def q_strip_properties(spark, d):
    return table(spark, d, "documents").select("doc_id", code.blank_properties(made(F.col("text"), PROPERTIES_LIKE)).alias("blanked"))


@query(None)
def q_strip_py(spark, d):
    """No SQL: which triple quote is a docstring depends on all lines before it. Tested on known answers and by invariants."""
    return table(spark, d, "documents").select("doc_id", code.blank_python(made(F.col("text"), PYTHON_LIKE)).alias("blanked"))


@query("""WITH t AS (SELECT page_id, replace(replace(regexp_replace(html, '[\\r\\n]+', ' ', 'g'), '=', '`'), chr(1), '') AS x FROM pages),
f AS (SELECT *, repeat('`', 1 + coalesce(list_max(list_transform(regexp_extract_all(x, '`+'), lambda r: length(r))), 0)) AS fence, CASE WHEN regexp_matches(x, '^[` ]|[` ]$') THEN ' ' ELSE '' END AS pad FROM t)
SELECT page_id, CASE WHEN trim(x) = '' THEN '—' ELSE fence || pad || replace(x, '|', '\\|') || pad || fence END AS span FROM f""")
def q_md_code_span(spark, d):
    text = F.replace(F.regexp_replace("html", r"[\r\n]+", " "), F.lit("="), F.lit("`"))
    return table(spark, d, "pages").select("page_id", code.code_span(text, cell=True).alias("span"))


@query("SELECT c_custkey, lower(regexp_replace(c_name || '_.-' || c_mktsegment, '[-_.]+', '-', 'g')) AS name FROM customer")
def q_package_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", code.package_name(F.concat("c_name", F.lit("_.-"), "c_mktsegment")).alias("name"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 4 AS a, l_partkey % 5 AS b, l_suppkey % 6 AS c, l_orderkey % 4 AS x, l_linenumber % 5 AS y, (l_orderkey // 4) % 6 AS z, (l_orderkey + l_linenumber) % 8 AS k FROM lineitem),
n AS (SELECT *, a * 10000 + b * 100 + c AS own, x * 10000 + y * 100 + z AS low FROM v)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN own >= low AND own < CASE WHEN x > 0 THEN (x + 1) * 10000 WHEN y > 0 THEN (y + 1) * 100 ELSE z + 1 END WHEN 1 THEN own >= x * 10000 + y * 100 AND own < x * 10000 + (y + 1) * 100
WHEN 2 THEN own >= low AND own < (x + 2) * 10000 WHEN 3 THEN a = x OR own = low + 1 WHEN 4 THEN NULL WHEN 5 THEN TRUE WHEN 6 THEN CASE WHEN own > low THEN TRUE END ELSE own <= low END AS fits FROM n""")
def q_semver(spark, d):
    i = table(spark, d, "lineitem")
    s = lambda c: c.cast("long").cast("string")
    x, y, z = F.col("l_orderkey") % 4, F.col("l_linenumber") % 5, F.floor(F.col("l_orderkey") / 4) % 6
    own = F.concat_ws(".", s(F.col("l_quantity").cast("long") % 4), s(F.col("l_partkey") % 5), s(F.col("l_suppkey") % 6))
    dotted = F.concat_ws(".", s(x), s(y), s(z))
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    wanted = (
        F.when(k == 0, F.concat(F.lit("^"), dotted)).when(k == 1, F.concat(F.lit("~"), s(x), F.lit("."), s(y)))
        .when(k == 2, F.concat(F.lit(">="), dotted, F.lit(" <"), s(x + 2), F.lit(".0.0"))).when(k == 3, F.concat(s(x), F.lit(".x || ="), s(x), F.lit("."), s(y), F.lit("."), s(z + 1)))
        .when(k == 4, F.concat(dotted, F.lit(" - 9.0.0"))).when(k == 5, "*").when(k == 6, F.concat(F.lit(">"), dotted, F.lit(" || latest"))).otherwise(F.concat(F.lit("<="), dotted))
    )
    return i.select("l_orderkey", "l_linenumber", code.satisfies(own, wanted).alias("fits"))


def raw_log(spark, d) -> DataFrame:
    """record: the orders as raw log records, their lines as touched files; every seventh line is a rename, every eleventh binary."""
    i = table(spark, d, "lineitem")
    n = i["l_orderkey"] + i["l_linenumber"]
    path = F.concat(F.lit("src/é "), i["l_suppkey"].cast("string"), F.when(n % 5 == 0, F.lit("\ttab.py")).otherwise(F.lit(".py")))
    count = lambda c: F.when(n % 11 == 0, "-").otherwise(c.cast("long").cast("string"))
    name = F.when(n % 7 == 0, F.concat(F.lit("\x00old name\x00"), path)).otherwise(path)
    touch = F.concat_ws("\t", count(i["l_quantity"]), count(i["l_linenumber"]), name)
    body = i.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity", touch.alias("t")))), lambda x: x["t"]), "\x00").alias("body"))
    o = table(spark, d, "orders")
    head = F.concat_ws("\x00", o["o_orderkey"].cast("string"), o["o_custkey"].cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), o["o_orderpriority"])
    return o.join(body, "o_orderkey", "left").select(F.concat(head, F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("record"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS sha, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) - 1 AS pos, 'src/é ' || l_suppkey || CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN chr(9) || 'tab.py' ELSE '.py' END AS path,
CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS adds, CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 0 ELSE l_linenumber END AS dels, (l_orderkey + l_linenumber) % 11 = 0 AS is_binary FROM lineitem""")
def q_log_touches(spark, d):
    return log.touches_of(log.parsed_log(raw_log(spark, d)))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS sha, CAST(o_custkey AS VARCHAR) AS author, strftime(o_orderdate, '%Y-%m-%d') AS authored_at, o_orderpriority AS subject, coalesce(n, 0) AS files FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def q_log_commits(spark, d):
    return log.parsed_log(raw_log(spark, d)).select("sha", "author", "authored_at", "subject", F.size("files").cast("long").alias("files"))


@query("""WITH RECURSIVE f AS (SELECT o_orderkey AS key, o_totalprice AS price, CASE WHEN o_orderkey % 10 <> 0 AND o_orderstatus <> 'F' THEN o_orderkey + 1 END AS duplicate_of FROM orders),
e AS (SELECT a.key AS u, b.key AS v FROM f a JOIN f b ON a.duplicate_of = b.key), both_ AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT key AS node, key AS other FROM f UNION SELECT r.node, b.v FROM r JOIN both_ b ON b.u = r.other),
g AS (SELECT node, min(other) AS root FROM r GROUP BY node), s AS (SELECT root, arg_min(key, struct_pack(p := price, k := key)) AS survivor FROM g JOIN f ON f.key = g.node GROUP BY root HAVING count(*) > 1)
SELECT node AS key, survivor FROM g JOIN s USING (root) WHERE node <> survivor""")
def q_duplicate_closure(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.when((F.col("o_orderkey") % 10 != 0) & (F.col("o_orderstatus") != "F"), F.col("o_orderkey") + 1).alias("duplicate_of"))
    return findings.duplicate_closure(f.select("key", "price"), f.select("key", "duplicate_of"), "key", [F.col("price"), F.col("key")])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'reuse' WHEN 1 THEN 'skip' ELSE 'check' END AS action, CASE l_partkey % 4 WHEN 0 THEN 'upheld' WHEN 1 THEN 'narrowed' WHEN 2 THEN 'refuted' ELSE 'inconclusive' END AS verdict, l_quantity AS q, l_discount AS dc, l_tax AS tx, l_suppkey AS s FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN action = 'reuse' THEN CASE WHEN s % 2 = 0 THEN 'upheld' ELSE 'refuted' END WHEN action = 'skip' THEN 'unchecked' WHEN q <= 3 THEN 'unchecked' WHEN q <= 6 THEN 'unchecked' WHEN q <= 9 THEN 'unchecked' WHEN q <= 12 THEN 'unchecked'
WHEN verdict IN ('refuted', 'narrowed') AND s % 5 = 0 THEN 'inconclusive' WHEN verdict IN ('refuted', 'narrowed') AND dc > 0.08 THEN 'inconclusive' WHEN verdict = 'narrowed' AND dc < 0.02 THEN 'inconclusive' ELSE verdict END AS status,
CASE WHEN action = 'reuse' THEN 'reused' WHEN action = 'skip' THEN 'skipped' WHEN q <= 3 THEN 'no result' WHEN q <= 6 THEN 'failed' WHEN q <= 9 THEN 'contract' WHEN q <= 12 THEN 'stale'
WHEN verdict IN ('refuted', 'narrowed') AND s % 5 = 0 THEN 'no evidence' WHEN verdict IN ('refuted', 'narrowed') AND dc > 0.08 THEN 'self-reference' WHEN verdict = 'narrowed' AND dc < 0.02 THEN 'does not say what holds' ELSE 'verdict' END AS rule, tx FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN status = 'upheld' AND tx > 0.05 THEN 'inconclusive' ELSE status END AS status, CASE WHEN status = 'upheld' AND tx > 0.05 THEN 'unconfirmed default' ELSE rule END AS rule FROM f""")
def q_settle(spark, d):
    k, q, dc = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.col("l_quantity"), F.col("l_discount")
    action = F.when(k == 0, "reuse").when(k == 1, "skip").otherwise("check")
    verdict = F.element_at(F.array(*map(F.lit, ("upheld", "narrowed", "refuted", "inconclusive"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    ledger = F.when(F.col("l_suppkey") % 2 == 0, "upheld").otherwise("refuted")
    told = evidence.settled(action, q > 3, q <= 6, q > 9, q > 12, verdict, F.col("l_suppkey") % 5, dc > 0.08, F.when(dc < 0.02, " ").otherwise("part"), F.when(F.col("l_tax") > 0.05, 1), ledger)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", told.alias("t")).select("l_orderkey", "l_linenumber", "l_partkey", "t.*")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey AS name, 'v' || l_suppkey % 3 AS version, CASE l_orderkey % 3 WHEN 0 THEN 'a/b.py' WHEN 1 THEN 'a/../b.py' ELSE 'c.py' END AS path, l_linenumber AS a, l_linenumber + CAST(l_quantity AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 7 = 0 THEN 'is not a dependency reference' WHEN p_size <= 10 THEN 'is not an available dependency' WHEN 'v' || p_partkey % 3 <> version THEN 'was read at another version'
WHEN path LIKE '%..%' THEN 'climbs out of the repository with ' || chr(39) || '..' || chr(39) WHEN path = 'c.py' THEN 'no such file' WHEN b > p_size THEN 'lines are outside the file' END AS problem FROM r JOIN part ON p_partkey = l_partkey""")
def q_dep_ref(spark, d):
    i = table(spark, d, "lineitem")
    s = lambda c: c.cast("long").cast("string")
    k = F.col("l_orderkey") % 3
    path = F.when(k == 0, "a/b.py").when(k == 1, "a/../b.py").otherwise("c.py")
    ref = F.concat(F.lit("npm:@x/"), s(F.col("l_partkey")), F.lit("@v"), s(F.col("l_suppkey") % 3), F.lit(":"), path, F.lit(":"), s(F.col("l_linenumber")), F.lit("-"), s(F.col("l_linenumber") + F.col("l_quantity").cast("long")))
    refs = i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_orderkey") % 7 == 0, F.concat(F.lit("x"), ref)).otherwise(ref).alias("ref"))
    p = table(spark, d, "part")
    name = F.concat(F.lit("npm:@x/"), s(F.col("p_partkey"))).alias("id")
    packages = p.select(name, F.concat(F.lit("v"), s(F.col("p_partkey") % 3)).alias("version"), F.when(F.col("p_size") > 10, "available").otherwise("missing").alias("status"))
    files = p.select(name, F.lit("a/b.py").alias("path"), F.col("p_size").cast("long").alias("n_lines"))
    return evidence.dependency_refs(refs, packages, files).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "problem")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS key, l_partkey AS path, CAST(l_linenumber AS BIGINT) AS lo, CAST(l_linenumber + l_quantity AS BIGINT) AS hi FROM lineitem), b AS (SELECT DISTINCT l_partkey AS path, CAST(l_quantity AS BIGINT) AS line, CASE WHEN l_returnflag = 'R' THEN repeat('0', 40) ELSE sha256(CAST(l_suppkey AS VARCHAR)) END AS sha FROM lineitem)
SELECT key, array_to_string(list_sort(list(DISTINCT sha)), ',') AS shas FROM r JOIN b ON b.path = r.path AND line BETWEEN lo AND hi AND sha <> repeat('0', 40) GROUP BY key""")
def q_blame(spark, d):
    i = table(spark, d, "lineitem")
    ranges = i.select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("path"), F.col("l_linenumber").cast("long").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("hi"))
    sha = F.when(F.col("l_returnflag") == "R", evidence.ZERO_SHA).otherwise(F.sha2(F.col("l_suppkey").cast("string"), 256))
    blame = i.select(F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("line"), sha.alias("sha"))
    return evidence.introduced(ranges, blame, ["key"]).select("key", F.array_join("shas", ",").alias("shas"))


@query(None)
def q_excerpt_budget(spark, d):
    """No SQL: what fits depends on all spans before it. Tested against a plain count of lines."""
    i = table(spark, d, "lineitem")
    spans = i.select(F.col("l_partkey").alias("path"), (-F.col("l_extendedprice")).alias("rank"), (F.col("l_linenumber") * 40).cast("long").alias("lo"), (F.col("l_linenumber") * 40 + F.col("l_quantity")).cast("long").alias("hi"), F.lit(300).cast("long").alias("n_lines"))
    return evidence.excerpts(spans, 150)


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END AS doc FROM events)
SELECT event_id, CASE WHEN json_valid(doc) THEN CAST(json_extract_string(doc, '$.k') AS VARCHAR) ELSE 'none' END AS k FROM e""")
def q_json_default(spark, d):
    doc = F.when(F.col("event_id") % 3 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(doc, "$.k"), F.lit("none")).alias("k"))


#: Rules of the one-pass query: all kinds of tests over the prose of the documents.
TABLE = [
    rules.Rule("after_heading", 1, pattern=r"^[A-Z][a-z]+ ", window=3, present_within="[0-9]{3,}"),
    rules.Rule("shout", 2, pattern="!!", require="[A-Z]{5}"),
    rules.Rule("no_end", 3, "en", pattern=r"[a-z]$", window=2, window_before=1, absent_within=r"\.$"),
    rules.Rule("first_numeral", 4, kind="absent", anchor="[0-9]", absent="@", require="[0-9]{4}"),
    rules.Rule("bar", 5, pattern=r"\|", absent_before="#", absent_before_window=2),
]
RULE_TABLE_SQL = """WITH lines AS (SELECT doc_id, lang, text, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line, ls FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)),
h1 AS (SELECT doc_id, n, 1 AS ord, 'after_heading' AS rule, line FROM lines WHERE regexp_matches(line, '^[A-Z][a-z]+ ') AND regexp_matches(array_to_string(ls[n:n + 2], chr(10)), '[0-9]{3,}')),
h2 AS (SELECT doc_id, n, 2, 'shout', line FROM lines WHERE contains(line, '!!') AND regexp_matches(text, '[A-Z]{5}')),
h3 AS (SELECT doc_id, n, 3, 'no_end', line FROM lines WHERE lang = 'en' AND regexp_matches(line, '[a-z]$') AND NOT regexp_matches(array_to_string(ls[greatest(1, n - 1):n + 1], chr(10)), '(?m)\\.$')),
h4 AS (SELECT doc_id, n, 4, 'first_numeral', line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM lines WHERE regexp_matches(line, '[0-9]') AND NOT contains(text, '@') AND regexp_matches(text, '[0-9]{4}')) WHERE r = 1),
h5 AS (SELECT doc_id, n, 5, 'bar', line FROM lines WHERE contains(line, '|') AND NOT contains(array_to_string(ls[greatest(1, n - 2):n], chr(10)), '#')),
a AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4 UNION ALL SELECT * FROM h5),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY n) AS r FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY ord) AS o FROM c WHERE r <= 5)
SELECT doc_id, n AS line_no, rule, substr(trim(line), 1, 200) AS snippet FROM k WHERE o = 1"""


@query(RULE_TABLE_SQL)
def q_rule_table(spark, d):
    return rules.run_rules(table(spark, d, "documents"), TABLE, lang="lang")


IMPORT_LIKE = [(". ", "\n"), (", ", " from '"), ("The ", "import "), ("Of ", "from "), (" of ", " import "), ("!!", "'"), ("Und ", "const x = require('"), ("En ", "  import ")]
_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(x, {_sql_text(p)}) THEN coalesce(nullif(regexp_extract(x, {_sql_text(p)}, 1), ''), {'nullif(regexp_extract(x, ' + _sql_text(p) + ', 2), ' + chr(39) * 2 + ')' if p.endswith('))') else 'NULL'})" for p in code.IMPORTS) + " END"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM (SELECT doc_id, {made_sql(IMPORT_LIKE)} AS t FROM documents)),
m AS (SELECT doc_id, i, {_FIRST} AS target FROM l), f AS (SELECT doc_id, target, min(i) AS i FROM m WHERE target IS NOT NULL GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(target, '|' ORDER BY i), '') AS imports FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def q_imports(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(code.captured(made(F.col("text"), IMPORT_LIKE), code.IMPORTS), "|").alias("imports"))


@query("""WITH t AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN 'x.get("' || upper(source) || '", 5)' WHEN 1 THEN 'os.getenv(' || chr(39) || source || chr(39) || ')' WHEN 2 THEN 'getattr(conf, ' || chr(39) || source || chr(39) || ' , None)' ELSE 'a.pop("x' || source || '", 1)' END || chr(10) || left(text, 200) AS body FROM documents)
SELECT doc_id, doc_id % 4 IN (0, 2) AND doc_id % 5 <> 0 AS reads FROM t""")
def q_fallback_read(spark, d):
    k, s = F.col("doc_id") % 4, F.col("source")
    call = F.when(k == 0, F.concat(F.lit('x.get("'), F.upper(s), F.lit('", 5)'))).when(k == 1, F.concat(F.lit("os.getenv('"), s, F.lit("')"))).when(k == 2, F.concat(F.lit("getattr(conf, '"), s, F.lit("' , None)"))).otherwise(F.concat(F.lit('a.pop("x'), s, F.lit('", 1)')))
    body = F.concat(call, F.lit("\n"), F.left("text", F.lit(200)))
    setting = F.when(F.col("doc_id") % 5 == 0, F.concat(s, F.lit("(?)"))).otherwise(s)
    return table(spark, d, "documents").select("doc_id", code.reads_with_fallback(body, setting, "python").alias("reads"))


@query("""SELECT doc_id, sha256('{"claim":"' || lang || '","key":' || doc_id || ',"preconditions":[{"needs":"changed","setting":"' || source || '"}]}') AS claim_hash FROM documents""")
def q_claim_hash(spark, d):
    settings = F.array(F.struct(F.col("source").alias("setting"), F.lit("changed").alias("needs"), F.lit("x").alias("confirmation")))
    return table(spark, d, "documents").select("doc_id", code.record_hash({"preconditions": settings, "key": F.col("doc_id"), "claim": F.col("lang")}, {"preconditions": ["needs", "setting"]}).alias("claim_hash"))
