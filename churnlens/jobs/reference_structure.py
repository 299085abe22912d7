"""Queries over programs that Spark makes of the given tables: blocks, structural rules, whole catalogs. Each with SQL that knows the lines by their kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.jobs.reference import query
from churnlens.operators import handlers, rules
from churnlens.sources.tables import table


def programs(spark: SparkSession, d: str, lines: list[str], by: str = "l_partkey", head: str = "") -> DataFrame:
    """doc_id, text: a program for each supplier, a line for each of its items, the kind of line told by the column `by`; head comes first where it is given."""
    item = F.struct("l_orderkey", "l_linenumber", "l_partkey", F.pmod(F.col(by).cast("long"), F.lit(len(lines))).cast("int").alias("k"))
    kinds = F.array(*map(F.lit, lines))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.get(kinds, x["k"])), "\n")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.concat(F.lit(head), text).alias("text"))


def in_turn(spark: SparkSession, d: str, forms: list[list[str]]) -> DataFrame:
    """doc_id, text: as programs, but lines come in turns of len(forms), the line at each place chosen among that place's forms by the part's number."""
    ordered = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    table_ = F.array(*(F.array(*map(F.lit, f)) for f in forms))

    def line(x, i):
        own = F.get(table_, F.pmod(i, F.lit(len(forms))))
        return F.get(own, F.pmod(x["l_partkey"], F.size(own)).cast("int"))

    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(F.array_join(F.transform(ordered, line), "\n").alias("text"))


def lines_sql(n: int, by: str = "l_partkey") -> str:
    return f"p AS (SELECT l_suppkey AS doc_id, row_number() OVER w AS n, CAST({by} AS BIGINT) % {n} AS k, l_partkey AS part, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey))"


def turns_sql(n: int) -> str:
    return f"p AS (SELECT doc_id, n, part, total, (n - 1) % {n} AS place, (n - 1) // {n} AS turn FROM (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n, l_partkey AS part, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem))"


BRACES = ["for (x of y) {", "}", "call();", "}", "if (a) {", "while (b) { c(); }", "work();"]
BLOCKS_SQL = f"""WITH {lines_sql(7)}, c AS (SELECT *, sum(CASE WHEN k IN (0, 4) THEN 1 WHEN k IN (1, 3) THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS depth FROM p),
h AS (SELECT doc_id, n, total, depth - (k = 0)::INT AS before, k FROM c WHERE k IN (0, 5)),
e AS (SELECT h.doc_id, h.n, h.k, h.total, min(c.n) AS stop FROM h LEFT JOIN c ON c.doc_id = h.doc_id AND c.n > h.n AND c.n < h.n + 200 AND c.depth <= h.before AND h.k = 0 GROUP BY ALL),
b AS (SELECT doc_id, n AS line_no, CASE WHEN k = 5 THEN n ELSE coalesce(stop, least(total, n + 200)) END AS end_line, CASE k WHEN 5 THEN 'while (b) {{ c(); }}' ELSE 'for (x of y) {{' END AS header FROM e)
SELECT b.doc_id, b.line_no, b.end_line, b.header, count(o.doc_id) AS depth FROM b LEFT JOIN b o ON o.doc_id = b.doc_id AND o.line_no < b.line_no AND o.end_line >= b.line_no GROUP BY ALL"""


@query(BLOCKS_SQL)
def q_blocks(spark, d):
    return handlers.blocks(programs(spark, d, BRACES), handlers.LOOP_BRACES, False)


INDENTED = ["for x in y:", "    for z in x:", "        while z:", "    call()", "        work()", "            deep()", ""]
INDENT_SQL = f"""WITH {lines_sql(7)}, c AS (SELECT *, CASE k WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 4 WHEN 4 THEN 8 WHEN 5 THEN 12 END AS indent FROM p),
e AS (SELECT h.doc_id, h.n, h.k, h.total, min(c.n) AS stop FROM c h LEFT JOIN c ON c.doc_id = h.doc_id AND c.n > h.n AND c.n < h.n + 200 AND c.indent <= h.indent WHERE h.k < 3 GROUP BY ALL),
b AS (SELECT doc_id, n AS line_no, coalesce(stop - 1, least(total, n + 200)) AS end_line, CASE k WHEN 0 THEN 'for x in y:' WHEN 1 THEN 'for z in x:' ELSE 'while z:' END AS header FROM e)
SELECT b.doc_id, b.line_no, b.end_line, b.header, count(o.doc_id) AS depth FROM b LEFT JOIN b o ON o.doc_id = b.doc_id AND o.line_no < b.line_no AND o.end_line >= b.line_no GROUP BY ALL"""


@query(INDENT_SQL)
def q_blocks_indented(spark, d):
    return handlers.blocks(programs(spark, d, INDENTED), handlers.LOOP_INDENT, True)


PAGED = [["for (;;) {", "while (go) {", "work();"], ["page++;", "read(rows);", "show(page);"], ["store(rows);", "work();"], ["work();", "nextCursor = r.next();", "work(1);"], ["}"]]
CHECKPOINT_SQL = f"""WITH {turns_sql(5)}, k AS (SELECT doc_id, n, turn, place, CASE place WHEN 0 THEN part % 3 < 2 WHEN 1 THEN part % 3 <> 1 WHEN 3 THEN part % 3 = 1 ELSE false END AS pages, place = 0 AND part % 3 < 2 AS loop, (place = 1 AND part % 3 = 0) OR (place = 3 AND part % 3 = 1) AS moves, place = 2 AND part % 2 = 0 AS saves FROM p),
t AS (SELECT doc_id, turn, min(n) AS line_no, bool_or(loop) AS loop, bool_or(pages AND NOT loop) AS pages, bool_or(moves) AS moves, bool_or(saves) AS saves, bool_or(pages AND place IN (1, 3)) AS beside FROM k GROUP BY 1, 2),
f AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM t WHERE loop AND pages AND moves AND NOT (saves AND beside))
SELECT doc_id, line_no, 'paged loop that saves no place, so an interrupted run begins anew' AS note FROM f WHERE r <= 3"""


@query(CHECKPOINT_SQL)
def q_mod_checkpoint(spark, d):
    return handlers.leads(in_turn(spark, d, PAGED), "s07_checkpoint", "typescript")


ENTITIES = [["for (Order o : orders) {", "for (OrderDto o : orders) {", "for (final Map.Entry<K, List<V>> e : all) {", "for (Order o : repo.findAll()) {"], ["o.getLines().size();", "o.getId();", "o.getPart().getName();", "o.getPart().getId();", "use(o.getLines().get(0));", "o.getName().trim();", "for (Line l : o.getLines())"], ["}"]]
N_PLUS_ONE_SQL = f"""WITH {turns_sql(3)}, t AS (SELECT doc_id, turn, min(n) AS line_no, max(CASE WHEN place = 0 THEN part % 4 END) AS head, max(CASE WHEN place = 1 THEN part % 7 END) AS body FROM p GROUP BY 1, 2),
f AS (SELECT doc_id, line_no + 1 AS line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM t WHERE head IN (0, 3) AND body IN (0, 2, 4, 6) AND doc_id % 3 <> 0)
SELECT doc_id, line_no, 'loop over `o` goes through an association of each element, with no eager fetch in this file' AS note FROM f WHERE r <= 3"""


@query(N_PLUS_ONE_SQL)
def q_mod_nplus1(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "@EntityGraph @Entity\n").otherwise("import jakarta.persistence.Entity;\n")
    return handlers.leads(in_turn(spark, d, ENTITIES).withColumn("text", F.concat(head, "text")), "s29_n_plus_one", "java")


WAITING = ["work();"] * 23 + ["retry();", "setTimeout(go, 500);", "setTimeout(go, wait);", "setTimeout(go, PAUSE);", "const PAUSE = 40 * 5;", "wait = wait * 2;", "const cap = Math.min(a, b);", "x = random();"]
BACKOFF_SQL = f"""WITH {lines_sql(len(WAITING))}, a AS (SELECT *, sum((k = 23)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS near, bool_or(k = 28) OVER d AS grows, bool_or(k = 29) OVER d AS capped, bool_or(k = 30) OVER d AS jitters, bool_or(k = 27) OVER d AS named FROM p WINDOW d AS (PARTITION BY doc_id)),
w AS (SELECT *, k = 24 OR (k = 26 AND named) AS still, k = 25 OR (k = 26 AND NOT named) AS varies FROM a WHERE k IN (24, 25, 26) AND near > 0),
f AS (SELECT doc_id, min(n) FILTER (still AND NOT grows) AS s, arg_min(k, n) FILTER (still AND NOT grows) AS sk, min(n) FILTER (varies AND grows AND NOT capped) AS c, min(n) FILTER (varies AND grows AND NOT jitters) AS j FROM w GROUP BY doc_id)
SELECT doc_id, s AS line_no, 'retry waits a constant ' || CASE sk WHEN 24 THEN '500' ELSE 'PAUSE (40 * 5)' END || ', so all clients retry on one schedule' AS note FROM f WHERE s IS NOT NULL
UNION ALL SELECT doc_id, c, 'backoff grows without a ceiling' FROM f WHERE c IS NOT NULL UNION ALL SELECT doc_id, j, 'backoff has no jitter, so clients retry together' FROM f WHERE j IS NOT NULL"""


@query(BACKOFF_SQL.replace("CAST(l_partkey AS BIGINT) % 31", "CASE WHEN (l_partkey * 7 + l_suppkey * 3) % 31 >= 28 AND l_suppkey % 5 <> (l_partkey * 7 + l_suppkey * 3) % 31 - 26 THEN 0 ELSE (l_partkey * 7 + l_suppkey * 3) % 31 END"))
def q_mod_backoff(spark, d):
    """Growth, ceiling and jitter each in the programs of some suppliers only, so that every verdict comes up."""
    kind = F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey") * 3, F.lit(31))
    kept = F.when((kind >= 28) & (F.col("l_suppkey") % 5 != kind - 26), 0).otherwise(kind)
    item = F.struct("l_orderkey", "l_linenumber", "l_partkey", kept.cast("int").alias("k"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.get(F.array(*map(F.lit, WAITING)), x["k"])), "\n")
    made = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc_id")).agg(text.alias("text"))
    return handlers.leads(made, "s02_backoff", "typescript")


CALLED = 140
RULE_CATALOG_SQL = f"""WITH {lines_sql(CALLED)}, r AS (SELECT DISTINCT p_partkey % {CALLED} AS r FROM part),
h AS (SELECT p.doc_id, p.n, r.r, r.r % 10 AS g, row_number() OVER (PARTITION BY p.doc_id, r.r ORDER BY p.n) AS c FROM p JOIN r ON p.k = r.r
WHERE (r.r % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.n BETWEEN p.n AND p.n + 2 AND q.k BETWEEN 10 AND 19)) AND (r.r % 5 <> 0 OR EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.k = 7)))
SELECT doc_id, n AS line_no, 'r' || r AS rule, 'call_' || r || '();' AS snippet, 'g' || g AS "group", 'note ' || r AS note FROM h WHERE c <= 5"""


@query(RULE_CATALOG_SQL)
def q_rule_catalog(spark, d):
    """Rules from a table, one for each kind of call, with frames and gates: many rules, one plan."""
    r = F.col("r")
    of = table(spark, d, "part").select((F.col("p_partkey") % CALLED).alias("r")).distinct()
    catalog = of.select(
        F.concat(F.lit("r"), r).alias("id"), r.cast("int").alias("ord"), F.concat(F.lit("g"), r % 10).alias("group"), F.concat(F.lit("note "), r).alias("note"), F.concat(F.lit(r"\bcall_"), r, F.lit(r"\s*\(")).alias("pattern"),
        F.when(r % 3 == 0, r"call_1\d\(").alias("absent_within"), F.lit(3).alias("window"), F.when(r % 5 == 0, r"^call_7\(").alias("require"),
    )
    made = programs(spark, d, [f"call_{i}();" for i in range(CALLED)])
    return rules.run_rules(made, rules.rules_from(catalog), told=True)


OUTSIDE = ["work();", "client.send(x);", "from legacy import db", "import requests", "db.execute(q)", "requests.get(url)", ""]
OUTSIDE_RULES = [rules.Boundary("http", 0, "HTTP", r"\brequests\s*\.\s*get\s*\(", None, r"^import requests\b"), rules.Boundary("sql", 1, "database", r"\.\s*execute\s*\("), rules.Boundary("any", 2, "other", r"\b(?:requests|client)\s*\.\s*(?:get|send)\s*\(")]
BOUNDARY_SQL = f"""WITH {lines_sql(7)}, k AS (SELECT doc_id, n, CASE WHEN doc_id % 2 = 0 AND k = 3 THEN 0 ELSE k END AS k FROM p), a AS (SELECT *, bool_or(k = 3) OVER (PARTITION BY doc_id) AS opened FROM k)
SELECT doc_id, n AS line_no, CASE k WHEN 1 THEN 'any' WHEN 4 THEN 'sql' ELSE CASE WHEN opened THEN 'http' ELSE 'any' END END AS rule, CASE k WHEN 1 THEN 'other' WHEN 4 THEN 'database' ELSE CASE WHEN opened THEN 'HTTP' ELSE 'other' END END AS label, CASE k WHEN 1 THEN 'client.send(x);' WHEN 4 THEN 'db.execute(q)' ELSE 'requests.get(url)' END AS snippet FROM a WHERE k IN (1, 4, 5)"""


@query(BOUNDARY_SQL)
def q_boundaries(spark, d):
    made = programs(spark, d, OUTSIDE).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("import requests"), F.lit("work();"))).otherwise(F.col("text")))
    return rules.boundaries(made.withColumn("lang", F.lit("python")), OUTSIDE_RULES)
