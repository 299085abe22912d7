"""Further queries: reports, evidence, scoring, caches. Each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.jobs.reference import HISTORY, KINDS, LINES, RULE_HITS, RULES, hits, query, rows
from churnlens.functions import exprs
from churnlens.operators import findings, history, leads
from churnlens.sources.tables import commits, table, touches

REASONS = [("vendored", "^Brand#1"), ("generated", "[02468]$"), ("test data", "PROMO|STANDARD")]
REASON_SQL = "CASE WHEN regexp_matches(p_brand || '/' || p_type, '^Brand#1') THEN 'vendored' WHEN regexp_matches(p_brand, '[02468]$') THEN 'generated' WHEN regexp_matches(p_type, 'PROMO|STANDARD') THEN 'test data' ELSE 'kept' END"


@query(f"WITH {LINES}, w AS (SELECT item_id, regexp_extract(text, '[a-z]{{6,}}') AS word FROM benchmark), t AS (SELECT DISTINCT doc_id, line_no, unnest(regexp_extract_all(line, '[a-z]{{6,}}')) AS word FROM lines) SELECT item_id, doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, line_no) AS r FROM t JOIN w USING (word) WHERE word <> '') WHERE r <= 15")
def q_call_sites(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.regexp_extract("text", "[a-z]{6,}", 0).alias("word")).where("word <> ''")
    seen = leads.lines(table(spark, d, "documents")).select("doc_id", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[a-z]{6,}"), F.lit(0)))).alias("word"))
    first = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id", "line_no"))
    return seen.join(words, "word").withColumn("r", first).where("r <= 15").select("item_id", "doc_id", "line_no")


@query("SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS packages FROM documents WHERE text LIKE '%,%' GROUP BY lang")
def q_own_packages(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains(",")).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("packages"))


@query("SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (toxic = 1) AS toxic, count(*) AS n FROM labels")
def q_report_json_counts(spark, d):
    one = lambda c, v: F.count_if(F.col(c) == v)
    return table(spark, d, "labels").agg(one("quality", 1).alias("good"), one("quality", 0).alias("poor"), one("toxic", 1).alias("toxic"), F.count("*").alias("n"))


@query("SELECT path, count(*) AS entries, min(role) AS first_role FROM (SELECT l_partkey AS path, 'primary' AS role FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey, 'cited' FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT l_partkey, 'duplicate' FROM lineitem WHERE l_returnflag = 'R') GROUP BY path")
def q_index_union(spark, d):
    i = table(spark, d, "lineitem")
    part = lambda cond, role: i.where(cond).select(F.col("l_partkey").alias("path"), F.lit(role).alias("role"))
    both = part("l_linenumber = 1", "primary").unionByName(part("l_linenumber = 2", "cited")).unionByName(part("l_returnflag = 'R'", "duplicate"))
    return both.groupBy("path").agg(F.count("*").alias("entries"), F.min("role").alias("first_role"))


@query("SELECT doc_id, sha256('# ' || source || chr(10) || text) AS bundle_hash FROM documents")
def q_bundle_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("# "), "source", F.lit("\n"), "text"), 256).alias("bundle_hash"))


@query(f"SELECT {REASON_SQL} AS reason, count(*) AS n FROM part GROUP BY 1")
def q_exclusion_reason(spark, d):
    path = F.concat_ws("/", "p_brand", "p_type")
    rules = [REASONS[0], ("generated", "^[^/]*[02468]/"), ("test data", "/.*(PROMO|STANDARD)")]
    return table(spark, d, "part").groupBy(exprs.ordered(rules, path, "kept").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT page_id FROM pages WHERE len(list_filter(list_slice(string_split(url, '/'), 1, len(string_split(url, '/')) - 1), lambda x: x IN ('scripts', 'bin', 'tools', 'blog', 'a', 'p'))) > 0 OR page_id % 10 = 0")
def q_script_path(spark, d):
    parts = F.split("url", "/")
    parents = F.slice(parts, 1, F.size(parts) - 1)
    return table(spark, d, "pages").where(F.arrays_overlap(parents, F.array(*map(F.lit, ("scripts", "bin", "tools", "blog", "a", "p")))) | (F.col("page_id") % 10 == 0)).select("page_id")


@query(f"WITH {LINES}, {RULE_HITS}, h AS (SELECT DISTINCT doc_id FROM hits WHERE rule <> 'comma') SELECT d.doc_id, round(coalesce(0.05 + 0.95 * (n_chars - min(n_chars) OVER ()) / nullif(max(n_chars) OVER () - min(n_chars) OVER (), 0)::DOUBLE, 1.0), 6) AS norm FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id WHERE h.doc_id IS NOT NULL OR lang <> 'en'")
def q_config_drop(spark, d):
    own = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    # the lead is looked for before the scaling, as what is dropped must not stretch the range
    has = F.exists(F.split("text", "\n", -1), lambda x: F.lit(False) | x.rlike("|".join(f"(?:{p})" for _, n, p in RULES if n != "comma")))
    kept = own.where(has | (F.col("lang") != "en")).select("doc_id", "n_chars")
    return kept.select("doc_id", F.round(exprs.normalised(F.col("n_chars"), *history.extremes(kept, "n_chars")), 6).alias("norm"))


@query("SELECT doc_id, CASE WHEN r > 1 THEN 'skip' WHEN doc_id % 4 = 0 THEN 'reuse' ELSE 'check' END AS action FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents)")
def q_plan_actions(spark, d):
    first = F.row_number().over(Window.partitionBy(F.md5(F.col("text").cast("binary"))).orderBy("doc_id"))
    ranked = table(spark, d, "documents").select("doc_id", first.alias("r"))
    return ranked.select("doc_id", F.when(F.col("r") > 1, "skip").when(F.col("doc_id") % 4 == 0, "reuse").otherwise("check").alias("action"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'incomplete' WHEN quality = 1 THEN 'clean' ELSE 'reported' END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q_report_states(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.select("doc_id", F.when(F.col("quality").isNull(), "incomplete").when(F.col("quality") == 1, "clean").otherwise("reported").alias("state"))


@query("SELECT a.k, bool_and(meets) AS self_reference FROM (SELECT n.k, n.lo, bool_or(n.lo <= h.hi AND h.lo <= n.hi) AS meets FROM (SELECT l_orderkey AS k, l_linenumber AS lo, l_linenumber + 1 AS hi FROM lineitem WHERE l_returnflag = 'N') n JOIN (SELECT l_orderkey AS k, l_linenumber AS lo, l_linenumber AS hi FROM lineitem WHERE l_returnflag <> 'N') h ON n.k = h.k GROUP BY 1, 2) a GROUP BY 1")
def q_overlap_every(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("lo"), "l_returnflag")
    need = i.where("l_returnflag = 'N'").select("k", "lo", (F.col("lo") + 1).alias("hi"))
    have = i.where("l_returnflag <> 'N'").select("k", "lo", F.col("lo").alias("hi"))
    return findings.covered(need.join(have.select("k"), "k", "left_semi"), have, "k").select("k", F.col("all_meet").alias("self_reference"))


@query(f"WITH {LINES}, {RULE_HITS} SELECT rule, count(*) AS read, count(*) FILTER (quality = 0) AS confirmed FROM (SELECT DISTINCT rule, doc_id FROM hits) h LEFT JOIN labels USING (doc_id) GROUP BY rule")
def q_lead_precision(spark, d):
    own = hits(spark, d).select("rule", "doc_id").distinct().join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return own.groupBy("rule").agg(F.count("*").alias("read"), F.count_if(F.col("quality") == 0).alias("confirmed"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY substr(sha256(text), 1, 8)) AS first_id, count(*) OVER (PARTITION BY substr(sha256(text), 1, 8)) AS documents FROM documents")
def q_prefix_join(spark, d):
    # short hashes have one length, so the prefix is a column and the join an equi-join; copies of one text meet in one row, never in pairs
    own = table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 8).alias("short"))
    each = own.groupBy("short").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("documents"))
    return own.join(each, "short").select("doc_id", "first_id", "documents")


@query("SELECT d.doc_id, r.doc_id IS NOT NULL AS recorded FROM documents d LEFT JOIN (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, md5(source) FROM documents WHERE doc_id % 3 = 1) r ON r.doc_id = d.doc_id AND r.h = md5(d.text)")
def q_hash_join(spark, d):
    docs = table(spark, d, "documents")
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias("h")
    record = docs.where("doc_id % 3 = 0").select("doc_id", digest("text")).unionByName(docs.where("doc_id % 3 = 1").select("doc_id", digest("source"))).withColumn("has", F.lit(True))
    return docs.select("doc_id", digest("text")).join(record, ["doc_id", "h"], "left").select("doc_id", F.coalesce("has", F.lit(False)).alias("recorded"))


@query("SELECT lower(trim(c_mktsegment)) AS setting, count(*) FILTER (o_orderstatus = 'F') AS matched, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def q_defaults_score(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return both.groupBy(F.lower(F.trim("c_mktsegment")).alias("setting")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("matched"), F.count("*").alias("n"))


@query("WITH c AS (SELECT doc_id % 3 AS claimed, quality + (1 - toxic) AS deserved FROM labels) SELECT count(*) FILTER (claimed = deserved) AS exact, count(*) FILTER (abs(claimed - deserved) <= 1) AS within_one, count(*) FILTER (claimed > deserved) AS over_, count(*) FILTER (claimed < deserved) AS under_ FROM c")
def q_confidence_score(spark, d):
    c = table(spark, d, "labels").select((F.col("doc_id") % 3).alias("c"), (F.col("quality") + 1 - F.col("toxic")).alias("d"))
    return c.agg(F.count_if(F.col("c") == F.col("d")).alias("exact"), F.count_if(F.abs(F.col("c") - F.col("d")) <= 1).alias("within_one"), F.count_if(F.col("c") > F.col("d")).alias("over_"), F.count_if(F.col("c") < F.col("d")).alias("under_"))


@query("WITH g AS (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) > 1 AS dup, doc_id % 2 = 0 AS said FROM documents) SELECT count(*) FILTER (dup AND said) AS found, count(*) FILTER (dup AND NOT said) AS missed, count(*) FILTER (NOT dup AND said) AS false_ FROM g")
def q_duplicates_score(spark, d):
    group = table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") % 2 == 0).alias("said"))
    dup = F.col("n") > 1
    total = lambda v: F.coalesce(F.sum(v), F.lit(0)).cast("long")
    return group.agg(total(F.when(dup, F.col("said"))).alias("found"), total(F.when(dup, F.col("n") - F.col("said"))).alias("missed"), total(F.when(~dup, F.col("said"))).alias("false_"))


@query("SELECT measure, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderstatus AS measure, o_orderpriority AS run, count(*) FILTER (o_totalprice > 200000) AS k, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY measure HAVING count(DISTINCT run) >= 2")
def q_pooled(spark, d):
    each = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("measure"), F.col("o_orderpriority").alias("run")).agg(F.count_if(F.col("o_totalprice") > 200000).alias("k"), F.count("*").alias("n"))
    return each.groupBy("measure").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.countDistinct("run").alias("runs")).where("runs >= 2").drop("runs")


@query("SELECT 'FR-' || lpad(CAST(r AS VARCHAR), 3, '0') AS id, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY quality, toxic DESC, doc_id) AS r FROM labels) WHERE r <= 200")
def q_gate_order(spark, d):
    best = table(spark, d, "labels").orderBy("quality", F.desc("toxic"), "doc_id").limit(200)
    return best.select(F.format_string("FR-%03d", F.row_number().over(Window.orderBy("quality", F.desc("toxic"), "doc_id"))).alias("id"), "doc_id")


@query("SELECT o.o_orderkey, arg_min(l_linenumber, struct_pack(s := l_quantity, n := l_linenumber)) AS innermost FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey AND l_linenumber <= 5 AND 5 <= l_linenumber + l_quantity GROUP BY 1")
def q_innermost_span(spark, d):
    spans = table(spark, d, "lineitem").where("l_linenumber <= 5 AND 5 <= l_linenumber + l_quantity")
    return table(spark, d, "orders").select("o_orderkey").join(spans, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.min_by("l_linenumber", F.struct("l_quantity", "l_linenumber")).alias("innermost"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 3")
def q_max_findings(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 3")


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_quantity DESC, l_linenumber) AS shown, max(n) - count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE r <= 3 GROUP BY 1")
def q_show_three(spark, d):
    best = F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), F.col("l_linenumber").alias("n"))))
    each = table(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("a"))
    return each.select("l_orderkey", F.array_join(F.transform(F.slice("a", 1, 3), lambda x: x["n"].cast("string")), ",").alias("shown"), F.greatest(F.lit(0), F.size("a") - 3).cast("long").alias("more"))


@query(f"WITH {LINES}, {RULE_HITS} SELECT doc_id, rule, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY line_no) AS r FROM hits) WHERE r <= 4")
def q_per_label_four(spark, d):
    return leads.capped(hits(spark, d), ["doc_id", "rule"], 4).select("doc_id", "rule", "line_no")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))), ' ') AS names FROM documents")
def q_array_distinct(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))), " ").alias("names"))


@query("SELECT doc_id, substr(sha256(source || chr(0) || lower(trim(lang))), 1, 12) AS key FROM documents")
def q_stable_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat("source", F.char(F.lit(0)), F.lower(F.trim("lang"))), 256), 1, 12).alias("key"))


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS age FROM orders")
def q_age_days(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("age"))


VALUE_SQL = "CASE event_id % 9 WHEN 0 THEN ' None' WHEN 1 THEN 'TRUE' WHEN 2 THEN CAST(user_id AS VARCHAR) || 'ms' WHEN 3 THEN CAST(user_id AS VARCHAR) || '.5  s' WHEN 4 THEN '-' || user_id WHEN 5 THEN 'Infinity' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE event_type || '  X' END"


@query(f"""WITH v AS (SELECT event_id, lower(regexp_replace(trim({VALUE_SQL}), '\\s+', ' ', 'g')) AS v FROM events), n AS (SELECT *, regexp_matches(v, '^-?[0-9]+([.][0-9]+)?\\s*(s|ms)?$') AS number FROM v)
SELECT event_id, CASE WHEN v IS NULL OR v IN ('none', 'null') THEN 'none' WHEN v IN ('true', 'false') THEN 'bool' WHEN number OR v IN ('inf', 'infinity') THEN 'number' ELSE 'text' END AS type,
CASE WHEN number THEN CAST(regexp_extract(v, '^(-?[0-9.]+)', 1) AS DOUBLE) / CASE WHEN v LIKE '%ms' THEN 1000.0 ELSE 1.0 END END AS num, coalesce(v IN ('inf', 'infinity'), false) AS infinite,
CASE WHEN number AND v LIKE '%s' THEN 's' END AS unit, CASE WHEN v IS NOT NULL AND NOT number AND v NOT IN ('none', 'null', 'inf', 'infinity') THEN v END AS txt FROM n""")
def q_normalise_value(spark, d):
    k, user = F.col("event_id") % 9, F.col("user_id").cast("string")
    v = F.when(k == 0, " None").when(k == 1, "TRUE").when(k == 2, F.concat(user, F.lit("ms"))).when(k == 3, F.concat(user, F.lit(".5  s"))).when(k == 4, F.concat(F.lit("-"), user)).when(k == 5, "Infinity").when(k == 6, "").when(k == 8, F.concat("event_type", F.lit("  X")))
    return table(spark, d, "events").select("event_id", exprs.normalised_value(v).alias("v")).select("event_id", "v.*")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.05 THEN 'call_site_fallback' ELSE 'not_checked' END WHEN l_quantity <= 10 THEN 'not_found' WHEN l_linestatus = 'F' AND l_tax > 0.06 THEN 'unresolved'
WHEN l_discount > 0.08 THEN 'call_site_fallback' WHEN l_quantity <= 20 THEN 'contradicted' WHEN l_quantity <= 40 THEN 'registered' ELSE 'not_checked' END AS basis FROM lineitem""")
def q_confirm(spark, d):
    q = F.col("l_quantity")
    found = F.when(q <= 10, "not_found").when(q <= 20, "different").when(q <= 40, "same")
    error = (F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06)
    item = F.when(F.col("l_returnflag") != "R", F.struct(found.alias("found"), error.alias("ref_error"), F.lit(None).cast("boolean").alias("names_setting"), (F.col("l_discount") > 0.08).alias("call_site")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", findings.confirmation(F.col("l_discount") > 0.05, item).alias("basis"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'upheld' WHEN 1 THEN 'narrowed' WHEN 2 THEN 'refuted' WHEN 3 THEN 'inconclusive' ELSE 'unchecked' END AS status, quality, toxic FROM labels)
SELECT doc_id, status, CASE WHEN status = 'upheld' THEN CASE WHEN toxic = 1 THEN 'upheld_but_gated' ELSE 'upheld' END WHEN status = 'narrowed' THEN CASE WHEN quality = 1 AND toxic = 0 THEN 'upheld_but_gated' ELSE 'narrowed' END WHEN status = 'refuted' THEN 'refuted' END AS verdict FROM c""")
def q_run_verdict(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    status = F.element_at(F.array(*map(F.lit, ("upheld", "narrowed", "refuted", "inconclusive", "unchecked"))), (F.col("doc_id") % 5 + 1).cast("int"))
    claim = lambda field, setting: F.struct(F.lit(field).alias("field"), setting.alias("setting"))
    claims = F.array_compact(F.array(F.when(q, claim("preconditions", F.lit("x"))), F.when(t, claim("failure_mode", F.lit(None).cast("string")))))
    own = table(spark, d, "labels").select("doc_id", status.alias("status"), claims.alias("claims"), F.when(t, "non_default_setting").otherwise("none").alias("gate"))
    return own.select("doc_id", "status", findings.run_verdict(F.col("status"), F.col("gate"), F.col("claims")).alias("verdict"))


@query("SELECT doc_id, contains(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), 'of the ') AS quoted FROM documents")
def q_quote_contains(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")).contains("of the ").alias("quoted"))


@query("""SELECT page_id, 'https://' || regexp_extract(url, '://([^/:]+)', 1) || '/blob/{sha}/a%20b%2Bc/%C3%A9~' || page_id || '.py#L' || page_id || '-L' || (page_id + 3) AS link FROM pages""")
def q_fill_template(spark, d):
    host = F.concat(F.lit("https://"), F.regexp_extract("url", "://([^/:]+)", 1))
    path = F.concat(F.lit("a b+c/é~"), F.col("page_id").cast("string"), F.lit(".py"))
    values = {"base": host, "path": exprs.encoded_path(path), "start": F.col("page_id").cast("string"), "end": (F.col("page_id") + 3).cast("string"), "head": F.lit("{base}{sha}")}
    return table(spark, d, "pages").select("page_id", exprs.filled_template("{base}/blob/{sha}/{path}#L{start}-L{end}", values).alias("link"))


@query("SELECT page_id, greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(replace(html, '=', '`'), '`+'), lambda x: length(x))), 0)) AS fence FROM pages")
def q_fence_len(spark, d):
    return table(spark, d, "pages").select("page_id", exprs.fence_length(F.replace("html", F.lit("="), F.lit("`"))).alias("fence"))


@query("SELECT doc_id, concat_ws('; ', CASE WHEN length(text) < 200 THEN 'text too short' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'unknown language' END, CASE WHEN source = 'src3' THEN 'source not allowed' END) AS errors FROM documents WHERE length(text) < 200 OR lang NOT IN ('en', 'de') OR source = 'src3'")
def q_constraint_errors(spark, d):
    wrong = F.array_compact(F.array(F.when(F.length("text") < 200, "text too short"), F.when(~F.col("lang").isin("en", "de"), "unknown language"), F.when(F.col("source") == "src3", "source not allowed")))
    return table(spark, d, "documents").select("doc_id", F.array_join(wrong, "; ").alias("errors")).where("errors <> ''")


@query(f"WITH {HISTORY} SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM commits WHERE sha = doc_id * 4) THEN 'commit' WHEN doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM touches WHERE path = doc_id) THEN 'code' ELSE 'unresolved' END AS resolved FROM documents")
def q_ref_resolution(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 4).alias("sha"))
    known = commits(spark, d).select("sha", F.lit(True).alias("c"))
    paths = touches(spark, d).select(F.col("path").alias("doc_id")).distinct().withColumn("p", F.lit(True))
    even = F.col("doc_id") % 2 == 0
    return docs.join(known, "sha", "left").join(paths, "doc_id", "left").select("doc_id", F.when(even & F.col("c"), "commit").when(~even & F.col("p"), "code").otherwise("unresolved").alias("resolved"))


@query("SELECT source, sha256(string_agg(h, ',' ORDER BY part)) AS evidence FROM (SELECT source, doc_id // 4096 AS part, sha256(string_agg(md5(text), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2) GROUP BY source")
def q_evidence_hashes(spark, d):
    own = table(spark, d, "documents").select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return findings.tree_hash(own, "source", "doc_id", "h")


@query("SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown document' WHEN n > 1 THEN 'labelled twice' WHEN quality NOT IN (0, 1) THEN 'bad label' ELSE 'ok' END AS problem FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang <> 'es'")
def q_label_problems(spark, d):
    labels = table(spark, d, "labels").withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    docs = table(spark, d, "documents").where("lang <> 'es'").select("doc_id", F.lit(True).alias("has"))
    problem = F.when(F.col("has").isNull(), "unknown document").when(F.col("n") > 1, "labelled twice").when(~F.col("quality").isin(0, 1), "bad label").otherwise("ok")
    return labels.join(docs, "doc_id", "left").select("doc_id", problem.alias("problem"))


@query("SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.h <> n.h THEN 'changed' WHEN n.doc_id % 5 = 0 THEN 'revalidate' ELSE 'reuse' END AS action FROM (SELECT doc_id, md5(text) AS h FROM documents) n LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(source) ELSE md5(text) END AS h FROM documents WHERE doc_id % 7 <> 0) o ON o.doc_id = n.doc_id")
def q_cache_reuse(spark, d):
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, digest("source")).otherwise(digest("text")).alias("o"))
    both = docs.select("doc_id", digest("text").alias("h")).join(old, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("o").isNull(), "new").when(F.col("o") != F.col("h"), "changed").when(F.col("doc_id") % 5 == 0, "revalidate").otherwise("reuse").alias("action"))


@query("SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS reusable, count(*) AS files FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 45) = 0")
def q_ledger_reuse(spark, d):
    each = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.every(F.col("l_returnflag") != "R").alias("reusable"), F.count("*").alias("files"), F.count_if(F.col("l_quantity") > 45).alias("gone"))
    return each.where("gone = 0").drop("gone")


@query(f"WITH {LINES}, {RULE_HITS} SELECT lang, rule, count(*) AS leads, count(DISTINCT h.doc_id) AS files FROM hits h JOIN documents d ON d.doc_id = h.doc_id GROUP BY lang, rule")
def q_coverage_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return hits(spark, d).join(docs, "doc_id").groupBy("lang", "rule").agg(F.count("*").alias("leads"), F.countDistinct("doc_id").alias("files"))


@query(f"WITH {HISTORY} SELECT path, CASE WHEN subject LIKE '1-%' THEN 'fix' WHEN subject LIKE '2-%' THEN 'resilience' WHEN subject LIKE '3-%' THEN 'refactor' ELSE 'feature' END AS kind, count(*) AS n FROM rows_ GROUP BY 1, 2")
def q_kind_by_path(spark, d):
    return rows(spark, d).groupBy("path", exprs.ordered(KINDS, F.col("subject"), "feature").alias("kind")).agg(F.count("*").alias("n"))
