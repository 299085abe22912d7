"""Queries over the given tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.functions import exprs
from churnlens.operators import findings, history, leads, usage
from churnlens.sources.tables import commits, responses, table, touches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HISTORY = """commits AS (SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate AS ts, o_orderpriority AS subject FROM orders),
touches AS (SELECT l_orderkey AS sha, l_suppkey AS path, CAST(l_linenumber AS BIGINT) AS pos, CAST(l_quantity AS BIGINT) AS adds, CAST(l_linenumber AS BIGINT) AS dels FROM lineitem),
rows_ AS (SELECT * FROM touches JOIN commits USING (sha))"""
LINES = """lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""
RESPONSES = """responses AS (SELECT CASE WHEN event_id % 5 <> 0 THEN CAST(floor(event_id / 3) AS BIGINT) END AS message, event_type AS model, event_id AS pos, ts AS ts, user_id, CAST(floor(value) AS BIGINT) AS tokens FROM events)"""
KINDS = [("fix", "^1-"), ("resilience", "^2-"), ("refactor", "^3-")]
#: Subjects of the commits in turn; numbers follow them.
SUBJECTS = ["Add retry with backoff", "feat(api): honour it on 429", "chore: fix it", "fix(sync)!: storm", 'Revert "add cache', "Release", "Fehler behoben", "Fix timeout on", "tidy imports of", "Simplify the leak", "Note: crashes in", "timeouts of", ""]
SUBJECT_SQL = "list_extract([" + ", ".join("'" + s + "'" for s in SUBJECTS) + "], CAST(o_orderkey % 13 + 1 AS INTEGER)) || ' ' || o_custkey"
#: Line rules of the queries: number, name, pattern.
RULES = [(1, "ends_short", r"^.{1,20}\.$"), (2, "has_number", "[0-9]{4,}"), (3, "shouts", "!!"), (4, "bars", r"\|"), (5, "comma", ",")]
RULE_SQL = "(VALUES (1, 'ends_short', '^.{1,20}\\.$'), (2, 'has_number', '[0-9]{4,}'), (3, 'shouts', '!!'), (4, 'bars', '\\|'), (5, 'comma', ','))"
RULE_HITS = f"hits AS (SELECT doc_id, line_no, ord, rule FROM lines JOIN {RULE_SQL} r(ord, rule, pattern) ON regexp_matches(line, pattern))"
DIMENSION = {"ends_short": ("S1", "A", 1.0, "high"), "has_number": ("S1", "A", 0.8, "medium"), "shouts": ("S2", "B", 1.0, "low"), "bars": ("S3", "A", 0.9, "low"), "comma": ("S4", "C", 1.0, "high")}
DIMENSION_SQL = "(VALUES ('ends_short','S1','A',1.0::DOUBLE,'high'),('has_number','S1','A',0.8,'medium'),('shouts','S2','B',1.0,'low'),('bars','S3','A',0.9,'low'),('comma','S4','C',1.0,'high'))"
WEIGHTS = {"click": 1.0, "view": 0.1, "purchase": 5.0}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, d: str) -> DataFrame:
    return history.history(commits(spark, d), touches(spark, d))


def hits(spark: SparkSession, d: str) -> DataFrame:
    return leads.ruled(leads.lines(table(spark, d, "documents")), RULES)


# --- sources and history


@query(f"WITH {HISTORY} SELECT sha, path, pos, author, adds, dels FROM rows_")
def src_history(spark, d):
    return rows(spark, d).select("sha", "path", "pos", "author", "adds", "dels")


@query("SELECT p_brand || '/' || p_type AS path, min(p_partkey) AS stage FROM part GROUP BY 1")
def src_index(spark, d):
    return table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("path")).agg(F.min("p_partkey").alias("stage"))


@query("SELECT doc_id, lang, length(text) AS n, sha256(text) AS digest FROM documents")
def src_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


@query(f"WITH {HISTORY} SELECT count(*) AS n, count(DISTINCT author) AS authors FROM commits WHERE ts >= DATE '2000-06-01' - 365")
def q_history_window(spark, d):
    since = F.lit("2000-06-01").cast("date") - F.expr("interval 365 days")
    return commits(spark, d).where(F.col("ts") >= since.cast("timestamp_ntz")).agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"))


@query(f"WITH {HISTORY} SELECT author, count(*) AS n FROM commits WHERE author % 50 <> 0 GROUP BY author")
def q_bot_filter(spark, d):
    return commits(spark, d).where(F.col("author") % 50 != 0).groupBy("author").agg(F.count("*").alias("n"))


@query(f"WITH {HISTORY} SELECT count(*) FILTER (author % 50 <> 0) AS commits, count(*) FILTER (author % 50 = 0) AS skipped_bots FROM commits")
def q_history_counters(spark, d):
    return history.counters(commits(spark, d), F.col("author") % 50 == 0)


@query(f"""WITH s AS (SELECT o_orderkey, {SUBJECT_SQL} AS subject FROM orders)
SELECT o_orderkey, subject, CASE WHEN regexp_extract(subject, '^\\s*([A-Za-z]+)(?:\\([^)]*\\))?!?:', 1) <> '' AND lower(regexp_extract(subject, '^\\s*([A-Za-z]+)(?:\\([^)]*\\))?!?:', 1)) IN ('fix', 'chore', 'feat', 'ci') THEN CASE lower(regexp_extract(subject, '^\\s*([A-Za-z]+)', 1)) WHEN 'fix' THEN 'fix' WHEN 'feat' THEN 'feature' ELSE 'refactor' END
WHEN regexp_matches(subject, '^\\s*Revert\\s+"') OR regexp_matches(subject, '(?i)\\b(fix(e[ds]|ing)?|crash(e[ds])?|leak(s|ed|ing)?)\\b') OR contains(lower(subject), 'behoben') THEN 'fix' WHEN regexp_matches(subject, '(?i)\\b(retry|backoff|timeouts?|429)\\b') THEN 'resilience' WHEN regexp_matches(subject, '(?i)\\b(rename[ds]?|tidy|simplif\\w*)\\b') THEN 'refactor' ELSE 'feature' END AS kind FROM s""")
def q_commit_kind(spark, d):
    subject = F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.col("o_orderkey") % len(SUBJECTS) + 1).cast("int"))
    own = table(spark, d, "orders").select("o_orderkey", F.concat(subject, F.lit(" "), F.col("o_custkey").cast("string")).alias("subject"))
    return own.withColumn("kind", exprs.commit_kind(F.col("subject"), ["behoben"]))


CHURN = """churn AS (SELECT path, count(*) AS commits, CAST(sum(adds) AS BIGINT) AS insertions, CAST(sum(dels) AS BIGINT) AS deletions, count(DISTINCT author) AS authors,
count(*) FILTER (subject LIKE '1-%') AS fix_commits, count(*) FILTER (subject LIKE '2-%') AS resilience_commits, count(*) FILTER (subject LIKE '3-%') AS refactor_commits, max(ts) AS last_modified FROM rows_ GROUP BY path)"""


@query(f"WITH {HISTORY}, {CHURN} SELECT * REPLACE (CAST(last_modified AS VARCHAR) AS last_modified), round(fix_commits / commits, 3) AS fix_ratio FROM churn")
def q_churn_per_file(spark, d):
    return history.churn(rows(spark, d), exprs.ordered(KINDS, F.col("subject"), "feature")).withColumn("last_modified", F.col("last_modified").cast("string"))


@query(f"WITH {HISTORY}, {CHURN} SELECT path, round(fix_commits / commits, 3) AS fix_ratio FROM churn WHERE fix_commits > 0")
def q_fix_ratio(spark, d):
    return history.churn(rows(spark, d), exprs.ordered(KINDS, F.col("subject"), "feature")).where("fix_commits > 0").select("path", "fix_ratio")


@query(f"WITH {HISTORY}, r AS (SELECT path, sha, row_number() OVER (PARTITION BY path ORDER BY ts DESC, sha DESC, pos DESC) AS r FROM rows_) SELECT path, string_agg(CAST(sha AS VARCHAR), ',' ORDER BY r) AS recent_shas FROM r WHERE r <= 15 GROUP BY path")
def q_recent_shas(spark, d):
    return history.recent(rows(spark, d))


@query(f"WITH {HISTORY} SELECT path, arg_max(sha, struct_pack(a := ts, s := sha)) AS last_sha FROM rows_ GROUP BY path")
def q_last_touch(spark, d):
    return rows(spark, d).groupBy("path").agg(F.max_by("sha", F.struct("ts", "sha")).alias("last_sha"))


@query(f"WITH {HISTORY} SELECT sha FROM commits WHERE EXISTS (SELECT 1 FROM touches WHERE touches.sha = commits.sha AND path % 10 = 3)")
def q_commit_touch_semi(spark, d):
    return commits(spark, d).join(touches(spark, d).where("path % 10 = 3"), "sha", "left_semi").select("sha")


@query("SELECT p_brand, count(*) AS touches FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 5 AND p_type <> 'ECONOMY' GROUP BY 1")
def q_candidates(spark, d):
    index = table(spark, d, "part").where("p_size > 5 AND p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("path"), "p_brand")
    return touches(spark, d, "l_partkey").join(index, "path").groupBy("p_brand").agg(F.count("*").alias("touches"))


@query(f"WITH {HISTORY}, {CHURN} SELECT path, round(coalesce(0.05 + 0.95 * (commits - min(commits) OVER ()) / nullif(max(commits) OVER () - min(commits) OVER (), 0), 1.0), 6) AS norm FROM churn")
def q_normalize(spark, d):
    files = rows(spark, d).groupBy("path").agg(F.count("*").alias("commits"))
    return files.select("path", F.round(exprs.normalised(F.col("commits"), *history.extremes(files, "commits")), 6).alias("norm"))


@query(f"""WITH {HISTORY}, f AS (SELECT path, count(*) AS commits, max(adds) AS ccn, (path % 7) / 7.0::DOUBLE AS weight FROM rows_ GROUP BY path),
n AS (SELECT *, coalesce(0.05 + 0.95 * (commits - min(commits) OVER ()) / nullif(max(commits) OVER () - min(commits) OVER (), 0)::DOUBLE, 1.0) AS a, coalesce(0.05 + 0.95 * (ccn - min(ccn) OVER ()) / nullif(max(ccn) OVER () - min(ccn) OVER (), 0)::DOUBLE, 1.0) AS b FROM f),
s AS (SELECT path, round(a * b * (1 + weight), 4) AS score FROM n), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS r FROM s) SELECT 'H' || lpad(CAST(r AS VARCHAR), 2, '0') AS id, path, score FROM t WHERE r <= 20""")
def q_hotspot_topk(spark, d):
    files = rows(spark, d).groupBy("path").agg(F.count("*").alias("commits"), F.max("adds").alias("ccn")).withColumn("weight", (F.col("path") % 7) / F.lit(7.0))
    return history.top(history.scored(files, "commits", "ccn", "weight"), 20).select("id", "path", "score")


COUPLING = """b AS (SELECT DISTINCT user_id * 100 + CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 604800) AS BIGINT) AS sha, event_type AS path FROM events),
z AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sha) AS k FROM b) WHERE k BETWEEN 2 AND 50), e AS (SELECT path, count(*) AS n FROM z GROUP BY path),
p AS (SELECT x.path AS file_a, y.path AS file_b, count(*) AS shared FROM z x JOIN z y ON x.sha = y.sha AND x.path < y.path GROUP BY 1, 2),
c AS (SELECT file_a, file_b, shared, a.n + b.n - shared AS either, round(shared / (a.n + b.n - shared), 4) AS ratio FROM p JOIN e a ON a.path = file_a JOIN e b ON b.path = file_b WHERE shared >= 5 AND shared >= 0.3 * (a.n + b.n - shared))"""


def _baskets(spark, d):
    week = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00+00:00").cast("timestamp"))) / 604800)
    return table(spark, d, "events").select((F.col("user_id") * 100 + week).alias("sha"), F.col("event_type").alias("path"))


@query(f"WITH {COUPLING} SELECT * FROM c")
def q_temporal_coupling(spark, d):
    return history.coupling(_baskets(spark, d))


@query(f"WITH {COUPLING}, u AS (SELECT file_a AS file, file_b AS partner, shared, ratio FROM c UNION ALL SELECT file_b, file_a, shared, ratio FROM c) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ratio DESC, shared DESC, partner) AS rank FROM u) WHERE rank <= 3")
def q_coupled_top5(spark, d):
    return history.coupled_top(history.coupling(_baskets(spark, d)), 3)


@query("SELECT p_brand, max(p_size) AS ccn_max, round(avg(p_size), 6) AS ccn_avg, arg_max(p_partkey, struct_pack(s := p_size, k := -p_partkey)) AS top_function, count(*) AS functions FROM part GROUP BY p_brand")
def q_complexity_argmax(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("ccn_max"), F.round(F.avg("p_size"), 6).alias("ccn_avg"), F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("top_function"), F.count("*").alias("functions"))


@query(f"""WITH {HISTORY}, t AS (SELECT path, count(*) AS w, max(ts) AS last FROM rows_ GROUP BY path), k AS (SELECT * FROM t ORDER BY w DESC, path LIMIT 30)
SELECT 'D' || lpad(CAST(r AS VARCHAR), 2, '0') AS id, path, w FROM (SELECT *, row_number() OVER (ORDER BY last, path) AS r FROM k) WHERE r <= 10""")
def q_dormant_topk(spark, d):
    first = rows(spark, d).groupBy("path").agg(F.count("*").alias("w"), F.max("ts").alias("last")).orderBy(F.desc("w"), "path").limit(30)
    ranked = first.withColumn("r", F.row_number().over(Window.orderBy("last", "path"))).where("r <= 10")
    return ranked.select(F.format_string("D%02d", "r").alias("id"), "path", "w")


# --- lines and rules


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM lines")
def q_line_explode(spark, d):
    return leads.lines(table(spark, d, "documents"))


@query(f"WITH {LINES} SELECT doc_id, line_no, substr(trim(line, ' '), 1, 200) AS snippet FROM lines WHERE regexp_matches(line, '[0-9]{{5,}}')")
def q_regex_lead(spark, d):
    return leads.framed_leads(table(spark, d, "documents"), "[0-9]{5,}", 0, 0)


FRAME = "string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN {} AND {}) AS frame"


@query(f"WITH {LINES}, f AS (SELECT *, {FRAME.format('1 PRECEDING', '3 FOLLOWING')} FROM lines) SELECT doc_id, line_no, substr(trim(line, ' '), 1, 200) AS snippet FROM f WHERE regexp_matches(line, 'th') AND NOT regexp_matches(frame, 'ing ')")
def q_window_absent(spark, d):
    return leads.framed_leads(table(spark, d, "documents"), "th", -1, 3, absent="ing ")


@query(f"WITH {LINES}, f AS (SELECT *, {FRAME.format('2 PRECEDING', '2 FOLLOWING')} FROM lines) SELECT doc_id, line_no, substr(trim(line, ' '), 1, 200) AS snippet FROM f WHERE regexp_matches(line, '^[A-Z]') AND regexp_matches(frame, '[0-9]{{3}}')")
def q_window_present(spark, d):
    return leads.framed_leads(table(spark, d, "documents"), "^[A-Z]", -2, 2, present="[0-9]{3}")


@query(f"WITH {LINES}, f AS (SELECT *, {FRAME.format('4 PRECEDING', 'CURRENT ROW')} FROM lines) SELECT doc_id, line_no FROM f WHERE regexp_matches(line, 'tion') AND NOT regexp_matches(frame, ',')")
def q_excused_before(spark, d):
    return leads.framed_leads(table(spark, d, "documents"), "tion", -4, 0, absent=",").select("doc_id", "line_no")


@query(f"WITH {LINES} SELECT doc_id, line_no, rn AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM lines WHERE regexp_matches(line, 'e')) WHERE rn <= 5")
def q_lead_cap5(spark, d):
    found = leads.lines(table(spark, d, "documents")).where(F.col("line").rlike("e"))
    return leads.capped(found, ["doc_id"]).select("doc_id", "line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).alias("nth"))


@query(f"WITH {LINES} SELECT doc_id, min(line_no) AS line_no FROM lines JOIN documents USING (doc_id) WHERE regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, '@') AND regexp_matches(line, '^[A-Z].*\\.$') GROUP BY doc_id")
def q_file_absent(spark, d):
    return leads.file_absent(table(spark, d, "documents"), "[0-9]", r"^[A-Z].*\.$", "@")


@query(f"WITH {LINES}, {RULE_HITS} SELECT doc_id, line_no, arg_min(rule, ord) AS rule, CAST(min(ord) AS INTEGER) AS ord FROM hits GROUP BY doc_id, line_no")
def q_boundary_first_rule(spark, d):
    return leads.first_of(hits(spark, d), ["doc_id", "line_no"], "ord")


@query(f"WITH {LINES}, {RULE_HITS} SELECT p AS pattern, doc_id, line_no, arg_min(h.rule, ord) AS rule FROM hits h JOIN {DIMENSION_SQL} m(rule, p, tier, w, c) ON h.rule = m.rule GROUP BY 1, 2, 3")
def q_lead_dedupe(spark, d):
    return leads.first_of(_dimension(hits(spark, d)), ["pattern", "doc_id", "line_no"], "ord").select("pattern", "doc_id", "line_no", "rule")


def _dimension(found):
    pick = lambda i: F.coalesce(*(F.when(F.col("rule") == k, F.lit(v[i])) for k, v in DIMENSION.items()))
    return found.withColumns({"pattern": pick(0), "tier": pick(1), "weight": pick(2), "confidence": pick(3)})


@query(f"""WITH {LINES}, {RULE_HITS}, e AS (SELECT doc_id, p, max(w * CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.6 ELSE 0 END * CASE c WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END) AS w FROM hits h JOIN {DIMENSION_SQL} m(rule, p, tier, w, c) ON h.rule = m.rule GROUP BY 1, 2)
SELECT doc_id, round(least(2.0, sum(w)), 6)::DOUBLE AS weight, count(*) AS patterns FROM e GROUP BY doc_id""")
def q_stability_weight(spark, d):
    return leads.weights(_dimension(hits(spark, d)))


@query(f"WITH {LINES}, {RULE_HITS} SELECT p AS pattern, count(DISTINCT doc_id) AS files FROM {DIMENSION_SQL} m(rule, p, tier, w, c) LEFT JOIN hits h ON h.rule = m.rule GROUP BY 1")
def q_pattern_coverage(spark, d):
    known = spark.createDataFrame([(v[0],) for v in DIMENSION.values()], "pattern string").distinct()
    found = _dimension(hits(spark, d)).groupBy("pattern").agg(F.countDistinct("doc_id").alias("files"))
    return known.join(found, "pattern", "left").select("pattern", F.coalesce("files", F.lit(0)).alias("files"))


@query(f"WITH {LINES}, {RULE_HITS} SELECT rule, count(*) AS hits, count(DISTINCT doc_id) AS files, round(1000 * count(*) / (SELECT count(*) FROM documents), 2) AS per_thousand FROM hits GROUP BY rule")
def q_calibrate_summary(spark, d):
    docs = table(spark, d, "documents")
    total = docs.agg(F.count("*").alias("swept"))
    found = hits(spark, d).groupBy("rule").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("files"))
    return found.join(F.broadcast(total)).select("rule", "hits", "files", F.round(1000 * F.col("hits") / F.col("swept"), 2).alias("per_thousand"))  # one row


SUPPRESS = [(1, "comma", "src1$"), (2, "comma", "src1"), (3, "bars", "src[0-5]$"), (4, "shouts", "nowhere")]
SUPPRESSED = f"hs AS (SELECT h.*, source, CASE WHEN rule = 'comma' AND regexp_matches(source, 'src1$') THEN 1 WHEN rule = 'comma' AND regexp_matches(source, 'src1') THEN 2 WHEN rule = 'bars' AND regexp_matches(source, 'src[0-5]$') THEN 3 WHEN rule = 'shouts' AND regexp_matches(source, 'nowhere') THEN 4 END AS rule_no FROM hits h JOIN documents d ON h.doc_id = d.doc_id)"


def _suppressed(spark, d):
    docs = table(spark, d, "documents")
    numbered = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    found = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(n)) for _, n, p in RULES)))
    return leads.suppressed(numbered.select("doc_id", "source", "line_no", F.explode(found).alias("rule")), SUPPRESS, "source")


@query(f"WITH {LINES}, {RULE_HITS}, {SUPPRESSED} SELECT rule, source, count(*) AS kept FROM hs WHERE rule_no IS NULL GROUP BY rule, source")
def q_suppress_kept(spark, d):
    return _suppressed(spark, d).where("rule_no IS NULL").groupBy("rule", "source").agg(F.count("*").alias("kept"))


@query(f"WITH {LINES}, {RULE_HITS}, {SUPPRESSED} SELECT n AS rule_no, count(hs.rule_no) AS n FROM (VALUES (1), (2), (3), (4)) v(n) LEFT JOIN hs ON hs.rule_no = n GROUP BY v.n")
def q_suppress_counts(spark, d):
    one = _suppressed(spark, d).agg(*(F.count_if(F.col("rule_no") == k).alias(str(k)) for k, *_ in SUPPRESS))
    return one.unpivot([], [str(k) for k, *_ in SUPPRESS], "rule_no", "n").withColumn("rule_no", F.col("rule_no").cast("int"))


@query(f"WITH {LINES}, {RULE_HITS} SELECT rule, source, min(line_no) AS line_no, arg_min(h.doc_id, struct_pack(l := line_no, d := h.doc_id)) AS doc_id FROM hits h JOIN documents d ON h.doc_id = d.doc_id GROUP BY rule, source")
def q_retry_layers_minby(spark, d):
    return _suppressed(spark, d).groupBy("rule", "source").agg(F.min("line_no").alias("line_no"), F.min_by("doc_id", F.struct("line_no", "doc_id")).alias("doc_id"))


@query(f"WITH {LINES}, {RULE_HITS} SELECT doc_id, count(DISTINCT rule) AS layers, min(line_no) AS first_line FROM hits WHERE rule <> 'comma' GROUP BY doc_id HAVING count(DISTINCT rule) >= 2")
def q_mod_layers(spark, d):
    return hits(spark, d).where("rule <> 'comma'").groupBy("doc_id").agg(F.countDistinct("rule").alias("layers"), F.min("line_no").alias("first_line")).where("layers >= 2")


@query(f"WITH {LINES}, s AS (SELECT *, sum(CASE WHEN length(line) < 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM lines) SELECT doc_id, CAST(seg AS BIGINT) AS seg, min(line_no) FILTER (line LIKE '%,%') AS first_call, min(line_no) FILTER (line LIKE '%tion%') AS first_check FROM s GROUP BY doc_id, seg HAVING min(line_no) FILTER (line LIKE '%,%') < min(line_no) FILTER (line LIKE '%tion%')")
def q_mod_failfast(spark, d):
    about = Window.partitionBy("doc_id").orderBy("line_no")
    seg = leads.lines(table(spark, d, "documents")).withColumn("seg", F.sum((F.length("line") < 12).cast("int")).over(about))
    first = lambda mark: F.min(F.when(F.col("line").contains(mark), F.col("line_no")))
    return seg.groupBy("doc_id", "seg").agg(first(",").alias("first_call"), first("tion").alias("first_check")).where("first_call < first_check")


@query(f"WITH {LINES}, {RULE_HITS}, {'{}'} SELECT doc_id, max(CASE WHEN c IN ('high', 'medium') THEN 1 ELSE 0 END) AS strong, count(DISTINCT p) AS patterns FROM hits h JOIN {DIMENSION_SQL} m(rule, p, tier, w, c) ON h.rule = m.rule GROUP BY doc_id HAVING max(CASE WHEN c IN ('high', 'medium') AND tier <> 'C' THEN 1 ELSE 0 END) = 1 OR count(DISTINCT p) >= 2".replace(", {}", ""))
def q_dormant_qualify(spark, d):
    known = _dimension(hits(spark, d))
    strong = F.col("confidence").isin("high", "medium")
    out = known.groupBy("doc_id").agg(F.max(strong.cast("int")).alias("strong"), F.countDistinct("pattern").alias("patterns"), F.bool_or(strong & (F.col("tier") != "C")).alias("scored"))
    return out.where("scored OR patterns >= 2").drop("scored")


@query("SELECT doc_id, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens FROM documents")
def q_tokens_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", exprs.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) <= 800 THEN text ELSE left(text, 560) || chr(10) || chr(10) || '... [trimmed: ' || CAST(length(text) - 760 AS VARCHAR) || ' characters omitted] ...' || chr(10) || chr(10) || right(text, 200) END AS clipped FROM documents")
def q_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", exprs.clip(F.col("text"), 200).alias("clipped"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest, substr(sha256(source || chr(0) || lower(trim(lang))), 1, 12) AS key FROM documents")
def q_content_hash(spark, d):
    key = F.substring(F.sha2(F.concat("source", F.char(F.lit(0)), F.lower(F.trim("lang"))), 256), 1, 12)
    return table(spark, d, "documents").select("doc_id", exprs.content_hash(F.col("text")).alias("digest"), key.alias("key"))


# --- coverage, paths, set operations


@query("SELECT CASE WHEN p_size <= 5 THEN 'excluded' WHEN p_type = 'ECONOMY' THEN 'unsupported' WHEN p_size > 40 THEN 'considered' ELSE 'unchanged' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def q_coverage_gaps(spark, d):
    bucket = F.when(F.col("p_size") <= 5, "excluded").when(F.col("p_type") == "ECONOMY", "unsupported").when(F.col("p_size") > 40, "considered").otherwise("unchanged")
    return table(spark, d, "part").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS r FROM c) SELECT CASE WHEN r <= 8 THEN p_brand ELSE 'other' END AS bucket, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def q_topn_other(spark, d):
    return findings.top_and_other(table(spark, d, "part"), "p_brand")


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'C:/' || page_id WHEN 1 THEN regexp_replace(url, '^https?://[^/]*', '') WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN regexp_replace(url, '^https?://', '') ELSE 'a\' || page_id END AS path FROM pages)
SELECT page_id, path, CASE WHEN path = '' THEN 'is empty' WHEN path LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:') THEN 'is absolute' WHEN contains(path, '\') THEN 'contains a backslash' WHEN list_contains(string_split(path, '/'), '..') THEN 'climbs out of the repository with ' || chr(39) || '..' || chr(39)
WHEN list_contains(string_split(path, '/'), '.') OR list_contains(string_split(path, '/'), '') THEN 'is not in canonical form (empty or ''.'' segment, or a trailing ''/'')' END AS problem FROM p""")
def q_path_problem(spark, d):
    k, own = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("C:/"), own)).when(k == 1, F.regexp_replace("url", "^https?://[^/]*", "")).when(k == 2, F.concat(F.lit("a/../"), own)).when(k == 3, F.regexp_replace("url", "^https?://", "")).otherwise(F.concat(F.lit("a\\"), own))
    return table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("problem", exprs.path_problem(F.col("path")))


@query(r"SELECT page_id, regexp_replace('././' || substr(regexp_replace(url, '^https?://[^/]*', ''), 2), '^(\./)+', '') AS path FROM pages")
def q_ref_path(spark, d):
    raw = F.concat(F.lit("././"), F.substr(F.regexp_replace("url", "^https?://[^/]*", ""), F.lit(2)))
    return table(spark, d, "pages").select("page_id", F.regexp_replace(raw, r"^(\./)+", "").alias("path"))


@query(r"SELECT CASE WHEN regexp_matches(p_brand || '/' || p_type, '^[^/]*1[^/]*/[^/]*$') THEN 1 ELSE 0 END AS one_level, CASE WHEN regexp_matches(p_brand || '/' || p_type, '^(?:.*/)?S[^/]*$') THEN 1 ELSE 0 END AS any_level, count(*) AS n FROM part GROUP BY 1, 2")
def q_glob_filter(spark, d):
    path = F.concat_ws("/", "p_brand", "p_type")
    return table(spark, d, "part").groupBy(path.rlike(exprs.glob_pattern("*1*/*")).cast("int").alias("one_level"), path.rlike(exprs.glob_pattern("**/S*", across=True)).cast("int").alias("any_level")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def q_language_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'git@' || regexp_extract(url, '://([^/]+)', 1) || ':team/' || page_id || '.git' WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN 'ssh://git@' || regexp_extract(url, '://([^/]+)', 1) || ':2222/a/' || page_id WHEN 3 THEN 'https://H.example:8443/x/y.git/' WHEN 4 THEN 'ftp://h/x' ELSE '/local/' || page_id END AS url, regexp_extract(url, '://([^/]+)', 1) AS h, trim(regexp_extract(url, '://[^/]+/([^?#]*)', 1), '/') AS p, url LIKE 'http://%' AS plain FROM pages)
SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN h WHEN 1 THEN h WHEN 2 THEN h WHEN 3 THEN 'h.example' END AS host, CASE page_id % 6 WHEN 0 THEN 'https://' || h || '/team/' || page_id WHEN 1 THEN CASE WHEN plain THEN 'http://' ELSE 'https://' END || h || '/' || p WHEN 2 THEN 'https://' || h || '/a/' || page_id WHEN 3 THEN 'https://h.example:8443/x/y' END AS base FROM u""")
def q_parse_remote(spark, d):
    k, own, host = F.col("page_id") % 6, F.col("page_id").cast("string"), F.regexp_extract("url", "://([^/]+)", 1)
    url = F.when(k == 0, F.concat(F.lit("git@"), host, F.lit(":team/"), own, F.lit(".git"))).when(k == 1, F.replace("url", F.lit("://"), F.lit("://user:pw@"))).when(k == 2, F.concat(F.lit("ssh://git@"), host, F.lit(":2222/a/"), own)).when(k == 3, "https://H.example:8443/x/y.git/").when(k == 4, "ftp://h/x").otherwise(F.concat(F.lit("/local/"), own))
    pages = table(spark, d, "pages").select("page_id", url.alias("url"))
    return pages.withColumn("r", exprs.remote(F.col("url"))).select("page_id", "url", "r.host", "r.base")


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', chr(92) || 'u0026'), '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), chr(8232), chr(92) || 'u2028'), chr(8233), chr(92) || 'u2029')) AS digest FROM pages")
def q_embed_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(exprs.escape_markup(F.col("html")), 256).alias("digest"))


@query("SELECT l_partkey AS k, 'item' AS origin FROM lineitem UNION ALL SELECT p_partkey, 'part' FROM part")
def q_union_all(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.lit("item").alias("origin")).unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit("part").alias("origin")))


@query("SELECT c_custkey AS author FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def q_except(spark, d):
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("author"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("author")).join(seen, "author", "left_anti")


@query("SELECT o_custkey AS author FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def q_intersect(spark, d):
    o = table(spark, d, "orders")
    pick = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("author"))
    return pick("F").intersect(pick("P"))


# --- findings and scores


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS lo, CAST(l_linenumber + l_quantity AS BIGINT) AS hi FROM lineitem)
SELECT a.p AS path, a.o AS owner_a, b.o AS owner_b, count(*) AS meetings FROM r a JOIN r b ON a.p = b.p AND a.o < b.o AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1, 2, 3""")
def q_shared_code_overlap(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_linenumber").cast("long").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("hi"))
    return findings.overlaps(r, "o", "p", "lo", "hi")


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS lo, CAST(l_linenumber + l_quantity AS BIGINT) AS hi FROM lineitem WHERE l_linenumber % 2 = 1),
h AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) - 1 AS l, CAST(l_linenumber + l_quantity AS BIGINT) AS h FROM lineitem WHERE l_linenumber % 2 = 0),
e AS (SELECT n.k, lo, hi, coalesce(bool_or(l <= lo AND hi <= h), false) AS i, coalesce(bool_or(l <= hi AND lo <= h), false) AS m FROM n LEFT JOIN h ON n.k = h.k GROUP BY 1, 2, 3)
SELECT k, bool_and(i) AS all_inside, bool_and(m) AS all_meet, count(*) AS ranges FROM e GROUP BY k""")
def q_range_containment(spark, d):
    i = table(spark, d, "lineitem").withColumn("hi", (F.col("l_linenumber") + F.col("l_quantity")).cast("long"))
    need = i.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("lo"), "hi").distinct()
    have = i.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber").cast("long") - 1).alias("lo"), "hi")
    return findings.covered(need, have, "k")


@query("SELECT md5(text) AS link, arg_min(doc_id, struct_pack(s := source, d := doc_id)) AS survivor, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_duplicate_groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("link"))
    return findings.group_survivors(docs, "link", [F.col("source"), F.col("doc_id")], "doc_id")


@query("SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'agree' WHEN quality = 0 AND toxic = 1 THEN 'opposed' ELSE 'mixed' END AS outcome, count(*) AS n FROM labels GROUP BY 1")
def q_verdict_matrix(spark, d):
    matrix = spark.createDataFrame([(1, 0, "agree"), (0, 1, "opposed"), (0, 0, "mixed"), (1, 1, "mixed")], "quality int, toxic int, outcome string")
    return table(spark, d, "labels").join(F.broadcast(matrix), ["quality", "toxic"]).groupBy("outcome").agg(F.count("*").alias("n"))  # four rows


@query("""SELECT o_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 OR (o_orderstatus = 'P' AND count(*) FILTER (l_linestatus = 'O' AND l_discount > 0.05) > 0) THEN 'non_default_setting'
WHEN count(*) FILTER (l_returnflag = 'A' AND l_linestatus <> 'F' AND l_tax > 0.02) > 0 THEN 'unconfirmed_default' ELSE 'none' END AS gate FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus""")
def q_gate(spark, d):
    needs = F.when(F.col("l_returnflag") == "R", "changed").when(F.col("l_returnflag") == "A", "default")
    state = F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("unconfirmed")
    basis = F.when(F.col("l_tax") > 0.02, "contradicted").otherwise("not_checked")
    field = F.when(F.col("l_linestatus") == "O", "preconditions").otherwise("failure_mode")
    setting = F.when(F.col("l_discount") > 0.05, F.col("l_partkey"))
    settings = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set(F.struct(needs.alias("needs"), state.alias("state"), basis.alias("basis"))).alias("s"), F.collect_set(F.struct(field.alias("field"), setting.alias("setting"))).alias("c"))
    status = F.when(F.col("o_orderstatus") == "P", "narrowed").otherwise("upheld")
    return table(spark, d, "orders").join(settings, "o_orderkey", "left").select("o_orderkey", findings.gate(F.col("s"), status, F.col("c")).alias("gate"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'odd' END AS claimed, CASE WHEN doc_id % 11 = 0 THEN 'inconclusive' WHEN doc_id % 13 = 0 THEN 'unheard of' WHEN quality = 1 AND toxic = 0 THEN 'upheld' WHEN quality = 1 THEN 'narrowed' WHEN toxic = 1 THEN 'refuted' ELSE 'unchecked' END AS status FROM labels),
r AS (SELECT *, greatest(1, CASE claimed WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END - CASE status WHEN 'narrowed' THEN 1 ELSE 0 END) AS own, CASE status WHEN 'upheld' THEN 3 WHEN 'refuted' THEN 1 ELSE 2 END AS most FROM c)
SELECT doc_id, claimed, status, CASE least(own, most) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS effective FROM r""")
def q_effective_confidence(spark, d):
    claimed = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "odd"))), (F.col("doc_id") % 4 + 1).cast("int"))
    q, t, i = F.col("quality"), F.col("toxic"), F.col("doc_id")
    status = F.when(i % 11 == 0, "inconclusive").when(i % 13 == 0, "unheard of").when((q == 1) & (t == 0), "upheld").when(q == 1, "narrowed").when(t == 1, "refuted").otherwise("unchecked")
    own = table(spark, d, "labels").select("doc_id", claimed.alias("claimed"), status.alias("status"))
    return own.withColumn("effective", exprs.effective_confidence(F.col("claimed"), F.col("status")))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(v, '^[0-9]+(-[0-9]+)?$') AND a >= 1 AND a <= b THEN a END AS lo, CASE WHEN regexp_matches(v, '^[0-9]+(-[0-9]+)?$') AND a >= 1 AND a <= b THEN b END AS hi FROM (SELECT *, TRY_CAST(regexp_extract(v, '^([0-9]+)(-[0-9]+)?$', 1) AS BIGINT) AS a, coalesce(TRY_CAST(nullif(regexp_extract(v, '^[0-9]+-([0-9]+)$', 1), '') AS BIGINT), TRY_CAST(regexp_extract(v, '^([0-9]+)(-[0-9]+)?$', 1) AS BIGINT)) AS b FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN o_custkey || '-' || (o_orderkey % 1000) ELSE 'x' || o_custkey END AS v FROM orders))")
def q_parse_range(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    value = F.when(k % 3 == 0, c).when(k % 3 == 1, F.concat(c, F.lit("-"), (k % 1000).cast("string"))).otherwise(F.concat(F.lit("x"), c))
    lo, hi = exprs.parse_range(value)
    return table(spark, d, "orders").select("o_orderkey", lo.alias("lo"), hi.alias("hi"))


@query("""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) FILTER (o_totalprice > 200000) AS k, count(*) AS n FROM orders GROUP BY 1, 2), w AS (SELECT *, k::DOUBLE / n AS p, 1.959964::DOUBLE AS z FROM c),
i AS (SELECT *, 1 + z * z / n AS d, p + z * z / (2 * n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) AS h FROM w)
SELECT o_orderstatus, o_orderpriority, k, n, CAST(round_even(100 * (m - h) / d, 0) AS INTEGER) AS lo, CAST(round_even(100 * (m + h) / d, 0) AS INTEGER) AS hi FROM i""")
def q_wilson(spark, d):
    each = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 200000).alias("k"), F.count("*").alias("n"))
    lo, hi = exprs.wilson(F.col("k"), F.col("n"))
    return each.select("o_orderstatus", "o_orderpriority", "k", "n", lo.alias("lo"), hi.alias("hi"))


@query("SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS labelled, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (l.quality = 1) AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_split_run(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    return both.agg(F.count_if(F.col("has")).alias("labelled"), F.count_if(F.col("has").isNull()).alias("unlabelled"), F.count_if(F.col("quality") == 1).alias("good"))


@query("SELECT v.w AS word, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('none')) v(w) LEFT JOIN orders ON o_orderstatus = v.w GROUP BY 1")
def q_vocab_counts(spark, d):
    return findings.vocabulary(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "none"])


@query("SELECT lang, source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, source")
def q_basis_mix(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS y FROM part) SELECT round(corr(x::DOUBLE, y::DOUBLE), 6) AS rho, count(*) AS n FROM r")
def q_spearman(spark, d):
    return findings.spearman(table(spark, d, "part"), "p_size", "p_retailprice")


@query("SELECT o_orderstatus, quantile_cont(CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS DOUBLE), 0.5) AS median_age FROM orders GROUP BY 1")
def q_median_age(spark, d):
    age = F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.percentile(age, 0.5).alias("median_age"))


# --- usage and state


@query(f"WITH {RESPONSES}, r AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY pos DESC) AS rn FROM responses) SELECT message, model, pos, tokens FROM r WHERE message IS NULL OR rn = 1")
def q_usage_dedupe(spark, d):
    return usage.last_response(responses(spark, d), "message", "pos").select("message", "model", "pos", "tokens")


@query(f"WITH {RESPONSES} SELECT model, count(*) AS responses, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) * CASE model WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.1 WHEN 'purchase' THEN 5.0 END, 1)::DOUBLE AS weighted FROM responses GROUP BY model")
def q_usage_tally(spark, d):
    return usage.tally(responses(spark, d), "model", "tokens", WEIGHTS)


@query(f"WITH {RESPONSES} SELECT model, user_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS responses, GROUPING(model, user_id) AS level FROM responses GROUP BY ROLLUP (model, user_id)")
def q_usage_rollup(spark, d):
    return usage.rollup(responses(spark, d), ["model", "user_id"], "tokens")


@query(f"WITH {RESPONSES} SELECT user_id, pos, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running FROM responses) WHERE running <= 2000")
def q_running_budget(spark, d):
    return usage.running_budget(responses(spark, d), ["user_id"], [F.col("pos")], "tokens", 2000).select("user_id", "pos", "running")


@query("SELECT conv_id, role, arg_min(text, turn) AS text, min(turn) AS turn FROM conversations GROUP BY conv_id, role")
def q_warn_once(spark, d):
    return usage.once(table(spark, d, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], "turn").select("conv_id", "role", "text", "turn")


@query(f"WITH {RESPONSES} SELECT pos, CASE WHEN age < 10 AND pos % 3 <> 0 THEN 'cached' WHEN pos % 4 <> 0 THEN 'fresh' WHEN age < 20 THEN 'stale' ELSE 'failed' END AS state FROM (SELECT pos, CASE WHEN pos % 7 <> 0 THEN date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') END AS age FROM responses)")
def q_cache_state(spark, d):
    age = F.when(F.col("pos") % 7 != 0, F.date_diff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date")))
    return responses(spark, d).select("pos", usage.cache_state(age, F.col("pos") % 4 == 0, 10, F.col("pos") % 3 == 0).alias("state"))


@query("SELECT doc_id, sha256(text) IS DISTINCT FROM CASE WHEN doc_id % 3 = 0 THEN sha256(text) WHEN doc_id % 3 = 1 THEN sha256(source) END AS stale FROM documents")
def q_stale_flag(spark, d):
    recorded = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.sha2("source", 256))
    return table(spark, d, "documents").select("doc_id", (~F.sha2("text", 256).eqNullSafe(recorded)).alias("stale"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def q_events_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k string")["k"].alias("k"))


@query("SELECT DISTINCT n_regionkey AS neighbour, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_edges_distinct(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("neighbour"), F.col("r_name").alias("name")).distinct()


@query("SELECT o_custkey, count(*) FILTER (r <= 5) AS kept, count(*) FILTER (r > 5) AS rest FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def q_edge_cap(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", F.least(F.lit(5), "n").cast("long").alias("kept"), F.greatest(F.lit(0), F.col("n") - 5).cast("long").alias("rest"))


@query("SELECT c_mktsegment, CASE WHEN count(*) <= 3 THEN string_agg(c_name, ', ' ORDER BY c_name) ELSE array_to_string(list_slice(list(c_name ORDER BY c_name), 1, 3), ', ') || ' and ' || (count(*) - 3) || ' more' END AS named FROM customer GROUP BY 1")
def q_named_list(spark, d):
    own = table(spark, d, "customer").select("c_mktsegment", "c_name")
    # the first three of a segment come from the first three of each of its parts, so no task ranks a whole segment
    parts = own.withColumn("part", F.pmod(F.xxhash64("c_name"), F.lit(64)))
    least = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("c_name"))
    few = parts.withColumn("r", least("c_mktsegment", "part")).where("r <= 3").withColumn("r", least("c_mktsegment")).where("r <= 3")
    first = few.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ", ").alias("first"))
    sizes = own.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") <= 3, F.col("first")).otherwise(F.concat("first", F.lit(" and "), (F.col("n") - 3).cast("string"), F.lit(" more")))
    return sizes.join(first, "c_mktsegment").select("c_mktsegment", more.alias("named"))
