"""Queries over transcripts, reuse, document checks and evidence. Each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.jobs.reference import query
from churnlens.operators import constraints, evidence, reuse, scoring, transcripts
from churnlens.sources.tables import table

MODELS = {"click-1": {"input": 1.0, "cache_write_5m": 1.25, "cache_write_1h": 2.0, "cache_read": 0.1, "output": 5.0}, "view-2": {"input": 0.5, "cache_write_5m": 0.5, "cache_write_1h": 1.0, "cache_read": 0.25, "output": 2.0}}
SINCE, UNTIL = "2024-01-05", "2024-01-20T12:00:00+02:00"


def _lines(spark, d):
    """An event as a line of a user's transcript: every eleventh line is cut short, every fifth response has no name, threes share one."""
    e, s = F.col("event_id"), lambda c: c.cast("string")
    n = F.floor("value").cast("long")
    kind = F.when(e % 13 == 0, "user").otherwise("assistant")
    model = F.when(e % 17 == 0, "<synthetic>").when(F.col("event_type") == "click", F.when(e % 2 == 0, "click-1").otherwise("click-1-20240101")).when(F.col("event_type") == "view", "view-2").otherwise(F.col("event_type"))
    name = F.when(e % 5 != 0, F.concat(F.lit('"id":"m'), s(F.floor(e / 3)), F.lit('",'))).otherwise("")
    cache = F.when(e % 4 == 0, F.concat(F.lit('"cache_creation":{"ephemeral_1h_input_tokens":'), s(n % 7), F.lit('},"cache_creation_input_tokens":9'))).otherwise(F.concat(F.lit('"cache_creation_input_tokens":'), s(n % 11)))
    tokens = F.concat(F.lit('"usage":{"input_tokens":'), s(n), F.lit(',"output_tokens":'), F.when(e % 6 == 0, F.concat(F.lit('"'), s(n), F.lit('"'))).otherwise(s(n % 5)), F.lit(',"cache_read_input_tokens":'), F.when(e % 7 == 0, "true").otherwise(s(n % 3)), F.lit(","), cache, F.lit("}"))
    line = F.concat(F.lit('{"type":"'), kind, F.lit('","timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(e % 2 == 0, "Z").otherwise(""), F.lit('","message":{'), name, F.lit('"model":"'), model, F.lit('",'), tokens, F.lit("}}"))
    return table(spark, d, "events").select(F.col("user_id").alias("session"), e.alias("pos"), F.when(e % 11 == 0, F.left(line, F.length(line) - 1)).when(e % 19 == 0, " ").otherwise(line).alias("line"))


LINES = """e AS (SELECT *, CAST(floor(value) AS BIGINT) AS n, date_trunc('second', ts) AS at FROM events WHERE event_id % 11 <> 0 AND event_id % 19 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-05' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-20 10:00:00'),
r AS (SELECT user_id AS session, event_id, CASE WHEN event_id % 5 <> 0 THEN 'm' || CAST(floor(event_id / 3) AS BIGINT) END AS message, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'click-1' ELSE 'click-1-20240101' END WHEN 'view' THEN 'view-2' ELSE event_type END AS model,
n AS input, CASE WHEN event_id % 4 = 0 THEN 0 ELSE n % 11 END AS cache_write_5m, CASE WHEN event_id % 4 = 0 THEN n % 7 ELSE 0 END AS cache_write_1h, CASE WHEN event_id % 7 = 0 THEN 0 ELSE n % 3 END AS cache_read, CASE WHEN event_id % 6 = 0 THEN 0 ELSE n % 5 END AS output FROM e),
k AS (SELECT * FROM r WHERE message IS NULL OR event_id = (SELECT max(o.event_id) FROM r o WHERE o.session = r.session AND o.message = r.message))"""


@query(f"WITH {LINES} SELECT session, message, model, input, cache_write_5m, cache_write_1h, cache_read, output FROM k")
def q_transcript_entries(spark, d):
    return transcripts.entries(_lines(spark, d), since=SINCE, until=UNTIL).drop("at")


@query(f"""WITH {LINES}, t AS (SELECT model, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cache_write_5m) AS BIGINT) AS cache_write_5m, CAST(sum(cache_write_1h) AS BIGINT) AS cache_write_1h, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(output) AS BIGINT) AS output FROM k GROUP BY model)
SELECT *, CAST(round_even(CASE WHEN model LIKE 'click-1%' THEN input + 1.25 * cache_write_5m + 2 * cache_write_1h + 0.1 * cache_read + 5 * output WHEN model = 'view-2' THEN 0.5 * input + 0.5 * cache_write_5m + cache_write_1h + 0.25 * cache_read + 2 * output END, 0) AS BIGINT) AS weighted FROM t""")
def q_transcript_tally(spark, d):
    return transcripts.tallies(transcripts.entries(_lines(spark, d), since=SINCE, until=UNTIL), MODELS)


@query("SELECT user_id AS session, count(*) FILTER (event_id % 11 = 0 OR event_id % 19 <> 0) AS lines, count(*) FILTER (event_id % 11 = 0) AS skipped FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 11 = 0 OR event_id % 19 <> 0) > 0")
def q_transcript_skipped(spark, d):
    return transcripts.skipped(_lines(spark, d))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 3 = 0 AND text IS DISTINCT FROM source THEN 'changed' WHEN doc_id % 5 < 2 AND doc_id % 4 <> 1 THEN 'revalidate' ELSE 'reuse' END AS action FROM documents")
def q_result_actions(spark, d):
    digest = lambda c: F.sha2(F.col(c), 256)
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, digest("source")).otherwise(digest("text")).alias("hash"), (F.col("doc_id") % 5 < 2).alias("validated"), F.when(F.col("doc_id") % 4 == 1, "v3").when(F.col("doc_id") % 4 == 2, "v2").alias("validated_with"))
    return reuse.result_actions(docs.select("doc_id", digest("text").alias("hash")), old, "v3", "doc_id")


VERDICT_SQL = """WITH f AS (SELECT o_orderkey AS key FROM orders), l AS (SELECT l_orderkey AS key, l_partkey AS path, l_suppkey AS package, l_quantity AS q FROM lineitem WHERE l_orderkey % 9 <> 0),
m AS (SELECT key, bool_or(path % 50 = 7 OR path NOT IN (SELECT p_partkey FROM part)) AS moved, bool_or(package % 40 = 3 OR package % 40 = 5 OR package NOT IN (SELECT s_suppkey FROM supplier)) AS other FROM l GROUP BY key),
c AS (SELECT l_orderkey AS key, max((l_linenumber = 7 AND l_orderkey % 2 = 0)::INT) AS strange FROM lineitem GROUP BY 1)
SELECT f.key, CASE WHEN f.key % 9 = 0 THEN 'not in the ledger' WHEN f.key % 8 = 1 THEN 'claim changed' WHEN f.key % 6 = 5 THEN 'no verdict' WHEN m.moved THEN 'a file changed' WHEN c.strange = 1 THEN 'cites another file' WHEN m.other THEN 'a dependency changed' END AS reason FROM f LEFT JOIN m ON m.key = f.key LEFT JOIN c ON c.key = f.key"""


@query(VERDICT_SQL)
def q_verdict_actions(spark, d):
    key = F.col("o_orderkey")
    orders, item, part, supplier = (table(spark, d, t) for t in ("orders", "lineitem", "part", "supplier"))
    claim = F.md5(key.cast("string").cast("binary"))
    findings = orders.select(key.alias("key"), claim.alias("claim_hash"))
    ledger = orders.where(key % 9 != 0).select(key.alias("key"), F.when(key % 8 == 1, "old").otherwise(claim).alias("claim_hash"), F.when(key % 12 == 5, "nobody").otherwise("skeptic").alias("by"), F.when(key % 12 == 11, "unchecked").otherwise("upheld").alias("status"))
    recorded = item.where("l_orderkey % 9 <> 0")
    path = F.col("l_partkey")
    ledger_files = recorded.select(F.col("l_orderkey").alias("key"), path.cast("string").alias("path"), F.concat(F.lit("h"), path).alias("hash"))
    versions = recorded.select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").cast("string").alias("package"), F.lit("1").alias("version"))
    cited = item.select(F.col("l_orderkey").alias("key"), F.when((F.col("l_linenumber") == 7) & (F.col("l_orderkey") % 2 == 0), "elsewhere").otherwise(path.cast("string")).alias("path"))
    files = part.select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 50 == 7, "other").otherwise(F.concat(F.lit("h"), F.col("p_partkey"))).alias("hash"))
    s = F.col("s_suppkey")
    packages = supplier.select(s.cast("string").alias("id"), F.when(s % 40 == 3, "2").otherwise("1").alias("version"), F.when(s % 40 == 5, "missing").otherwise("available").alias("status"))
    return reuse.verdict_actions(findings, ledger, ledger_files, versions, cited, files, packages)


CHECKS = [
    constraints.Check("lang", "one_of", ("en", "de"), message="language is not read"), constraints.Check("source", "text"), constraints.Check("title", "text", optional=True, when="lang = 'fr'"), constraints.Check("words", "most", n=200),
    constraints.Check("proofs", "some"), constraints.Check("proofs[].type", "one_of", ("code", "commit")), constraints.Check("proofs[].ref", "matches", pattern=r"^[a-z]+:[0-9]+$", optional=True), constraints.Check("n_chars", "between", n=10, m=5000),
    constraints.Check("tags", "known", ("a", "b")), constraints.Check("doc_id % 10 <> 3 OR lang = 'en'", "expression", message="threes are English"),
]
CHECKS_SQL = """WITH b AS (SELECT *, doc_id % 3 AS p, len(string_split(text, ' ')) AS w FROM documents),
e AS (SELECT doc_id, 1 AS c, 0 AS j, 'lang' AS "at", 'language is not read' AS message FROM b WHERE lang NOT IN ('en', 'de') OR lang IS NULL
UNION ALL SELECT doc_id, 2, 0, 'source', 'must be a non-empty string' FROM b WHERE source IS NULL OR trim(source) = ''
UNION ALL SELECT doc_id, 3, 0, 'title', 'must be a non-empty string' FROM b WHERE lang = 'fr' AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 4, 0, 'words', 'has more than 200 elements' FROM b WHERE w > 200
UNION ALL SELECT doc_id, 5, 0, 'proofs', 'must be a non-empty list' FROM b WHERE p = 0
UNION ALL SELECT doc_id, 6, j, 'proofs[' || j || '].type', 'is not one of code, commit' FROM b, range(3) r(j) WHERE j < p AND (doc_id + j) % 4 IN (2, 3)
UNION ALL SELECT doc_id, 7, j, 'proofs[' || j || '].ref', 'is not of the form ^[a-z]+:[0-9]+$' FROM b, range(3) r(j) WHERE j < p AND (doc_id + j) % 5 = 1
UNION ALL SELECT doc_id, 8, 0, 'n_chars', 'is not between 10 and 5000' FROM b WHERE n_chars IS NULL OR n_chars < 10 OR n_chars > 5000
UNION ALL SELECT doc_id, 9, 0, 'tags', 'contains something not in a, b' FROM b WHERE doc_id % 6 = 4
UNION ALL SELECT doc_id, 10, 0, '', 'threes are English' FROM b WHERE NOT coalesce(doc_id % 10 <> 3 OR lang = 'en', false))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c, j) AS BIGINT) AS n, "at", message FROM e"""


@query(CHECKS_SQL)
def q_document_errors(spark, d):
    i = F.col("doc_id")

    def proof(j):
        k = (i + j) % 4
        return F.struct(F.when(k == 0, "code").when(k == 1, "commit").when(k == 2, "note").alias("type"), F.when((i + j) % 5 == 0, F.lit(None)).when((i + j) % 5 == 1, "a b").otherwise("file:12").alias("ref"))

    proofs = F.slice(F.array(proof(0), proof(1)), 1, (i % 3).cast("int"))
    tags = F.when(i % 6 == 4, F.array(F.lit("a"), F.lit("z"))).when(i % 6 == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("b")))
    docs = table(spark, d, "documents").withColumns({"title": F.when(i % 2 == 0, " ").when(i % 4 == 1, "T"), "words": F.split("text", " ", -1), "proofs": proofs, "tags": tags})
    return constraints.problems(docs, CHECKS, ["doc_id"])


@query("""WITH r AS (SELECT item_id + n AS key, CASE WHEN n = 1 THEN item_id + item_id % 3 WHEN item_id % 5 = 0 THEN item_id + 100000 END AS refers FROM (SELECT doc_id * 2 AS item_id FROM documents), (SELECT unnest([0, 1]) AS n) UNION ALL SELECT doc_id * 2, NULL FROM documents WHERE doc_id % 10 = 1),
k AS (SELECT key, count(*) AS times, max(refers) AS on_ FROM r GROUP BY key)
SELECT DISTINCT r.key, CASE WHEN k.times > 1 THEN 'key repeats' WHEN r.refers = r.key THEN 'refers to itself' WHEN r.refers IS NOT NULL AND t.key IS NULL THEN 'refers to nothing' WHEN t.on_ IS NOT NULL THEN 'refers to a row that refers on' END AS problem FROM r JOIN k ON k.key = r.key LEFT JOIN k t ON t.key = r.refers
WHERE k.times > 1 OR r.refers = r.key OR (r.refers IS NOT NULL AND t.key IS NULL) OR t.on_ IS NOT NULL""")
def q_set_problems(spark, d):
    i = F.col("doc_id") * 2
    docs = table(spark, d, "documents")
    both = docs.select(i.alias("i"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    x = F.col("i")
    rows = both.select((x + F.col("n")).alias("key"), F.when(F.col("n") == 1, x + x % 3).when(x % 5 == 0, x + 100000).alias("refers"))
    again = docs.where("doc_id % 10 = 1").select(i.alias("key"), F.lit(None).cast("long").alias("refers"))
    return constraints.set_problems(rows.union(again), "key", "refers")


EVIDENCE_SQL = """WITH i AS (SELECT l_orderkey AS finding, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
c AS (SELECT *, (part + i) % 8 AS k FROM i), f AS (SELECT p_partkey AS part, CAST(p_size AS BIGINT) AS n_lines FROM part),
ok AS (SELECT c.*, n AS lo, n + q % 5 AS hi, f.n_lines, f.part IS NOT NULL AND n >= 1 AND n + q % 5 <= f.n_lines AS fits FROM c LEFT JOIN f ON f.part = c.part),
code AS (SELECT finding, part, lo, hi FROM ok WHERE k IN (0, 1, 2) AND fits), places AS (SELECT DISTINCT finding, part FROM code),
touch AS (SELECT DISTINCT l_suppkey AS supp, l_partkey AS part FROM lineitem WHERE l_linenumber % 2 = 0),
t AS (SELECT DISTINCT c.finding, c.i FROM c JOIN places p ON p.finding = c.finding JOIN touch ON touch.supp = c.supp AND touch.part = p.part WHERE k IN (3, 4)),
w AS (SELECT DISTINCT c.finding, c.i FROM c JOIN code p ON p.finding = c.finding WHERE k = 4 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = p.part AND b.l_suppkey = c.supp AND CAST(b.l_quantity AS BIGINT) BETWEEN p.lo AND p.hi))
SELECT c.finding, c.i, CASE WHEN k = 7 THEN 'type is unknown' WHEN k = 5 AND c.part % 3 = 0 THEN 'ref is missing' WHEN k = 5 THEN 'role is for commits only' WHEN k = 6 THEN CASE WHEN c.part % 2 = 0 THEN 'no such hit' END
WHEN k = 2 AND c.part % 4 = 0 THEN 'role is for commits only' WHEN k IN (0, 1, 2) THEN CASE WHEN n_lines IS NULL THEN 'no such file' WHEN NOT fits THEN 'lines are outside the file' END
WHEN c.supp % 10 = 9 THEN 'no such commit' WHEN EXISTS (SELECT 1 FROM places p WHERE p.finding = c.finding) AND t.i IS NULL THEN 'does not touch a cited file' WHEN k = 4 AND EXISTS (SELECT 1 FROM places p WHERE p.finding = c.finding) AND w.i IS NULL THEN 'wrote none of the cited lines' END AS problem
FROM ok c LEFT JOIN t ON t.finding = c.finding AND t.i = c.i LEFT JOIN w ON w.finding = c.finding AND w.i = c.i"""


@query(EVIDENCE_SQL)
def q_evidence_resolve(spark, d):
    """Items of an order as the evidence of a finding: code, commits that changed or introduced it, hits, and what is none."""
    item, s = table(spark, d, "lineitem"), lambda c: c.cast("string")
    own = item.withColumn("i", F.row_number().over(_by_item()))
    part, k = F.col("l_partkey"), (F.col("l_partkey") + F.col("i")) % 8
    n, sha = F.col("l_linenumber").cast("long"), F.left(F.sha2(F.col("l_suppkey").cast("string"), 256), F.lit(40))
    path = F.concat(F.lit("src/p"), s(part), F.lit(".py"))
    kind = F.when(k < 3, "code").when(k < 5, "commit").when(k == 5, "code").when(k == 6, "detector").otherwise("note")
    ref = F.when(k == 5, F.when(part % 3 == 0, " ").otherwise("x")).when(kind == "code", F.concat(path, F.lit(":"), s(n), F.lit("-"), s(n + F.col("l_quantity").cast("long") % 5))).when(kind == "commit", F.concat(F.left(sha, F.lit(12)), F.lit(" subject"))).otherwise(F.concat(F.lit("S1@p:"), s(part)))
    role = F.when(k == 3, "changed").when(k == 4, "introduced").when((k == 5) | ((k == 2) & (part % 4 == 0)), "fixed")
    cited = own.select(F.col("l_orderkey").alias("finding"), "i", kind.alias("type"), ref.alias("ref"), role.alias("role"))
    files = table(spark, d, "part").select(F.concat(F.lit("src/p"), s(F.col("p_partkey")), F.lit(".py")).alias("path"), F.col("p_size").cast("long").alias("n_lines"))
    hits = item.where("l_partkey % 2 = 1").select(F.concat(F.lit("S1@p:"), s(part)).alias("ref"))
    commits = item.where("l_suppkey % 10 <> 9").select(sha.alias("sha")).distinct()
    touches = item.where("l_linenumber % 2 = 0").select(sha.alias("sha"), path.alias("path"))
    blame = item.select(path.alias("path"), F.col("l_quantity").cast("long").alias("line"), sha.alias("sha"))
    located, edges = cited.select("finding", F.lit(None).cast("string").alias("path")), hits.limit(0)
    return evidence.resolved(cited, located, files, hits, edges, commits, touches, blame)


def _by_item():
    from pyspark.sql.window import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


RECORDS = """r AS (SELECT doc_id AS key, doc_id % 4 AS v, doc_id % 3 AS c, (doc_id // 2) % 4 AS l, doc_id % 5 AS s FROM documents)"""


def _scored(spark, d):
    i = F.col("doc_id")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    docs = table(spark, d, "documents")
    run = docs.select(i.alias("key"), pick(list(scoring.OUTCOMES), i % 4).alias("verdict"), pick(scoring.LEVELS, i % 3).alias("confidence"))
    labels = docs.where("doc_id % 5 <> 0").select(i.alias("key"), pick(scoring.LABELS, F.floor(i / 2) % 4).alias("label"), F.when(i % 5 == 1, "model").otherwise("person").alias("labelled_by"), F.when(i % 7 > 0, pick(scoring.LEVELS, F.floor(i / 3) % 3)).alias("deserved"))
    return scoring.states(run, labels, "model")


@query(f"""WITH {RECORDS} SELECT key, CASE s WHEN 0 THEN 'unlabelled' WHEN 1 THEN 'excluded' ELSE 'scored' END AS state, CASE WHEN s > 1 THEN CASE WHEN v = 3 AND l < 2 THEN 'correct refuted' WHEN v = l OR (v = 3 AND l = 3) OR (v = 2 AND l = 2) THEN 'same' WHEN v < 2 AND l >= 2 THEN 'wrong direction' ELSE 'one step' END END AS outcome,
CASE WHEN s > 1 AND key % 7 > 0 THEN c - (key // 3) % 3 END AS step FROM r""")
def q_score_records(spark, d):
    only = lambda c: F.when(F.col("state") == "scored", c)
    return _scored(spark, d).select("key", "state", only(scoring.outcome(F.col("verdict"), F.col("label"))).alias("outcome"), only(scoring.confidence_step(F.col("confidence"), F.col("deserved"))).alias("step"))


@query("SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'found' WHEN doc_id % 4 = 1 THEN 'missed, false' ELSE 'missed' END WHEN doc_id % 2 = 0 OR doc_id % 4 = 1 THEN 'false' END AS state FROM documents")
def q_score_duplicates(spark, d):
    i = F.col("doc_id")
    label = F.when(i % 3 == 0, i + 1)
    told = F.when(i % 2 == 0, i + 1).when(i % 4 == 1, i + 2)
    return table(spark, d, "documents").select(i.alias("key"), scoring.duplicate_state(i % 5 != 0, told, label).alias("state"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS key, CASE WHEN l_partkey % 3 = 0 THEN 'dependency' ELSE 'repo' END AS kind, 'p' || l_partkey % 3 AS path, l_linenumber * 10 AS lo, CAST(l_linenumber * 10 + l_quantity AS INTEGER) AS hi FROM lineitem),
m AS (SELECT *, kind = 'repo' AND path = 'p' || (1 + key % 2) AS mine, (lo >= 1 AND hi <= 60) OR (lo >= 40 AND hi <= 100 + key % 9) AS held FROM f),
s AS (SELECT key, count(*) FILTER (kind = 'repo') AS repo, count(*) FILTER (mine) AS own, count(*) FILTER (mine AND NOT held) AS open FROM m GROUP BY key),
o AS (SELECT key, repo, own, CASE WHEN repo = 0 THEN 'not in repository' WHEN key % 11 = 0 THEN 'unreadable' WHEN own = 0 THEN 'elsewhere' WHEN open = 0 THEN 'shown' ELSE 'not shown' END AS outcome FROM s)
SELECT key, outcome, outcome = 'shown' AND own < repo AS partly_elsewhere FROM o""")
def q_score_shown(spark, d):
    i, k = table(spark, d, "lineitem"), F.col("l_orderkey")
    p = F.col("l_partkey") % 3
    facts = i.select(k.alias("key"), F.when(p == 0, "dependency").otherwise("repo").alias("kind"), F.concat(F.lit("p"), p).alias("path"), (F.col("l_linenumber") * 10).alias("lo"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("int").alias("hi")).distinct()
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("p"), 1 + F.col("o_orderkey") % 2).alias("file"), (F.col("o_orderkey") % 11 != 0).alias("readable"))
    shown = records.select("key", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("first"), F.lit(60).cast("long").alias("last")), F.struct(F.lit(40).cast("long").alias("first"), (100 + F.col("key") % 9).alias("last")))).alias("s")).select("key", "s.first", "s.last")
    return scoring.shown_states(records, facts, shown)


@query("""WITH f AS (SELECT doc_id, doc_id % 97 AS key FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM f)
SELECT doc_id, key, CASE WHEN n > 1 THEN 'skip' WHEN key % 4 IN (0, 3) THEN 'check' ELSE 'reuse' END AS action FROM r""")
def q_plan_checks(spark, d):
    own = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 97).alias("key"))
    reasons = own.select("key", F.when(F.col("key") % 4 == 0, "claim changed").alias("reason")).where("key % 4 <> 3").distinct()
    return scoring.planned(own, reasons, ["doc_id"])
