"""Operator 10: line-first quality rules, in DataFrame functions alone.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines go; then a document goes that fails
the base rules or has lost more than half of its characters to failing lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import BLANK, text_of, without_blanks, word_count

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEAT_PERCENT = 8, 20, 30
CAPITALS, SMALLS = "[A-ZÀ-ÖØ-Þ]++", "[a-zß-öø-ÿ]++"
#: Stock phrases in any case, grouped by how they begin, so that few alternatives are tried at each place.
BOILERPLATE = r"(?iu:all rights reserved|terms of (?:use|service)|p(?:rivacy policy|owered by)|c(?:ookie policy|lick here|opyright [(©0-9])|we use cookies|enable javascript|s(?:ign up for|ubscribe to our|kip to content)|licensed under)"
SENTENCE_END = "[.!?:;…\"”»)][ \\t\\r\\x0B\\f]*$"


DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _without(s: Column, marks: str) -> Column:
    """Number of characters of s that are among marks, all of one byte."""
    return sum(((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(m), F.lit("")))) for m in marks[1:]), F.octet_length(s) - F.octet_length(F.replace(s, F.lit(marks[0]), F.lit(""))))


def line_fails(line: Column) -> Column:
    """True where a line with a word breaks a rule.

    punctuation: a shout mark for every third word, or more capitals than small letters in three words or more;
    navigation: two bars or more, one for every fourth word, or two words at most with no end of a sentence;
    boilerplate: a stock phrase, or symbols for more than an eighth of the characters.
    """
    # measured once in a struct of one line, as nothing shares what a lambda computes twice
    measured = F.transform(F.array(line), lambda x: F.struct(
        x.alias("line"), word_count(x).alias("words"), _without(x, "|").alias("bars"),
        (F.length(x) - F.length(F.replace(x, F.lit("!!"), F.lit("")))).alias("shouts"),
    ))

    def fails(m: Column) -> Column:
        x, words = m["line"], m["words"]
        capitals = F.length(x) - F.length(F.regexp_replace(x, CAPITALS, ""))
        smalls = F.length(x) - F.length(F.regexp_replace(x, SMALLS, ""))
        return (
            ((m["bars"] >= 2) & (m["bars"] * 4 >= words))
            | (m["shouts"] * 3 >= words * 2)
            | ((words <= 2) & ~x.rlike(SENTENCE_END))
            | (_without(x, SYMBOLS) * 8 > F.length(without_blanks(x)))
            | ((words >= 3) & (capitals > smalls))
            | x.rlike(BOILERPLATE)
        )

    return F.exists(measured, fails)


def repeat_words(positions: Column) -> Column:
    """Words in windows that begin at positions, a sorted column of its own; null: none."""
    step = F.transform(positions, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(positions, k + 1) - p), F.lit(WINDOW)))
    return F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def _judged(docs: DataFrame) -> DataFrame:
    """row, a struct of docs' columns, and the columns of DIGEST and clean_text."""
    step = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text_of(docs).alias("text"))
    words = F.filter(F.split("text", f"[{BLANK}]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    step = step.withColumns({
        "hashes": F.transform(words, lambda w: F.xxhash64(w)),
        "lines": F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"))),
    })
    count = F.size("hashes")
    step = step.withColumn("windows", F.when(count >= WINDOW, F.transform(F.sequence(F.lit(1), count - WINDOW + 1), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(F.array().cast("array<long>")))
    # positions only where a window comes twice: sorted hashes with their places, those equal to a neighbour, in order
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    step = step.withColumn("sorted", F.when(twice, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("sorted")
    like = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
    step = step.withColumn("places", F.array_sort(F.filter(F.transform(s, lambda x, k: F.when(like(x, k), x["i"])), lambda i: i.isNotNull())))
    kept_lines = F.filter("lines", lambda x: ~x["fails"])
    step = step.withColumns({
        "n_words": count.cast("long"),
        "word_chars": F.length(without_blanks(F.col("text"))).cast("long"),
        "n_symbols": _without(F.col("text"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct(F.transform("lines", lambda x: x["line"])))).cast("long"),
        "n_repeat_words": repeat_words(F.col("places")),
        "clean_text": F.array_join(F.transform(kept_lines, lambda x: x["line"]), "\n"),
    })
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    left = F.length(without_blanks(F.col("clean_text")))
    step = step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (2 * left >= F.col("word_chars")))
    return step.select("row", *DIGEST, "clean_text")


def judge(docs: DataFrame, into: str = "verdict") -> DataFrame:
    """docs with one more column, into: a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text.

    Words are runs of characters other than blanks. A null or empty text has no words, so it fails the base rules and is not
    kept. Repeated rows and null ids are judged one by one. The user's columns come back as they are, whatever their names;
    into must not be among them.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {into}")
    return _judged(docs).select(*(F.col("row")[c].alias(c) for c in docs.columns), F.struct(*DIGEST, "clean_text").alias(into))


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, their text without the lines that fail and n_chars, where docs has it, counted anew; other columns as they are."""
    # the partition's number keeps the filter above what it judges by: pushed below, it would judge each line anew for every use
    kept = _judged(docs).withColumn("task", F.spark_partition_id()).where("kept and task >= 0")
    put = {"text": F.col("clean_text").alias("text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return kept.select(*(put.get(c, F.col("row")[c].alias(c)) for c in docs.columns))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The digest columns of judge, one row per row of docs."""
    found = judge(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]))
    return found.select("doc_id", *(F.col("verdict")[c].alias(c) for c in DIGEST))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
u AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n,
  string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM u),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS times FROM g WHERE n = 8),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM d WHERE times > 1),
rep AS (SELECT r, sum(CASE WHEN after IS NULL THEN 8 ELSE least(8, after - i) END) AS n_repeat_words FROM p GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
l1 AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  length(line) - length(replace(line, '|', '')) AS bars, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
  (length(line) - length(replace(line, '!!', ''))) / 2 AS shouts,
  length(line) - length(regexp_replace(line, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS capitals, length(line) - length(regexp_replace(line, '[a-zß-öø-ÿ]', '', 'g')) AS smalls
  FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l2 AS (SELECT *, (bars >= 2 AND bars * 4 >= words) OR symbols * 8 > chars OR shouts * 3 >= words OR (words >= 3 AND capitals > smalls)
  OR (words <= 2 AND NOT regexp_matches(line, '[.!?:;…"”»)][ \t\r\x0B\f]*$'))
  OR regexp_matches(line, '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|we use cookies|enable javascript|click here|sign up for|subscribe to our|skip to content|copyright [(©0-9]|licensed under|powered by)') AS fails FROM l1),
ln AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN fails THEN 0 ELSE chars END) AS kept_chars FROM l2 GROUP BY r),
b AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
  FROM w LEFT JOIN ln USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * kept_chars >= word_chars AS kept FROM b
"""
