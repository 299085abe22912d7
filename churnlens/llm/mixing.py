"""Operator 3: mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Each source's target is a number of words. What the target has of whole epochs is taken of every document; for the rest the
source's documents are ranked by exponential keys whose rate is their quality weight, and taken in turn until the budget is
used; the document at the edge is taken in part. Sums over a source run over ranges of keys first, so that a source with
a third of all rows is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.llm.common import hash_unit, sized, staged, text_of, word_count

#: Weights of the sources in turn; share of all words that the mix has; times a source may be used.
WEIGHTS, TOTAL, MOST_EPOCHS = (5, 2, 1), 1.5, 2
RANGES = 4096
#: A row per source is broadcast up to so many, joined by shuffle beyond.
BROADCAST_SOURCES = 100_000
MARKS = "#*$%&|<>!"


def same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Join condition that takes null as a value."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def running(df: DataFrame, by: list[str], part: str, order: list[Column], value: str, name: str) -> DataFrame:
    """df with name, the sum of value over the rows of the same by that come before, by part and then by order.

    No task sees more than the rows of one part of one by; the sums of the parts, one row each, run over by.
    """
    parts = df.groupBy(*by, part).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, part, before.alias("_before"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = df.withColumn("_inner", inner)
    joined = held.join(parts, same(held, parts, [*by, part]))
    return joined.select(*(held[c] for c in df.columns), (F.col("_before") + F.col("_inner")).cast("long").alias(name))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: total times all words shared by weight, none above most times its source's size.

    sizes has a row per source (source, source_size). The excess of those at their most goes to the others by weight; the level
    at which that settles is found from running sums over the sources in order of most times size by weight, with no loop.
    """
    by_name = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (by_name % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("n", by_name).withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "n")
    level = (F.sum("source_size").over(Window.partitionBy()) * total - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "n", "level"))).over(Window.partitionBy())["level"]
    return ranked.withColumn("found", found).select("source", "source_size", F.round(F.coalesce(F.least("cap", F.col("found") * F.col("w")), "cap"), 6).alias("target"))


def quality_weight(text: Column) -> Column:
    """1 for a text without marks of junk, less five times their share of its characters, 0.05 at least."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * marks / F.greatest(F.length(text), F.lit(1)))


def sample_key(docs: DataFrame) -> Column:
    """Exponential key of a row whose rate is its quality weight; the least come first."""
    return -F.log(hash_unit(docs["doc_id"])) / quality_weight(text_of(docs))


def _ranked(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key, source_size, target, epochs, budget (what is left after whole epochs), before (words that come first)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text_of(docs)).alias("size"), sample_key(docs).alias("key"))
    rows = staged(rows.withColumn("part", F.floor((1 - F.exp(-F.col("key"))) * RANGES).cast("int")))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = running(rows, ["source"], "part", [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size")], "size", "before")
    both = ranked.join(goal, same(ranked, goal, ["source"])).drop(goal["source"])
    both = both.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    return both.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    size counts words (null or empty text: 0, never more than 0 taken). A null source is a source of its own, last in order.
    Rows that repeat an id are documents of their own; rows that are equal in id and size may trade places, which changes no
    result. Reruns agree: keys come from a hash of the id. An empty table gives no rows.
    """
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before")))
    return _ranked(docs).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as its source's mixture takes it: its whole epochs, and once more if it is drawn, if only in part.

    Which rows are drawn is told by each source's last drawn key, a row per source, so the texts are not shuffled. Rows of
    one id and size that lie at the edge are all drawn. Rows without words are taken in whole epochs only.
    """
    order = lambda key, doc_id, size: F.struct(key.alias("key"), doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), size.alias("size"))
    drawn = (F.col("before") < F.col("budget")) & (F.col("size") > 0)
    last = F.max(F.when(drawn, order(F.col("key"), F.col("doc_id"), F.col("size"))))
    edges = staged(_ranked(docs).groupBy("source").agg(F.max("epochs").alias("epochs"), last.alias("last")))
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["source"].cast("string").alias("own"), docs["doc_id"].cast("long").alias("doc_id"), word_count(text_of(docs)).alias("size"), sample_key(docs).alias("key"))
    both = held.join(sized(edges, BROADCAST_SOURCES), held["own"].eqNullSafe(edges["source"]))
    again = F.coalesce((F.col("size") > 0) & (order(F.col("key"), F.col("doc_id"), F.col("size")) <= F.col("last")), F.lit(False)).cast("long")
    times = (F.col("epochs") + again).cast("int")
    out = both.select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


SQL = r"""
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
  / greatest(0.05, 1.0 - 5.0 * (length(text) - length(regexp_replace(text, '[#*$%&|<>!]', '', 'g'))) / greatest(length(text), 1)) AS key FROM t),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
c AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT level FROM v WHERE level <= cap / w ORDER BY cap / w, n LIMIT 1),
g AS (SELECT source, source_size, round(least(cap, coalesce((SELECT level FROM f) * w, cap)), 6) AS target FROM v),
r AS (SELECT d.*, g.source_size, g.target, coalesce(floor(g.target / nullif(g.source_size, 0)), 0) AS epochs,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken FROM r
"""
