"""Change history: churn, coupling, rankings. Inputs are commits(sha, author, ts, subject) and touches(sha, path, pos, adds, dels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.functions.exprs import normalised

RECENT = 30


def history(commits: DataFrame, touches: DataFrame) -> DataFrame:
    """One row per file of each commit (operators 1 and 58). The narrow commit side joins on sha; both are hashed on it once."""
    return touches.join(commits, "sha")


def counters(commits: DataFrame, is_bot: Column) -> DataFrame:
    """Commits that count and bot commits that are skipped, in one row (operators 30 and 74)."""
    return commits.agg(F.count_if(~is_bot).alias("commits"), F.count_if(is_bot).alias("skipped_bots"))


def churn(rows: DataFrame, kind: Column) -> DataFrame:
    """Per path (operators 73 and 75): counts, sums, authors, kinds, first row in log order, share of fixes.

    A touch counts once per row. All are partial aggregates, so a path with a third of the rows is summed before it is shuffled.
    """
    told = rows.withColumn("kind", kind)
    out = told.groupBy("path").agg(
        F.count("*").alias("commits"), F.sum("adds").alias("insertions"), F.sum("dels").alias("deletions"), F.countDistinct("author").alias("authors"),
        *(F.count_if(F.col("kind") == k).alias(f"{k}_commits") for k in ("fix", "resilience", "refactor")),
        F.min_by("ts", F.struct(-F.unix_seconds(F.col("ts").cast("timestamp")), "sha", "pos")).alias("last_modified"),
    )
    return out.withColumn("fix_ratio", F.round(F.coalesce(F.try_divide("fix_commits", "commits"), F.lit(0.0)), 3))


def recent(rows: DataFrame, keep: int = RECENT, show: int = 15) -> DataFrame:
    """The newest shas of each path (operator 96); the rank limit cuts each path to keep rows before the shuffle."""
    newest = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("sha"), F.desc("pos"))
    top = rows.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= keep)
    shas = F.transform(F.array_sort(F.collect_list(F.struct("r", "sha"))), lambda x: x["sha"])
    return top.groupBy("path").agg(F.array_join(F.slice(shas, 1, show).cast("array<string>"), ",").alias("recent_shas"))


def coupling(rows: DataFrame, most_files: int = 50, least_shared: int = 5, least_ratio: float = 0.3) -> DataFrame:
    """Pairs of paths that change together (operators 59 and 76): shared, either, ratio.

    Baskets of 2 to most_files distinct paths only, which bounds the pairs of a basket; counts of each path cover the same baskets.
    """
    own = rows.select("sha", "path").distinct()
    sized = own.withColumn("n", F.count("*").over(Window.partitionBy("sha"))).where(F.col("n").between(2, most_files)).drop("n")
    pairs = sized.withColumnRenamed("path", "file_a").join(sized.withColumnRenamed("path", "file_b"), "sha").where("file_a < file_b")
    shared = pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    each = sized.groupBy("path").agg(F.count("*").alias("n"))
    out = shared.join(each.select(F.col("path").alias("file_a"), F.col("n").alias("na")), "file_a").join(each.select(F.col("path").alias("file_b"), F.col("n").alias("nb")), "file_b")
    out = out.withColumn("either", F.col("na") + F.col("nb") - F.col("shared"))
    return out.where(F.col("shared") >= least_ratio * F.col("either")).select("file_a", "file_b", "shared", "either", F.round(F.col("shared") / F.col("either"), 4).alias("ratio"))


def coupled_top(pairs: DataFrame, keep: int = 5) -> DataFrame:
    """Each path's strongest partners (operators 60 and 98)."""
    both = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("partner"), "shared", "ratio").unionByName(pairs.select(F.col("file_b").alias("file"), F.col("file_a").alias("partner"), "shared", "ratio"))
    best = Window.partitionBy("file").orderBy(F.desc("ratio"), F.desc("shared"), "partner")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def extremes(rows: DataFrame, column: str) -> tuple[Column, Column]:
    """Least and greatest value as scalar subqueries over one partial aggregate: no row of the table goes through one task."""
    both = rows.select(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    return both["low"], both["high"]


def scored(files: DataFrame, churn_by: str, complexity: str, weight: str) -> DataFrame:
    """Hotspot scores (operators 79 and 80) rounded to 4 places before they are ranked."""
    columns = {}
    for name, by in (("churn_norm", churn_by), ("complexity_norm", complexity)):
        columns[name] = normalised(F.col(by), *extremes(files, by))
    out = files.withColumns(columns)
    return out.withColumn("score", F.round(F.col("churn_norm") * F.col("complexity_norm") * (1 + F.col(weight)), 4))


def top(scores: DataFrame, keep: int, prefix: str = "H") -> DataFrame:
    """The best by score, ties by path, with ids (operator 95); sorted by a bounded top-k, not as a whole."""
    best = scores.orderBy(F.desc("score"), "path").limit(keep)
    return best.withColumn("id", F.format_string(f"{prefix}%02d", F.row_number().over(Window.orderBy(F.desc("score"), "path"))))
