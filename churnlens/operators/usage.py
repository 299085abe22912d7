"""Consumption and state: response de-duplication, tallies, rollups, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_response(rows: DataFrame, message: str, pos: str) -> DataFrame:
    """The last row of each message, and all rows without one (operator 140). The maximum is a partial aggregate."""
    rest = [c for c in rows.columns if c != message]
    known = rows.where(F.col(message).isNotNull()).groupBy(message).agg(F.max_by(F.struct(*rest), pos).alias("s")).select(message, "s.*")
    return known.unionByName(rows.where(F.col(message).isNull()))


def tally(rows: DataFrame, model: str, tokens: str, weights: dict[str, float]) -> DataFrame:
    """Tokens of each model and their weighted sum (operator 87); a model without a weight has a null one."""
    weight = F.coalesce(*(F.when(F.col(model) == k, F.lit(v)) for k, v in weights.items()))
    return rows.groupBy(model).agg(F.count("*").alias("responses"), F.sum(tokens).alias("tokens")).withColumn("weighted", F.round(F.col("tokens") * weight, 1))


def rollup(rows: DataFrame, levels: list[str], tokens: str) -> DataFrame:
    """Totals at every level (operator 88); level is the grouping id."""
    return rows.rollup(*levels).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("responses"), F.grouping_id().cast("long").alias("level"))


def running_budget(rows: DataFrame, by: list[str], order: list[Column], value: str, limit: float) -> DataFrame:
    """Rows while the running sum of by stays within limit (operator 19)."""
    total = F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", total).where(F.col("running") <= limit)


def cache_state(age: Column, failed: Column, most: float, refresh: Column | None = None) -> Column:
    """cached, fresh, stale or failed (operator 143): a copy younger than most is used unless a refresh is asked for; else a fetch
    that does not fail is fresh; after a failed one a copy younger than twice most is stale. A null age means no usable copy."""
    asked = F.lit(False) if refresh is None else F.coalesce(refresh, F.lit(False))
    return F.when((age < most) & ~asked, "cached").when(~F.coalesce(failed, F.lit(True)), "fresh").when(age < 2 * most, "stale").otherwise("failed")


def once(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each by (operator 141)."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("s")).select(*by, "s.*")
