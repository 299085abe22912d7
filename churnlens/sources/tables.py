"""The tables of a folder, and the shapes that operators take, projected from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """commits(sha, author, ts, subject) from orders."""
    o = table(spark, folder, "orders")
    return o.select(o["o_orderkey"].alias("sha"), o["o_custkey"].alias("author"), o["o_orderdate"].alias("ts"), o["o_orderpriority"].alias("subject"))


def touches(spark: SparkSession, folder: str, path: str = "l_suppkey") -> DataFrame:
    """touches(sha, path, pos, adds, dels) from lineitem."""
    i = table(spark, folder, "lineitem")
    return i.select(i["l_orderkey"].alias("sha"), i[path].alias("path"), i["l_linenumber"].cast("long").alias("pos"), i["l_quantity"].cast("long").alias("adds"), i["l_linenumber"].cast("long").alias("dels"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """responses(message, model, pos, ts, user_id, tokens) from events: every fifth has no message id, the rest share ids by threes."""
    e = table(spark, folder, "events")
    message = F.when(e["event_id"] % 5 != 0, F.floor(e["event_id"] / 3).cast("long"))
    return e.select(message.alias("message"), e["event_type"].alias("model"), e["event_id"].alias("pos"), e["ts"].alias("ts"), "user_id", F.floor(e["value"]).cast("long").alias("tokens"))
