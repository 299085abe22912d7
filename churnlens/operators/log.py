"""Raw change-log records to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What parts records, and fields and names within one.
RECORD, FIELD = "\x1e", "\x00"
#: A touched file: added, removed, then its name, or an empty name with the old and the new one after it.
_TOUCH = r"[^\t\x00]*\t[^\t\x00]*\t(?:\x00[^\x00]*\x00[^\x00]*|[^\x00]+)"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """record: one row per commit of log text written with RECORD before each; files are split over tasks at that mark."""
    return spark.read.option("lineSep", RECORD).text(path).withColumnRenamed("value", "record")


def parsed_log(records: DataFrame, record: str = "record") -> DataFrame:
    """sha, author, authored_at, subject, files (array of pos, path, adds, dels, is_binary) for each record (operator 1).

    A record is a header of four fields, a line feed, and the touched files. A rename counts under its new name; a binary
    file adds and removes nothing; records with fewer fields are dropped. A commit that touches nothing has an empty array.
    """
    whole = F.regexp_replace(record, r"\A\n+|\n+\z", "")
    header, body = F.substring_index(whole, "\n", 1), F.when(whole.contains("\n"), F.regexp_replace(whole, r"\A[^\n]*\n", "")).otherwise("")
    own = records.select(F.split(header, FIELD).alias("h"), F.regexp_extract_all(body, F.lit(_TOUCH), F.lit(0)).alias("touched")).where(F.size("h") >= 4)

    def file(t, i):
        parts = F.split(t, "\t", 3)
        adds, dels = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        count = lambda c: F.when(c.rlike("^[0-9]+$"), c.try_cast("long")).otherwise(0)
        return F.struct(i.cast("long").alias("pos"), F.element_at(F.split(F.get(parts, F.lit(2)), FIELD), -1).alias("path"), count(adds).alias("adds"), count(dels).alias("dels"), (adds == "-").alias("is_binary"))

    files = F.filter(F.transform("touched", file), lambda f: f["path"] != "")
    return own.select(*(F.get("h", F.lit(i)).alias(c) for i, c in enumerate(("sha", "author", "authored_at", "subject"))), files.alias("files"))


def touches_of(log: DataFrame) -> DataFrame:
    """sha, pos, path, adds, dels, is_binary: a row per touched file."""
    return log.select("sha", F.explode("files").alias("f")).select("sha", "f.*")
