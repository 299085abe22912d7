"""Reports as lines: Markdown of findings by repository, and sweeps of hits; written as text by Spark, a folder for each report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.functions.code import code_span
from churnlens.functions.markdown import linked, prose, table_row

#: Levels of confidence and gates in the order in which findings are told.
GATES, LEVELS = ["none", "unconfirmed_default", "non_default_setting"], ["high", "medium", "low"]


def _rank(c: str, order: list[str]) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), F.col(c))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def ordered(findings: DataFrame, by: str) -> DataFrame:
    """findings with no, their place in each report (operator 99): by gate, confidence, score (highest first), path, line and key; ties beyond that share no place.

    The sort is one of a report's findings; ids of the form F01 follow from no.
    """
    order = [_rank("gate", GATES), _rank("confidence", LEVELS), F.desc_nulls_last("score"), F.asc_nulls_last("path"), F.asc_nulls_last("line"), F.asc_nulls_last("key")]
    return findings.withColumn("no", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def markdown(findings: DataFrame, by: str, title: str = "Findings") -> DataFrame:
    """by, section, at, line: each report's lines in order (operator 22): a head, counts by confidence, a table, and a part for each finding.

    findings has by, key, path, line, url, gate, confidence, score, claim and evidence (an array of (ref, url, note)). All text is made inert. A report's lines
    are made where its findings are; nothing is collected.
    """
    own = ordered(findings, by)
    fid = F.concat(F.lit("F"), F.lpad(F.col("no").cast("string"), 2, "0"))
    fid = F.when(F.col("no") > 99, F.concat(F.lit("F"), F.col("no"))).otherwise(fid)
    place = F.concat_ws(":", "path", "line")
    counts = findings.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col("confidence") == level).alias(level) for level in LEVELS))
    told = F.concat_ws(", ", *(F.when(F.col(level) > 0, F.concat(F.col(level), F.lit(f" {level}"))) for level in LEVELS))
    head = F.array(F.concat(F.lit(f"# {title}: "), prose(F.col(by).cast("string"), heading=True)), F.lit(""), F.concat("n", F.lit(" findings"), F.when(told != "", F.concat(F.lit(": "), told)).otherwise("")), F.lit(""), F.lit("| id | where | confidence | claim |"), F.lit("|-|-|-|-|"))
    row = table_row(fid, linked(place, F.col("url"), cell=True), prose(F.col("confidence"), cell=True), prose(F.col("claim"), cell=True))
    proof = F.transform("evidence", lambda e: F.concat(F.lit("- "), linked(e["ref"], e["url"]), F.when(F.coalesce(e["note"], F.lit("")) != "", F.concat(F.lit(": "), prose(e["note"]))).otherwise("")))
    gate = F.when(F.col("gate") == "none", F.array()).otherwise(F.array(F.concat(F.lit("Gate: "), code_span(F.col("gate"))), F.lit(""))).cast("array<string>")
    part = F.concat(F.array(F.lit(""), F.concat(F.lit("## "), fid, F.lit(" "), code_span(place)), F.lit(""), prose(F.col("claim")), F.lit("")), gate, F.coalesce(proof, F.array().cast("array<string>")))
    sections = [counts.select(by, F.lit(0).alias("section"), F.lit(0).alias("no"), F.posexplode(head).alias("i", "line")), own.select(by, F.lit(1), "no", F.lit(0), row), own.select(by, F.lit(2), "no", F.posexplode_outer(part))]  # outer, as no part is empty and a plain explode has it made again for a filter
    all_ = sections[0]
    for more in sections[1:]:
        all_ = all_.union(more)
    at = F.row_number().over(Window.partitionBy(by).orderBy("section", "no", "i"))
    return all_.select(by, "section", at.alias("at"), "line")


def sweep(hits: DataFrame) -> DataFrame:
    """line of each hit, rule TAB path:line TAB snippet (operator 26), for a sorted sink; tabs and ends of lines in snippets are blanks."""
    clean = F.regexp_replace(F.coalesce("snippet", F.lit("")), "[\\t\\r\\n]+", " ")
    return hits.select("rule", "path", "line_no", F.concat_ws("\t", "rule", F.concat_ws(":", "path", "line_no"), clean).alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str], by: str | None = None) -> None:
    """Lines as text files in order: with by a folder and one file for each of its values, else files that in turn are the whole, sorted over all tasks."""
    if by:
        lines.repartition(by).sortWithinPartitions(by, *order).select(by, "line").write.partitionBy(by).text(path)
    else:
        lines.orderBy(*order).select("line").write.text(path)
