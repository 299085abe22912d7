"""Line rules over texts: leads, frames, excuses, caps, suppressions, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CAP = 5
TIERS = {"A": 1.0, "B": 0.6, "C": 0.0}
CONFIDENCES = {"high": 1.0, "medium": 0.7, "low": 0.4}


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1 (operator 48); empty lines stay."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line")


def framed(numbered: DataFrame, before: int, after: int) -> DataFrame:
    """lines with frame, the lines about each one joined (operators 49 and 100); a document's lines meet in one task."""
    about = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(before, after)
    return numbered.withColumn("frame", F.array_join(F.collect_list("line").over(about), "\n"))


def framed_leads(docs: DataFrame, hit: str, before: int, after: int, present: str | None = None, absent: str | None = None, gate: str | None = None) -> DataFrame:
    """Lines that match hit and whose frame has present and lacks absent (operators 49 and 50).

    Frames are cut from the document's own array of lines at the hit lines only, so lines are never shuffled. gate, a pattern
    of the whole text, is tested first.
    """
    gated = docs if gate is None else docs.where(F.col("text").rlike(gate))
    # texts are kept by their lines, as anchors and looks around mean something else in a whole text
    own = gated.select("doc_id", F.split("text", "\n", -1).alias("ls")).where(F.exists("ls", lambda x: x.rlike(hit)))
    found = own.select("doc_id", "ls", F.posexplode("ls").alias("i", "line")).where(F.col("line").rlike(hit))
    first = F.greatest(F.lit(0), F.col("i") + before)
    frame = F.array_join(F.slice("ls", first + 1, F.greatest(F.lit(0), F.col("i") + after - first + 1)), "\n")
    out = found.select("doc_id", (F.col("i") + 1).alias("line_no"), "line", frame.alias("frame"))
    if present:
        out = out.where(F.col("frame").rlike(present))
    if absent:
        out = out.where(~F.col("frame").rlike(absent))
    return out.select("doc_id", "line_no", F.substring(F.trim("line"), 1, 200).alias("snippet"))


def capped(hits: DataFrame, by: list[str], keep: int = CAP) -> DataFrame:
    """The first hits of each rule and document (operator 103)."""
    return hits.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("line_no"))).where(F.col("r") <= keep).drop("r")


def first_of(hits: DataFrame, by: list[str], order: str) -> DataFrame:
    """One hit for each of by, the one of least order (operators 53 and 54)."""
    rest = [c for c in hits.columns if c not in by]
    return hits.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("s")).select(*by, "s.*")


def ruled(numbered: DataFrame, rules: list[tuple[int, str, str]], cond: Column | None = None) -> DataFrame:
    """Lines by rule (ord, name, pattern): each rule is a literal pattern in one pass over the lines, not a join."""
    found = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(o).alias("ord"), F.lit(n).alias("rule"))) for o, n, p in rules)))
    return numbered.select("doc_id", "line_no", F.explode(found).alias("f")).select("doc_id", "line_no", "f.ord", "f.rule")


def file_absent(docs: DataFrame, require: str, anchor: str, absent: str) -> DataFrame:
    """The first anchor line of texts that have require and nowhere absent (operator 51)."""
    gated = docs.where(F.col("text").rlike(require) & ~F.col("text").rlike(absent))
    at = F.array_position(F.transform(F.split("text", "\n", -1), lambda x: x.rlike(anchor)), True)
    return gated.select("doc_id", at.cast("int").alias("line_no")).where("line_no > 0")


def suppressed(hits: DataFrame, rules: list[tuple[int, str, str]], path: str) -> DataFrame:
    """hits with rule_no, the first suppression (number, rule name, path pattern) that covers each, or null (operator 38)."""
    no = F.coalesce(*(F.when((F.col("rule") == n) & F.col(path).rlike(p), F.lit(k)) for k, n, p in sorted(rules)))
    return hits.withColumn("rule_no", no)


def weights(hits: DataFrame, cap: float = 2.0) -> DataFrame:
    """Per doc (operators 61 and 78): the largest contribution of each pattern, summed, capped. hits has pattern, tier, weight, confidence."""
    level = lambda c, known: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in known.items()), F.lit(0.0))
    each = hits.groupBy("doc_id", "pattern").agg(F.max(F.col("weight") * level("tier", TIERS) * level("confidence", CONFIDENCES)).alias("w"))
    return each.groupBy("doc_id").agg(F.round(F.least(F.lit(cap), F.sum("w")), 6).alias("weight"), F.count("*").alias("patterns"))
