"""A run's records against labels: which count, how verdicts, confidence, duplicates and shown ranges compare, and what is planned to be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The levels of confidence from low to high, the verdicts of labels in order, and what each pair of a run's verdict and a label's counts as.
LEVELS = ["low", "medium", "high"]
LABELS = ["correct", "correct_but_gated", "partially_correct", "wrong"]
OUTCOMES = {
    "upheld": ["same", "one step", "wrong direction", "wrong direction"],
    "upheld_but_gated": ["one step", "same", "wrong direction", "wrong direction"],
    "narrowed": ["one step", "one step", "same", "one step"],
    "refuted": ["correct refuted", "correct refuted", "one step", "same"],
}


def states(run: DataFrame, labels: DataFrame, model: str | None, key: str = "key") -> DataFrame:
    """run with the labels' columns and state (operator 63): unlabelled, excluded where the label is by the model that is scored, else scored."""
    theirs = labels.withColumn("_labelled", F.lit(True))
    both = run.join(theirs, key, "left")
    own = F.coalesce(F.col("labelled_by") == model, F.lit(False)) if model else F.lit(False)
    return both.withColumn("state", F.when(F.col("_labelled").isNull(), "unlabelled").when(own, "excluded").otherwise("scored")).drop("_labelled")


def outcome(verdict: Column, label: Column) -> Column:
    """What a run's verdict is worth beside a label's (operator 72); null where either is none of the known ones."""
    at = F.array_position(F.array(*map(F.lit, LABELS)), label)
    row = F.coalesce(*(F.when(verdict == v, F.array(*map(F.lit, o))) for v, o in OUTCOMES.items()))
    return F.when(at > 0, F.get(row, (at - 1).cast("int")))


def confidence_step(claimed: Column, deserved: Column) -> Column:
    """Levels that a claim lies above what was deserved (operator 90), below zero where it is below; null where either is unknown."""
    levels = F.array(*map(F.lit, LEVELS))
    at = lambda c: F.nullif(F.array_position(levels, c), F.lit(0).cast("long"))
    return at(claimed) - at(deserved)


def duplicate_state(stated: bool | Column, told: Column, label: Column) -> Column:
    """found, missed or false of a record that states a duplicate or that it has none (operator 90); null where there is nothing to say. stated says
    whether the record speaks of duplicates at all. A record that names another one than the label missed the label's and is false too: it is `missed, false`."""
    right = F.coalesce(told == label, F.lit(False))
    missed, false = label.isNotNull() & ~right, told.isNotNull() & ~right
    return F.when(stated, F.when(label.isNotNull() & right, "found").when(missed & false, "missed, false").when(missed, "missed").when(false, "false"))


def shown_states(records: DataFrame, facts: DataFrame, shown: DataFrame) -> DataFrame:
    """key, outcome, partly_elsewhere of records whose label names refuting ranges (operator 90): were those in the briefing?

    records(key, file, readable): the briefing's file, and whether what it shows could be read; facts(key, kind, path, lo, hi); shown(key, first, last). A range is shown
    if one shown range holds it: ranges meet those of their own key by equal keys alone, as a briefing shows a few.
    """
    own = facts.join(records, "key").withColumn("mine", (F.col("kind") == "repo") & F.coalesce(F.col("path") == F.col("file"), F.lit(False)))
    held = own.where("mine").join(shown, "key").where("first <= lo AND hi <= last").select("key", "path", "lo", "hi").distinct().withColumn("_held", F.lit(True))
    every = own.join(held, ["key", "path", "lo", "hi"], "left")
    sums = every.groupBy("key").agg(F.count_if(F.col("kind") == "repo").alias("repo"), F.count_if("mine").alias("own"), F.count_if(F.col("mine") & F.col("_held").isNull()).alias("open"), F.first("readable").alias("readable"))
    told = F.when(F.col("repo") == 0, "not in repository").when(~F.coalesce(F.col("readable"), F.lit(False)), "unreadable").when(F.col("own") == 0, "elsewhere").when(F.col("open") == 0, "shown").otherwise("not shown")
    return sums.withColumn("outcome", told).select("key", "outcome", ((F.col("outcome") == "shown") & (F.col("own") < F.col("repo"))).alias("partly_elsewhere"))


def planned(findings: DataFrame, reasons: DataFrame, order: list[str]) -> DataFrame:
    """findings with action (operator 44): skip for all but the first of a key, reuse where nothing speaks against the ledger's verdict, else check.

    reasons(key, reason) is what reuse.verdict_actions gives: null where the verdict stands.
    """
    first = F.row_number().over(Window.partitionBy("key").orderBy(*order)) == 1
    stands = reasons.select("key", F.col("reason").isNull().alias("_stands")).distinct()
    both = findings.withColumn("_first", first).join(stands, "key", "left")
    return both.withColumn("action", F.when(~F.col("_first"), "skip").when(F.coalesce(F.col("_stands"), F.lit(False)), "reuse").otherwise("check")).drop("_first", "_stands")
