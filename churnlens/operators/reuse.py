"""What a rerun need not do again: results of unchanged briefings, verdicts whose claim, files and versions still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Verdicts that a ledger may hand on.
VERDICTS = ["upheld", "narrowed", "refuted"]


def result_actions(now: DataFrame, before: DataFrame, rules: str, key: str = "id") -> DataFrame:
    """key, action of each briefing (operator 138): new without a result, changed where its hash is another, revalidate where the result was
    validated under other rules, else reuse.

    now has key and hash; before has key, hash, validated (whether its findings passed a check) and validated_with. A null hash is no match.
    """
    old = before.select(F.col(key).alias("_key"), F.col("hash").alias("_hash"), "validated", "validated_with")
    both = now.join(old, F.col(key) == F.col("_key"), "left")
    aged = F.coalesce(F.col("validated"), F.lit(False)) & ~F.col("validated_with").eqNullSafe(F.lit(rules))
    same = F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False))
    return both.select(key, F.when(F.col("_key").isNull(), "new").when(~same, "changed").when(aged, "revalidate").otherwise("reuse").alias("action"))


def verdict_actions(findings: DataFrame, ledger: DataFrame, ledger_files: DataFrame, ledger_versions: DataFrame, cited: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """key, reason of each finding (operator 139): null where the ledger's verdict stands, else the first thing that does not hold.

    findings(key, claim_hash), ledger(key, claim_hash, by, status), ledger_files(key, path, hash) and ledger_versions(key, package, version) as recorded,
    cited(key, path) now, files(path, hash) and packages(id, version, status) as they are. All joins are on keys; what a finding cites is one row a file.
    """
    was = ledger.select(F.col("key").alias("_key"), F.col("claim_hash").alias("_claim"), "by", "status")
    now = files.select("path", F.col("hash").alias("_now"))
    moved = ledger_files.join(now, "path", "left").groupBy("key").agg(F.count_if(F.col("hash").isNull() | ~F.col("hash").eqNullSafe(F.col("_now"))).alias("moved"))
    strange = cited.distinct().join(ledger_files.select("key", "path").distinct(), ["key", "path"], "left_anti").groupBy("key").agg(F.count("*").alias("strange"))
    there = packages.where("status = 'available'").select(F.col("id").alias("package"), F.col("version").alias("_there"))
    other = ledger_versions.join(there, "package", "left").groupBy("key").agg(F.count_if(~F.col("version").eqNullSafe(F.col("_there")) | F.col("_there").isNull()).alias("other"))
    all_ = findings.join(was, F.col("key") == F.col("_key"), "left")
    for part in (moved, strange, other):
        all_ = all_.join(part, "key", "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    sound = F.coalesce((F.col("by") == "skeptic") & F.col("status").isin(*VERDICTS), F.lit(False))
    reason = (
        F.when(F.col("_key").isNull(), "not in the ledger")
        .when(~F.col("claim_hash").eqNullSafe(F.col("_claim")), "claim changed")
        .when(~sound, "no verdict")
        .when(more("moved"), "a file changed")
        .when(more("strange"), "cites another file")
        .when(more("other"), "a dependency changed")
    )
    return all_.select("key", reason.alias("reason"))
