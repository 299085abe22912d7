"""Findings: ranges, duplicates, decision tables, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.functions.exprs import DOUBTFUL
from churnlens.operators.components import components
from churnlens.operators.intervals import meet
from churnlens.sources.staging import sized, staged


def overlaps(ranges: DataFrame, owner: str, path: str, lo: str, hi: str) -> DataFrame:
    """Pairs of different owners whose closed ranges on one path meet (operator 64), each once, with the number of meetings.

    The result has a row for each pair that meets; intervals.meetings counts them for each range without making pairs. Owners with one range on a path
    meet once, where they are joined; only pairs with an owner of several ranges there are dealt out again and counted.
    """
    named = ranges.select(F.col(path).alias("path"), F.col(owner).alias("o"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    several = F.count("*").over(Window.partitionBy("path", "o")) > 1
    own = staged(named.repartition("path", "o").distinct().withColumn("several", several))
    side = lambda df, s: df.drop("several").withColumnsRenamed({c: f"{c}_{s}" for c in ("o", "lo", "hi")})
    join = lambda a, b: meet(side(a, "a"), side(b, "b"), ["path"], ("lo_a", "hi_a"), ("lo_b", "hi_b"))
    single, many = own.where("NOT several"), sized(own.where("several"))
    once = join(single, single).where("o_a < o_b").select("path", F.col("o_a").alias("owner_a"), F.col("o_b").alias("owner_b"), F.lit(1).cast("long").alias("meetings"))
    again = join(many, single).union(join(many, own.where("several")).where("o_a < o_b"))
    pairs = again.select("path", F.least("o_a", "o_b").alias("owner_a"), F.greatest("o_a", "o_b").alias("owner_b"))
    return once.union(pairs.groupBy("path", "owner_a", "owner_b").agg(F.count("*").alias("meetings")))


def covered(need: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Per key (operators 65 and 66): does every needed range lie inside some range that is there, and does every one meet some.

    One sorted pass over a key's ends: the furthest end of all ranges that begin at or before lo reaches hi if one holds the
    needed range, and that of those that begin at or before hi reaches lo if one meets it. No pairs are made, and of the ranges that
    begin at one place only the longest is kept before they are shuffled, so a key's sort has a row for each place.
    """
    own = need.select(key, "lo", "hi").distinct()
    longest = have.groupBy(key, "lo").agg(F.max("hi").alias("hi"))
    begins = longest.select(F.col(key), F.col("lo").alias("at"), F.lit(0).alias("kind"), F.col("hi").alias("reach"), *(F.lit(None).cast("long").alias(c) for c in ("lo", "hi")))
    asked = [own.select(F.col(key), F.col(c).alias("at"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("reach"), "lo", "hi") for kind, c in ((1, "lo"), (2, "hi"))]
    furthest = F.max("reach").over(Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    seen = begins.unionByName(asked[0]).unionByName(asked[1]).withColumn("far", furthest).where("kind > 0")
    inside, meets = F.coalesce(F.col("far") >= F.col("hi"), F.lit(False)), F.coalesce(F.col("far") >= F.col("lo"), F.lit(False))
    return seen.groupBy(key).agg(F.every(inside | (F.col("kind") == 2)).alias("all_inside"), F.every(meets | (F.col("kind") == 1)).alias("all_meet"), F.count_if(F.col("kind") == 1).alias("ranges"))


def group_survivors(rows: DataFrame, link: str, order: list[Column], member: str) -> DataFrame:
    """Duplicate groups by a shared link value with the least member by order (operator 71, where links are equal values)."""
    least = F.min_by(F.col(member), F.struct(*order))
    return rows.groupBy(link).agg(least.alias("survivor"), F.count("*").alias("members")).where("members > 1")


def gate(preconditions: Column, status: Column | None = None, claims: Column | None = None) -> Column:
    """The gate of a finding (operator 121). preconditions: array of (needs, state, basis); claims: array of (field, setting), those a check refuted.

    A precondition that needs a changed setting gates first, as does a setting that a narrowing check found to be needed; then
    a default that is unconfirmed for a reason to doubt it.
    """
    none = F.lit(False)
    changed = F.exists(preconditions, lambda p: F.coalesce(p["needs"] == "changed", none))
    found = none if claims is None else (status == "narrowed") & F.exists(claims, lambda c: F.coalesce((c["field"] == "preconditions") & c["setting"].isNotNull(), none))
    doubtful = F.exists(preconditions, lambda p: F.coalesce((p["needs"] == "default") & (F.coalesce(p["state"], F.lit("")) != "confirmed") & p["basis"].isin(*DOUBTFUL), none))
    yes = lambda c: F.coalesce(c, none)
    return F.when(yes(changed) | yes(found), "non_default_setting").when(yes(doubtful), "unconfirmed_default").otherwise("none")


def confirmation(call_site: Column, item: Column) -> Column:
    """Basis of a default's confirmation (operator 122): item is null where no check looked, else (found, ref_error, names_setting, call_site)."""
    looked = item.isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~looked, F.when(yes(call_site), "call_site_fallback").otherwise("not_checked"))
        .when(yes(item["found"] == "not_found"), "not_found")
        .when(yes(item["ref_error"]) | yes(~item["names_setting"]), "unresolved")
        .when(yes(item["call_site"]), "call_site_fallback")
        .when(yes(item["found"] == "different"), "contradicted")
        .when(yes(item["found"] == "same"), "registered")
        .otherwise("not_checked")
    )


def run_verdict(status: Column, gate_: Column, claims: Column) -> Column:
    """Verdict class of a checked finding, or null (operator 123): claims is an array of (field, setting) that a check refuted."""
    only_gate = (F.size(claims) > 0) & F.forall(claims, lambda c: F.coalesce((c["field"] == "preconditions") & c["setting"].isNotNull(), F.lit(False)))
    return (
        F.when(status == "upheld", F.when(gate_ == "non_default_setting", "upheld_but_gated").otherwise("upheld"))
        .when(status == "narrowed", F.when(F.coalesce(only_gate, F.lit(False)), "upheld_but_gated").otherwise("narrowed"))
        .when(status == "refuted", "refuted")
    )


def duplicate_closure(findings: DataFrame, links: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """key, survivor for each finding that its group's first by order absorbs (operator 71). links(key, duplicate_of) counts where both are findings.

    Only linked keys get numbers, each its own, so that two groups cannot meet by a hash.
    """
    known = findings.select(key).distinct()
    real = links.join(known, key).join(known.select(F.col(key).alias("duplicate_of")), "duplicate_of").where(F.col(key) != F.col("duplicate_of")).select(key, "duplicate_of")
    linked = real.select(key).union(real.select("duplicate_of")).distinct()
    ids = staged(linked.withColumn("id", F.monotonically_increasing_id()))
    edges = real.join(ids.withColumnRenamed("id", "a"), key).join(ids.select(F.col(key).alias("duplicate_of"), F.col("id").alias("b")), "duplicate_of").select("a", "b")
    grouped = findings.join(ids.withColumnRenamed("id", "node"), key).join(components(edges), "node")
    first = grouped.groupBy("root").agg(F.min_by(key, F.struct(*order)).alias("survivor"))
    return grouped.join(first, "root").where(F.col(key) != F.col("survivor")).select(key, "survivor")


def vocabulary(rows: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Counts over a fixed vocabulary, zeros and all (operator 86), as one aggregate row unpivoted."""
    one = rows.agg(*(F.count_if(F.col(column) == w).alias(w) for w in words))
    return one.unpivot([], words, "word", "n")


def top_and_other(rows: DataFrame, column: str, keep: int = 8) -> DataFrame:
    """The keep most frequent values and the rest as `other` (operator 83)."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    top = F.broadcast(counts.orderBy(F.desc("n"), column).limit(keep).select(F.col(column).alias("_top"), F.lit(True).alias("_is")))
    bucket = F.when(F.col("_is"), F.col(column).cast("string")).otherwise("other")
    return counts.join(top, F.col(column).eqNullSafe(F.col("_top")), "left").groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def spearman(rows: DataFrame, x: str, y: str, parts: int = 256) -> DataFrame:
    """Rank correlation with average ranks (operator 93). Ranks come from counts of each value; values are dealt into ranges by their
    quantiles, so that no task sorts them all."""

    def ranked(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count("*").alias("k"))
        cuts = sorted(set(counts.approxQuantile(c, [i / parts for i in range(1, parts)], 1 / (4 * parts))))
        part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda q: q < F.col(c)))
        held = counts.withColumn("part", part)
        sums = held.groupBy("part").agg(F.sum("k").alias("n"))  # a row per range
        before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        upto = F.sum("k").over(Window.partitionBy("part").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        inner = held.withColumn("upto", upto).join(F.broadcast(before), "part")
        return inner.select(c, (F.col("before") + F.col("upto") - (F.col("k") - 1) / 2).alias(f"r_{c}"))

    out = rows.join(ranked(x), x).join(ranked(y), y)
    return out.agg(F.round(F.corr(f"r_{x}", f"r_{y}"), 6).alias("rho"), F.count("*").alias("n"))


def tree_hash(rows: DataFrame, by: str, order: str, digest: str, fan: int = 4096) -> DataFrame:
    """by, evidence: a hash over each group's digests (operator 136), first over id ranges of fan ids, then over the ranges' hashes."""
    chained = lambda name, at: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, name))), lambda x: x[name]), ","), 256)
    ranges = rows.groupBy(by, F.floor(F.col(order) / fan).alias("range")).agg(chained(digest, order).alias("h"))
    return ranges.groupBy(by).agg(chained("h", "range").alias("evidence"))
