"""Closed ranges that meet: a join by bins of powers of two, and counts of meetings without any pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(lo: Column, hi: Column) -> Column:
    """The least power of two that is no less than a range's length: at that bin size a range lies in two bins at most."""
    return F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int")


def _levels(ranges: DataFrame, lo: str, hi: str) -> list[int]:
    return sorted(r[0] for r in ranges.select(_level(F.col(lo), F.col(hi))).distinct().collect())  # 64 at most


def _dealt(ranges: DataFrame, own: Column, others: list[int]) -> DataFrame:
    """Each range at its own level and at those levels of the other side that are higher, once for each bin it lies in there."""
    levels = F.array_distinct(F.concat(F.array(own), F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > own)))
    leveled = ranges.withColumn("_own", own).withColumn("_level", F.explode(levels))
    return leveled.withColumn("_bin", F.explode(F.expr("sequence(shiftright(_lo, _level), shiftright(_hi, _level))")))


def meet(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str] = ("lo", "hi"), right_range: tuple[str, str] = ("lo", "hi")) -> DataFrame:
    """Rows of left and right, equal in `on`, whose closed ranges meet; each pair once. Other columns' names must differ.

    A pair meets at the higher of its two levels, in the bin where the later range begins, so the join is an equi-join on path, level and bin, long
    ranges are not listed line by line, and no pair is made twice. Ranges that end before they begin meet nothing.
    """
    sides = []
    for df, (lo, hi), name in ((left, left_range, "a"), (right, right_range, "b")):
        sound = df.where(F.col(lo) <= F.col(hi)).withColumns({"_lo": F.col(lo).cast("long"), "_hi": F.col(hi).cast("long")})
        sides.append((sound, _level(F.col("_lo"), F.col("_hi")), name))
    found = [_levels(df, "_lo", "_hi") for df, _, _ in sides]
    a, b = (_dealt(df, own, other).withColumnsRenamed({c: f"{c}_{name}" for c in ("_lo", "_hi", "_own")}) for (df, own, name), other in zip(sides, reversed(found), strict=True))
    met = a.join(b, [*on, "_level", "_bin"]).where("_level = greatest(_own_a, _own_b) AND _lo_a <= _hi_b AND _lo_b <= _hi_a AND _bin = shiftright(greatest(_lo_a, _lo_b), _level)")
    return met.drop("_level", "_bin", *(f"{c}_{n}" for c in ("_lo", "_hi", "_own") for n in "ab"))


#: Bins of lists have one of few sizes, powers of 2^COARSE, so that short ranges are listed for few sizes of longer ones.
COARSE = 4


def gathered(left: DataFrame, right: DataFrame, on: list[str], keep: list[str], value: str, left_range: tuple[str, str] = ("lo", "hi"), right_range: tuple[str, str] = ("lo", "hi")) -> DataFrame:
    """keep and met of rows of left: the values of the right rows, equal in `on`, whose closed ranges meet theirs; a row that lies in several bins comes with a part for each.

    Like meet, but the right rows of a bin are one list, and a left row takes from it what it meets, so no pair is a row. A bin has a list of all right ranges that are no longer
    than it and one of those of its own size: a left row reads the first at its own size, and of larger bins only the second, which is short where ranges do not overlap.
    """
    sides = []
    for df, (lo, hi) in ((left, left_range), (right, right_range)):
        sound = df.where(F.col(lo) <= F.col(hi)).withColumns({"_lo": F.col(lo).cast("long"), "_hi": F.col(hi).cast("long")})
        sides.append((sound, F.ceil((_level(F.col("_lo"), F.col("_hi")) + 1) / COARSE).cast("int") * COARSE))
    (a, own_a), (b, own_b) = sides
    asks, has = ([r[0] for r in df.select(own).distinct().collect()] for df, own in sides)  # 17 at most
    # a list is known by one number: its bin, its size and whether it is of all
    at = F.expr("shiftleft(_bin, 8) + 2 * _level + int(_all)")
    a = _dealt(a, own_a, has).withColumn("_all", F.col("_own") == F.col("_level")).select(*keep, *on, at.alias("_at"), "_lo", "_hi")
    sorts = F.when(F.col("_own") == F.col("_level"), F.array_compact(F.array(F.lit(True), F.when(F.col("_level") > min(asks, default=0), False)))).otherwise(F.array(F.lit(True)))
    b = _dealt(b, own_b, asks).withColumn("_all", F.explode(sorts)).select(*on, at.alias("_at"), "_lo", "_hi", value)
    lists = b.repartition(*on, "_at").groupBy(*on, "_at").agg(F.collect_list(F.struct("_lo", "_hi", value)).alias("_list"))
    met = F.transform(F.filter("_list", lambda x: (x["_lo"] <= F.col("_hi")) & (x["_hi"] >= F.col("_lo"))), lambda x: x[value])
    return a.join(lists, [*on, "_at"]).select(*keep, met.alias("met")).where("size(met) > 0")


def meetings(ranges: DataFrame, owner: str, path: str, lo: str, hi: str) -> DataFrame:
    """path, owner, lo, hi, others of each distinct range: how many ranges of other owners meet it. No pairs are made.

    Those that meet a range are those that begin no later than it ends less those that ended before it began, over all owners less the same over its own. A range is dealt
    out once, by its path; there its two ends are counted in order, a place's beginnings before its ends, and summed. Rows with a null or with hi before lo are left out.
    """
    named = ranges.select(F.col(path).alias("path"), F.col(owner).alias("owner"), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi")).dropna().where("lo <= hi")
    own = named.repartition("path").distinct()
    ends = own.select("path", "owner", "lo", "hi", F.explode(F.array(F.lit(0), F.lit(1))).alias("end")).withColumn("at", F.when(F.col("end") == 1, F.col("hi")).otherwise(F.col("lo")))

    def seen(*keys: str) -> Column:
        """What began up to an end, or less what ended up to a beginning."""
        upto = Window.partitionBy(*keys).orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0)
        ended = F.sum("end").over(upto)
        return F.when(F.col("end") == 1, F.count("*").over(upto) - ended).otherwise(-ended)

    counted = ends.withColumn("n", seen("path")).withColumn("mine", seen("path", "owner"))
    return counted.groupBy("path", "owner", "lo", "hi").agg(F.sum(F.col("n") - F.col("mine")).alias("others"))
