"""Paths: the index of a repository from its listing, languages by extension, edges kept up to a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Edges of each direction that are kept.
EDGES = 25


def index_entries(listings: DataFrame, keys: list[str], text: str = "listing") -> DataFrame:
    """keys, path, mode, sha, stage of each entry of an index listing, `mode sha stage TAB path` ended by NUL (operator 2); a path that is unmerged
    counts by its first entry. Entries are cut from the text in their row, and only paths that stand twice meet."""
    entry = F.posexplode(F.split(text, "\x00", -1)).alias("_at", "_e")
    rows = listings.select(*keys, entry).withColumn("_meta", F.split(F.substring_index("_e", "\t", 1), " "))
    path = F.substring(F.col("_e"), F.instr("_e", "\t") + 1, F.length("_e"))
    named = rows.where(F.instr("_e", "\t") > 0).select(*keys, "_at", path.alias("path"), F.get("_meta", F.lit(0)).alias("mode"), F.get("_meta", F.lit(1)).alias("sha"), F.get("_meta", F.lit(2)).try_cast("int").alias("stage")).where("path <> ''")
    first = F.min_by(F.struct("mode", "sha", "stage"), "_at").alias("_s")
    return named.groupBy(*keys, "path").agg(first).select(*keys, "path", "_s.mode", "_s.sha", "_s.stage")


def extension(path: Column) -> Column:
    """The last extension of a path's name in lower case, with its dot; null where the name has none, only begins with a dot or ends with one."""
    return F.nullif(F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)), F.lit(""))


def with_language(files: DataFrame, extensions: dict[str, str], aliases: dict[str, str] | None = None, only_with_leads: set[str] | None = None, path: str = "path") -> DataFrame:
    """files with lang, the language of each path's extension, rule_lang, the one whose rules it takes, and needs_leads, whether it counts only where a
    rule hits it (operators 34 and 35). The maps are a catalog's, and constants of the plan; paths without a language have a null one."""
    known = F.create_map(*(F.lit(x) for pair in extensions.items() for x in pair)) if extensions else F.create_map().cast("map<string,string>")
    other = F.create_map(*(F.lit(x) for pair in (aliases or {}).items() for x in pair)) if aliases else F.create_map().cast("map<string,string>")
    lang = F.try_element_at(known, extension(F.col(path)))
    named = files.withColumn("lang", lang)
    needs = F.coalesce(F.col("lang").isin(*sorted(only_with_leads)), F.lit(False)) if only_with_leads else F.lit(False)
    return named.withColumns({"rule_lang": F.coalesce(F.try_element_at(other, F.col("lang")), F.col("lang")), "needs_leads": needs})


def capped_edges(edges: DataFrame, by: list[str], order: list[str], direction: str = "direction", keep: int = EDGES) -> DataFrame:
    """edges with kept, whether each is among the first of its direction (operator 94). Spark drops no row: what is cut is counted by cut_edges."""
    at = F.row_number().over(Window.partitionBy(*by, direction).orderBy(*order))
    return edges.withColumn("kept", at <= keep)


def cut_edges(edges: DataFrame, by: list[str], direction: str = "direction", keep: int = EDGES) -> DataFrame:
    """by, inbound, outbound: how many edges of each direction are beyond the cap; from counts alone, so nothing is sorted."""
    over = lambda d: F.greatest(F.lit(0), F.count_if(F.col(direction) == d) - keep).cast("long").alias(d)
    return edges.groupBy(*by).agg(over("inbound"), over("outbound"))
