"""Queries over manifests that Spark writes from the given tables, a repository for each supplier, and reads back. Each with SQL that never sees the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.jobs.reference import query
from churnlens.operators import packages
from churnlens.sources.tables import table


def _text(c):
    return c.cast("string")


def _parts(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("p"), (F.col("l_linenumber") % 2).alias("odd")).repartition("repo").distinct()


@query("""WITH l AS (SELECT l_suppkey AS repo, l_partkey AS p, max(l_linenumber % 2) AS odd FROM lineitem GROUP BY 1, 2), x AS (SELECT *, p % 3 AS a, p % 5 AS b, p % 7 AS c, CASE WHEN odd = 1 THEN '^' ELSE '~' END AS op FROM l)
SELECT repo, 'npm:p' || p AS id, op || a || '.' || b || '.0' AS declared, CASE WHEN p % 4 <> 0 THEN a || '.' || c || '.0' END AS version, CASE WHEN p % 4 = 0 THEN NULL WHEN a = 0 THEN 'locked' ELSE 'declared_range' END AS basis,
CASE WHEN p % 4 = 0 THEN 'no installed copy' WHEN a = 0 THEN CASE WHEN p % 2 = 1 THEN 'installed 0.' || c || '.0, the lock says 0.' || (c + 1) || '.0' END WHEN CASE op WHEN '^' THEN c < b ELSE c <> b END THEN 'installed ' || a || '.' || c || '.0 is not in the declared range' END AS reason FROM x""")
def q_npm_packages(spark, d):
    """A part in both sections counts by the first; the lock stands a folder above the manifest."""
    p, a, c = F.col("p"), F.col("p") % 3, F.col("p") % 7
    parts = _parts(spark, d)
    name = F.concat(F.lit("p"), _text(p))
    rng = F.concat(F.when(F.col("odd") == 1, "^").otherwise("~"), _text(a), F.lit("."), _text(p % 5), F.lit(".0"))
    pairs = lambda odd: F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("odd") == odd, F.struct(name, rng)))))
    manifests = parts.groupBy("repo").agg(F.to_json(F.struct(F.lit("x").alias("name"), pairs(1).alias("dependencies"), pairs(0).alias("devDependencies"))).alias("text")).select("repo", F.lit("sub/app/package.json").alias("path"), "text")
    one = parts.select("repo", "p").distinct()
    held = F.struct(F.concat_ws(".", F.lit("0"), _text(c + p % 2), F.lit("0")).alias("version"))
    locks = one.where("p % 3 = 0").groupBy("repo").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("node_modules/"), name), held))).alias("packages"))).alias("text")).select("repo", F.lit("package-lock.json").alias("path"), "text")
    files = manifests.union(locks)
    installed = one.where("p % 4 <> 0").select("repo", F.lit("npm").alias("ecosystem"), name.alias("name"), F.concat_ws(".", _text(a), _text(c), F.lit("0")).alias("version"), F.lit(False).alias("editable"))
    return packages.discovered(packages.npm_declared(files), packages.npm_locked(files), installed).select("repo", "id", "declared", "version", "basis", "reason")


@query("""WITH l AS (SELECT l_suppkey AS repo, l_partkey AS p, max(l_linenumber % 2) AS odd, min(l_linenumber % 2) AS even FROM lineitem GROUP BY 1, 2)
SELECT repo, 'part-' || p AS name, CASE WHEN p % 6 = 0 THEN '' ELSE '>=' || p % 4 || '.0,<' || (p % 4 + 2) END AS declared, CASE WHEN odd = 1 AND even = 0 THEN 'common/base.txt,requirements.txt' WHEN odd = 1 THEN 'requirements.txt' ELSE 'common/base.txt' END AS declared_in FROM l""")
def q_pypi_packages(spark, d):
    """Odd items are in a repository's requirements, the others in a file that these include, which includes the first again."""
    p = F.col("p")
    line = F.concat(F.lit("Part_."), _text(p), F.when(p % 6 == 0, F.lit(" # any")).otherwise(F.concat(F.lit("[x] >= "), _text(p % 4), F.lit(".0, <"), _text(p % 4 + 2), F.lit("; python_version > '3'"))))
    lines = lambda odd, head: F.concat(F.lit(head), F.array_join(F.array_compact(F.collect_list(F.when(F.col("odd") == odd, line))), "\n"))
    own = _parts(spark, d).groupBy("repo").agg(lines(1, "-r common/../common/base.txt\n--index-url x\n").alias("a"), lines(0, "-r ../requirements.txt\n").alias("b"))
    files = own.select("repo", F.lit("requirements.txt").alias("path"), F.col("a").alias("text")).union(own.select("repo", F.lit("common/base.txt"), "b"))
    return packages.pypi_declared(files).select("repo", "name", "declared", F.array_join("declared_in", ",").alias("declared_in"))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS repo, l_partkey AS p FROM lineitem)
SELECT repo, 'maven:g/p' || p AS id, CASE p % 4 WHEN 0 THEN p % 9 || '.1' WHEN 1 THEN '2.' || repo WHEN 2 THEN '[1,2)' ELSE '' END AS declared, CASE WHEN p % 5 = 0 THEN '7.' || p % 3 WHEN p % 4 = 0 THEN p % 9 || '.1' WHEN p % 4 = 1 THEN '2.' || repo END AS version,
CASE WHEN p % 5 = 0 THEN 'locked' WHEN p % 4 < 2 THEN 'pinned' END AS basis, CASE WHEN p % 5 = 0 OR p % 4 < 2 THEN 'no sources in the local caches' WHEN p % 4 = 2 THEN 'declared version is a range' ELSE 'no version declared' END AS reason FROM l""")
def q_maven_packages(spark, d):
    p = F.col("p")
    one = _parts(spark, d).select("repo", "p").distinct()
    version = F.when(p % 4 == 0, F.concat(F.lit("<version>"), _text(p % 9), F.lit(".1</version>"))).when(p % 4 == 1, "<version>${own.v}</version>").when(p % 4 == 2, "<version> [1,2) </version>").otherwise("")
    dep = F.concat(F.lit("<dependency>\n<groupId>g</groupId><artifactId>p"), _text(p), F.lit("</artifactId>"), version, F.lit("<exclusions><exclusion><groupId>x</groupId></exclusion></exclusions></dependency>"))
    poms = one.groupBy("repo").agg(F.array_join(F.collect_list(dep), "\n").alias("deps")).select("repo", F.lit("pom.xml").alias("path"), F.concat(F.lit("<project><properties><own.v>2."), _text(F.col("repo")), F.lit("</own.v></properties><dependencies>"), "deps", F.lit("</dependencies></project>")).alias("text"))
    lock = one.where("p % 5 = 0").groupBy("repo").agg(F.array_join(F.collect_list(F.concat(F.lit("g:p"), _text(p), F.lit(":7."), _text(p % 3), F.lit("=compile"))), "\n").alias("text")).select("repo", F.lit("gradle.lockfile").alias("path"), "text")
    files = poms.union(lock)
    none = spark.createDataFrame([], "repo long, ecosystem string, name string, version string, editable boolean")
    return packages.discovered(packages.maven_declared(files), packages.maven_locked(files), none).select("repo", "id", "declared", "version", "basis", "reason")
