"""Packages that repositories declare, lock and have installed: manifests of three ecosystems as rows of text, joined to their status.

files(repo, path, text) holds the manifests of any number of repositories. JSON is read as variants, XML and lines by patterns; TOML and YAML, which
Spark has no reader for, become JSON text in one small pandas function each. The rest is joins on repository and name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.functions.code import package_name, satisfies
from churnlens.functions.exprs import let
from churnlens.sources.staging import sized, staged

# The sections of package.json in the order in which they count, and what a package's status tells.
NPM_SECTIONS = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
REQUIREMENT = r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(?:\[[^\]]*\])?\s*\(?\s*((?:[<>=!~][^;()@]*)?)\)?\s*(?:;.*)?$"
GRADLE = r"""["']([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+:[A-Za-z0-9_.+-]+)["']"""
MAP, LIST = "map<string,variant>", "array<variant>"
#: How deep requirements files may include one another.
MAX_INCLUDES = 30


def _as_json(parse):
    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            try:
                return None if text is None else json.dumps(parse(text), default=str)
            except ValueError:
                return None

        for batch in texts:
            yield batch.map(one)

    return run


def _toml(text: str):
    import tomllib

    return tomllib.loads(text)


def _yaml(text: str):
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError from e


def _object(v: Column, path: str = "$") -> Column:
    """The object at a path as a map, or null."""
    return let(F.try_variant_get(v, path, "variant"), lambda there: F.when(F.startswith(F.schema_of_variant(there), F.lit("OBJECT")), there.cast(MAP)))


def _string(v: Column, path: str = "$") -> Column:
    there = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(there) == "STRING", F.try_variant_get(v, path, "string"))


def _named(files: DataFrame, *names: str) -> DataFrame:
    return files.where(F.regexp_extract("path", "[^/]*$", 0).isin(*names))


def folder(path: Column) -> Column:
    """The folder of a path, '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _named_values(value: Column, told) -> Column:
    """A map of variants as a map of strings, made before it is exploded: each variant of a document holds the names of all its keys, so a row for each would
    take the square of the document's length."""
    return F.transform_values(value, lambda _, v: told(v))


def npm_declared(files: DataFrame) -> DataFrame:
    """repo, folder, ecosystem, name, declared, declared_in of package.json files (operator 17): of a name the first section counts. Files that are no JSON object declare nothing."""
    docs = _named(files, "package.json").where(~F.col("path").rlike("(^|/)node_modules/")).select("repo", "path", F.try_parse_json("text").alias("v"))
    told = lambda v: F.coalesce(_string(v), v.cast("string"))
    sections = F.array(*(_named_values(_object(F.col("v"), f"$.{s}"), told) for s in NPM_SECTIONS))
    all_ = docs.select("repo", "path", F.posexplode_outer(sections).alias("ord", "m")).select("repo", "path", "ord", F.explode_outer("m").alias("name", "value")).where("name IS NOT NULL")
    return all_.groupBy("repo", "path", "name").agg(F.min_by("value", "ord").alias("declared")).select("repo", folder(F.col("path")).alias("folder"), F.lit("npm").alias("ecosystem"), "name", "declared", F.array("path").alias("declared_in"))


def npm_locked(files: DataFrame) -> DataFrame:
    """repo, folder, ecosystem, name, version of package-lock.json (both forms) and pnpm-lock.yaml; nested copies do not count, and of two locks in a folder npm's own does."""
    v = F.col("v")
    npm = _named(files, "package-lock.json").select("repo", "path", F.try_parse_json("text").alias("v"))
    packages, old = _object(v, "$.packages"), _object(v, "$.dependencies")
    # what is exploded is made once a document and a step before: a plain explode has it made again for filters, and what stands beside it for each entry
    told = let(packages, lambda p: F.struct(p.isNotNull().alias("new"), _named_values(F.coalesce(p, old), lambda x: _string(x, "$.version")).alias("m")))
    maps = npm.select("repo", "path", told.alias("s")).select("repo", "path", F.col("s.new").alias("new"), F.col("s.m").alias("m"))
    entries = maps.select("repo", "path", "new", F.explode_outer("m").alias("key", "version")).where("key IS NOT NULL")
    top = ~F.col("new") | (F.startswith("key", F.lit("node_modules/")) & ~F.substring("key", 14, 1 << 20).contains("/node_modules/"))
    own = entries.where(top).select("repo", folder(F.col("path")).alias("folder"), F.lit(0).alias("ord"), F.when(F.col("new"), F.substring("key", 14, 1 << 20)).otherwise(F.col("key")).alias("name"), "version")
    pnpm = _named(files, "pnpm-lock.yaml").select("repo", "path", F.try_parse_json(_as_json(_yaml)("text")).alias("v"))
    at = F.coalesce(F.try_variant_get(v, "$.importers['.']", "variant"), v)
    rooted = pnpm.select("repo", "path", at.alias("v"))
    for s in NPM_SECTIONS[:3]:
        told = _named_values(_object(v, f"$.{s}"), lambda x: F.substring_index(F.coalesce(_string(x), _string(x, "$.version")), "(", 1))
        more = rooted.select("repo", "path", F.explode(told).alias("name", "version")).select("repo", folder(F.col("path")).alias("folder"), F.lit(1).alias("ord"), "name", "version")
        own = own.union(more)
    return own.where(F.col("version").isNotNull()).groupBy("repo", "folder", "name").agg(F.min_by("version", "ord").alias("version")).select("repo", "folder", F.lit("npm").alias("ecosystem"), "name", "version")


def _requirement_lines(files: DataFrame) -> DataFrame:
    """repo, path, line of the requirements files at a repository's top or in its folder requirements, and of those that they include."""
    is_root = F.col("path").rlike(r"^requirements[^/]*\.txt$|^requirements/.*\.txt$")
    texts = files.where(F.endswith("path", F.lit(".txt")))
    lines = staged(texts.select("repo", "path", is_root.alias("root"), F.explode(F.split("text", r"\r\n|[\n\r]")).alias("x")).select("repo", "path", "root", F.trim(F.substring_index("x", " #", 1)).alias("line")).where("line <> '' AND NOT startswith(line, '#')"))
    child = F.regexp_extract("line", r"^(?:-r|--requirement)\s+(.+)$", 1)
    joined = F.when(folder(F.col("path")) == "", F.col("child")).otherwise(F.concat_ws("/", folder(F.col("path")), F.col("child")))
    # a/../b and ./b are b; what climbs out of the repository is no file
    parts = F.filter(F.split(joined, "/"), lambda p: ~p.isin("", "."))
    clean = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    edges = staged(lines.withColumn("child", child).where("child <> ''").select("repo", "path", F.array_join(clean, "/").alias("child")).distinct())
    reached = staged(lines.where("root").select("repo", "path").distinct())
    last = reached
    for _ in range(MAX_INCLUDES):
        last = staged(last.join(edges, ["repo", "path"]).select("repo", F.col("child").alias("path")).distinct().join(reached, ["repo", "path"], "left_anti"))
        if last.isEmpty():
            return lines.join(reached, ["repo", "path"], "left_semi").where("NOT startswith(line, '-') AND NOT contains(line, '://')").select("repo", "path", "line")
        reached = staged(reached.union(last))
    raise RuntimeError("requirements include one another too deeply")


def _poetry(version: Column) -> Column:
    """Poetry's ^ and ~ as plain comparators."""
    v = F.trim(version)
    rest = F.substring(v, F.lit(2), F.length(v))
    major = F.coalesce(F.substring_index(rest, ".", 1).try_cast("long"), F.lit(0))
    caret = F.when(major > 0, F.concat(F.lit(">="), rest, F.lit(",<"), major + 1)).otherwise(F.concat(F.lit(">="), rest))
    tilde = F.concat(F.when(rest.contains("."), "~=").otherwise(">="), rest)
    return F.when(v.isin("", "*"), "").when(v.startswith("^"), caret).when(v.startswith("~"), tilde).when(v.rlike("^[<>=!]"), v).otherwise(F.concat(F.lit("=="), v))


def pypi_declared(files: DataFrame) -> DataFrame:
    """repo, folder, ecosystem, name, declared, declared_in of pyproject.toml and requirements files (operator 16), by normal names: the first that is not empty of a
    name's ranges counts, pyproject.toml before requirements files by path. Lines that are options, links or no requirement declare nothing."""
    docs = files.where("path = 'pyproject.toml'").select("repo", "path", F.try_parse_json(_as_json(_toml)("text")).alias("v"))
    v = F.col("v")
    texts = lambda x: F.filter(F.transform(x, lambda i: _string(i)), lambda t: t.isNotNull())
    listed = lambda x: F.when(F.startswith(F.schema_of_variant(x), F.lit("ARRAY")), x.cast(LIST))
    groups = [F.array(listed(F.try_variant_get(v, "$.project.dependencies", "variant")))] + [F.transform(F.map_values(_object(v, f"${p}")), listed) for p in (".project['optional-dependencies']", "['dependency-groups']")]
    plain = F.flatten(F.transform(F.flatten(F.array_compact(F.array(*groups))), lambda g: F.coalesce(texts(g), F.array().cast("array<string>"))))
    poetry = [_object(v, f"$.tool.poetry{p}") for p in (".dependencies", "['dev-dependencies']")]
    nested = F.transform(F.map_values(_object(v, "$.tool.poetry.group")), lambda g: _object(g, "$.dependencies"))
    tables = F.filter(F.concat(F.array(*poetry), F.coalesce(nested, F.array().cast(f"array<{MAP}>"))), lambda m: m.isNotNull())
    asked = F.transform(F.flatten(F.transform(tables, lambda m: F.map_entries(m))), lambda e: F.when(F.lower(e["key"]) != "python", F.concat(e["key"], _poetry(F.coalesce(_string(e["value"]), _string(e["value"], "$.version"), F.lit(""))))))
    own = docs.select("repo", "path", F.posexplode(F.array_compact(F.concat(plain, asked))).alias("at", "line"))
    more = _requirement_lines(files).select("repo", "path", F.lit(0).alias("at"), "line")
    rows = own.union(more).where(F.col("line").rlike(REQUIREMENT))
    told = rows.select("repo", "path", "at", package_name(F.regexp_extract("line", REQUIREMENT, 1)).alias("name"), F.regexp_replace(F.regexp_extract("line", REQUIREMENT, 2), r"\s+", "").alias("spec"))
    order = F.struct((F.col("spec") == ""), (F.col("path") != "pyproject.toml"), "path", "at", "spec")
    return told.groupBy("repo", "name").agg(F.min_by("spec", order).alias("declared"), F.array_sort(F.collect_set("path")).alias("declared_in")).select("repo", F.lit("").alias("folder"), F.lit("pypi").alias("ecosystem"), "name", "declared", "declared_in")


def pypi_locked(files: DataFrame) -> DataFrame:
    """repo, folder, ecosystem, name, version of uv.lock, poetry.lock, pdm.lock and Pipfile.lock, the first of a folder's that names a package."""
    v, order = F.col("v"), {n: i for i, n in enumerate(("uv.lock", "poetry.lock", "pdm.lock"))}
    ranked = F.coalesce(*(F.when(F.endswith("path", F.lit(n)), F.lit(i)) for n, i in order.items()))
    listed = _named(files, *order).select("repo", "path", ranked.alias("ord"), F.explode(F.try_variant_get(F.try_parse_json(_as_json(_toml)("text")), "$.package", LIST)).alias("v"))
    own = listed.select("repo", "path", "ord", _string(v, "$.name").alias("name"), _string(v, "$.version").alias("version"))
    for i, section in enumerate(("default", "develop")):
        pip = _named(files, "Pipfile.lock").select("repo", "path", F.explode(_object(F.try_parse_json("text"), f"$.{section}")).alias("name", "v"))
        own = own.union(pip.select("repo", "path", F.lit(len(order) + i).alias("ord"), "name", F.nullif(F.regexp_extract(_string(v, "$.version"), "^==(.*)$", 1), F.lit("")).alias("version")))
    named = own.dropna(subset=["name", "version"]).withColumns({"name": package_name(F.col("name")), "folder": folder(F.col("path"))})
    return named.groupBy("repo", "folder", "name").agg(F.min_by("version", F.struct("ord", "version")).alias("version")).select("repo", "folder", F.lit("pypi").alias("ecosystem"), "name", "version")


def maven_declared(files: DataFrame) -> DataFrame:
    """repo, folder, ecosystem, name (group/artifact), declared, declared_in of pom.xml, Gradle scripts and version catalogs (operator 18); of a name in a
    folder the first file counts. A version that is a property of its own file is put in, one that is not known is null."""
    inner = lambda s, tag: F.nullif(F.trim(F.regexp_extract(s, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)<!--.*?-->", ""), r"(?s)<exclusions>.*?</exclusions>", "")
    poms = _named(files, "pom.xml").withColumn("xml", bare)
    props = F.regexp_extract("xml", r"(?s)<properties>(.*?)</properties>", 1)
    every = lambda g: F.regexp_extract_all(props, F.lit(r"<([\w.-]+)>([^<]*)</\1>"), F.lit(g))
    deps = poms.select("repo", "path", F.arrays_zip(every(1).alias("k"), every(2).alias("v")).alias("props"), F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("at", "d"))
    version = inner(F.col("d"), "version")
    key = F.nullif(F.regexp_extract(version, r"^\$\{(.*)\}$", 1), F.lit(""))
    put = F.when(key.isNull(), version).otherwise(F.trim(F.get(F.filter("props", lambda p: p["k"] == key), 0)["v"]))
    pom = deps.select("repo", "path", F.lit(0).alias("ord"), "at", F.concat_ws("/", inner(F.col("d"), "groupId"), inner(F.col("d"), "artifactId")).alias("name"), put.alias("version")).where(F.col("name").contains("/"))
    scripts = _named(files, "build.gradle", "build.gradle.kts").select("repo", "path", F.when(F.endswith("path", F.lit("kts")), 2).otherwise(1).alias("ord"), F.posexplode(F.regexp_extract_all("text", F.lit(GRADLE), F.lit(1))).alias("at", "d"))
    gradle = scripts.select("repo", "path", "ord", "at", F.concat_ws("/", F.split_part("d", F.lit(":"), F.lit(1)), F.split_part("d", F.lit(":"), F.lit(2))).alias("name"), F.split_part("d", F.lit(":"), F.lit(3)).alias("version"))
    tables = files.where(F.col("path").rlike(r"(^|/)gradle/libs\.versions\.toml$")).select("repo", "path", F.try_parse_json(_as_json(_toml)("text")).alias("c"))
    libs = tables.select("repo", "path", "c", F.posexplode(_object(F.col("c"), "$.libraries")).alias("at", "k", "v"))
    v = F.col("v")
    ref = _string(v, "$.version.ref")
    known = F.coalesce(_string(v, "$.version"), F.when(ref.isNotNull(), _string(F.element_at(_object(F.col("c"), "$.versions"), ref))).otherwise(F.coalesce(_string(v, "$.version.strictly"), _string(v, "$.version.require"))))
    catalog = libs.select("repo", "path", F.lit(3).alias("ord"), "at", F.replace(_string(v, "$.module"), F.lit(":"), F.lit("/")).alias("name"), known.alias("version")).where(F.col("name").contains("/"))
    # a catalog stands in the folder gradle of the project it is for
    home = F.when(F.col("ord") == 3, F.regexp_replace(folder(F.col("path")), "/?gradle$", "")).otherwise(folder(F.col("path")))
    all_ = pom.union(gradle).union(catalog).withColumn("folder", home)
    best = F.min_by(F.struct("version", "path"), F.struct("ord", "at")).alias("s")
    return all_.groupBy("repo", "folder", "name").agg(best).select("repo", "folder", F.lit("maven").alias("ecosystem"), "name", F.coalesce("s.version", F.lit("")).alias("declared"), F.array("s.path").alias("declared_in"))


def maven_locked(files: DataFrame) -> DataFrame:
    """repo, folder, ecosystem, name, version of gradle.lockfile; a name's last line counts."""
    lines = _named(files, "gradle.lockfile").select("repo", "path", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("at", "x")).withColumn("c", F.trim(F.substring_index("x", "=", 1)))
    good = lines.where(F.col("c").rlike("^[^#:][^:]*:[^:]*:[^:]*$"))
    part = lambda i: F.split_part("c", F.lit(":"), F.lit(i))
    return good.groupBy("repo", folder(F.col("path")).alias("folder"), F.concat_ws("/", part(1), part(2)).alias("name")).agg(F.max_by(part(3), "at").alias("version")).select("repo", "folder", F.lit("maven").alias("ecosystem"), "name", "version")


def nearest(rows: DataFrame, held: DataFrame, on: list[str], value: str) -> DataFrame:
    """Distinct rows with value of the held row, equal in on, whose folder is the nearest at or above theirs, or null.

    A row meets one folder for each of its levels at which its group (on without its last) holds anything. Rows and what is held are dealt out by on together and
    once: what a folder holds is carried to the rows that ask there, and the deepest that a row found counts.
    """
    group, parts = on[:-1], F.filter(F.split("folder", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    at = staged(held.where(F.col("folder").isNotNull()).dropna(subset=on).select(*on, F.col("folder").alias("_above"), F.struct(F.col(value).alias("v")).alias("_value")))
    homes = sized(staged(at.select(*group, "_above", F.lit(True).alias("_home")).distinct()))
    asked = rows.withColumn("_above", F.explode_outer(above)).join(homes, [*group, "_above"], "left").where("_home OR coalesce(_above, '') = ''").drop("_home")
    both = asked.withColumn("_kind", F.lit(1)).unionByName(at.withColumn("_kind", F.lit(0)), allowMissingColumns=True).repartition(*on)
    here = F.first("_value", True).over(Window.partitionBy(*on, "_above").orderBy("_kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_value", here).where("_kind = 1")
    best = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.length("_above")))
    return found.groupBy(*rows.columns).agg(best.alias("_value")).select(*rows.columns, F.col("_value.v").alias(value))


def discovered(declared: DataFrame, locked: DataFrame, installed: DataFrame) -> DataFrame:
    """id, repo, folder, ecosystem, name, declared, version, basis, status, reason of each declared package.

    A lock counts from the nearest folder at or above the manifest's; installed(repo, ecosystem, name, version, editable) is what is there. The basis is the lock, else
    the one version that is declared, else the range; a version that does not meet it is not available. Maven packages need no installed
    copy to have a version: theirs is the locked or the declared one, and installed then names those whose sources are there. Declared packages are dealt out once, by repository
    and name, and then staged.
    """
    have = installed.where("ecosystem <> 'maven'").select("repo", "ecosystem", "name", F.col("version").alias("_have"), "editable", F.lit(None).cast("array<string>").alias("_sources"))
    sources = installed.where("ecosystem = 'maven'").groupBy("repo", "ecosystem", "name").agg(F.collect_set("version").alias("_sources"))
    have = have.unionByName(sources, allowMissingColumns=True)
    known = nearest(declared, locked.withColumnRenamed("version", "_lock"), ["repo", "ecosystem", "name"], "_lock")
    maven, spec, own = F.col("ecosystem") == "maven", F.col("declared"), F.col("_have")
    one = F.when(F.col("ecosystem") == "pypi", F.nullif(F.regexp_extract(spec, r"^==([^,*]+)$", 1), F.lit(""))).when(F.col("ecosystem") == "npm", F.when(spec.rlike(r"^v?\d+\.\d+\.\d+"), F.trim(spec))).otherwise(F.when((spec != "") & ~spec.rlike(r"[\[\](),+$]"), spec))
    pinned = F.when(F.col("ecosystem") == "npm", F.when(one == own, one)).otherwise(one)
    wanted = F.coalesce(F.col("_lock"), pinned)
    version = F.when(maven, wanted).otherwise(own)
    there = staged(known.join(have, ["repo", "ecosystem", "name"], "left").withColumns({"_wanted": wanted, "_pinned": pinned}))
    # a range is looked at only where it decides, and once for each version that it meets anywhere
    npm = F.col("ecosystem") == "npm"
    range_ = F.when(~maven & own.isNotNull() & F.col("_lock").isNull() & (npm | F.col("_pinned").isNull()), F.when(npm, spec).otherwise(comparators(spec)))
    asked = there.withColumns({"_v": own, "_range": range_})
    met = sized(staged(asked.select("_v", "_range").dropna().distinct().withColumn("_in", satisfies(F.col("_v"), F.col("_range")))))
    all_ = asked.join(met, ["_v", "_range"], "left")
    in_range = F.col("_in")
    reason = (
        F.when(maven & F.col("_wanted").isNull(), F.when(spec == "", "no version declared").otherwise("declared version is a range"))
        .when(maven, F.when(~F.coalesce(F.array_contains("_sources", F.col("_wanted")), F.lit(False)), "no sources in the local caches"))
        .when(own.isNull(), "no installed copy")
        .when(F.coalesce(F.col("editable"), F.lit(False)), "editable install")
        .when(F.col("_lock").isNotNull(), F.when(F.col("_lock") != own, F.concat(F.lit("installed "), own, F.lit(", the lock says "), F.col("_lock"))))
        .when((F.col("ecosystem") == "pypi") & F.col("_pinned").isNotNull(), F.when(F.col("_pinned") != own, F.concat(F.lit("installed "), own, F.lit(", pinned at "), F.col("_pinned"))))
        .when(in_range.isNull(), "declared range could not be checked")
        .when(~in_range, F.concat(F.lit("installed "), own, F.lit(" is not in the declared range")))
    )
    basis = F.when(~maven & (own.isNull() | F.coalesce(F.col("editable"), F.lit(False))), None).when(F.col("_lock").isNotNull(), "locked").when(F.col("_pinned").isNotNull(), "pinned").when(~maven, "declared_range")
    told = all_.withColumns({"version": version, "basis": basis, "reason": reason})
    return told.select(F.concat_ws(":", "ecosystem", "name").alias("id"), "repo", "folder", "ecosystem", "name", "declared", "version", "basis", F.when(F.col("reason").isNull(), "available").otherwise("unavailable").alias("status"), "reason")


def comparators(spec: Column) -> Column:
    """A range of Python's form in the comparators of npm's, as far as they say the same; what they cannot say, such as !=, stays and is not understood."""
    spaced = F.replace(F.replace(spec, F.lit(","), F.lit(" ")), F.lit("=="), F.lit("="))
    two = F.regexp_replace(spaced, r"~=\s*(\d+)\.(\d+)(?![.\d])", "^$1.$2")
    return F.when(F.trim(spec) == "", "*").otherwise(F.regexp_replace(two, r"~=\s*(\d+\.\d+\.\d+)", "~$1"))
