"""Packages declared, locked and installed, from manifests of three ecosystems."""

import json
import time

from churnlens.operators import packages

PACKAGE = json.dumps({"dependencies": {"a": "^1.2.0", "b": "1.0.0"}, "devDependencies": {"a": "9", "@x/c": "~2.0"}, "peerDependencies": {"d": ">=1 <2", "e": "git:x", "f": 5}})
LOCK = json.dumps({"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1.3.0"}, "node_modules/a/node_modules/b": {"version": "7"}, "node_modules/@x/c": {"version": "2.0.1"}, "node_modules/z": {}}})
PNPM = "importers:\n  .:\n    dependencies:\n      a: {specifier: ^1, version: 1.4.0(x@1)}\n    devDependencies:\n      b: 2.0.0\n"
PYPROJECT = """
[project]
dependencies = ["Foo_Bar >= 1.0, <2 ; python_version > '3'", "baz[x]", "not a requirement"]
optional-dependencies = {dev = ["qux==3.1", "baz>=2"]}
[dependency-groups]
test = ["tool~=1.4", {include-group = "x"}]
[tool.poetry.dependencies]
python = "^3.9"
Poe = "^1.2"
til = {version = "~2.3", extras = ["x"]}
any = "*"
old = "^0.4"
"""
POM = """<project><properties><v.x> 1.5 </v.x></properties><!-- <dependency><groupId>no</groupId></dependency> -->
<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v.x}</version><exclusions><exclusion><groupId>h</groupId><artifactId>b</artifactId></exclusion></exclusions></dependency>
<dependency><groupId>g</groupId><artifactId>b</artifactId><version>${gone}</version></dependency><dependency><groupId>g</groupId><artifactId>r</artifactId><version>[1,2)</version></dependency></dependencies></project>"""
FILES = [
    ("r", "package.json", PACKAGE), ("r", "package-lock.json", LOCK), ("r", "sub/package.json", '{"dependencies": {"a": "*", "b": "2"}}'), ("r", "sub/deep/package.json", '{"dependencies": {"a": "1.x"}}'), ("r", "sub/deep/pnpm-lock.yaml", PNPM), ("r", "node_modules/a/package.json", '{"dependencies": {"no": "1"}}'), ("s", "package.json", "{broken"), ("s", "x/package.json", "[]"),
    ("r", "pyproject.toml", PYPROJECT), ("r", "requirements-dev.txt", "# all\nfoo.bar==1.5 # why\n-r more/base.txt\n--requirement ../../out.txt\n-e .\nhttps://x/y.whl\nzed ; python_version > '3'\r\nbaz>=1"), ("r", "more/base.txt", "-r ../requirements/other.txt\nlast (>=1)"), ("r", "requirements/other.txt", "-r ../more/base.txt\nloop!=2"), ("r", "docs/notes.txt", "unread"),
    ("r", "uv.lock", '[[package]]\nname = "Foo.Bar"\nversion = "1.5"\n[[package]]\nname = "x"\n'), ("r", "Pipfile.lock", json.dumps({"default": {"foo-bar": {"version": "==9"}, "zed": {"version": "==1.0"}}, "develop": {"w": {"version": ">1"}}})), ("s", "pyproject.toml", "= broken"), ("s", "uv.lock", None),
    ("r", "pom.xml", POM), ("r", "app/build.gradle", "implementation 'g:k:1.0'\napi(\"g:l:2.+\")\nx 'g:k:3'"), ("r", "gradle/libs.versions.toml", '[versions]\nk = "4"\n[libraries]\na = {module = "g:a", version = "9"}\nm = {module = "g:m", version.ref = "k"}\nn = {module = "g:n", version = {strictly = "5"}}\no = {module = "g:o"}\np = "g:p:1"\n'), ("r", "gradle.lockfile", "# head\ng:l:2.7=compile\nempty=\ng:l:2.8=run\n"),
]


def rows(df, *names):
    return {tuple(r[n] for n in names[:-1]): r[names[-1]] for r in df.collect()}


def test_manifests(spark):
    files = spark.createDataFrame(FILES, "repo string, path string, text string")
    npm = rows(packages.npm_declared(files), "repo", "folder", "name", "declared")
    assert npm == {("r", "", "a"): "^1.2.0", ("r", "", "b"): "1.0.0", ("r", "", "@x/c"): "~2.0", ("r", "", "d"): ">=1 <2", ("r", "", "e"): "git:x", ("r", "", "f"): "5", ("r", "sub", "a"): "*", ("r", "sub", "b"): "2", ("r", "sub/deep", "a"): "1.x"}
    assert rows(packages.npm_locked(files), "folder", "name", "version") == {("", "a"): "1.3.0", ("", "@x/c"): "2.0.1", ("sub/deep", "a"): "1.4.0", ("sub/deep", "b"): "2.0.0"}
    old = spark.createDataFrame([("o", "package-lock.json", '{"dependencies": {"q": {"version": "1"}, "p": {}}}')], files.schema)
    assert rows(packages.npm_locked(old), "name", "version") == {("q",): "1"}
    declared = {r["name"]: (r["declared"], r["declared_in"]) for r in packages.pypi_declared(files).collect()}
    top, dev = "pyproject.toml", "requirements-dev.txt"
    assert declared == {
        "foo-bar": (">=1.0,<2", [top, dev]), "baz": (">=2", [top, dev]), "qux": ("==3.1", [top]), "tool": ("~=1.4", [top]), "poe": (">=1.2,<2", [top]), "til": ("~=2.3", [top]), "any": ("", [top]), "old": (">=0.4", [top]), "zed": ("", [dev]), "last": (">=1", ["more/base.txt"]), "loop": ("!=2", ["requirements/other.txt"]),
    }
    assert rows(packages.pypi_locked(files), "name", "version") == {("foo-bar",): "1.5", ("zed",): "1.0"}
    assert {(r["folder"], r["name"]): (r["declared"], r["declared_in"][0]) for r in packages.maven_declared(files).collect()} == {
        ("", "g/a"): ("1.5", "pom.xml"), ("", "g/b"): ("", "pom.xml"), ("", "g/r"): ("[1,2)", "pom.xml"), ("app", "g/k"): ("1.0", "app/build.gradle"), ("app", "g/l"): ("2.+", "app/build.gradle"), ("", "g/m"): ("4", "gradle/libs.versions.toml"), ("", "g/n"): ("5", "gradle/libs.versions.toml"), ("", "g/o"): ("", "gradle/libs.versions.toml"),
    }
    assert rows(packages.maven_locked(files), "name", "version") == {("g/l",): "2.8"}
    for f in (packages.npm_declared, packages.npm_locked, packages.pypi_declared, packages.pypi_locked, packages.maven_declared, packages.maven_locked):
        assert f(files.limit(0)).collect() == []


def test_status_of_packages(spark):
    declared = spark.createDataFrame(
        [(e, f, n, d) for e, f, n, d in [
            ("npm", "", "a", "^1.0.0"), ("npm", "sub/deep", "a", "^1.0.0"), ("npm", "", "b", "1.0.0"), ("npm", "", "c", "^2.0.0"), ("npm", "", "d", "git:x"), ("npm", "", "gone", "*"),
            ("pypi", "", "p", "==1.0"), ("pypi", "", "q", ">=1.0.0,<2"), ("pypi", "", "r", "~=1.4.2"), ("pypi", "", "s", "!=2"), ("pypi", "", "ed", ""), ("pypi", "", "t", ""), ("maven", "app", "g/a", "1.0"), ("maven", "app", "g/b", "1.+"), ("maven", "app", "g/c", ""), ("maven", "app", "g/d", "1"), ("maven", "app", "g/e", "")]],
        "ecosystem string, folder string, name string, declared string").selectExpr("'r' AS repo", "*", "array('x') AS declared_in")
    locked = spark.createDataFrame([("r", "", "npm", "a", "1.1.0"), ("r", "sub", "npm", "a", "1.2.0"), ("r", "sub/other", "npm", "a", "9.0.0"), ("x", "", "npm", "b", "7.0.0"), ("r", "", "maven", "g/e", "3")], "repo string, folder string, ecosystem string, name string, version string")
    installed = spark.createDataFrame([("r", "npm", "a", "1.1.0", False), ("r", "npm", "b", "1.0.0", False), ("r", "npm", "c", "1.9.0", False), ("r", "npm", "d", "1.0.0", False), ("r", "pypi", "p", "1.1", False), ("r", "pypi", "q", "1.5.0", False), ("r", "pypi", "r", "1.5.0", None), ("r", "pypi", "s", "1.0.0", False), ("r", "pypi", "ed", "1.0.0", True), ("r", "pypi", "t", "3.0.0", False), ("r", "maven", "g/a", "1.0", None), ("r", "maven", "g/e", "3", None), ("r", "maven", "g/e", "4", None)], "repo string, ecosystem string, name string, version string, editable boolean")
    got = {(r["id"], r["folder"]): (r["version"], r["basis"], r["status"], r["reason"]) for r in packages.discovered(declared, locked, installed).collect()}
    assert got == {
        ("npm:a", ""): ("1.1.0", "locked", "available", None), ("npm:a", "sub/deep"): ("1.1.0", "locked", "unavailable", "installed 1.1.0, the lock says 1.2.0"), ("npm:b", ""): ("1.0.0", "pinned", "available", None), ("npm:c", ""): ("1.9.0", "declared_range", "unavailable", "installed 1.9.0 is not in the declared range"), ("npm:d", ""): ("1.0.0", "declared_range", "unavailable", "declared range could not be checked"), ("npm:gone", ""): (None, None, "unavailable", "no installed copy"),
        ("pypi:p", ""): ("1.1", "pinned", "unavailable", "installed 1.1, pinned at 1.0"), ("pypi:q", ""): ("1.5.0", "declared_range", "available", None), ("pypi:r", ""): ("1.5.0", "declared_range", "unavailable", "installed 1.5.0 is not in the declared range"), ("pypi:s", ""): ("1.0.0", "declared_range", "unavailable", "declared range could not be checked"), ("pypi:ed", ""): ("1.0.0", None, "unavailable", "editable install"), ("pypi:t", ""): ("3.0.0", "declared_range", "available", None),
        ("maven:g/a", "app"): ("1.0", "pinned", "available", None), ("maven:g/b", "app"): (None, None, "unavailable", "declared version is a range"), ("maven:g/c", "app"): (None, None, "unavailable", "no version declared"), ("maven:g/d", "app"): ("1", "pinned", "unavailable", "no sources in the local caches"), ("maven:g/e", "app"): ("3", "locked", "available", None),
    }


def test_a_long_lock_is_read_once_not_once_a_name(spark):
    """Before, each entry of a lock was told from the whole document again: 2,000 names took minutes."""
    names = [f"p{i}" for i in range(2000)]
    files = spark.createDataFrame([("r", "package-lock.json", json.dumps({"packages": {f"node_modules/{n}": {"version": "1.0.0"} for n in names}})), ("r", "a/package.json", json.dumps({"dependencies": dict.fromkeys(names, "^1.0.0")}))], "repo string, path string, text string")
    began = time.monotonic()
    assert packages.npm_locked(files).where("version = '1.0.0'").count() == packages.npm_declared(files).where("declared = '^1.0.0'").count() == 2000
    assert time.monotonic() - began < 30


def test_nearest_of_many_levels(spark):
    rows = spark.createDataFrame([("r", "a/b/c", "x"), ("r", "a", "x"), ("r", "", "x"), ("r", "b", "y"), ("r", None, "x"), ("s", "a/b", "x"), (None, "a", "x")], "repo string, folder string, name string")
    held = spark.createDataFrame([("r", "a/b", "x", "2"), ("r", "a", "x", "1"), ("r", "a/b/c/d", "x", "3"), ("r", "b/c", "y", "4"), ("r", None, "x", "5"), ("s", "a", "y", "6"), (None, "", "x", "7")], "repo string, folder string, name string, v string")
    got = {tuple(r) for r in packages.nearest(rows, held, ["repo", "name"], "v").select("repo", "folder", "name", "v").collect()}
    assert got == {("r", "a/b/c", "x", "2"), ("r", "a", "x", "1"), ("r", "", "x", None), ("r", "b", "y", None), ("r", None, "x", None), ("s", "a/b", "x", None), (None, "a", "x", None)}
