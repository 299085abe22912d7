"""Evidence: settled verdicts, references into dependencies, blame, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.functions.exprs import let, path_problem
from churnlens.operators.intervals import gathered, meet
from churnlens.sources.staging import BROADCAST_ROWS, staged

# Fixed value: the form of a dependency reference, ecosystem:name@version:path:line or line range.
DEPENDENCY_REF = r"^(pypi|npm|maven):((?:@[^/@:\s]+/)?[^@:\s]+)@([^:@\s]+):([^:]+):([0-9]+)(?:-([0-9]+))?$"
# Fixed value: what git names a line that is not committed yet.
ZERO_SHA = "0" * 40


def settled(
    action: Column, same_scan: Column, failed: Column, contract_ok: Column, brief_ok: Column, verdict: Column, claims: Column,
    steered: Column, holds: Column, unconfirmed: Column, ledger_status: Column,
) -> Column:
    """status and rule of a finding's check (operator 124); the first rule that applies decides, a null fact counts as not so.

    action is reuse, skip or check; claims counts refuted claims whose evidence resolved; steered says that all of it lies in
    the text the finding reports as steering the audit; unconfirmed counts defaults that nobody confirmed, on which no
    upheld status may rest, a reused one neither.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    told = lambda status, rule: F.struct(status.alias("status") if isinstance(status, Column) else F.lit(status).alias("status"), F.lit(rule).alias("rule"))
    against = verdict.isin("refuted", "narrowed")
    first = (
        F.when(yes(action == "reuse"), told(ledger_status, "reused"))
        .when(yes(action == "skip"), told("unchecked", "skipped"))
        .when(~yes(same_scan), told("unchecked", "no result"))
        .when(yes(failed), told("unchecked", "failed"))
        .when(~yes(contract_ok), told("unchecked", "contract"))
        .when(~yes(brief_ok), told("unchecked", "stale"))
        .when(yes(against & (F.coalesce(claims, F.lit(0)) == 0)), told("inconclusive", "no evidence"))
        .when(yes(against & steered), told("inconclusive", "self-reference"))
        .when(yes(~steered | steered.isNull()) & yes(verdict == "narrowed") & (F.trim(F.coalesce(holds, F.lit(""))) == ""), told("inconclusive", "does not say what holds"))
        .otherwise(told(verdict, "verdict"))
    )
    return F.when((first["status"] == "upheld") & (F.coalesce(unconfirmed, F.lit(0)) > 0), told("inconclusive", "unconfirmed default")).otherwise(first)


def dependency_refs(refs: DataFrame, packages: DataFrame, files: DataFrame, ref: str = "ref") -> DataFrame:
    """refs with package, version, path, first, last and problem, null where the reference resolves (operator 131).

    packages has id, version and status, files id, path and n_lines of the snapshots. Equi-joins on id, and on id and path.
    """
    at = lambda i: F.regexp_extract(F.trim(ref), DEPENDENCY_REF, i)
    own = refs.withColumns({"package": F.when(F.trim(ref).rlike(DEPENDENCY_REF), F.concat_ws(":", at(1), at(2))), "version": at(3), "path": at(4), "first": at(5).try_cast("long")})
    own = own.withColumn("last", F.coalesce(at(6).try_cast("long"), F.col("first")))
    there = packages.where("status = 'available'").select(F.col("id").alias("package"), F.col("version").alias("read_at"))
    known = files.select(F.col("id").alias("package"), "path", "n_lines")
    both = own.join(there, "package", "left").join(known, ["package", "path"], "left")
    problem = (
        F.when(F.col("package").isNull(), "is not a dependency reference")
        .when(F.col("read_at").isNull(), "is not an available dependency")
        .when(F.col("read_at") != F.col("version"), "was read at another version")
        .when(path_problem(F.col("path")).isNotNull(), path_problem(F.col("path")))
        .when(F.col("n_lines").isNull(), "no such file")
        .when(~((F.col("first") >= 1) & (F.col("first") <= F.col("last")) & (F.col("last") <= F.col("n_lines"))), "lines are outside the file")
    )
    return both.withColumn("problem", problem).select(*refs.columns, "package", "version", "path", "first", "last", "problem")


# Fixed value: how a line of blame output begins, a commit and the line's numbers then and now.
BLAME_HEAD = r"(?m)^(?=[0-9a-f]{40} [0-9]+ [0-9]+)"


def blamed(outputs: DataFrame, text: str = "text") -> DataFrame:
    """path, line, sha, author, summary, code of each line of blame output in its porcelain form (operator 4).

    outputs has path and text. A commit's author and summary stand at its first line only, and are carried to its others. Each entry is
    cut from the text where its head begins, so lines are not shuffled but for those of one commit in one path.
    """
    entry = F.col("entry")
    field = lambda name: F.nullif(F.regexp_extract(entry, rf"(?m)^{name} (.*)$", 1), F.lit(""))
    entries = outputs.select("path", F.explode(F.split(text, BLAME_HEAD, -1)).alias("entry")).where(entry.rlike(r"^[0-9a-f]{40} "))
    rows = entries.select("path", F.substring_index(entry, " ", 1).alias("sha"), F.regexp_extract(entry, r"^\S+ [0-9]+ ([0-9]+)", 1).cast("long").alias("line"), field("author").alias("author"), field("summary").alias("summary"), F.regexp_extract(entry, r"(?m)^\t(.*)$", 1).alias("code"))
    told = rows.groupBy("path", "sha").agg(F.max("author").alias("author"), F.max("summary").alias("summary"))
    return rows.drop("author", "summary").join(told, ["path", "sha"]).select("path", "line", "sha", "author", "summary", "code")


def introduced(ranges: DataFrame, blame: DataFrame, keys: list[str]) -> DataFrame:
    """keys and shas, the commits that the lines of each range come from, in order (operator 4).

    ranges has keys, path, lo, hi and blame path, line, sha. Runs of lines of one commit are ranges too, and ranges meet by bins of their
    lengths, so no range is listed line by line; a range that ends before it begins has no lines, and lines that are not committed have no sha.
    Up to BROADCAST_ROWS commits are numbered in their order, and lists of numbers are dealt out in place of pairs with names; beyond, it is the pairs.
    """
    asked, lines = ranges.select(*keys, "path", "lo", "hi"), blame.where(F.col("sha") != ZERO_SHA).select("path", "line", "sha")
    shas = staged(lines.select("sha").distinct())
    n = shas.count()
    if n > BROADCAST_ROWS:
        found = meet(asked, _runs(lines, "sha"), ["path"], right_range=("_first", "_last")).select(*keys, "sha").distinct()
        return found.groupBy(*keys).agg(F.array_sort(F.collect_list("sha")).alias("shas"))
    names = staged(shas.agg(F.array_sort(F.collect_list("sha")).alias("names")))
    first, kind = (-(1 << 15), "smallint") if n <= 1 << 16 else (0, "int")
    numbers = names.select(F.posexplode("names").alias("at", "sha")).select("sha", (F.col("at") + first).cast(kind).alias("no"))
    runs = staged(_runs(lines.join(F.broadcast(numbers), "sha").select("path", "line", "no"), "no"))
    found = gathered(asked, runs, ["path"], keys, "no", right_range=("_first", "_last"))
    own = found.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("met")))).alias("_own"))
    return own.withColumn("_names", names.scalar()).select(*keys, let(F.col("_names"), lambda known: F.transform("_own", lambda no: F.get(known, no.cast("int") - first))).alias("shas"))


def _runs(lines: DataFrame, commit: str) -> DataFrame:
    """path, commit, _first, _last of each run of lines of one commit; lines are dealt out once."""
    step = Window.partitionBy("path", commit).orderBy("line")
    runs = lines.repartition("path", commit).distinct().withColumn("run", F.col("line") - F.row_number().over(step))
    return runs.groupBy("path", commit, "run").agg(F.min("line").alias("_first"), F.max("line").alias("_last")).drop("run")


# The lines of a diff that name its files and open its parts.
DIFF_FILE, DIFF_OLD, DIFF_NEW, HUNK = r"^diff --git ", r"^--- (?:a/)?(.*?)\t?$", r"^\+\+\+ (?:b/)?(.*?)\t?$", r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@(.*)$"


def hunks(diffs: DataFrame, keys: list[str], text: str = "diff") -> DataFrame:
    """keys, path, hunk, kind, old_line, new_line, line of every line that a unified diff adds, removes or shows about them (operator 5).

    kind is added, removed or context; old_line is null where a line is added and new_line where it is removed. hunk counts from 1 in a diff. A hunk's
    own counts say how far it reaches, so that lines like `--- x` in it are lines. Lines of one diff meet in one task, as their numbers follow from those before.
    """
    lines = diffs.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("at", "x"))
    head = lambda g: F.when(F.col("x").rlike(HUNK), F.coalesce(F.regexp_extract("x", HUNK, g).try_cast("long"), F.lit(1)))
    by = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # a header's look-alike inside a hunk is a removed or added line; those of a hunk itself cannot be: each of its lines has a mark before it
    marked = lines.withColumns({"hunk": F.count(head(1)).over(by), "old_at": F.last(head(1), True).over(by), "old_n": F.last(head(2), True).over(by), "new_at": F.last(head(3), True).over(by), "new_n": F.last(head(4), True).over(by), "opens": head(1).isNotNull()})
    own = Window.partitionBy(*keys, "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.substring("x", 1, 1)
    old, new = (~F.col("opens") & mark.isin(" ", "-")).cast("int"), (~F.col("opens") & mark.isin(" ", "+")).cast("int")
    counted = marked.withColumns({"old_seen": F.sum(old).over(own), "new_seen": F.sum(new).over(own)})
    inside = ~F.col("opens") & (F.col("hunk") > 0) & mark.isin(" ", "+", "-") & (F.col("old_seen") <= F.col("old_n")) & (F.col("new_seen") <= F.col("new_n")) & ((old == 0) | (F.col("old_seen") - old < F.col("old_n"))) & ((new == 0) | (F.col("new_seen") - new < F.col("new_n")))
    named = counted.withColumn("inside", inside)
    name = lambda p: F.nullif(F.when(~F.col("inside"), F.regexp_extract("x", p, 1)), F.lit(""))
    to, come = F.last(name(DIFF_NEW), True).over(by), F.last(name(DIFF_OLD), True).over(by)
    told = named.withColumn("path", F.when(to == "/dev/null", come).otherwise(to)).where("inside")
    kind = F.when(mark == "+", "added").when(mark == "-", "removed").otherwise("context")
    return told.select(*keys, "path", "hunk", kind.alias("kind"), F.when(mark != "+", F.col("old_at") + F.col("old_seen") - 1).alias("old_line"), F.when(mark != "-", F.col("new_at") + F.col("new_seen") - 1).alias("new_line"), F.substring("x", 2, 1 << 30).alias("line"))


CONTEXT_LINES = 3


def excerpts(spans: DataFrame, budget: int, around: int = CONTEXT_LINES) -> DataFrame:
    """path, lo, hi: what is shown of each file (operator 101). spans has path, rank, lo, hi, n_lines: the functions of one file, best first.

    Spans are shown in turn, whole and with lines about them, until one does not fit, which is cut. What fits depends on all spans before it, so a
    file's spans are one array and one aggregate, whose state is the lines shown, budget at most.
    """
    lines = lambda s: F.when(F.greatest(F.lit(1), s["lo"] - around) <= F.least(s["n"], s["hi"] + around), F.sequence(F.greatest(F.lit(1), s["lo"] - around), F.least(s["n"], s["hi"] + around))).otherwise(F.array().cast("array<bigint>"))

    def show(a: Column, s: Column) -> Column:
        def put(own: Column) -> Column:
            new, room = F.array_except(own, a["shown"]), F.greatest(F.lit(0), budget - F.size(a["shown"]))
            part = F.when(room > around + 2, F.array_union(a["shown"], F.slice(own, F.lit(1), room))).otherwise(a["shown"])
            over = F.size(new) > room
            return F.struct(F.when(over, part).otherwise(F.concat(a["shown"], new)).alias("shown"), over.alias("full"))

        return F.when(a["full"], a).otherwise(let(lines(s), put))

    def runs(xs: Column) -> Column:
        edge = lambda step: F.filter(F.transform(xs, lambda x, i: F.when(~F.coalesce(F.try_element_at(xs, F.when(i + step >= 0, i + step + 1)) == x + step, F.lit(False)), x)), lambda x: x.isNotNull())
        return F.arrays_zip(edge(-1).alias("lo"), edge(1).alias("hi"))

    start = F.struct(F.array().cast("array<bigint>").alias("shown"), F.lit(False).alias("full"))
    every = F.array_sort(F.collect_list(F.struct("rank", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))))
    files = spans.groupBy("path").agg(every.alias("spans"), F.max("n_lines").cast("long").alias("n"))
    shown = F.aggregate(F.transform("spans", lambda s: F.struct(s["lo"], s["hi"], F.col("n").alias("n"))), start, show, lambda a: F.array_sort(a["shown"]))
    return files.select("path", F.explode(let(shown, runs)).alias("r")).select("path", "r.lo", "r.hi")


# The forms of evidence, what a commit may have done, and the forms of references.
EVIDENCE_TYPES, ROLES = ["catalog", "code", "commit", "detector"], ["introduced", "fixed", "mitigated", "changed"]
CODE_REF, HIT_REF, SHA_REF = r"^([^:]+):([0-9]+)(?:-([0-9]+))?\z", r"^[A-Z]+[0-9]+@[^:]+:[0-9]+\z", r"^[0-9a-fA-F]{4,40}\z"
#: Hexadecimal digits by which short names of commits are joined; no shorter name is a reference.
SHORT = 4


def resolved(cited: DataFrame, located: DataFrame, files: DataFrame, hits: DataFrame, edges: DataFrame, commits: DataFrame, touches: DataFrame, blame: DataFrame) -> DataFrame:
    """finding, i, problem of each piece of evidence, null where it resolves (operator 134).

    cited(finding, i, type, ref, role), located(finding, path): where the findings are; files(path, n_lines), hits(ref), edges(ref), commits(sha),
    touches(sha, path), blame(path, line, sha) are what there is. A commit must touch a file that its finding cites or is in; one that is said to have
    introduced the code must have written one of the cited lines. Short names are joined by their first digits and then compared, all else by equal
    keys; lines and ranges meet by bins.
    """
    at = lambda g: F.nullif(F.regexp_extract("_ref", CODE_REF, g), F.lit(""))
    own = cited.withColumn("_ref", F.trim("ref")).withColumns({"_path": at(1), "_lo": at(2).try_cast("long")})
    own = own.withColumns({"_hi": F.coalesce(at(3).try_cast("long"), "_lo"), "_short": F.lower(F.substring_index("_ref", " ", 1))})
    own = own.join(files.select(F.col("path").alias("_path"), "n_lines"), "_path", "left")
    for name, known in (("_hit", hits), ("_edge", edges)):
        own = own.join(known.select(F.col("ref").alias("_known")).distinct().withColumn(name, F.lit(True)), F.col("_ref") == F.col("_known"), "left").drop("_known")

    own = staged(own)  # what follows reads it five times
    is_commit = (F.col("type") == "commit") & F.col("_short").rlike(SHA_REF)
    asked = own.where(is_commit).select("finding", "i", "role", "_short").withColumn("_key", F.left("_short", F.lit(SHORT)))
    full = staged(asked.join(commits.select("sha", F.left(F.lower("sha"), F.lit(SHORT)).alias("_key")), "_key").where(F.startswith(F.lower("sha"), F.col("_short"))).select("finding", "i", "role", "sha"))
    fits = (F.col("_lo") >= 1) & (F.col("_lo") <= F.col("_hi")) & (F.col("_hi") <= F.col("n_lines"))
    code = own.where((F.col("type") == "code") & fits).select("finding", F.col("_path").alias("path"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    places = staged(code.select("finding", "path").union(located.join(files, "path", "left_semi").select("finding", "path")).distinct())
    # a finding's commits meet its files first, then the touches, so no commit's touches are listed for findings that do not cite it
    touching = full.join(places, "finding").join(touches.select("sha", "path").distinct(), ["sha", "path"]).select("finding", "i").distinct().withColumn("_touches", F.lit(True))
    wrote = introduced(code.distinct(), blame, ["finding"]).select("finding", F.explode("shas").alias("sha"))
    written = full.where("role = 'introduced'").join(wrote, ["finding", "sha"]).select("finding", "i").distinct().withColumn("_wrote", F.lit(True))
    flags = ("_there", "_touches", "_wrote")
    told = full.select("finding", "i").withColumn("_there", F.lit(True)).unionByName(touching, allowMissingColumns=True).unionByName(written, allowMissingColumns=True)
    own = own.join(told.groupBy("finding", "i").agg(*(F.max(c).alias(c) for c in flags)), ["finding", "i"], "left")
    # only commits ask whether their finding has a place
    cites = own.where(F.col("type") == "commit").join(places.select("finding").distinct().withColumn("_placed", F.lit(True)), "finding", "left")
    own = own.where("type IS NULL OR type <> 'commit'").withColumn("_placed", F.lit(False)).unionByName(cites)

    kind, not_ = F.col("type"), lambda c: ~F.coalesce(F.col(c), F.lit(False))
    role = F.coalesce(F.col("role"), F.lit(""))
    code_problem = F.when(F.col("_path").isNull(), "is not path:line or path:start-end").when(path_problem(F.col("_path")).isNotNull(), path_problem(F.col("_path"))).when(F.col("n_lines").isNull(), "no such file").when(~F.coalesce(fits, F.lit(False)), "lines are outside the file")
    commit_problem = (
        F.when(~F.col("_short").rlike(SHA_REF), "is not a commit")
        .when(not_("_there"), "no such commit")
        .when(~not_("_placed") & not_("_touches"), "does not touch a cited file")
        .when(~not_("_placed") & (role == "introduced") & not_("_wrote"), "wrote none of the cited lines")
    )
    problem = (
        F.when(~F.coalesce(kind.isin(*EVIDENCE_TYPES), F.lit(False)), "type is unknown")
        .when(F.coalesce(F.col("_ref"), F.lit("")) == "", "ref is missing")
        .when((kind == "commit") & ~role.isin(*ROLES), "role is unknown")
        .when((kind != "commit") & F.col("role").isNotNull(), "role is for commits only")
        .when(kind == "code", code_problem)
        .when(kind == "commit", commit_problem)
        .when(kind == "detector", F.when(~F.col("_ref").rlike(HIT_REF), "is not a hit's reference").when(not_("_hit"), "no such hit"))
        .otherwise(F.when(not_("_edge"), "no such edge"))
    )
    return own.select("finding", "i", problem.alias("problem"))
