"""Column builders shared by the operators; all native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels in rising order, the most that each check status allows, needs of a precondition, gates, bases that raise doubt.
LEVELS = ("low", "medium", "high")
CEILINGS = {"upheld": "high", "unchecked": "medium", "narrowed": "medium", "inconclusive": "medium", "refuted": "low"}
NEEDS = ("changed", "default")
GATES = ("none", "unconfirmed_default", "non_default_setting")
DOUBTFUL = ("call_site_fallback", "contradicted", "not_found", "unresolved")
#: The normal quantile of a two-sided interval of 95 percent.
Z95 = 1.959964


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the score interval for k of n in whole percent, halves to the even side; 0 and 100 where n is 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = k / m, z * z
    mid = (p + z2 / (2 * m)) / (1 + z2 / m)
    half = z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m)
    return F.coalesce(F.bround(100 * (mid - half)).cast("int"), F.lit(0)), F.coalesce(F.bround(100 * (mid + half)).cast("int"), F.lit(100))


def normalised(v: Column, low: Column, high: Column, floor: float = 0.05) -> Column:
    """Min-max scaling to floor..1 between the extremes; 1 where all values are equal."""
    return F.coalesce(floor + (1 - floor) * F.try_divide(v - low, (high - low).cast("double")), F.lit(1.0))


def let(value: Column, then) -> Column:
    """then(value), with value made once however often then uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def clip(text: Column, tokens: int, note: str = "trimmed", head: float = 0.7, tail: float = 0.25) -> Column:
    """text if it fits into tokens of four characters, else its head and tail, and between them a note of how much is left out."""
    room = max(0, tokens) * 4
    a, b = int(room * head), int(room * tail)
    cut = F.concat(F.left(text, F.lit(a)), F.lit(f"\n\n... [{note}: "), (F.length(text) - a - b).cast("string"), F.lit(" characters omitted] ...\n\n"), F.right(text, F.lit(b)))
    return F.when(F.length(text) <= room, text).otherwise(cut)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def effective_confidence(claimed: Column, status: Column) -> Column:
    """The claim held down to the status's ceiling; a narrowed claim loses a level first; an unknown claim is low, an unknown status unchecked."""
    rank = F.greatest(F.lit(1), F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), claimed), F.lit(0)).cast("int"))
    ceiling = F.lit(LEVELS.index(CEILINGS["unchecked"]) + 1)
    for s, c in CEILINGS.items():
        ceiling = F.when(status == s, LEVELS.index(c) + 1).otherwise(ceiling)
    own = F.when(status == "narrowed", rank - 1).otherwise(rank)
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(F.lit(1), F.least(own, ceiling)))


def path_problem(path: Column) -> Column:
    """What keeps a cited path from naming a file of the repository, the gravest first, or null."""
    parts = F.split(path, "/")
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "is empty")
        .when(path.startswith("/") | path.rlike("^[A-Za-z]:"), "is absolute")
        .when(path.contains("\\"), "contains a backslash")
        .when(F.array_contains(parts, ".."), "climbs out of the repository with '..'")
        .when(F.array_contains(parts, ".") | F.array_contains(parts, ""), "is not in canonical form (empty or '.' segment, or a trailing '/')")
    )


def parse_range(value: Column) -> tuple[Column, Column]:
    """First and last line of `a` or `a-b` with 1 <= a <= b; null otherwise."""
    a = F.regexp_extract(value, r"^([0-9]+)(?:-[0-9]+)?$", 1).try_cast("long")
    b = F.coalesce(F.nullif(F.regexp_extract(value, r"^[0-9]+-([0-9]+)$", 1), F.lit("")).try_cast("long"), a)
    good = (a >= 1) & (a <= b)
    return F.when(good, a), F.when(good, b)


_GLOB = re.compile(r"(\*\*/)|(\*\*)|(\*)|(\?)|([\w/-]+)|(.)", re.S)


def glob_pattern(glob: str, across: bool = False) -> str:
    """Anchored regular expression of a glob; with across, `**` also spans folders."""
    here = "[^/]*"
    put = ("(?:.*/)?", ".*") if across else (f"{here}{here}/", f"{here}{here}")

    def one(m: re.Match) -> str:
        return (*put, here, "[^/]", m[0], f"\\{m[0]}")[m.lastindex - 1]

    return f"^{_GLOB.sub(one, glob)}$"


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def escape_markup(text: Column) -> Column:
    """JSON text made safe inside a page: angle brackets, ampersand and the two line separators as escapes."""
    for mark, put in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = F.replace(text, F.lit(mark), F.lit(put))
    return text


def ordered(rules: list[tuple[str, str]], subject: Column, otherwise: str) -> Column:
    """The name of the first rule (name, pattern) that subject matches, else otherwise."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(subject.rlike(pattern), name).otherwise(out)
    return out


def fence_length(text: Column) -> Column:
    """Backticks of a fence that no run inside text closes: one more than the longest run, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.greatest(F.lit(3), 1 + F.coalesce(F.array_max(runs), F.lit(0))).cast("long")


def normalised_value(raw: Column) -> Column:
    """A stated value as a struct of type (none, bool, number, text), num (in seconds where it has a unit of time), infinite, unit, txt."""
    v = F.lower(F.regexp_replace(F.trim(raw), r"\s+", " "))
    number = v.rlike(r"^-?[0-9]+(\.[0-9]+)?\s*(s|ms)?$")
    none, flag, infinite = v.isNull() | v.isin("none", "null"), v.isin("true", "false"), v.isin("inf", "infinity")
    num = F.regexp_extract(v, r"^(-?[0-9.]+)", 1).try_cast("double") / F.when(v.endswith("ms"), 1000.0).otherwise(1.0)
    return F.struct(
        F.when(none, "none").when(flag, "bool").when(number | infinite, "number").otherwise("text").alias("type"),
        F.when(number, num).alias("num"), F.coalesce(infinite, F.lit(False)).alias("infinite"),
        F.when(number & v.endswith("s"), "s").alias("unit"), F.when(~none & ~number & ~infinite, v).alias("txt"),
    )


def values_match(a: Column, b: Column) -> Column:
    """Whether two normalised values say the same; a missing unit fits any."""
    number = (a["infinite"] == b["infinite"]) & (a["infinite"] | (a["num"] == b["num"])) & F.coalesce(a["unit"] == b["unit"], F.lit(True))
    same = F.when(a["type"] == "none", F.lit(True)).when(a["type"] == "number", number).otherwise(a["txt"] == b["txt"])
    return (a["type"] == b["type"]) & F.coalesce(same, F.lit(False))


# Kinds of conventional prefixes, then the words of each intent in the order they are tried.
PREFIX_KINDS = {
    "fix": "fix", "hotfix": "fix", "bugfix": "fix", "revert": "fix",
    "refactor": "refactor", "style": "refactor", "chore": "refactor", "build": "refactor", "ci": "refactor", "deps": "refactor",
    "feat": "feature", "feature": "feature", "perf": "feature", "docs": "feature", "doc": "feature", "test": "feature", "tests": "feature",
}
INTENT_WORDS = {
    "fix": r"fix(e[ds]|ing)?|bug(s|fix)?|hotfix|revert(ed|s)?|regress\w*|crash(e[ds])?|outage|incident|deadlock\w*|hang(ing|s)?|stall\w*|leak(s|ed|ing)?|oom|broken|repair\w*",
    "resilience": r"retry|retries|retrying|backoff|jitter|timeouts?|429|rate.?limit\w*|throttl\w*|circuit.?breaker\w*|idempoten\w*|dedupe?\w*",
    "refactor": r"refactor\w*|cleanup|clean.?up|rename[ds]?|tidy|reformat|lint|style|move[ds]?|extract\w*|simplif\w*",
}


def commit_kind(subject: Column, fix_words: list[str] | None = None) -> Column:
    """fix, resilience, refactor or feature by a subject's intent: a known prefix wins, then a revert or a fix word of any language given, then the other words."""
    subject = F.coalesce(subject, F.lit(""))
    prefix = F.lower(F.regexp_extract(subject, r"^\s*([A-Za-z]+)(?:\([^)]*\))?!?:", 1))
    out = F.lit("feature")
    for kind, words in reversed(INTENT_WORDS.items()):
        hit = subject.rlike(f"(?i)\\b({words})\\b")
        if kind == "fix":
            hit = hit | subject.rlike(r'^\s*Revert\s+"')
            own = [re.escape(w.strip()) for w in fix_words or [] if w.strip()]
            hit = hit | subject.rlike(r"(?iU)(?<!\w)(?:" + "|".join(own) + r")(?!\w)") if own else hit
        out = F.when(hit, kind).otherwise(out)
    known = F.create_map(*(F.lit(x) for pair in PREFIX_KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, prefix), out)


def remote(url: Column) -> Column:
    """host and web base of a repository's remote as a struct, null where it has none: no credentials, no .git, an ssh port dropped."""
    text = F.trim(F.coalesce(url, F.lit("")))
    form = r"(?i)^(https?|ssh|git|git\+ssh|ssh\+git)://(?:[^/@]*@)?([^/:?#@]+)(?::([0-9]+))?(?:/([^?#]*))?(?:[?#].*)?$"
    short = r"^(?:[^@/\s]+@)?([A-Za-z0-9.-]{2,}):([^/\\].*)$"
    has = text.contains("://")
    scheme, port = F.lower(F.regexp_extract(text, form, 1)), F.regexp_extract(text, form, 3)
    host = F.lower(F.when(has, F.regexp_extract(text, form, 2)).otherwise(F.regexp_extract(text, short, 1)))
    net = F.when(has & (port != "") & scheme.isin("http", "https"), F.concat(host, F.lit(":"), port)).otherwise(host)
    path = F.btrim(F.when(has, F.regexp_extract(text, form, 4)).otherwise(F.regexp_extract(text, short, 2)), F.lit("/"))
    path = F.when(path.endswith(".git"), F.rtrim(F.regexp_replace(path, r"\.git$", ""), F.lit("/"))).otherwise(path)
    good = (host != "") & path.rlike("^[A-Za-z0-9._~%/+-]+$") & net.rlike("^[A-Za-z0-9.-]+(:[0-9]+)?$")
    base = F.concat(F.when(scheme == "http", "http").otherwise("https"), F.lit("://"), net, F.lit("/"), path)
    return F.when(good, F.struct(host.alias("host"), base.alias("base")))


def encoded_path(path: Column) -> Column:
    """A path with each segment percent-encoded; letters, digits and _.-~ stay."""
    def one(segment: Column) -> Column:
        for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            segment = F.replace(segment, F.lit(a), F.lit(b))
        return segment

    return F.array_join(F.transform(F.split(path, "/"), lambda s: one(F.url_encode(s))), "/")


def filled_template(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} put in from values, in one pass: what is put in is never read again, and unknown names stay."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(x) if i % 2 == 0 else values.get(x, F.lit(f"{{{x}}}")) for i, x in enumerate(parts)))
