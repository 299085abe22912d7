"""Structural rules over program text: block ends by braces or indentation, and what loops and functions hold.

Each rule is a native expression of a text, its array of lines and its language: an array of (line_no, note). A block is found from its header by one
aggregate over the lines behind it, so texts stay where they are and nothing is shuffled; `blocks` gives the same ranges as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEADS = "array<struct<line_no:int,note:string>>"
#: Lines a block is followed for, lines above a wait in which its loop is looked for, lines about a wait in which it is told to be a retry.
BLOCK_LINES, LOOP_LINES, NEAR_LINES = 200, 400, 12
#: Leads of one text.
MOST = 3

# The words and forms by which the structural rules know retries, waits, paging, saving, calls, checks and entities.
RETRY = r"(?i)\b(retry|retries|retrying|attempt|attempts|backoff|back_off)\b"
ERROR_STATUS = r"(?i)(\b(429|4\d\d|5\d\d)\b|status(_code)?\s*(>=|===?|==)|\bcatch\b|\bexcept\b)"
RESUME = r"(?m)^\s*continue\b|\bcontinue\s*;"
GROWTH = r"(?i)(\*\*|Math\s*\.\s*pow|\bpow\s*\(|<<|\*\s*2\b|2\s*\*\*|\bexponential\b)"
GROWTH_PYTHON = r"(?i)((?:\b(?!lambda\b)\w+|[)\]])\s*\*\*|\bpow\s*\(|<<|\*\s*2\b|\bexponential\b)"
CEILING = r"(?i)(Math\s*\.\s*min|\bmin\s*\(|\bcap(ped)?\b|MAX_[A-Z_]*|[A-Z_]*_MAX\b|max_?(delay|backoff|wait|interval)|ceiling)"
JITTER = r"(?i)(jitter|random|rand\s*\(|uniform\s*\(|splay|stagger)"
NUMBER = r"[\d_]+(?:\.\d+)?(?:\s*\*\s*[\d_]+(?:\.\d+)?)*"
CONSTANT = r"^\s*(?:const|let|var|final)?\s*([A-Za-z_]\w*)\s*(?::\s*\w+\s*)?=\s*(" + NUMBER + r")\s*;?\s*$"
WAITS = {
    "typescript": [r"setTimeout\s*\(\s*[^,]+?,\s*([^),]+)", r"\b(?:sleep|delay|wait|pause)\s*\(\s*([^),]*)"],
    "python": [r"\b(?:time|asyncio|gevent|eventlet|trio|anyio)\s*\.\s*sleep\s*\(\s*([^),]*)", r"(?<![.\w])(?<!def )(?:sleep|delay)\s*\(\s*([^),]*)"],
    "java": [r"\b(?!(?:set|get|is|has)[A-Z])\w*[Ss]leep\w*\s*\(\s*([^),]*)"],
}
LOOP_WORD, TYPE_WORD = r"\b(?:while|for|do)\b", r"\b(?:class|interface|enum|record)\s+[\w$]"
PAGING = r"(?i)(page|cursor|offset|next_?token|has_?more|has_?next|per_?page|page_?size|paginat|\bskip)"
PAGING_JAVA = r"(?i)(page|cursor|offset|next_?token|has_?more(?!elements|tokens)|per_?page|page_?size|paginat|\bskip)"
SAVING = r"(?i)(save|persist|upsert|checkpoint|commit|store|flush|record_progress|last_?sync|last_?seen|progress|set_?state|resume_?from)|\.update\s*\(|UPDATE\s+\w+\s+SET"
SAVING_JAVA = SAVING + r"|\bset_?(last|resume|checkpoint|committed|saved)\w*\s*\("
ADVANCE = r"(?i)((page|cursor|offset|skip|start_?at)\s*(\+\+|\+=|=\s*[^=])|has_?more|has_?next|next_?(page|cursor|token|url)|is_?last_?page)"
ADVANCE_PYTHON = (
    r"(?im)(^\s*(?:\w+_)?page(?:_?(?:num|number|no|idx|index))?\s*(\+=|\s=\s*[^=])"
    r"|^\s*(?:\w*(?:cursor|marker)\w*|\w*(?:next|page|continuation|resume)\w*token\w*)\s+=\s*[^=\n]*"
    r"\b(next(?:_?(?:page|cursor|token|url|link|marker|offset)\w*)?|resp\w*|results?|data|body|json|page\w*|meta\w*)\b"
    r"|has_?more|has_?next|next_?(page|cursor|token|url)|is_?last_?page|\boffset\s*\+=\s*[\w.]*(limit|page_?size|batch_?size|per_?page|chunk_?size))"
)
ADVANCE_JAVA = (
    r"(?im)((?:^|[;{(,]|\bthis\s*\.)\s*\w*(page|cursor|start_?at)\s*(\+\+|\+=|=\s*[^=])|page\w*\s*(\+\+|\+=)|\+\+\s*\w*page|has_?more(?!elements|tokens)(?!\s*\()"
    r"|(page|resp|response|result|batch|chunk|slice|list)\w*\s*\.\s*(get|is)?has_?more\s*\(|(page|slice)\w*\s*\.\s*(hasNext|isLast|nextPageable)\s*\("
    r"|next_?(page|cursor|token|url)|is_?last_?page|offset\s*\+=\s*[\w.]*(limit|page_?size|batch_?size|fetch_?size))"
)
LOOP_BRACES, LOOP_INDENT = r"^\s*(?:\}\s*)?(?:do\b|while\s*\(|for\s*(?:await\s*)?\()", r"^\s*(?:while|for)\b.*:"
LAYERS = {
    "typescript": [
        ("own retry loop", r"(?i)\b(for|while)\s*\(.*\b(attempt|retry|retries|tries)\b"),
        ("retry wrapper", r"(?i)\b(withRetry|fetchWithRetry|pRetry|p_retry|retryable|asyncRetry|retry\s*\(\s*(?:async|\(|function))\b"),
        ("SDK retry config", r"\b(maxAttempts|retryStrategy|retryConfig|adaptiveRetry|RetryPolicy|retryMode)\b"),
    ],
    "python": [
        ("own retry loop", r"(?i)\b(for|while)\b.*\b(attempt|retry|retries|tries)\b"),
        ("retry decorator", r"@\s*(retry|backoff\.on_exception|tenacity|retrying)"),
        ("SDK retry config", r"\b(max_attempts|Retry\s*\(|retry_strategy|retry_config|urllib3\.Retry)\b"),
    ],
    "java": [
        ("own retry loop", r"(?i)\b(for|while)\s*\(.*\b(attempt|attempts|retry|retries|tries)\b"),
        ("Spring Retry", r"@\s*(?:[\w$]+\s*\.\s*)*Retryable\b|\bRetryTemplate\b|[Rr]etryTemplate\s*\.\s*execute\s*\("),
        ("resilience4j retry", r"@\s*(?:[\w$]+\s*\.\s*)*Retry\s*\(|\bRetry\s*\.\s*(of\w*|decorate\w*)\s*\(|\bRetryRegistry\b|\bRetryConfig\s*\.\s*(custom|of\w*)\s*\("),
        ("Failsafe retry", r"\bFailsafe\s*\.\s*with\b|\bRetryPolicy\s*\.\s*builder\s*\("),
    ],
}
BUDGET = r"(?i)(retry.?budget|token.?bucket|retry.?quota|budget_remaining)"
DECLARES = r"^\s*(export\s+)?(default\s+)?(async\s+)?(function\s+\w+|def\s+\w+|class\s+\w+|const\s+\w+\s*=\s*(async\s*)?(\(|function)|(public|private|protected)\s+)"
SPRING_CONFIG, IMPORT_JAVA = r"@\s*(Configuration|AutoConfiguration)\b", r"^\s*import\s"
METHOD_JAVA = (
    r"^\s*(?:@[\w.]+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|synchronized|abstract|default|native|strictfp)\s+)*(?:<[^>]+>\s+)?"
    r"(?:(?!(?:return|new|else|throw|case|yield|assert)\b)[\w$.]+(?:<[^;=(){}]*>)?(?:\[\])*\s+)?(?!(?:if|for|while|switch|catch|synchronized|try|return|new|throw)\b)[\w$]+\s*\("
    r"(?:(?:[^;()]|\([^;()]*\))*\)\s*(?:throws\s+[\w$.,\s]+)?\{|(?:[^;()]|\([^;()]*\))*$)"
)
FUNCTIONS = {
    "typescript": r"^\s*(export\s+)?(default\s+)?(async\s+)?(function\s+\w+|const\s+\w+\s*=|(public|private|protected)?\s*\w+\s*\([^)]*\)\s*[:{])",
    "python": r"^\s*(async\s+)?def\s+\w+",
    "java": r"(?:" + METHOD_JAVA + r")|^\s*(?:(?:public|protected|private|static)\s|(?:(?:abstract|final|sealed|non-sealed)\s+)*(?:class|interface|enum|record)\s)",
}
CALLS = {
    "typescript": r"(?i)\b(fetch|axios|got|requests\s*\.|httpx\s*\.|aiohttp|urlopen|\.query\s*\(|\.findMany\s*\(|\.execute\s*\(|generateContent|\.send\s*\(|\.invoke\s*\()",
    "python": r"(?i)\b(?:requests|httpx)\s*\.\s*(?:get|post|put|patch|delete|head|options|request|stream)\s*\(|(?<!\.)\bfetch\s*\(|\baiohttp\b|\burlopen\s*\(|\.query\s*\(|\.execute\s*\(|generateContent|\.send\s*\(|\.invoke\s*\(",
    "java": r"\.\s*(?:send|sendAsync|exchange|retrieve|getForObject|getForEntity|postForObject|postForEntity|executeQuery|executeUpdate|queryFor\w+)\s*\(|(?<!Query)\.\s*query\s*\(|(?<![Ee]xecutor)(?<![Pp]ool)(?<![Ss]ervice)\.\s*execute\s*\(|\bgenerateContent\b",
}
CHECKS = {
    "typescript": r"(?i)(\bvalidate\w*\s*\(|\bis_?valid\b|\.parse\s*\(|\bschema\b|\bassert\b|throw new (Validation|BadRequest|TypeError|RangeError)|raise (ValueError|TypeError|ValidationError))",
    "python": r"(?i)(\bvalidate\w*\s*\(|\bis_?valid\b|\bschema\b|raise (ValueError|TypeError|ValidationError))",
    "java": r"\bvalidate\w*\s*\(|\bisValid\w*\s*\(|\bObjects\s*\.\s*requireNonNull\s*\(|\bPreconditions\s*\.\s*check\w+\s*\(|\bAssert\s*\.\s*\w+\s*\(|throw\s+new\s+(IllegalArgumentException|\w*Validation\w*Exception|ConstraintViolationException|BadRequest\w*|ResponseStatusException\s*\(\s*(?:HttpStatus\s*\.\s*)?BAD_REQUEST)\b",
}
SWITCH_LABEL, CATCH, IF, RESPONSE = r"^\s*(?:case\b|default\b)", r"\bcatch\s*\(", r"\bif\s*\(", r"\b(?:getBody|body|getStatusCode|getStatusCodeValue|statusCode)\s*\("
PERSISTENCE = r"(javax|jakarta)\.persistence|org\.hibernate|org\.springframework\.data|@\s*(Entity|Transactional)\b|\bEntityManager\b|\w+Repository\b"
OTHER_STORE, JPA = r"org\.springframework\.data\.(mongodb|jdbc|cassandra|couchbase|elasticsearch|redis|neo4j|r2dbc)|\bcom\.mongodb\.", r"(javax|jakarta)\.persistence|org\.hibernate"
EAGER = r"(?i)@\s*(Named)?EntityGraph\b|JOIN\s+FETCH|Hibernate\s*\.\s*initialize\s*\(|FetchType\s*\.\s*EAGER|@\s*BatchSize\b|FetchMode\s*\.\s*(SUBSELECT|JOIN)|\.(fetch|load)graph\b"
FOR_EACH = r"\bfor\s*\(\s*(?:final\s+)?([\w.]+)(?:<(?:[^<>]|<[^<>]*>)*>)?(?:\[\])*\s+(\w+)\s*:([^\n]*)"
VALUE_TYPE = (
    r"(?:^|\.)(?:String|CharSequence|Integer|Long|Short|Byte|Double|Float|Boolean|Character|Number|BigDecimal|BigInteger|UUID|Object|Optional|Entry|File|Path|URI|URL|Instant|Duration|Date"
    r"|Local\w*|Zoned\w*|Offset\w*|Class|int|long|short|byte|double|float|boolean|char)$|(?:Dto|DTO|Request|Response|View|Vm|VM|Projection|Payload|Command|Event|Form)$"
)
MAPPED = r"\.\s*map\s*\(|Dto|DTO"
COLLECTION_CALL = r"^(size|isEmpty|stream|parallelStream|iterator|forEach|contains|containsAll|containsKey|add|addAll|remove|removeAll|removeIf|clear|toArray|values|keySet|entrySet)$"
VALUE_GETTER = r"^get(?:Id|Class|Year|Month\w*|Day\w*|Hour|Minute|Second|Nano|Time|Epoch\w*|Bytes|SimpleName)$"
NESTED = r"\bfor\s*\([^:;\n]*:\s*(\w+)\s*\.\s*(get[A-Z]\w*)\s*\(\s*\)\s*\)"
CHAIN = r"\b(\w+)\s*\.\s*get[A-Z]\w*\s*\(\s*\)\s*\.\s*(\w+)\s*\((?=\s*(\S?))"


def _count(s: Column, mark: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))


def _indent(s: Column) -> Column:
    return F.length(s) - F.length(F.ltrim(s, F.lit(" \t\r\f\x0b")))


def _bare(s: Column) -> Column:
    """Whether a line holds nothing."""
    return F.trim(s, F.lit(" \t\r\f\x0b")) == ""


def _join(lines: Column, first: Column, last: Column) -> Column:
    """The lines from first to last, both from 1, joined."""
    begin = F.greatest(F.lit(1), first)
    return F.array_join(F.slice(lines, begin, F.greatest(F.lit(0), F.least(last, F.size(lines)) - begin + 1)), "\n")


def _first(items: Column) -> Column:
    return F.get(items, 0)


def _numbered(lines: Column, keep: Callable[[Column], Column], value: Callable[[Column, Column], Column]) -> Column:
    """value(line, number from 1) of the lines to keep."""
    return F.filter(F.transform(lines, lambda x, i: F.when(keep(x), value(x, i + 1))), lambda v: v.isNotNull())


def _numbers(lines: Column, pattern: str) -> Column:
    return _numbered(lines, lambda x: x.rlike(pattern), lambda x, n: n)


def block_end(lines: Column, at: Column, indented: bool, limit: int = BLOCK_LINES) -> Column:
    """Number of the last line of the block whose header is line at, both from 1.

    Braces: the first line from the header on at whose end no brace opened since is left open, once one has been opened. Indented: the line before
    the next that holds something and is indented no deeper. A block that does not end within limit lines ends limit lines behind its header, or with the text.
    """
    ahead, base = F.slice(lines, at, limit), _indent(F.get(lines, at - 1))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("seen"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        if indented:
            depth, seen = acc["depth"], acc["seen"]
            over = (n > 1) & ~_bare(x) & (_indent(x) <= base)
            last = n - 1
        else:
            opened = _count(x, "{")
            depth, seen, last = acc["depth"] + opened - _count(x, "}"), acc["seen"] | (opened > 0), n
            over = seen & (depth <= 0)
        moved = F.struct(n.alias("n"), depth.alias("depth"), seen.alias("seen"), F.when(over, last).otherwise(F.lit(0)).alias("end"))
        return F.when(acc["end"] > 0, acc).otherwise(moved)

    end = F.aggregate(ahead, start, step, lambda acc: acc["end"])
    return F.when(end > 0, at + end - 1).otherwise(F.least(F.size(lines), at + limit)).cast("int")


def blocks(docs: DataFrame, header: str, indented: bool, text: str = "text", limit: int = BLOCK_LINES) -> DataFrame:
    """doc_id, line_no, end_line, header, depth of the blocks whose headers match, depth counting the blocks about them."""
    own = docs.select("doc_id", F.split(text, "\n", -1).alias("lines"))
    spans = _numbered(F.col("lines"), lambda x: x.rlike(header), lambda x, n: F.struct(n.cast("int").alias("line_no"), block_end(F.col("lines"), n, indented, limit).alias("end_line"), F.trim(x).alias("header")))
    held = own.select("doc_id", spans.alias("spans"))
    about = lambda s: F.size(F.filter("spans", lambda o: (o["line_no"] < s["line_no"]) & (o["end_line"] >= s["line_no"])))
    deep = F.transform("spans", lambda s: F.struct(s["line_no"], s["end_line"], s["header"], about(s).alias("depth")))
    return held.select("doc_id", F.explode(deep).alias("b")).select("doc_id", "b.line_no", "b.end_line", "b.header", "b.depth")


def _lead(line_no: Column, *note: Column | str) -> Column:
    return F.struct(line_no.cast("int").alias("line_no"), F.concat(*(F.lit(n) if isinstance(n, str) else n.cast("string") for n in note)).alias("note"))


def _leads(gate: Column, leads: Column) -> Column:
    return F.when(F.coalesce(gate, F.lit(False)), leads).otherwise(F.array()).cast(LEADS)


def _retried(text: Column) -> Column:
    return text.rlike(RETRY) | (text.rlike(ERROR_STATUS) & text.rlike(RESUME))


def _in_loop(lines: Column, at: Column, before: Column) -> Column:
    """Whether a loop encloses what stands behind `before`, the beginning of line at: the open braces above from the inside out, until one
    belongs to a loop (yes) or a type (no). A brace alone on its line belongs to the line above."""

    def braces(x: Column, above: Column) -> Column:
        marked = F.transform(F.split(x, ""), lambda c, i: F.struct(c.alias("c"), F.substring(x, F.lit(1), i).alias("head")))
        told = F.transform(F.filter(marked, lambda m: m["c"].isin("{", "}")), lambda m: F.struct(m["c"].alias("c"), F.when(_bare(m["head"]), above).otherwise(m["head"]).alias("head")))
        return F.reverse(told)

    low = F.greatest(F.lit(1), at - (LOOP_LINES - 1))
    upward = F.reverse(F.sequence(low, at))
    line = lambda n: F.coalesce(F.get(lines, n - 1), F.lit(""))
    all_ = F.flatten(F.transform(upward, lambda n: braces(F.when(n == at, before).otherwise(line(n)), F.when(n > 1, line(n - 1)).otherwise(""))))
    start = F.struct(F.lit(0).alias("closed"), F.lit(None).cast("boolean").alias("found"))

    def step(acc: Column, b: Column) -> Column:
        opens = (b["c"] == "{") & (acc["closed"] == 0)
        found = F.when(opens & b["head"].rlike(TYPE_WORD), F.lit(False)).when(opens & b["head"].rlike(LOOP_WORD), F.lit(True))
        closed = F.when(b["c"] == "}", acc["closed"] + 1).otherwise(F.greatest(F.lit(0), acc["closed"] - 1))
        return F.when(acc["found"].isNotNull(), acc).otherwise(F.struct(closed.alias("closed"), found.alias("found")))

    return before.rlike(r"\b(?:while|for)\s*\(") | F.coalesce(F.aggregate(all_, start, step, lambda acc: acc["found"]), F.lit(False))


def backoff(text: Column, lines: Column, lang: str) -> Column:
    """The first retry wait of a text that is a constant, and the first that grows without a ceiling, or without jitter."""
    growth, waits = GROWTH_PYTHON if lang == "python" else GROWTH, WAITS[lang]
    constants = _numbered(lines, lambda x: x.rlike(CONSTANT), lambda x, n: F.struct(F.regexp_extract(x, CONSTANT, 1).alias("name"), F.trim(F.regexp_extract(x, CONSTANT, 2)).alias("value")))

    def wait(x: Column, n: Column) -> Column:
        """The argument of the first form that has one, if the line is in a retry."""
        given = F.coalesce(*(F.when(F.trim(F.regexp_extract(x, w, 1)) != "", F.struct(F.trim(F.regexp_extract(x, w, 1)).alias("arg"), F.regexp_instr(x, F.lit(w)).alias("col"))) for w in waits))
        near = _retried(_join(lines, n - NEAR_LINES, n + NEAR_LINES))
        if lang == "java":
            near = near & _in_loop(lines, n, F.substring(x, F.lit(1), given["col"] - 1))
        return F.when(given.isNotNull() & near, F.struct(n.alias("n"), given["arg"].alias("arg")))

    def judged(w: Column, named: Column) -> Column:
        value = F.when(w["arg"].rlike(rf"^\s*{NUMBER}\s*$"), w["arg"]).otherwise(F.get(F.reverse(F.filter(named, lambda c: c["name"] == w["arg"])), 0)["value"])
        return F.struct(w["n"].alias("n"), w["arg"].alias("arg"), value.alias("value"))

    def told(all_waits: Column) -> Column:
        # a wait of nothing only yields
        still = F.filter(all_waits, lambda w: w["value"].isNotNull() & (w["value"].rlike("[1-9]") if lang == "python" else F.lit(True)))
        grown = F.filter(all_waits, lambda w: w["value"].isNull() & (w["arg"].rlike(growth) | text.rlike(growth)))
        s, g = _first(still), _first(grown)
        shown = F.when(s["value"] == s["arg"], s["arg"]).otherwise(F.concat(s["arg"], F.lit(" ("), s["value"], F.lit(")")))
        found = F.array(
            F.when(s.isNotNull() & ~text.rlike(growth), _lead(s["n"], "retry waits a constant ", shown, ", so all clients retry on one schedule")),
            F.when(g.isNotNull() & ~text.rlike(CEILING), _lead(g["n"], "backoff grows without a ceiling")),
            F.when(g.isNotNull() & ~text.rlike(JITTER), _lead(g["n"], "backoff has no jitter, so clients retry together")),
        )
        return F.array_sort(F.array_compact(found), lambda a, b: a["line_no"] - b["line_no"])

    any_wait = lambda x: F.greatest(*(x.rlike(w) for w in waits)) if len(waits) > 1 else x.rlike(waits[0])
    held = F.transform(_numbered(lines, any_wait, wait), lambda w: judged(w, constants))
    return _leads(_retried(text), _first(F.transform(F.array(held), told)))


def checkpoint(text: Column, lines: Column, lang: str) -> Column:
    """Loops that walk pages and nowhere save the place they have come to. A loop inside one that was looked at is part of it."""
    indented = lang == "python"
    paging, saving = (PAGING_JAVA, SAVING_JAVA) if lang == "java" else (PAGING, SAVING)
    advance = {"python": ADVANCE_PYTHON, "java": ADVANCE_JAVA}.get(lang, ADVANCE)
    loops = _numbered(lines, lambda x: x.rlike(LOOP_INDENT if indented else LOOP_BRACES), lambda x, n: F.struct(n.cast("int").alias("at"), block_end(lines, n, indented).alias("end")))

    def saved(body: Column) -> Column:
        """Whether a line that saves has the place in it or beside it."""
        return F.exists(F.transform(body, lambda x, i: x.rlike(saving) & _join(body, i, i + 2).rlike(paging)), lambda x: x)

    def walks(b: Column) -> Column:
        body = _join(lines, b["at"], b["end"])
        return body.rlike(paging) & body.rlike(advance) & ~saved(F.slice(lines, b["at"], b["end"] - b["at"] + 1))

    start = F.struct(F.lit(0).alias("past"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, b: Column) -> Column:
        found = F.when((F.size(acc["found"]) < MOST) & walks(b), F.concat(acc["found"], F.array(b["at"]))).otherwise(acc["found"])
        return F.when(b["at"] > acc["past"], F.struct(F.greatest(b["at"], b["end"]).alias("past"), found.alias("found"))).otherwise(acc)

    found = F.aggregate(loops, start, step, lambda acc: acc["found"])
    return _leads(text.rlike(paging), F.transform(found, lambda n: _lead(n, "paged loop that saves no place, so an interrupted run begins anew")))


def _layered(layers: Column) -> Column:
    """The lead of layers (label, line_no) in one call path, at the last of them."""
    labels = F.array_join(F.transform(layers, lambda x: x["label"]), ", ")
    return _lead(F.array_max(F.transform(layers, lambda x: x["line_no"])), F.size(layers), " retry layers in one call path (", labels, ") with no shared budget")


def retry_layers(text: Column, lines: Column, lang: str) -> Column:
    """Two or more kinds of retry in one text, or in Java in one method, where no budget is shared."""
    used = lambda x, p: x.rlike(p) & ~x.rlike(DECLARES) & (~x.rlike(IMPORT_JAVA) if lang == "java" else F.lit(True))
    found = lambda p: _numbered(lines, lambda x: used(x, p), lambda x, n: F.struct(n.cast("int").alias("n"), F.ltrim(x).startswith("@").alias("marks")))
    hits = [(label, found(p)) for label, p in LAYERS[lang]]
    if lang != "java":
        layers = F.array_compact(F.array(*(F.when(F.size(h) > 0, F.struct(F.lit(label).alias("label"), _first(h)["n"].alias("line_no"))) for label, h in hits)))
        return _leads(~text.rlike(BUDGET), _first(F.transform(F.array(layers), lambda s: F.when(F.size(s) > 1, F.array(_layered(s))).otherwise(F.array().cast(LEADS)))))

    def owned(methods: Column) -> Column:
        # an annotation belongs to the method below it, a statement to the one above
        def owner(h: Column) -> Column:
            below, above = F.filter(methods, lambda m: m >= h["n"]), F.filter(methods, lambda m: m <= h["n"])
            return F.coalesce(F.when(h["marks"], F.array_min(below)).otherwise(F.array_max(above)), F.lit(0))

        known = [(label, F.transform(h, lambda x: F.struct(owner(x).alias("owner"), x["n"].alias("n")))) for label, h in hits]
        owners = F.array_distinct(F.flatten(F.array(*(F.transform(h, lambda x: x["owner"]) for _, h in known))))

        def layers(o: Column) -> Column:
            first = lambda h: _first(F.filter(h, lambda x: x["owner"] == o))["n"]
            return F.array_compact(F.array(*(F.when(first(h).isNotNull(), F.struct(F.lit(label).alias("label"), first(h).alias("line_no"))) for label, h in known)))

        stacked = F.filter(F.transform(owners, layers), lambda s: F.size(s) > 1)
        return F.array_sort(F.transform(stacked, _layered))

    # methods are looked for only where something retries
    some = F.greatest(*(F.size(h) for _, h in hits)) > 0
    return _leads(~text.rlike(SPRING_CONFIG) & ~text.rlike(BUDGET) & some, _first(F.transform(F.array(_numbers(lines, METHOD_JAVA)), owned)))


def _assigned(x: Column) -> Column:
    """(name, value) of a Java line that assigns before its first bracket, or null."""
    head = F.substring_index(x, "(", 1)
    at = F.instr(head, "=")
    name = F.regexp_extract(F.substring(head, F.lit(1), at - 1), r"([\w$]+)[^\w$]*$", 1)
    sound = (at > 1) & ~F.substring(head, at - 1, F.lit(1)).isin("=", "!", "<", ">") & (F.substring(head, at + 1, F.lit(1)) != "=") & (name != "")
    return F.when(sound, F.struct(name.alias("name"), F.substring(x, at + 1, F.length(x)).alias("value")))


def _mentions(x: Column, names: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(x, F.lit(r"(?<![\w$.])[\w$]+"), F.lit(0)), names)


def fail_fast(text: Column, lines: Column, lang: str) -> Column:
    """Functions whose first check of their input comes behind their first call to the outside; in Java, checks of what the call returned do not count."""
    starts = _numbers(lines, FUNCTIONS[lang])

    def translated(n: Column) -> Column:
        """A switch label, or a line in or right behind the head of a catch."""
        x = F.get(lines, n - 1)
        above = F.slice(F.filter(F.reverse(F.slice(lines, F.greatest(F.lit(1), n - 20), F.least(n - 1, F.lit(20)))), lambda y: ~_bare(y)), 1, 2)
        return x.rlike(SWITCH_LABEL) | x.rlike(CATCH) | F.exists(above, lambda y: y.rlike(CATCH))

    def reads_response(x: Column, n: Column, names: Column) -> Column:
        above = _first(F.filter(F.reverse(F.slice(lines, F.greatest(F.lit(1), n - 2), F.least(n - 1, F.lit(2)))), lambda y: ~_bare(y)))
        seen = F.when(F.ltrim(x).startswith("throw") & F.coalesce(above, F.lit("")).rlike(IF), F.concat(above, F.lit("\n"), x)).otherwise(x)
        return seen.rlike(RESPONSE) | F.coalesce(_mentions(seen, names), F.lit(False))

    state = F.struct(F.lit(0).alias("call"), F.lit(0).alias("check"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, n: Column) -> Column:
        x = F.get(lines, n - 1)
        call = F.when((acc["call"] == 0) & x.rlike(CALLS[lang]), n).otherwise(acc["call"])
        names, fits = acc["names"], x.rlike(CHECKS[lang])
        if lang == "java":
            own = _assigned(x)
            takes = (call == n) | ((call > 0) & (F.coalesce(_mentions(own["value"], names), F.lit(False)) | own["value"].rlike(RESPONSE)))
            names = F.when(own.isNotNull() & F.coalesce(takes, F.lit(False)), F.concat(names, F.array(own["name"]))).otherwise(names)
            fits = fits & ~translated(n) & ~((call > 0) & (n > call) & reads_response(x, n, names))
        return F.struct(call.alias("call"), F.when((acc["check"] == 0) & fits, n).otherwise(acc["check"]).alias("check"), names.alias("names"))

    def late(f: Column, i: Column, all_: Column) -> Column:
        last = F.coalesce(F.get(all_, i + 1) - 1, F.size(lines))
        return F.aggregate(F.sequence(f, F.greatest(f, last)), state, step)

    found = _first(F.transform(F.array(starts), lambda all_: F.filter(F.transform(all_, lambda f, i: late(f, i, all_)), lambda s: (s["call"] > 0) & (s["call"] < s["check"]))))
    return _leads(text.rlike(CALLS[lang]) & text.rlike(CHECKS[lang]), F.transform(F.slice(found, 1, MOST), lambda s: _lead(s["check"], "input is checked behind the outside call on line ", s["call"])))


def n_plus_one(text: Column, lines: Column, lang: str) -> Column:
    """Java loops over entities that go through a getter of each element, where no fetch is made eager."""

    def navigates(body: Column, name: Column) -> Column:
        every = lambda p, *groups: F.arrays_zip(*(F.regexp_extract_all(body, F.lit(p), F.lit(g)).alias(f"g{g}") for g in groups))
        inner = F.exists(every(NESTED, 1, 2), lambda m: (m["g1"] == name) & ~m["g2"].rlike(VALUE_GETTER))
        reached = lambda m: m["g2"].rlike(COLLECTION_CALL) | ((m["g2"] == "get") & ~m["g3"].isin("", ")")) | (m["g2"].rlike(r"^get[A-Z]\w*$") & ~m["g2"].rlike(VALUE_GETTER))
        return inner | F.exists(every(CHAIN, 1, 2, 3), lambda m: (m["g1"] == name) & reached(m))

    def loop(x: Column, n: Column) -> Column:
        kind, name, source = (F.regexp_extract(x, FOR_EACH, g) for g in (1, 2, 3))
        end = F.when(x.contains("{"), block_end(lines, n, False)).otherwise(F.least(n + 1, F.size(lines)))
        fits = ~kind.rlike(VALUE_TYPE) & ~source.rlike(MAPPED) & navigates(_join(lines, n, end), name)
        return F.when(fits, _lead(n, "loop over `", name, "` goes through an association of each element, with no eager fetch in this file"))

    gate = text.rlike(PERSISTENCE) & ~text.rlike(EAGER) & ~(text.rlike(OTHER_STORE) & ~text.rlike(JPA))
    return _leads(gate, F.slice(_numbered(lines, lambda x: x.rlike(FOR_EACH), loop), 1, MOST))


#: Structural rules by the names that catalogs give them.
HANDLERS: dict[str, Callable[[Column, Column, str], Column]] = {"s02_backoff": backoff, "s07_checkpoint": checkpoint, "s10_retry_layers": retry_layers, "s18_fail_fast": fail_fast, "s29_n_plus_one": n_plus_one}


def leads(docs: DataFrame, handler: str, lang: str, text: str = "text") -> DataFrame:
    """doc_id, line_no, note of one structural rule over code with its comments blanked."""
    own = docs.select("doc_id", F.col(text).alias("text"), F.split(text, "\n", -1).alias("lines")).where(F.col("text").isNotNull())
    return own.select("doc_id", F.explode(HANDLERS[handler](F.col("text"), F.col("lines"), lang)).alias("x")).select("doc_id", "x.line_no", "x.note")
