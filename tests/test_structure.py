"""Blocks, structural rules, patterns and catalogs on known answers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from churnlens.functions import patterns
from churnlens.operators import handlers, rules
from churnlens.sources import catalog

PAGES_TS = "async function run() {\n  let page = 1;\n  while (more) {\n    const r = await get(page);\n    page += 1;\n%s  }\n}"
PAGES_PY = "page = 1\nwhile has_more:\n    r = get(page)\n    page += 1\n%s\ndone()"
PAGES_JAVA = "void run() {\n  for (;;) {\n    Page p = repo.findAll(next);\n    if (!p.hasNext()) break;\n    next = p.nextPageable();\n%s  }\n}"
ORDERS = "import jakarta.persistence.Entity;\nvoid f(List<Order> orders) {\n  for (Order o : orders) {\n    %s\n  }\n}"
#: handler, language, text, lines it leads to.
CASES = [
    ("s07_checkpoint", "typescript", PAGES_TS % "", [3]), ("s07_checkpoint", "typescript", PAGES_TS % "    await saveCursor(page);\n", []), ("s07_checkpoint", "typescript", PAGES_TS % "    a();\n    await save(r);\n    b();\n", [3]),
    ("s07_checkpoint", "typescript", "for (const item of pageItems) {\n  use(item);\n}", []), ("s07_checkpoint", "python", PAGES_PY % "", [2]), ("s07_checkpoint", "python", PAGES_PY % "    progress.page = page", []), ("s07_checkpoint", "python", "for x in y:\n    cursor += HEIGHT\n", []),
    ("s07_checkpoint", "java", PAGES_JAVA % "", [2]), ("s07_checkpoint", "java", PAGES_JAVA % "    job.setLastPage(next);\n", []), ("s07_checkpoint", "java", "while (it.hasNext()) {\n  String page = it.next();\n}", []),
    ("s07_checkpoint", "typescript", "\n".join(["for (;;) {", "  page++;", "}", ""] * 5), [1, 5, 9]), ("s07_checkpoint", "typescript", "for (;;) {\n  while (x) {\n    page++;\n  }\n}", [1]), ("s07_checkpoint", "typescript", "", []), ("s07_checkpoint", "typescript", None, []),
    ("s29_n_plus_one", "java", ORDERS % "o.getLines().size();", [3]), ("s29_n_plus_one", "java", ORDERS % "o.getBuyer().getName();", [3]), ("s29_n_plus_one", "java", ORDERS % "o.getId();", []), ("s29_n_plus_one", "java", ORDERS % "o.getBuyer().getId();", []),
    ("s29_n_plus_one", "java", ORDERS % "for (Line l : o.getLines()) { use(l); }", [3]), ("s29_n_plus_one", "java", ORDERS % "p.getLines().size();", []), ("s29_n_plus_one", "java", ORDERS % "o.getLines().get(0);", [3]), ("s29_n_plus_one", "java", ORDERS % "o.getName().get();", []),
    ("s29_n_plus_one", "java", "// JOIN FETCH\n" + ORDERS % "o.getLines().size();", []), ("s29_n_plus_one", "java", "import com.mongodb.Client;\n@Entity\n" + ORDERS.partition("\n")[2] % "o.getLines().size();", []), ("s29_n_plus_one", "java", (ORDERS % "o.getLines().size();").replace("Order o", "OrderDto o"), []),
    ("s02_backoff", "typescript", "while (retry) {\n  await sleep(500);\n}", [2]), ("s02_backoff", "typescript", "const MS = 2 * 1000;\nfor (attempt of t) {\n  setTimeout(go, MS);\n}", [3]), ("s02_backoff", "typescript", "await sleep(500);", []),
    ("s02_backoff", "typescript", "retry();\nwait = base * 2 ** n;\nsleep(wait);", [3, 3]), ("s02_backoff", "typescript", "retry();\nwait = Math.min(cap, 2 ** n) * Math.random();\nsleep(wait);", []), ("s02_backoff", "typescript", "retry();\n" + "x();\n" * 20 + "sleep(500);", []),
    ("s02_backoff", "python", "for attempt in r:\n    time.sleep(5)", [2]), ("s02_backoff", "python", "for attempt in r:\n    time.sleep(0)", []), ("s02_backoff", "python", "for attempt in r:\n    f(**kw)\n    time.sleep(pause)", []), ("s02_backoff", "python", "for attempt in r:\n    task.delay(5)", []),
    ("s02_backoff", "java", "class A {\n  void f() {\n    for (int attempt = 0;;) {\n      try { g(); } catch (E e) {\n        Thread.sleep(100);\n      }\n    }\n  }\n}", [5]), ("s02_backoff", "java", "class Retry {\n  // retry\n  void f() {\n    retry();\n    Thread.sleep(100);\n  }\n}", []),
    ("s02_backoff", "java", "void f() {\n  while (retry)\n  {\n    Thread.sleep(100);\n  }\n}", [4]), ("s02_backoff", "java", "void f() {\n  for (;;) { a(); }\n  retry(); Thread.sleep(100);\n}", []), ("s02_backoff", "java", "int retry; setSleepMs(100);", []),
    ("s10_retry_layers", "typescript", "for (let attempt = 0;;) {\n  pRetry(x);\n}", [2]), ("s10_retry_layers", "typescript", "for (let attempt = 0;;) {\n  pRetry(x); // token bucket\n}", []), ("s10_retry_layers", "typescript", "export async function withRetry(f) {\n  for (let attempt = 0;;) {}\n}", []),
    ("s10_retry_layers", "python", "@retry\ndef f():\n    for attempt in r:\n        g()", [3]), ("s10_retry_layers", "java", "@Retryable\nvoid f() {\n  for (int attempt = 0;;) { g(); }\n}\n", [3]), ("s10_retry_layers", "java", "@Retryable\nvoid f() {\n}\n@Retry(name)\nvoid g() {\n}\n", []),
    ("s18_fail_fast", "typescript", "function f(a) {\n  fetch(a);\n  validate(a);\n}", [3]), ("s18_fail_fast", "typescript", "function f(a) {\n  validate(a);\n  fetch(a);\n}", []), ("s18_fail_fast", "python", "def f(a):\n    requests.get(a)\n    raise ValueError(a)\n", [3]),
    ("s18_fail_fast", "python", "def f(a):\n    requests.get(a)\ndef g(a):\n    raise ValueError(a)\n", []), ("s18_fail_fast", "java", "void f(A a) {\n  R r = client.send(a);\n  Objects.requireNonNull(a);\n}", [3]), ("s18_fail_fast", "java", "void f(A a) {\n  R r = client.send(a);\n  S s = r.two();\n  Objects.requireNonNull(s);\n}", []),
]


def test_structural_rules(spark):
    for handler, lang in sorted({c[:2] for c in CASES}):
        own = [(i, c[2]) for i, c in enumerate(CASES) if c[:2] == (handler, lang)]
        got = {}
        for r in handlers.leads(spark.createDataFrame(own, "doc_id long, text string"), handler, lang).collect():
            got.setdefault(r["doc_id"], []).append(r["line_no"])
        assert {i: sorted(got.get(i, [])) for i, _ in own} == {i: CASES[i][3] for i, _ in own}


@pytest.mark.parametrize("indented", [True, False])
def test_block_ends_against_a_plain_scan(spark, indented):
    rng = random.Random(7)
    forms = ["for x:", "  while y:", "    for z:", "  a", "      b", "", "   "] if indented else ["for (a) {", "}", "while (b) {", "x();", "} for (;;) {", "{ } }", "for (c) { d }", "for (e)"]
    texts = ["\n".join(rng.choice(forms) for _ in range(rng.randrange(1, 60))) for _ in range(40)] + [(forms[0] + "\n") + ("      b\n" if indented else "x();\n") * 300]
    header = handlers.LOOP_INDENT if indented else handlers.LOOP_BRACES

    def end(lines, i):
        depth, seen = 0, False
        for j in range(i, min(len(lines), i + 200)):
            if indented:
                if j > i and lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= len(lines[i]) - len(lines[i].lstrip()):
                    return j
            else:
                depth, seen = depth + lines[j].count("{") - lines[j].count("}"), seen or "{" in lines[j]
                if seen and depth <= 0:
                    return j + 1
        return min(len(lines), i + 1 + 200)

    got = {(r.doc_id, r.line_no): r.end_line for r in handlers.blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), header, indented).collect()}
    assert got == {(d, i + 1): end(t.split("\n"), i) for d, t in enumerate(texts) for i, x in enumerate(t.split("\n")) if re.match(header, x)}


PATTERNS = [r"\bfoo\s*\(", r"(?:ab|cd)e+", r"(?i)Retry-After", r"x?", r"[Ff]oo|bar", r"(?P<q>['\"])a(?P=q)", r"a\Z", r"^[^\n\]x]+$", r"[]a[]b", r"[a&&b]c", r"(a|b){2}cd", r"(?:(abc))+d", r"^\s*def\b", r"(?=look)l\w+", r"\[x\]", r"é+t"]
TEXTS = ["foo (1)", "cdee", "retry-after", "", "Foo", "bar", "'a'", '"a\'', "ba", "ba\n", "ab]c", "]b", "[b", "&c", "abcd", "xabcabcd", "  def f", "looking", "[x]", "ééT", "éét", "FOO(", "a\ndef"]


def test_patterns_match_as_in_python(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for p in PATTERNS:
        for lines in (False, True):
            got = [r[0] for r in texts.select(F.col("t").rlike(patterns.java_pattern(p, lines))).collect()]
            assert got == [re.search(p, t, re.M if lines else 0) is not None for t in TEXTS], p
        literals = patterns.required_literals(p)
        assert all(not re.search(p, t) or not literals or any(x in t.lower() for x in literals) for t in TEXTS), p
    assert patterns.required_literals(r"(?:ab|cd)e+") == ["ab", "cd"] and patterns.required_literals(r"\bfoo\s*\(") == ["foo"] and patterns.required_literals("x?") == [] and patterns.required_literals("(?i)Retry-After") == ["retry-after"]


CATALOG = """
languages:
  python: {extensions: [.py, .PYI]}
  yaml: {extensions: [.yml], rank_only_with_leads: true}
aliases: {jython: python}
patterns:
  - id: P1
    name: Waits
    tier: a
    weight: 0.5
    detectors:
      python:
        - {id: p1-sleep, kind: regex, pattern: 'sleep\\(', note: waits, absent_before: '# fine', absent_before_window: 2}
        - {id: p1-any, kind: regex, pattern: 's\\w+\\(', note: any call}
        - {id: p1-bad, kind: regex, pattern: '('}
        - {id: p1-loop, kind: module, handler: s07_checkpoint}
        - {id: p1-odd, kind: unheard}
  - id: P2
    tier: B
    dormant: true
    detectors:
      python:
        - {id: p2-open, kind: file_absent, anchor: '^open', absent: 'close', require: 'with', absent_before: '# kept', absent_before_window: 1}
        - {id: p2-todo, kind: regex, pattern: 'todo', include_comments: true}
      yaml:
        - {id: p2-y, kind: regex, pattern: 'timeout:'}
boundaries:
  python:
    - {id: b-http, label: HTTP, pattern: 'http\\.get\\(', require: '^import http'}
    - {id: b-call, label: call, pattern: '\\.get\\('}
"""


def test_catalog_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text(CATALOG)
    known = catalog.read_catalog(spark, str(path))
    found = catalog.rules_of(known)
    assert [r.id for r in found] == ["p1-sleep", "p1-any", "p1-bad", "p1-loop", "p2-open", "p2-todo", "p2-y"] and [r.id for r in catalog.rules_of(known, {"P2"})] == ["p2-open", "p2-todo", "p2-y"]
    assert catalog.extensions(known) == {".py": "python", ".pyi": "python", ".yml": "yaml"} and catalog.rule_languages(known) == {"jython": "python"} and catalog.only_with_leads(known) == {"yaml"}
    assert [tuple(r) for r in catalog.dimension(spark, known).collect()] == [("P1", "Waits", "A", 0.5, False), ("P2", None, "B", 0.0, True)]
    raw = "sleep(1) # todo\n# fine\nsleep(2)\nx\nsleep(3)\nsend(4)"
    opened = "with x:\n# kept\nopen(1)\n\nopen(2)\nimport http\nhttp.get(a)\nb.get(c)"
    docs = spark.createDataFrame([(1, raw.replace("# todo", "      "), raw, "python"), (2, opened, opened, "python"), (3, "timeout: 1\nsleep(", "timeout: 1\nsleep(", "yaml"), (4, None, None, "python"), (5, "", "", None)], "doc_id long, code string, text string, lang string")
    got = {(r.doc_id, r.line_no, r.rule, r.group, r.note) for r in rules.run_rules(docs, found, "code", "lang", "text", told=True).collect()}
    assert got == {
        (1, 1, "p1-sleep", "P1", "waits"), (1, 1, "p2-todo", "P2", None), (1, 3, "p1-any", "P1", "any call"), (1, 5, "p1-sleep", "P1", "waits"), (1, 6, "p1-any", "P1", "any call"), (2, 5, "p2-open", "P2", None), (3, 1, "p2-y", "P2", None),
    }
    lines = {(r.doc_id, r.line_no, r.rule, r.label) for r in rules.boundaries(docs, catalog.boundaries_of(known), "code").collect()}
    assert lines == {(2, 7, "b-http", "HTTP"), (2, 8, "b-call", "call")}
    empty = tmp_path / "none.yaml"
    empty.write_text("")
    assert catalog.rules_of(catalog.read_catalog(spark, str(empty))) == []


def test_plan_does_not_grow_with_rules(spark):
    docs = spark.createDataFrame([(1, "a 7 b\nword99"), (2, "word3 word3")], "doc_id long, text string")
    many = [rules.Rule(f"r{i}", i, pattern=rf"\bword{i}\b") for i in range(400)]
    size = [len(rules.run_rules(docs, many[:n])._jdf.queryExecution().optimizedPlan().toString().split("\n")) for n in (1, 400)]
    assert size[0] == size[1]
    assert {(r.doc_id, r.line_no, r.rule) for r in rules.run_rules(docs, many).collect()} == {(1, 2, "r99"), (2, 1, "r3")}
