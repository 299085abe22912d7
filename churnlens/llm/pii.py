"""Operator 7: personal data as spans, by boosted trees over candidates, in DataFrame functions alone.

Generators propose spans of each kind: the base patterns, whose valid matches always stay, and wider ones of high recall that
match other spellings too and overlap them. Boosted trees judge the wider candidates by format and context. Their labels
are what the features do not hold: a wide candidate on a valid base span of its kind is one, and a look-alike is none, that
is, one on a base match that failed its test or is of another kind, or an address sign with no domain. What is neither is
what the trees are for. Format and context make a few small categories, so counts of their combinations, at most some ten
thousand rows, are all that boosting needs. Thresholds come from documents that the trees did not see. Wide candidates at
or above their kind's threshold are added where no base span lies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import SCANNED, blocks, clusters, let, scan, staged, text_of

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive where giving back characters could not make a match, so that long runs cost linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns of the same kinds: spelled-out addresses, address groups in hexadecimal, card groups parted by other marks, numbers with no plus.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[({]at[\])}]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]{1,63}+)*+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,4}+(?:\.[0-9]{1,4}+){3,}+|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9+])(?<![0-9][._/\x20-])[0-9](?:[._/\x20-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][\x20().-])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,18}+(?![0-9])",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": r"@|[\[({]at[\])}]", "ip": "[.:][0-9A-Fa-f]", "card": "[0-9]", "phone": "[0-9]"}
CONTEXT = {"email": "(?i)(mail|contact|write|reach)", "ip": "(?i)(ip|host|server|address)", "card": "(?i)(card|visa|credit|pay|account)", "phone": "(?i)(tel|phone|call|fax|mobile|cell)"}
#: Number of alphanumeric groups (5 and more alike), length of the longest and of the last (3 and less, 4, 5 and more), the mark
#: between groups, whether brackets occur, classes of the neighbours, and words of this and of other kinds before it.
FEATURES = ("kind", "groups", "longest", "last", "parting", "bracket", "before", "after", "context", "other")
ROUNDS, RATE, LEAST_LEAF, PRECISION = 25, 0.4, 5, 0.9
#: One document in FOLDS sets thresholds and teaches no tree. Pseudo-counts at PRECISION stand beside a kind's labels there.
FOLDS, PSEUDO = 4, 10
#: Log-odds that a word of the kind before a candidate is worth before any label is seen.
CONTEXT_PRIOR = 1.0
SPAN = "struct<kind: int, base: boolean, start: long, end: long, valid: boolean, groups: int, longest: int, last: int, parting: int, bracket: int, before: int, after: int, context: int, other: int>"


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum, every second one from the right doubled, is a multiple of ten."""
    back = F.reverse(digits)
    # characters 0 to 9 in even places stand for themselves, in odd places for their doubled digit sum
    value = F.transform(F.split(back, "(?<=.)(?=.)"), lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.try_to_number(c, F.lit("9")).cast("int") + 1)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def is_valid(kind: str, s: Column) -> Column:
    """The test that a match of the kind's base pattern must pass."""
    n = F.length(_digits(s))
    if kind == "ip":
        return ~F.exists(F.split(s, r"\."), lambda part: F.coalesce(part.try_cast("decimal(38,0)") > 255, F.lit(True)))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _side(c: Column) -> Column:
    """Class of a neighbouring character: 0 none or blank, 1 letter, 2 digit, 3 bracket or quote, 4 other mark."""
    return F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[()\\[\\]\"'<>]"), 3).otherwise(4)


def _found(text: Column, kind: str, base: bool) -> Column:
    """Spans of one pattern in text: start, end (code points, end exclusive), valid, the features; empty where nothing matches."""
    pattern = (BASE if base else WIDE)[kind]
    # lengths between and of matches, in turn, give the places: split and the list of matches walk alike
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(p: Column) -> Column:
        # the part after the last match goes along with a null match, for the character that follows
        sizes = scan(p, F.lit(0), lambda at, x: at + F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)), "bigint")
        put = lambda at: F.transform(p, lambda x, i: F.struct((F.get(at, i) + F.length(x["g"])).alias("start"), (F.get(at, i) + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("m"), F.right(x["g"], F.lit(24)).alias("left"), F.substring(F.get(p, i + 1)["g"], 1, 1).alias("right")))
        return F.filter(let(sizes, put), lambda x: x["m"].isNotNull())

    parts = lambda m: F.filter(F.split(m, "[^0-9A-Za-z]+"), lambda g: g != "")
    bucket = lambda n: F.when(n <= 3, 0).when(n == 4, 1).otherwise(2)
    others = "(?i)(" + "|".join(CONTEXT[k].removeprefix("(?i)") for k in KINDS if k != kind) + ")"
    spans = F.transform(let(pairs, placed), lambda p: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), p["start"].alias("start"), p["end"].alias("end"),
        is_valid(kind, p["m"]).alias("valid"),
        F.least(F.size(parts(p["m"])), F.lit(5)).alias("groups"),
        bucket(F.array_max(F.transform(parts(p["m"]), lambda g: F.length(g)))).alias("longest"),
        bucket(F.length(F.element_at(parts(p["m"]), -1))).alias("last"),
        F.when(p["m"].rlike("-"), 2).when(p["m"].rlike(r"\x20"), 1).when(p["m"].rlike(r"\."), 3).when(p["m"].rlike(":"), 4).otherwise(0).alias("parting"),
        p["m"].rlike(r"[\[({]").cast("int").alias("bracket"),
        _side(F.right(p["left"], F.lit(1))).alias("before"),
        _side(F.coalesce(p["right"], F.lit(""))).alias("after"),
        p["left"].rlike(CONTEXT[kind]).cast("int").alias("context"),
        p["left"].rlike(others).cast("int").alias("other"),
    ))
    return F.when(text.rlike(HINT[kind]) & text.rlike(pattern), spans.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(text: Column) -> Column:
    """Array of every generator's proposals in a text column."""
    return F.concat(*(_found(text, kind, base) for base in (True, False) for kind in KINDS))


def _codes(c: Column) -> list[Column]:
    """The features as whole numbers, in the order of FEATURES."""
    return [c[f] for f in FEATURES]


def _crosses(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _sorted(cands: Column) -> Column:
    """Candidates by their start; the rest of the order is of no account."""
    return F.array_sort(cands, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def labelled(cands: Column) -> Column:
    """The wide candidates with y: 1 on a valid base span of their kind, 0 on any other base match, null where none lies.

    An e-mail candidate with its sign that is on no base match failed for want of a domain: its parting is not a word in
    brackets, so it is 0 too.
    """

    def one(cluster: Column) -> Column:
        def judged(c: Column, base: Column) -> Column:
            good = F.exists(base, lambda b: _crosses(b, c) & b["valid"] & (b["kind"] == c["kind"]))
            bad = F.exists(base, lambda b: _crosses(b, c)) | ((c["kind"] == KINDS.index("email")) & (c["bracket"] == 0))
            return F.struct(*(c[f].alias(f) for f in FEATURES), F.when(good, 1).when(bad, 0).alias("y"))

        return let(F.filter(cluster, lambda c: c["base"]), lambda base: F.transform(F.filter(cluster, lambda c: ~c["base"]), lambda c: judged(c, base)))

    return F.flatten(F.transform(clusters(_sorted(cands)), one))


@dataclass
class Boosted:
    """Sum of small trees over the features; least says from what probability each kind's candidates are taken."""

    base: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    least: dict[int, float] = field(default_factory=dict)

    def margin(self, x: tuple) -> float:
        out = self.base + CONTEXT_PRIOR * x[FEATURES.index("context")]
        for f, at, low, high in self.trees:
            g, cut, a, b = high if x[f] > at else low
            out += b if x[g] > cut else a
        return out

    def column(self, codes: list[Column]) -> Column:
        """The probability as a Column over the features' columns."""
        out = F.lit(self.base) + CONTEXT_PRIOR * codes[FEATURES.index("context")]
        for f, at, low, high in self.trees:
            leaf = lambda node: F.when(codes[node[0]] > node[1], F.lit(node[3])).otherwise(F.lit(node[2]))
            out = out + F.when(codes[f] > at, leaf(high)).otherwise(leaf(low))
        return 1 / (1 + F.exp(-out))


def _best(rows: list[tuple], g: list[float], h: list[float], members: list[int]) -> tuple[float, tuple]:
    """The cut of members that gains most: (gain, (feature, cut, low value, high value))."""
    sum_g, sum_h = sum(g[i] for i in members), sum(h[i] for i in members)
    value = lambda a, b: -RATE * a / (b + 1.0)
    best = (0.0, (0, 1 << 30, value(sum_g, sum_h), 0.0))
    for f in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for i in members:
            own = by.setdefault(rows[i][0][f], [0.0, 0.0, 0.0])
            own[0] += g[i]
            own[1] += h[i]
            own[2] += rows[i][1] + rows[i][2]
        a = b = n = 0.0
        total = sum(x[2] for x in by.values())
        for cut in sorted(by)[:-1]:
            a, b, n = a + by[cut][0], b + by[cut][1], n + by[cut][2]
            if min(n, total - n) >= LEAST_LEAF:
                gain = a * a / (b + 1) + (sum_g - a) ** 2 / (sum_h - b + 1) - sum_g**2 / (sum_h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut, value(a, b), value(sum_g - a, sum_h - b)))
    return best


def boost(rows: list[tuple[tuple[int, ...], int, int]], held: list[tuple[tuple[int, ...], int, int]]) -> Boosted:
    """Boosted trees of depth two from (features, ones, noughts) counts, by Newton steps on the logistic loss; thresholds from the counts held back.

    A kind's threshold is the least probability above 0.5 from which PRECISION of the labels held back, and of the pseudo-counts
    beside them, are ones: where all of them are good enough, or none were held back, that is 0.5.
    """
    rows = sorted(rows)
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    model = Boosted(math.log((good + 1) / (bad + 1)))
    margin = [model.margin(r[0]) for r in rows]
    for _ in range(ROUNDS if good and bad else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [q * (r[1] + r[2]) - r[1] for q, r in zip(p, rows, strict=True)]
        h = [q * (1 - q) * (r[1] + r[2]) for q, r in zip(p, rows, strict=True)]
        gain, (f, cut, *_) = _best(rows, g, h, list(range(len(rows))))
        if gain <= 1e-6:
            break
        sides = [_best(rows, g, h, [i for i, r in enumerate(rows) if (r[0][f] > cut) == s])[1] for s in (False, True)]
        model.trees.append((f, cut, *sides))
        margin = [model.margin(r[0]) for r in rows]
    for kind in range(len(KINDS)):
        own = sorted(((1 / (1 + math.exp(-model.margin(x))), a, b) for x, a, b in held if x[0] == kind), reverse=True)
        ones, every, good = PRECISION * PSEUDO, PSEUDO, -1
        for i, (_, a, b) in enumerate(own):
            ones, every = ones + a, every + a + b
            if ones >= PRECISION * every - 1e-9:
                good = i
        # half way between the last that is good enough and the next, which spoils it
        cut = 0.5 if good == len(own) - 1 else own[0][0] if good < 0 else (own[good][0] + own[good + 1][0]) / 2
        model.least[kind] = max(0.5, cut) + 1e-9
    return model


def fit(found: DataFrame) -> Boosted:
    """The model from a table with doc_id and the array column cands. Counts cover all its rows; what is collected has a row per combination of features, some ten thousand at most."""
    one = found.select((F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("held"), F.explode(labelled(F.col("cands"))).alias("c")).where("c.y is not null")
    counts = one.groupBy("held", *(x.alias(f) for x, f in zip(_codes(F.col("c")), FEATURES, strict=True))).agg(F.sum("c.y").alias("ones"), F.sum(1 - F.col("c.y")).alias("noughts")).collect()
    rows = {held: [(tuple(r[1:-2]), r[-2], r[-1]) for r in counts if r[0] == held] for held in (False, True)}
    return boost(rows[False], rows[True])


def chosen(cands: Column, model: Boosted) -> Column:
    """Spans (start, end, kind, base) in order: all valid base ones, and added ones clear of them and of better added ones."""
    better = lambda a, b: (b["p"] > a["p"]) | ((b["p"] == a["p"]) & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["kind"] < a["kind"]))))
    shape = lambda xs, own: F.transform(xs, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), F.lit(own).alias("base")))

    def one(cluster: Column) -> Column:
        """What crosses a candidate is in its own cluster."""
        base = F.filter(cluster, lambda c: c["base"] & c["valid"])
        wide = F.filter(F.transform(F.filter(cluster, lambda c: ~c["base"]), lambda c: F.struct(c["start"], c["end"], c["kind"], model.column(_codes(c)).alias("p"))), lambda c: _taken(c, model))
        both = F.struct(base.alias("base"), wide.alias("wide"))
        clear = lambda x: F.filter(x["wide"], lambda a: ~F.exists(x["base"], lambda b: _crosses(a, b)) & ~F.exists(x["wide"], lambda b: _crosses(a, b) & better(a, b)))
        return let(both, lambda x: F.concat(shape(x["base"], True), shape(clear(x), False)))

    none = F.array().cast("array<struct<start: long, end: long, kind: int, base: boolean>>")
    return F.when(F.size(cands) == 0, none).otherwise(F.array_sort(F.flatten(F.transform(clusters(_sorted(cands)), one))))


def _taken(c: Column, model: Boosted) -> Column:
    out = F.lit(False)
    for kind, least in model.least.items():
        out = out | ((c["kind"] == kind) & (c["p"] >= least))
    return out


def listed(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row.

    A null or empty text has no spans: counts 0, the SHA-256 of the empty string, spans empty. Repeated rows and null ids are
    searched one by one; other columns are not read. Candidates are staged in the shared folder without the texts, so that
    texts are read once.
    """
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    found = staged(text.select("doc_id", candidates(F.col("text")).alias("cands")))
    model = fit(found)
    spans = found.select("doc_id", chosen(F.col("cands"), model).alias("s"))
    base = F.filter("s", lambda s: s["base"])
    number = lambda k: F.size(F.filter("s", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"), F.size(F.filter("s", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, or each run of overlapping spans, as its kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    one = lambda c: F.struct(F.get(c, 0)["start"].alias("start"), F.array_max(F.transform(c, lambda s: s["end"])).alias("end"), F.get(c, 0)["kind"].alias("kind"))
    cut = lambda t, begin, end: F.substr(t, (begin + 1).cast("int"), (end - begin).cast("int"))

    def part(spans_: Column, begin: Column) -> Column:
        """The text from begin to the last of some spans, cut from the whole once."""
        last = F.get(spans_, F.size(spans_) - 1)["end"]
        inner = lambda t: F.array_join(F.transform(spans_, lambda s, i: F.concat(cut(t, F.when(i > 0, F.get(spans_, i - 1)["end"]).otherwise(begin) - begin, s["start"] - begin), F.element_at(names, s["kind"] + 1))), "")
        return let(cut(text, begin, last), inner)

    def whole(runs: Column) -> Column:
        ends = F.get(runs, F.size(runs) - 1)["end"]
        begin = lambda k: F.when(k > 0, F.get(runs, k * SCANNED - 1)["end"]).otherwise(F.lit(0).cast("long"))
        pieces = let(blocks(runs), lambda parts: F.transform(parts, lambda p, k: let(begin(k), lambda at: part(p, at))))
        return F.concat(F.array_join(pieces, ""), F.substr(text, (ends + 1).cast("int")))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.transform(clusters(spans), one), whole))


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text put out and n_chars, where docs has it, counted anew; null texts stay null."""
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    # the rows are staged with their candidates, which are made once
    found = staged(docs.select(row, docs["doc_id"].alias("doc_id"), candidates(text_of(docs)).alias("cands")))
    model = fit(found)
    text = F.col("row.text").cast("string")
    out = found.select("row", redacted(text, chosen(F.col("cands"), model)).alias("put"))
    put = {"text": F.col("put").alias("text"), "n_chars": F.length("put").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {"text": F.col("put").alias("text")}
    return out.select(*(put.get(c, F.col("row")[c].alias(c)) for c in docs.columns))
