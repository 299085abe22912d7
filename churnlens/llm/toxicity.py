"""Operator 6: toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values.

Log-odds compare a token's rate in toxic and other labelled texts, under a Dirichlet prior whose shape is the
token's rate in all documents. Tokens that are clearly toxic score their log-odds, all others a small loss, so a text's
expected score is negative and passages stand out. A linear scan finds every maximal passage. The best one's chance under
the extreme-value law of clean texts of that length, and what the other passages add, give the text's score. Both values of
that law, and the logistic curve from evidence to score, are fitted to labelled texts, each scored as if its own words had
not been counted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import held_out, text_of
from churnlens.llm.tokens import _EDGES, Words, core, mix

#: Token numbers; labelled rows that the fit draws at most.
BUCKETS, SAMPLE_ROWS = 1 << 20, 24_000
#: Weight of the prior in tokens; a token is toxic from so many standard errors and so much log-odds; the most it scores.
PRIOR, LEAST_Z, LEAST_ODDS, MOST_ODDS = 2_000.0, 3.0, 2.5, 6.0
#: In the fit of the extreme-value law a clean text's best passage counts as so much at most: one text that repeats one odd word a
#: thousand times must not bend the law. Rates that are tried.
MOST_BEST, RATES = 2 * MOST_ODDS, np.linspace(0.1, 3.0, 117)
#: A toxic text that is missed counts as so many false alarms.
MISS_COST = 2.0
#: A word stands for itself and for what it begins with, so many letters.
STEM = 6
#: What every other token loses.
DRIFT = 0.05
#: Passages whose chance in a clean text is greater than this are not reported.
SIGNIFICANT = 0.05


def tokens(word: str) -> int:
    """The buckets of the word and of its stem (of the word again if it is shorter), in one number."""
    whole = core(word) % BUCKETS
    low = _EDGES.sub("", word.lower())
    return whole | (zlib.crc32(f"{low[:STEM]}-".encode()) % BUCKETS if len(low) >= STEM else whole) << 20


def both(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = numbers.astype(np.int64)
    return n & (BUCKETS - 1), n >> 20


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring passages (first token, end, score) by the linear scan of Ruzzo and Tompa.

    Only positive tokens can begin or end a passage, so the scan steps from one to the next over running sums.
    """
    positive = np.flatnonzero(scores > 0)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[list] = []  # start, end, sum before, sum at the end
    back: list[int] = []  # for each held passage, the nearest earlier one with a smaller sum before it
    for p in positive.tolist():
        start, end, low, high = p, p + 1, float(total[p]), float(total[p + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = back[j]
            if j < 0 or held[j][3] >= high:
                break
            start, low = held[j][0], held[j][2]
            del held[j:], back[j:]
        held.append([start, end, low, high])
        back.append(j)
    return [(s, e, high - low) for s, e, low, high in held]


@dataclass(frozen=True)
class Model:
    """Token scores and the calibration: chance = 1 - exp(-k n exp(-rate s)); score = logistic(slope * evidence + base)."""

    odds: np.ndarray
    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    base: float = -35.0

    def chance(self, best: float, n: int) -> float:
        return -math.expm1(-self.k * max(n, 1) * math.exp(-self.rate * best))

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """-log chance of the best passage, and what each further significant one has over the threshold; at most 60."""
        logs = sorted((-math.log(max(self.chance(s, n), 1e-30)) for _, _, s in found), reverse=True)
        return min(60.0, logs[0] + sum(max(0.0, x + math.log(SIGNIFICANT)) for x in logs[1:])) if logs else 0.0

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.slope * evidence + self.base))))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))


def _labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, limit: int) -> tuple[DataFrame, list[float]]:
    """At most limit rows (doc_id, y) outside the held-out fold, half of each class, by least id hash; and how many rows one of each class stands for."""
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("y").alias("y"))
    all_ = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    drawn = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2) for y in (0, 1)]
    return drawn[0].unionByName(drawn[1]), [max(1.0, all_.get(y, 0) / (limit // 2)) for y in (0, 1)]


def _distinct(docs: DataFrame, chosen: DataFrame) -> dict[int, int]:
    """The chosen rows' labels without near copies: one row of those that share two of four least shingle hashes.

    A toxic text copied twenty times would else make all its rare words look toxic. Bounded by the number chosen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(core)
        for b in batches:
            least = []
            for text in b.column("text"):
                h = words.of(text.as_py().split())
                with np.errstate(over="ignore"):
                    h = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5 << 9) + h[2:] * np.uint64(7 << 18) if len(h) > 2 else h
                    least.append([int(mix(h * np.uint64(2 * i + 1) + np.uint64(i)).min() >> np.uint64(1)) if len(h) else i for i in range(4)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "y", "least"])

    known: dict[int, int] = {}
    seen: set[tuple[int, int]] = set()
    drawn = _texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, y int, least array<long>")
    for r in drawn.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # limit rows
        own = set(enumerate(r["least"]))
        if len(own & seen) < 2:  # two, as one may lie in a passage that many texts quote
            known[r["doc_id"]] = r["y"]
        seen |= own
    return known


def counts(docs: DataFrame, known: dict[int, int]) -> DataFrame:
    """bucket, everywhere, toxic, other: tokens of all documents; toxic and other labelled texts that have the token. At most BUCKETS rows."""
    sent = docs.sparkSession.sparkContext.broadcast(known)  # bounded by SAMPLE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, label = Words(tokens), sent.value
        sums = np.zeros((3, BUCKETS), np.int64)
        for b in batches:
            held: list[np.ndarray] = []
            size = 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.concatenate(both(words.of(text.as_py().split())))
                held.append(own)
                size += len(own)
                if (y := label.get(doc_id)) is not None:
                    sums[2 - y][np.unique(own)] += 1  # once a text, as a text may repeat one word at will
                if size > BUCKETS:
                    sums[0] += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
            if held:
                sums[0] += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(s[at]) for s in sums)], names=["bucket", "everywhere", "toxic", "other"])

    made = _texts(docs).mapInArrow(run, "bucket long, everywhere long, toxic long, other long")
    return made.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("everywhere", "toxic", "other")))


@dataclass(frozen=True)
class Counts:
    """Of each bucket: tokens in all documents, toxic and other labelled texts that have it. At most BUCKETS numbers each."""

    everywhere: np.ndarray
    toxic: np.ndarray
    other: np.ndarray

    @cached_property
    def totals(self) -> tuple[float, float, float]:
        return float(self.everywhere.sum()), float(self.toxic.sum()), float(self.other.sum())

    def scores(self, at: np.ndarray | slice = slice(None), label: int | None = None) -> np.ndarray:
        """Scores of the buckets at: the log-odds of clearly toxic ones, -DRIFT for the rest.

        Given a label, as they are without a labelled text of that label that has just these buckets.
        """
        n = 0 if label is None else len(at)
        toxic, other = self.toxic[at] - (label == 1), self.other[at] - (label == 0)
        tokens_, toxic_, other_ = self.totals
        prior = PRIOR * self.everywhere[at] / max(1.0, tokens_)
        all_toxic, all_other = toxic_ - n * (label == 1) + PRIOR, other_ - n * (label == 0) + PRIOR
        y, x = np.maximum(toxic, 0) + prior, np.maximum(other, 0) + prior
        with np.errstate(divide="ignore", invalid="ignore"):  # a bucket that no document has
            odds = np.log(y / (all_toxic - y)) - np.log(x / (all_other - x))
            z = odds / np.sqrt(1 / y + 1 / x)
        return np.where((prior > 0) & (z >= LEAST_Z) & (odds >= LEAST_ODDS), np.minimum(odds, MOST_ODDS), -DRIFT)


def extremes(clean: list[tuple[float, int]]) -> tuple[float, float]:
    """The rate and k of chance(s) = 1 - exp(-k n exp(-rate s)), of greatest likelihood for the best passages (score, tokens) of clean texts.

    A text with no passage says that its best is 0 or less. One more text, of mean length and with a best passage of half the
    most a token scores, keeps both values finite where all clean texts have none.
    """
    if not clean:
        return 1.0, 1.0
    n = np.array([x for _, x in clean] + [np.mean([x for _, x in clean])], float)
    best = np.minimum(np.array([s for s, _ in clean] + [MOST_ODDS / 2]), MOST_BEST)
    some = best > 0
    found = []
    for rate in RATES:
        falls = n * np.exp(-rate * best)
        k = some.sum() / falls.sum()
        found.append((float((np.log(k * rate * n[some]) - rate * best[some]).sum() - k * falls.sum()), float(rate), float(k)))
    return max(found)[1:]


def calibrate(odds: np.ndarray, best: list[tuple[int, list[tuple[int, int, float]], int]], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit the extreme-value law to the best passages of clean texts, then the logistic curve to evidence; rows are (y, passages, n)."""
    rate, k = extremes([(max((s for *_, s in found), default=0.0), max(n, 1)) for y, found, n in best if y == 0])
    first = Model(odds, rate, k)
    x = np.array([first.evidence(found, n) for _, found, n in best])
    y = np.array([y for y, *_ in best], float)
    if not len(y) or y.min() == y.max():
        return first
    weight = np.where(y == 1, MISS_COST * stands_for[1], stands_for[0])
    slope, base = 0.0, 0.0
    for _ in range(50):  # Newton steps with a slight ridge, so that separable rows settle
        p = 1 / (1 + np.exp(-np.clip(slope * x + base, -35, 35)))
        w = weight * p * (1 - p) + 1e-9
        r = weight * (p - y)
        g = np.array([(r * x).sum() + 0.1 * slope, r.sum() + 0.1 * base])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, base = slope - step[0], base - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(odds, rate, k, float(slope), float(base))


def _without_own(docs: DataFrame, known: DataFrame, sums: Counts) -> DataFrame:
    """y, n_tokens and spans of the labelled texts, each scored by the counts of the others."""
    sent = docs.sparkSession.sparkContext.broadcast(sums)  # three times BUCKETS numbers
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("sum", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokens)
        for b in batches:
            n, spans = [], []
            for y, text in zip(b.column("y").to_pylist(), b.column("text"), strict=True):
                pair = np.stack(both(words.of(text.as_py().split())))
                at, back = np.unique(pair, return_inverse=True)
                scores = sent.value.scores(at, y)[back].reshape(pair.shape).max(axis=0)
                n.append(pair.shape[1])
                spans.append([{"first": s, "end": e, "sum": v} for s, e, v in segments(scores)])
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(span))], names=["y", "n_tokens", "spans"])

    return _texts(docs).join(known, "doc_id").select("y", "text").mapInArrow(run, "y int, n_tokens long, spans array<struct<first: long, end: long, sum: double>>")


def passages(docs: DataFrame, odds: np.ndarray) -> DataFrame:
    """doc_id, n_tokens and spans: every maximal passage as first token, end and log-odds sum."""
    sent = docs.sparkSession.sparkContext.broadcast(odds.astype("<f4"))  # BUCKETS floats
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("sum", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        words = Words(tokens)
        for b in batches:
            n, spans = [], []
            for text in b.column(1):
                word, stem = both(words.of(text.as_py().split()))
                n.append(len(word))
                spans.append([{"first": s, "end": e, "sum": v} for s, e, v in segments(np.maximum(table[word], table[stem]).astype(float))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(span))], names=["doc_id", "n_tokens", "spans"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, spans array<struct<first: long, end: long, sum: double>>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, limit: int = SAMPLE_ROWS) -> Model:
    """Token scores and calibration. Counts cover all documents; labels come from at most limit rows outside the held-out fold, half of each class."""
    chosen, stands_for = _labelled(docs, labels, label, folds, fold, limit)
    known = _distinct(docs, chosen)  # limit rows at most
    sums = np.zeros((3, BUCKETS))
    told = counts(docs, known).toArrow()  # BUCKETS rows of four numbers
    sums[:, told.column("bucket").to_numpy()] = [told.column(c).to_numpy() for c in ("everywhere", "toxic", "other")]
    held = Counts(*sums)
    drawn = F.broadcast(docs.sparkSession.createDataFrame(list(known.items()), "doc_id long, y int"))
    best = [(r[0], [tuple(s) for s in r[2]], r[1]) for r in _without_own(docs, drawn, held).collect()]  # limit rows
    return calibrate(held.scores(), sorted(best), tuple(stands_for))


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """passages with those that are not significant left out, and the text's score. Null counts as empty; all rows stay."""
    k, rate, slope, base = model.k, model.rate, model.slope, model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(np.zeros(0), rate, k, slope, base)
        for b in batches:
            score, kept = [], []
            for n, spans in zip(b.column("n_tokens").to_pylist(), b.column("spans").to_pylist(), strict=True):
                score.append(own.score(own.evidence([(s["first"], s["end"], s["sum"]) for s in spans], n)))
                kept.append([s for s in spans if own.chance(s["sum"], n) <= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(kept, b.schema.field("spans").type), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "spans", "score"])

    return passages(docs, model.odds).mapInArrow(run, "doc_id long, n_tokens long, spans array<struct<first: long, end: long, sum: double>>, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages for each row; held_out is false for a null id."""
    found = detect(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_passages"))
