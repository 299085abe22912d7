"""Near copies: texts whose SimHash fingerprints differ in two bits or fewer, and all others at a set similarity.

Fingerprints come first, as in operator 1: Golay keys, candidates that share one, verified by their bits. They miss many pairs
whose five-word shingles have a Jaccard similarity of 0.8 or more, above all where a block was cut or added. The exact way
for these has shingles for keys, and leaves out only pairs that fingerprints have put into one class. Two sets of
0.8 share at least 0.8 of the larger one, hence in any common order one of the first 0.2 of each (and one more): these are
a text's keys. The order puts shingles last that are frequent in a sample, so common lines and passages are rarely keys;
the sample changes the work only, never the result. The place of a key in both texts bounds what they can share: at the
first key that two similar texts share, neither has more before it than may differ. Texts of one key are first compared
with three of its texts, those whose shingles are shared from the earliest place on, which takes time in proportion to
the key. What links leave in more than one class is then paired within the key, under the same bound.

Of a text, what is kept and shuffled is its keys and a bit or two a shingle; shingles are made again from the texts of
pairs that the bits do not rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import BROADCAST_ROWS, fresh, sized, staged, text_of
from churnlens.llm.simhash import fingerprint, near_pairs
from churnlens.operators.components import components

SIMILARITY, SHINGLE = 0.8, 5
#: About so many texts, at most one in LEAST_STEP, tell which shingles are frequent; so many of the most frequent are put last.
SAMPLE, LEAST_STEP, FREQUENT = 20_000, 8, 200_000
#: A text's parity map has so many bits at least.
MAP_BITS = 512
#: Each text of a key is compared with so many of the key's texts before what is left is paired.
PIVOTS = 3
#: Shared keys, one long each, are broadcast up to so many; beyond, a bit map of them, eight bits a key and MARK_BITS at most.
BROADCAST_KEYS, MARK_BITS = 2_000_000, 1 << 29
#: Texts whose shingles a verifying task remembers.
REMEMBERED = 64


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles, or of the whole sequence where there are fewer words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)).view(np.int64))


def prefix(s: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which sets that are similar share one: the first in the order of (count, hash); frequent is sorted. Zero stands for no shingle."""
    if not len(s):
        return np.zeros(1, np.int64)
    count = np.zeros(len(s), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        count = np.where(frequent[at] == s, counts[at], 0)
    return s[np.lexsort((s, count))][: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]


def parity(s: np.ndarray) -> np.ndarray:
    """A map, 64 bits a long, of at least as many bits as there are shingles, a power of two: a bit says whether an odd number of them fall on it."""
    bits = MAP_BITS
    while bits < len(s):
        bits *= 2
    odd = np.bincount((s.view(np.uint64) >> np.uint64(11)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def marked(df: DataFrame, column: str, keys: DataFrame, into: str) -> DataFrame:
    """df with a boolean, into: false only where column is not among keys (one column of longs). A bit map of the keys is broadcast, not the keys."""
    bits = min(MARK_BITS, max(1 << 15, 1 << (8 * keys.count()).bit_length()))
    block, of, long = fresh(df, "block", "block_of", "longs")
    at = lambda x: F.pmod(F.col(x), F.lit(bits))
    (key,) = keys.columns
    maps = keys.groupBy(F.shiftright(at(key), 15).alias(block)).agg(F.bitmap_construct_agg(at(key).bitwiseAND(F.lit(0x7FFF))).alias("map"))
    longs = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("map", 8 * i + 1, F.lit(8))), 16, -10).cast("long"))
    maps = staged(maps.select(block, longs.alias(long)))
    place = f"pmod(`{column}`, {bits}L)"
    # bytes of a map are in order of place, bits within a byte from the least
    bit = F.expr(f"shiftright(get(`{long}`, cast(shiftright({place}, 6) & 511 as int)), cast(56 - ({place} & 56) + ({place} & 7) as int)) & 1")
    joined = df.withColumn(of, F.shiftright(at(column), 15)).join(F.broadcast(maps), F.col(of) == F.col(block), "left")
    return joined.withColumn(into, F.coalesce(bit == 1, F.lit(False))).drop(block, of, long)


def among(df: DataFrame, column: str, keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of df whose column is among keys, a staged table of that column. Beyond so many keys, the rows that are surely not are left out before any shuffle."""
    if keys.count() <= rows:
        return df.join(F.broadcast(keys), column, "left_semi")
    (may,) = fresh(df, "may")
    return marked(df, column, keys, may).where(may).drop(may).join(keys, column, "left_semi")


def beside(df: DataFrame, column: str, table: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df left joined to table, a staged one, where column equals key. Beyond so many rows, only the rows of df that may meet one are shuffled."""
    if table.count() <= rows:
        return df.join(F.broadcast(table), F.col(column) == F.col(key), "left")
    (may,) = fresh(df, "may")
    told = marked(df, column, table.select(key), may)
    return told.where(may).join(table, F.col(column) == F.col(key), "left").unionByName(told.where(~F.col(may)), allowMissingColumns=True).drop(may)


def with_id(docs: DataFrame) -> DataFrame:
    """id, doc_id and text; equal texts have equal ids (64 bits of hash, so that strangers share one by no real chance)."""
    text = text_of(docs)
    return docs.select(F.xxhash64(text).alias("id"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))


def _unlike_left_out(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """The pairs without those whose maps differ too much: each bit that differs stands for a shingle that one set alone has,
    and similar sets have at most (1 - t) / (1 + t) of both sizes. Of two maps the longer is folded to the other's length."""
    a, b = (maps.select(F.col("id").alias(x), F.col("bits").alias(f"m{x}"), F.col("size").alias(f"n{x}")) for x in "ab")
    first = F.size("ma") <= F.size("mb")
    short, long = F.when(first, F.col("ma")).otherwise(F.col("mb")), F.when(first, F.col("mb")).otherwise(F.col("ma"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", short.alias("short"), long.alias("long"))
    folded = lambda j: F.aggregate(F.sequence(j, F.size("long") - 1, F.size("short")), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get("long", k)))
    differ = F.aggregate(F.transform("short", lambda x, j: F.bit_count(x.bitwiseXOR(folded(j)))), F.lit(0), lambda s, x: s + x)
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("na") + F.col("nb")) + 1e-6
    return both.where(differ <= most).select("a", "b")


def _frequent(texts: DataFrame, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles found more than once in about SAMPLE texts or fewer, the FREQUENT most frequent of them, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()))], names=["s"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(max(LEAST_STEP, distinct // SAMPLE))) == 0).select("text")
    seen = some.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    got = seen.orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    s, n = got.column("s").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _fit(x: str, y: str, similarity: float) -> Column:
    """Whether two sets (size, pos) that share a shingle at these places, and none before, can be similar; the margin is for rounding.

    Similar sets share similarity / (1 + similarity) of both sizes; these share at most what follows the place in either.
    """
    most = F.least(F.col(f"{x}.size") - F.col(f"{x}.pos"), F.col(f"{y}.size") - F.col(f"{y}.pos"))
    return most >= F.lit(similarity / (1 + similarity)) * (F.col(f"{x}.size") + F.col(f"{y}.size")) - 1e-6


def _pair(x: str, y: str) -> tuple[Column, Column]:
    return F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")


def _pivot_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """a < b: each text with the pivots of its keys. Pivots are least over all of a key's texts, so nothing is gathered in one task."""
    place = F.struct((F.col("pos") / F.greatest("size", F.lit(1))).alias("share"), "id", "size", "pos")
    least = [F.min(F.when(F.pmod("id", F.lit(PIVOTS)) == i, place)) for i in range(PIVOTS)]
    pivots = staged(members.groupBy("key").agg(F.array_compact(F.array(*least)).alias("pivots")))
    own = F.struct("id", "size", "pos").alias("x")
    return members.join(pivots, "key").select(own, F.explode("pivots").alias("y")).where(F.col("x.id") != F.col("y.id")).where(_fit("x", "y", similarity)).select(*_pair("x", "y")).distinct()


def _open_pairs(members: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """a < b: all pairs of one key and two classes that its place lets be similar."""
    now = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", F.struct("id", "size", "pos", F.coalesce("root", "id").alias("root")).alias("x"))
    now = staged(now)
    mixed = staged(now.groupBy("key").agg(F.min("x.root").alias("lo"), F.max("x.root").alias("hi")).where("lo < hi").select("key"))
    left = staged(now.join(sized(mixed), "key", "left_semi"))
    right = left.select("key", F.col("x").alias("y"))
    return left.join(right, "key").where("x.id < y.id and x.root <> y.root").where(_fit("x", "y", similarity)).select(*_pair("x", "y")).distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id, root, first, copies, rows for each distinct text: its class, its smallest doc_id, how many rows have text and that doc_id, how many have the text.

    Texts with the same root are near copies or linked by some. An empty or null text is one more text. An empty table gives no rows.
    """
    texts = with_id(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    exact = staged(texts.groupBy("id", "doc_id").agg(F.count("*").alias("k")).groupBy("id").agg(F.min(order).alias("first"), F.min_by("k", order).alias("copies"), F.sum("k").alias("rows")))
    frequent, counts = _frequent(texts, exact.count())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([parity(s) for s in sets], [prefix(s, similarity, frequent, counts) for s in sets])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(fps), *lists], names=["id", "size", "fp", "bits", "keys"])

    # of equal texts the row of least doc_id speaks for all
    again = staged(exact.where("rows > 1").select(F.col("id").alias("of"), F.col("first.doc_id").alias("by"), "copies"))
    once = beside(texts, "id", again, "of").where(F.col("of").isNull() | F.col("doc_id").eqNullSafe(F.col("by")))
    if not exact.where("copies > 1").isEmpty():
        more = F.coalesce("copies", F.lit(1)) > 1  # rows that repeat text and doc_id
        once = once.where(~more).unionByName(once.where(more).dropDuplicates(["id"]))
    once = once.select("id", "text")
    known = staged(once.mapInArrow(told, "id long, size int, fp long, bits array<long>, keys array<long>"))
    roots = _linked(known, once, similarity)
    return exact.join(roots, exact["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"), "first", "copies", "rows")


def _members(known: DataFrame) -> DataFrame:
    """key, id, size, pos: each text under those of its keys that it shares."""
    rows = known.select("id", "size", F.posexplode("keys").alias("pos", "key"))
    shared = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    return staged(among(rows, "key", shared, BROADCAST_KEYS).select("key", "id", "size", "pos"))


def _by_fingerprint(known: DataFrame) -> DataFrame:
    """node, root for each text that its fingerprint links to others: the least id of those that links of two bits or fewer connect."""
    fps = components(near_pairs(known.select("fp").distinct()))
    rooted = staged(known.join(sized(staged(fps)), known["fp"] == F.col("node"), "left").select("id", F.coalesce("root", "fp").alias("class")))
    named = staged(rooted.groupBy("class").agg(F.min("id").alias("root"), F.count("*").alias("n")).where("n > 1").select("class", "root"))
    return staged(rooted.join(sized(named), "class").select(F.col("id").alias("node"), "root"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of two classes."""
    roots = sized(roots)
    for x in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _linked(known: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """node, root of what near fingerprints and similar pairs connect. A pair is left out only where both are of one class by links found before."""
    alike = _by_fingerprint(known)
    members, maps = _members(known), known.select("id", "size", "bits")
    links = _similar(_apart(staged(_pivot_pairs(members, similarity)), alike), maps, texts, similarity)
    links = links.unionByName(alike.select(F.col("root").alias("a"), F.col("node").alias("b")))
    roots = staged(components(links))
    more = _similar(_open_pairs(members, roots, similarity), maps, texts, similarity)
    return roots if more.isEmpty() else components(links.unionByName(more))


def _similar(pairs: DataFrame, maps: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b that are similar: those whose maps do not rule it out, verified on the shingles of both texts."""
    pairs = staged(_unlike_left_out(staged(pairs), maps, similarity))
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    needed = staged(among(texts, "id", ids), codec="zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(REMEMBERED)(shingles)  # pairs of a text come one after another
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = of(x.as_py()), of(y.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                # of two empty sets the share is 0 / 0: equal texts never get here, so those are blanks of different kinds, which are alike
                alike.append(both >= similarity * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    a, b = (needed.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return staged(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: the one of least doc_id (nulls last; of repeated rows any).

    Rows in classes of one stay untouched. Columns and their order are those of docs, whatever their names.
    """
    found = staged(classes(docs, similarity))
    best = found.groupBy("root").agg(F.min(F.struct("first", "id")).alias("best"), F.sum("rows").alias("all"))
    of, id_, keep, copies = fresh(docs, "of", "id", "keep", "copies")
    # only classes of more than one row are told; keep is null but for the text that stays
    told = found.join(best, "root").where("all > 1").select(F.col("id").alias(id_), F.when(F.col("id") == F.col("best.id"), F.col("first")).alias(keep), F.col("copies").alias(copies))
    joined = beside(docs.withColumn(of, F.xxhash64(text_of(docs))), of, staged(told), id_)
    stays = F.col(id_).isNull() | (F.col(keep).isNotNull() & F.col(keep)["doc_id"].eqNullSafe(F.col("doc_id").cast("long")))
    kept = joined.where(stays)
    single = F.coalesce(F.col(copies), F.lit(1)) == 1
    once = kept.where(single).select(*docs.columns)
    more = kept.where(~single).dropDuplicates([of]).select(*docs.columns)
    return once.unionByName(more)
