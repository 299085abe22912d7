"""Operator 12: nearest neighbours by an inverted multi-index.

Each vector is cut into two halves and each half is put to the nearest of its own centroids, so a pair of centroids is a
cell. A query walks the pairs by summed squared distance with a heap, nearest first, until the cells it has met hold
enough entries, and these are then compared with it in double precision. How many are enough is measured, not decreed:
a bounded number of queries is compared with every entry, and the walk's length is what meets RECALL of their neighbours.

Equal vectors are one entry with their least ids: more than the k + 1 least of them cannot be among anybody's k nearest. So a
vector that a third of the table shares costs what one vector costs, as entry and as query.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import staged

#: Entries a cell holds on average; centroids of a half at most; rows that centroids are fitted to, for each of them.
CELL_ENTRIES, MAX_CENTROIDS, FIT_ROWS = 64, 1024, 64
FIT_ROUNDS = 12
#: Queries that measure the walk, and the share of their neighbours that it has to meet.
MEASURED, RECALL = 96, 0.96
#: Distinct vectors that a task gathers before it hands them on; entries and queries of a cell that are compared in one task.
GATHERED, BLOCK_ENTRIES, BLOCK_QUERIES = 50_000, 8192, 2048
#: Distances made at once in a task, and results kept before they are reduced.
AT_ONCE, RESULTS = 1 << 16, 1 << 19

ENTRY_DDL = "vec binary, ids array<long>, query boolean"
FOUND = pa.schema([("eid", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("cell", pa.int32())])
FOUND_DDL = "eid long, id long, score double, cell int"
RESULT_DDL = "query_id long, rank int, vec_id long, score double"


def _gather(dim: int, every: int, keep: int) -> Callable:
    """Distinct vectors as bytes with the least `keep` of their ids, and whether one of them is a query."""

    def out(held: dict[bytes, tuple[list[int], bool]]) -> pa.RecordBatch:
        ids = [sorted(x[0])[:keep] for x in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([x[1] for x in held.values()], pa.bool_())], names=["vec", "ids", "query"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[list[int], bool]] = {}
        for batch in batches:
            vectors = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dim) + 0.0  # no negative zeros
            for vec_id, vector in zip(batch.column(0).to_pylist(), vectors, strict=True):
                ids, query = held.get(key := vector.tobytes(), ((), False))
                ids = [*ids, vec_id] if len(ids) < 8 * keep else sorted([*ids, vec_id])[:keep]
                held[key] = (ids, query or vec_id % every == 0)
            if len(held) > GATHERED:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    return run


def entries_of(vectors: DataFrame, dim: int, every: int, k: int) -> DataFrame:
    """eid, vec, ids, query of the distinct vectors, staged. A group of equal vectors holds at most k + 1 ids for every GATHERED rows or task."""
    some = vectors.mapInArrow(_gather(dim, every, k + 1), ENTRY_DDL)
    least = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1)
    return staged(some.groupBy("vec").agg(least.alias("ids"), F.max("query").alias("query")).withColumn("eid", F.monotonically_increasing_id()))


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, good enough to choose a centroid."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None], 0)


def centroids(rows: np.ndarray, n: int) -> np.ndarray:
    """At most n centroids by Lloyd's rounds, begun from distinct rows."""
    own = np.unique(rows, axis=0)
    if len(own) <= n:
        return own
    at = own[np.random.default_rng(0).permutation(len(own))[:n]]
    for _ in range(FIT_ROUNDS):
        nearest = np.concatenate([_far(part, at).argmin(1) for part in np.array_split(rows, -(-len(rows) // 8192))])
        many = np.bincount(nearest, minlength=n)
        sums = np.zeros_like(at)
        np.add.at(sums, nearest, rows)
        at = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], at)
    return at


class Cells:
    """The centroids of both halves, and entries in each of their pairs."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.halves = (first, second)
        self.counts = np.zeros(len(first) * len(second), np.int64)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        cut = self.halves[0].shape[1]
        return (_far(vectors[:, :cut], self.halves[0]).argmin(1) * len(self.halves[1]) + _far(vectors[:, cut:], self.halves[1]).argmin(1)).astype(np.int32)

    def walk(self, vector: np.ndarray) -> Iterator[int]:
        """All cells by summed squared distance. A pair is pushed when the ones before it in its row and column are out."""
        cut = self.halves[0].shape[1]
        far = [_far(part[None], half)[0] for part, half in zip((vector[:cut], vector[cut:]), self.halves, strict=True)]
        order = [np.argsort(d, kind="stable").tolist() for d in far]
        d = [np.sort(x, kind="stable").tolist() for x in far]
        n, m = len(d[0]), len(d[1])
        heap, reached = [(d[0][0] + d[1][0], 0, 0)], [0] * n  # reached: how many of a row are out
        while heap:
            _, i, j = heapq.heappop(heap)
            reached[i] = j + 1
            yield order[0][i] * m + order[1][j]
            if i + 1 < n and reached[i + 1] == j:
                heapq.heappush(heap, (d[0][i + 1] + d[1][j], i + 1, j))
            if j + 1 < m and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (d[0][i] + d[1][j + 1], i, j + 1))

    def within(self, vector: np.ndarray, enough: int) -> list[int]:
        """The cells of the walk that hold anything, until they hold enough entries."""
        out, held = [], 0
        for cell in self.walk(vector):
            if many := int(self.counts[cell]):
                out.append(cell)
                held += many
                if held >= enough:
                    break
        return out

    def depths(self, vector: np.ndarray, wanted: list[int]) -> list[int]:
        """Entries that the walk has met when it has met each wanted cell."""
        left, held, at = set(wanted), 0, {}
        for cell in self.walk(vector):
            held += int(self.counts[cell])
            if cell in left:
                at[cell] = held
                left.discard(cell)
                if not left:
                    break
        return [at[c] for c in wanted]


class Best:
    """The least k (score, id) of each query among what a task has seen."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, eids: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], cells: np.ndarray) -> None:
        """Compare all queries with all vectors. Of each query the k entries least by score and least id are enough."""
        least = np.array([x[0] for x in ids])
        step = max(1, AT_ONCE // max(1, len(vectors)))
        for i in range(0, len(queries), step):
            part = queries[i : i + step]
            score = np.stack([np.sqrt(((vectors - q) ** 2).sum(1)) for q in part])
            if len(vectors) > self.k:
                edge = np.partition(score, self.k - 1, axis=1)[:, self.k - 1]
                row, col = np.nonzero(score <= edge[:, None])
            else:
                row, col = (x.ravel() for x in np.indices(score.shape))
            at = self._least(row, score[row, col], least[col])
            row, col = row[at], col[at]
            many = np.array([len(ids[c]) for c in col.tolist()], np.int64)
            flat = np.array([v for c in col.tolist() for v in ids[c]], np.int64)
            self._keep(np.repeat(eids[i : i + step][row], many), flat, np.repeat(score[row, col], many), np.repeat(cells[col], many))

    def _least(self, of: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> np.ndarray:
        """Indices of the k least by score and id of each `of`."""
        order = np.lexsort((vec_id, score, of))
        own = of[order]
        start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        place = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
        return order[place < self.k]

    def _keep(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > RESULTS:
            self.reduce()

    def reduce(self) -> None:
        if self.parts:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            at = self._least(columns[0], columns[2], columns[1])
            self.parts = [tuple(c[at] for c in columns)]
            self.size = len(at)

    def full(self) -> bool:
        """Whether reducing did not help: many queries are open, and what they have is handed on."""
        return self.size > RESULTS // 2 and len(self.parts) == 1

    def out(self) -> Iterator[pa.RecordBatch]:
        self.reduce()
        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.parts[0], FOUND, strict=True)], schema=FOUND)
        self.parts, self.size = [], 0


def _least_of_all(found: DataFrame, k: int) -> DataFrame:
    """The k least of each query over all tasks; Spark keeps k of each task before it shuffles them."""
    order = Window.partitionBy("eid").orderBy("score", "id", "cell")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _measured(entries: DataFrame, cells, dim: int, k: int, recall: float, total: int) -> int:
    """Entries that a walk has to meet for so much recall, by comparing some queries with every entry."""
    some = entries.where("query").orderBy(F.xxhash64("vec"), "vec").limit(MEASURED).select("eid", "vec").collect()
    eids, queries = np.array([r["eid"] for r in some], np.int64), np.frombuffer(b"".join(bytes(r["vec"]) for r in some), np.float64).reshape(-1, dim)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k + 1)
        for batch in batches:
            vectors = _matrix(batch.column(0), dim)
            if len(vectors):
                best.add(eids, queries, vectors, batch.column(1).to_pylist(), cells.value.of(vectors))
        yield from best.out()

    near: dict[int, list[int]] = {}
    for r in _least_of_all(entries.select("vec", "ids").mapInArrow(compare, FOUND_DDL), k + 1).collect():
        near.setdefault(r["eid"], []).append(r["cell"])
    depths = sorted(d for eid, q in zip(eids.tolist(), queries, strict=True) for d in cells.value.depths(q, near[eid]))
    return min(total, depths[min(len(depths) - 1, int(recall * len(depths)))])


def _blocks(rows: DataFrame, sizes: DataFrame, own: str, other: str, key: str) -> DataFrame:
    """rows of a cell dealt to one of their own blocks and to all blocks of the other side. sizes: cell, n_entries, n_queries as blocks."""
    here = rows.join(sizes, "cell")
    mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
    theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    return here.select("*", mine.alias(f"{own}_at"), theirs.alias(f"{other}_at"))


def _compare(dim: int, k: int) -> Callable:
    """Cells in a task, each with its queries first; the queries of a block are held, its entries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, eids, queries = Best(k), None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            entry = batch.column(3).to_pylist()
            start = 0
            while start < len(keys):
                stop = start
                while stop < len(keys) and keys[stop] == keys[start] and entry[stop] == entry[start]:
                    stop += 1
                part = batch.slice(start, stop - start)
                if keys[start] != key:
                    key, eids, queries = keys[start], [], []
                if not entry[start]:
                    eids.append(np.asarray(part.column(4), np.int64))
                    queries.append(_matrix(part.column(5), dim))
                elif queries:
                    best.add(np.concatenate(eids), np.concatenate(queries), _matrix(part.column(5), dim), part.column(6).to_pylist(), np.full(stop - start, key[0], np.int32))
                    if best.full():
                        yield from best.out()
                start = stop
        yield from best.out()

    return run


def nearest(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose id is divisible by `every`, among all rows but itself.

    score is the Euclidean distance of the original vectors in double precision; nearest first, ties to the smaller id. Rows whose vector is
    null, empty, all zeros or has a null or non-finite component take no part, nor do rows without an id or of another length than most
    (of lengths as common, the longest counts). A repeated row is a row of its own: its twin is its neighbour at distance 0. With fewer
    candidates than k all are given. Other columns are not read; an empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    none = spark.createDataFrame([], RESULT_DDL)
    v = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    lengths = v.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return none
    dim = lengths[0]["dim"]
    v = v.where(F.size("vec") == dim)
    entries = entries_of(v, dim, every, k)
    total, queries = entries.agg(F.count("*"), F.count_if("query")).first()
    if not queries:
        return none

    n = int(min(MAX_CENTROIDS, max(1, (total / CELL_ENTRIES) ** 0.5)))
    fit, spread = n * FIT_ROWS, 1 << 40
    drawn = entries.where(F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(spread)) < int(min(1.0, 2 * (fit + 1000) / total) * spread))
    sample = drawn.orderBy(F.xxhash64("vec", F.lit(1)), "vec").limit(fit).select("vec").collect()
    rows = np.frombuffer(b"".join(bytes(r["vec"]) for r in sample), np.float64).reshape(-1, dim)
    own = Cells(centroids(rows[:, : dim // 2], n), centroids(rows[:, dim // 2 :], n))
    halves = spark.sparkContext.broadcast(own)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(halves.value.of(_matrix(batch.column(0), dim)), pa.int32()))

    # staged, so that the cells that are counted are those that are compared
    in_cells = staged(entries.select("vec", "ids", "query", "eid").mapInArrow(placed, "vec binary, ids array<long>, query boolean, eid long, cell int"))
    for r in in_cells.groupBy("cell").count().collect():  # at most MAX_CENTROIDS squared
        own.counts[r["cell"]] = r["count"]
    cells = spark.sparkContext.broadcast(own)
    enough = _measured(in_cells, cells, dim, k, recall, total)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                met = [cells.value.within(q, enough) for q in _matrix(part.column(1), dim)]
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(m) for m in met]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([c for m in met for c in m], pa.int32())], names=["eid", "vec", "cell"])

    visits = staged(in_cells.where("query").select("eid", "vec").mapInArrow(walked, "eid long, vec binary, cell int"))
    blocks = lambda n, block: F.ceil(n / block).cast("int")
    held = in_cells.groupBy("cell").agg(blocks(F.count("*"), BLOCK_ENTRIES).alias("n_entries"))
    sizes = F.broadcast(held.join(visits.groupBy("cell").agg(blocks(F.count("*"), BLOCK_QUERIES).alias("n_queries")), "cell"))  # a row a cell at most
    asked = _blocks(visits, sizes, "n_queries", "n_entries", "eid").select("cell", "n_entries_at", "n_queries_at", F.lit(False).alias("entry"), "eid", "vec", F.lit(None).cast("array<long>").alias("ids"))
    given = _blocks(in_cells, sizes, "n_entries", "n_queries", "eid").select("cell", "n_entries_at", "n_queries_at", F.lit(True).alias("entry"), "eid", "vec", "ids")
    block = ["cell", "n_entries_at", "n_queries_at"]
    met = asked.unionByName(given).repartition(*block).sortWithinPartitions(*block, "entry").mapInArrow(_compare(dim, k + 1), FOUND_DDL)
    found = _least_of_all(met, k + 1).groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("score", F.col("id").alias("vec_id")))).alias("near"))

    # back from distinct vectors to the rows that ask: each leaves out itself once
    asks = v.where(F.col("vec_id") % every == 0).select("vec_id", "vec").mapInArrow(_as_bytes(dim), "query_id long, vec binary")
    eids = in_cells.where("query").select("vec", "eid")
    mine = F.transform("near", lambda x: F.when((x["score"] == 0) & (x["vec_id"] == F.col("query_id")), 1).otherwise(0))
    at = F.array_position(mine, 1)
    rest = F.when(at > 0, F.concat(F.slice("near", F.lit(1), (at - 1).cast("int")), F.slice("near", (at + 1).cast("int"), F.lit(k + 1)))).otherwise(F.col("near"))
    ranked = asks.join(eids, "vec").join(found, "eid").select("query_id", F.posexplode(F.slice(rest, 1, k)))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col")["vec_id"].alias("vec_id"), F.col("col")["score"].alias("score"))


def _as_bytes(dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in vectors], pa.binary())], names=["query_id", "vec"])

    return run
