"""Nearest neighbours against brute force: recall on the tables, exact rows where everything is met, awkward vectors."""

import numpy as np
import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from churnlens.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<double>, label int, ids string, cell string, eid string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA)


def sound(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, every=100, k=10, dim=None):
    """(query_id, rank, vec_id, score) by comparing every query with every other row."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and sound(v) and (dim is None or len(v) == dim)]
    out = []
    for at, (i, q) in enumerate(rows):
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for other, (j, v) in enumerate(rows) if other != at)
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()]
    want, found = brute(rows), got(queries.op12_nearest_neighbours(spark, MEDIUM))
    assert len(want) == len(found) and {x[:2] for x in want} == {x[:2] for x in found}
    assert len({(q, v) for q, _, v, _ in want} & {(q, v) for q, _, v, _ in found}) >= 0.9 * len(want)
    exact = {i: np.array(v, float) for i, v in rows}
    for q, _, v, score in found:
        assert score == np.sqrt(((exact[q] - exact[v]) ** 2).sum())


@pytest.fixture(scope="module")
def clusters():
    """Tight clusters, one vector that a third of all rows share, and 13 dimensions, so that halves differ in length."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(60, 13)) * 10
    rows = [(i, (middle[rng.integers(60)] + rng.normal(size=13)).tolist()) for i in range(4000)]
    return rows + [(i, [1.0] * 13) for i in range(4000, 6000)]


def test_clusters_are_met_by_a_short_walk(spark, clusters, monkeypatch):
    enough = []
    monkeypatch.setattr(neighbours, "_measured", lambda *a, real=neighbours._measured: enough.append(real(*a)) or enough[-1])
    found = got(neighbours.nearest(table(spark, clusters)))
    want = brute(clusters)
    assert len({(q, v) for q, _, v, _ in want} & {(q, v) for q, _, v, _ in found}) >= 0.9 * len(want)
    assert enough[0] < 1000  # of 4,001 entries
    shared = [x for x in found if x[0] >= 4000]
    assert shared == [x for x in want if x[0] >= 4000]  # equal vectors: the least ids, itself left out


def test_all_met_is_brute_force(spark, clusters, monkeypatch):
    """With the whole walk the result is exact, also where cells are cut into many blocks and results are reduced often."""
    monkeypatch.setattr(neighbours, "GATHERED", 300)
    monkeypatch.setattr(neighbours, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(neighbours, "RESULTS", 500)
    few = clusters[:700] + clusters[4000:4300]
    assert got(neighbours.nearest(table(spark, few), recall=2.0)) == brute(few)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (100, [-0.0, 2.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0]), (3, [1.0, -1.0])]
    bad = [(4, None), (5, []), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (None, [1.0, 0.5]), (200, [0.0, 0.0]), (10, [1.0]), (300, [1.0, 2.0, 3.0])]
    assert got(neighbours.nearest(table(spark, rows + bad))) == brute(rows)
    assert got(neighbours.nearest(table(spark, [(0, [1.0])]))) == []
    assert got(neighbours.nearest(table(spark, [(0, [1.0]), (5, [3.0])]))) == [(0, 1, 5, 2.0)]
    for none in ([], bad[:6], [(1, [1.0, 2.0])]):
        df = neighbours.nearest(table(spark, none))
        assert df.collect() == [] and df.columns == ["query_id", "rank", "vec_id", "score"]


def test_ties_and_many_equal_distances(spark):
    rows = [(i, [float(i == j) for j in range(40)]) for i in range(40)] + [(1000 - i, [float(i == j) for j in range(40)]) for i in range(40)]
    assert got(neighbours.nearest(table(spark, rows), every=10, recall=2.0)) == brute(rows, every=10)


def test_walk_is_by_summed_distance():
    rng = np.random.default_rng(1)
    cells = neighbours.Cells(rng.normal(size=(7, 3)), rng.normal(size=(5, 4)))
    q = rng.normal(size=7)
    far = [((half - part) ** 2).sum(1) for half, part in zip(cells.halves, (q[:3], q[3:]), strict=True)]
    sums = (far[0][:, None] + far[1][None]).ravel()
    walk = list(cells.walk(q))
    assert sorted(walk) == list(range(35)) and np.allclose(sums[walk], np.sort(sums))


def test_floats_and_reruns(spark):
    df = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").withColumn("rank", F.lit(1))
    assert got(neighbours.nearest(df)) == got(neighbours.nearest(df.repartition(5)))
