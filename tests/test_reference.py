"""Every query against its SQL on the smallest tables, by values and names."""

import datetime
import decimal

import duckdb
import pytest
from conftest import SMALL

from churnlens.jobs import reference, reference_code, reference_more, reference_structure, reference_text, reference_checks, reference_packages  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return (0, str(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        return (1, round(float(v), 9))
    if isinstance(v, datetime.datetime):
        return (2, v.replace(tzinfo=None).isoformat())
    return (3, str(v))


@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = reference.QUERIES[name](spark, SMALL)
    got = df.collect()
    if name not in reference.ORACLES:
        assert got
        return
    out = sql.execute(reference.ORACLES[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in out.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got) == want
    assert got or name in {"q_dormant_qualify", "q_temporal_coupling", "q_coupled_top5", "q_except"}
