"""Every registered query against its SQL twin, on the small tables."""

import math
import os

import duckdb
import pytest

from runscope.plans import queries as Q

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")
TABLES = ("events", "conversations", "documents", "labels", "pages", "benchmark")


def flat(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.SQL[name])
    names = [c[0] for c in want.description]
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    types = {c[0]: kinds.get(str(c[1]), str(c[1])) for c in want.description}
    assert types == dict(got.dtypes)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    rows = sorted((tuple(flat(r[n]) for n in sorted(names)) for r in got.collect()), key=key)
    twin = sorted((tuple(flat(dict(zip(names, r, strict=True))[n]) for n in sorted(names)) for r in want.fetchall()), key=key)
    assert len(rows) == len(twin) and rows, (len(rows), len(twin))
    assert rows == twin
