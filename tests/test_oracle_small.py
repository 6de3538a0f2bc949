"""Every registered query against its DuckDB oracle on the smallest tables (sf0.001)."""

import datetime as dt
import hashlib
import json
import math

import pytest

import __spark_entry__ as entry
from feedspark.catalog import load_all

SF = "/root/testdata/sf0.001"
# the training-data queries have tests of their own
QUERIES = {k: e.build for k, e in load_all().items()}
ORACLES = {k: e.oracle for k, e in load_all().items() if e.oracle is not None}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["uid", "doc", "pos"]
    assert df.count() > 0
