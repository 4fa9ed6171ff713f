import math

import duckdb
import pytest

from attestra.plans import vectors as X


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(X.QUERIES))
def test_planted_rows(spark, name):
    got = X.QUERIES[name](spark, "")
    columns = sorted(got.columns)
    want = duckdb.sql(X.ORACLE[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == rows and rows
