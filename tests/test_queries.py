"""Every core query against its SQL on the smallest tables; those without SQL must give rows with a stable schema."""

from __future__ import annotations

import pytest

from graphmill import catalog
from tests.compare import canonical, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, con, name):
    df = catalog.QUERIES[name](spark, small)
    rows = df.collect()
    if name not in catalog.SQL:
        assert df.columns and len(set(df.columns)) == len(df.columns)
        return
    cur = con.execute(catalog.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = lambda names: sorted(range(len(names)), key=lambda i: names[i])
    mine = sorted(tuple(canonical(r[i]) for i in order(df.columns)) for r in rows)
    want = sorted(tuple(canonical(r[i]) for i in order(cols)) for r in cur.fetchall())
    assert mine == want
