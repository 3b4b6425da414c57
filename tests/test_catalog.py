"""Every registered query against its SQL, and that those without SQL return rows."""

from __future__ import annotations

import pytest

from tempora import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(df.columns)
    clean = lambda r: tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)
    expected = [clean(tuple(r[i] for i in order)) for r in want.fetchall()]
    assert sorted(map(clean, got), key=repr) == sorted(expected, key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["rec_id", "first", "last", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
