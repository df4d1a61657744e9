"""Every query of the library runs on the smallest tables and agrees with its oracle."""

import math

import pytest
from conftest import SF

from textloom.plans import catalog


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return v


def rows_of(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    mine = rows_of(df.columns, df.collect())
    if sql := catalog.ORACLE_SQL.get(name):
        r = duck.sql(sql)
        assert sorted(df.columns) == sorted(r.columns)
        assert mine == rows_of(list(r.columns), r.fetchall())
    else:
        assert mine


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_without_the_training_subpackage():
    import pathlib

    root = pathlib.Path(catalog.__file__).resolve().parents[1]
    own = [p for p in root.rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if "llm" in p.read_text()]
