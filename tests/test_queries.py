"""Every registered query against its oracle SQL; those without one must give rows."""

import pytest

from strataforge import queries as core

from .conftest import rows_of

QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    out = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in out.collect()]
    if name not in SQL:
        assert out.columns and all(kind != "void" for _, kind in out.dtypes)
        return
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(columns) == sorted(out.columns)
    assert rows_of(out.columns, rows) == rows_of(columns, want)


def test_the_rest_works_without_the_training_data_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith(("strataforge.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "strataforge.llm", None)
    assert entry.queries().keys() == QUERIES.keys()


def test_the_flagship_query_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
