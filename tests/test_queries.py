"""Every query against its SQL, as the driver runs them, at the smallest scale."""

from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from seine.oracle import ORACLE  # noqa: E402
from seine.queries import QUERIES  # noqa: E402


def shown(value):
    if value is None or value != value:
        return "NULL"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def rows(names, table):
    return sorted(tuple(shown(v) for v in r) for r in zip(*[table[n] for n in sorted(names)], strict=True))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck):
    found = QUERIES[name](spark, str(SF))
    columns = found.columns
    collected = found.collect()
    got = {c: [r[c] for r in collected] for c in columns}
    assert collected or name in ()
    if name in ORACLE:
        expected = duck.execute(ORACLE[name]).to_arrow_table().to_pydict()
        assert sorted(columns) == sorted(expected)
        assert rows(columns, got) == rows(columns, expected)


def test_entry_point_lists_these_queries():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
