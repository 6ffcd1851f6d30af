"""Every registered query against its DuckDB oracle (sf0.001); rows-only
queries must run and return rows."""

import pytest

import __spark_entry__ as E
from oracle_compare import digest, duck

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLE[name])
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in sdf.schema.fields:
        t = f.dataType.simpleString()
        assert dtypes.get(f.name) == SPARK_TO_DUCK.get(t, t.upper()), (f.name, t, dtypes.get(f.name))
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows) == digest(dcols, drows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 6
    assert "col_datatype" in df.columns
