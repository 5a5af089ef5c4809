"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from terracadence import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, tmp_path, name):
    catalog.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    mine, sql = f"select * from '{tmp_path}/out/*.parquet'", catalog.oracle_sql()[name]
    types = lambda q: sorted((r[0], r[1]) for r in duck.execute(f"describe {q}").fetchall())
    assert types(mine) == types(sql)
    cols = ", ".join(f'"{c}"' for c, _ in types(sql))
    a, b = f"select {cols} from ({mine})", f"select {cols} from ({sql})"
    assert duck.execute(f"{a} except all {b}").fetchall() == []
    assert duck.execute(f"{b} except all {a}").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
