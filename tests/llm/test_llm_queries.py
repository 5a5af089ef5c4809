"""The package's queries against their SQL."""

import glob
import os

import duckdb
import pytest

from terracadence.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, tmp_path, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    queries.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    mine = f"select * from '{tmp_path}/out/*.parquet'"
    types = lambda q: sorted((r[0], r[1]) for r in duck.execute(f"describe {q}").fetchall())
    assert types(mine) == types(queries.SQL[name])
    cols = ", ".join(f'"{c}"' for c, _ in types(mine))
    a, b = f"select {cols} from ({mine})", f"select {cols} from ({queries.SQL[name]})"
    assert duck.execute(f"{a} except all {b}").fetchall() == duck.execute(f"{b} except all {a}").fetchall() == []
