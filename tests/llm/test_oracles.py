"""The queries that SQL can state, against their SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pressgauge.llm.oracles import ORACLES
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    verdict, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict.startswith("ok"), verdict
