"""Every registered query of the library against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, tables, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), tables.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
