"""Every registered query against its DuckDB oracle, and the plans of the rest."""

import math
import os

import duckdb
import pytest

from evenkeel.plans.registry import ORACLES, QUERIES


def rows_of(frame):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5)
        return float(v) if type(v).__name__ == "Decimal" else v

    return sorted((tuple(map(plain, r)) for r in frame), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.select(*(f"`{c}`" for c in sorted(df.columns))).collect()
    assert len(got) > 0
    if name in ORACLES:
        names = sorted(duck.sql(ORACLES[name]).columns)
        assert sorted(df.columns) == names
        quoted = ", ".join(f'"{n}"' for n in names)
        assert rows_of(got) == rows_of(duck.sql(f"select {quoted} from ({ORACLES[name]})").fetchall())
