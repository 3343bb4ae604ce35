import math
import os

import duckdb


def rows_of(frame):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in frame), key=repr)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    return names, rows_of(con.sql(f"select {', '.join(names)} from ({sql})").fetchall())


def same(df, sf_dir, sql):
    names, want = duck(sf_dir, sql)
    assert sorted(df.columns) == names
    assert rows_of(df.select(*names).collect()) == want
