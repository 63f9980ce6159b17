"""Holds a query's rows against DuckDB's."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return int(x) if x.is_integer() and abs(x) < 1e15 else float(f"{x:.9g}")
        return x

    return list(frame.columns), sorted((tuple(plain(x) for x in row) for row in frame.itertuples(index=False)), key=repr)


def compare(spark, sf_dir, name, query, sql):
    found = rows_of(query(spark, sf_dir).toPandas())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    wanted = rows_of(con.execute(sql).df())
    assert found[0] == wanted[0], (name, found[0], wanted[0])
    assert len(found[1]) == len(wanted[1]), (name, len(found[1]), len(wanted[1]))
    for a, b in zip(found[1], wanted[1]):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b)), (name, a, b)
    return len(found[1])
