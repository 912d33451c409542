"""Runs a query and its SQL side by side."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def canon(value):
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    value = value.item() if hasattr(value, "item") else value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def bag(frame: pd.DataFrame) -> Counter:
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(str(canon(v)) if not isinstance(canon(v), float) or canon(v) != int(canon(v)) else str(int(canon(v))) for v in row) for row in frame.itertuples(index=False, name=None))


def agree(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    ours, theirs = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = bag(ours), bag(theirs)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
