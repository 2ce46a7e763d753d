"""Rows of a Spark result beside those of DuckDB."""

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if hasattr(v, "as_tuple") else v


def same(spark_frame, relation):
    columns = sorted(spark_frame.columns)
    assert columns == sorted(relation.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in spark_frame.collect()), key=str)
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=str)
    assert got == want
