"""Runs a query and its SQL side by side on the driver's small tables."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


def agree(spark, query, sql):
    got = query(spark, DATA)
    names = sorted(got.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(sql)
    found = [c[0] for c in want.description]
    assert sorted(found) == names
    order = [found.index(n) for n in names]
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    mine = [tuple(r) for r in got.select(*names).collect()]
    assert _plain(mine) == _plain(rows)
    return len(mine)
