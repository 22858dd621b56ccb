"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{float(x):.5g}" if not isinstance(x, (str, bool)) else str(x)

    return sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in registry.ORACLE_SQL:
        want = db.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert _plain(rows, got.columns) == _plain(want.fetchall(), names)
