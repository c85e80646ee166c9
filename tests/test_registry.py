"""Every registered query of the library's own operators against its SQL on the smallest tables."""

import duckdb
import pytest

from vellum.plans import catalogue as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(values):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = rows(tuple(r) for r in got.select(*columns).collect())
    assert mine
    if name in registry.ORACLE:
        want = db.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})").fetchall()
        assert [[float(x) if type(x).__name__ == "Decimal" else x for x in r] for r in mine] == [[float(x) if type(x).__name__ == "Decimal" else x for x in r] for r in rows(tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in want)]
