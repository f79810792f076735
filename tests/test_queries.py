"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from civisphere.plans import registry, registry_rules, registry_wide  # noqa: F401  the others add to the first

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    sql = db.sql(registry.ORACLE_SQL[name])
    assert sorted(sql.columns) == cols
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    order = [sql.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in sql.fetchall()), key=repr)


def test_silence_map_many_languages(spark, tmp_path):
    rows = [("a" if k % 2 else "b", f"l{k:04}", "x") for k in range(1200)]
    spark.createDataFrame(rows, "source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["silence_map"](spark, str(tmp_path)).distinct().count() == 2400
