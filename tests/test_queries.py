"""Every registered query against its SQL, on the smallest tables."""

import pytest

from quern import catalog
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, small, name):
    df = catalog.queries()[name](spark, small)
    assert_same(df, catalog.oracle_sql()[name], small)


def test_full_lm_takes_long_documents_whole(spark, tmp_path):
    import duckdb

    texts = ["ab", "".join(chr(97 + i % 23) for i in range(150_000)), "cd"]
    spark.createDataFrame([(i, t, "src0") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["full_lm"](spark, str(tmp_path)).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len(t) + 2 for t in texts)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(c.sql(catalog.oracle_sql()["full_lm"]).fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
