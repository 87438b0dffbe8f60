"""The numbered operators that SQL can express, against their SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from corpusforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(found.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(r[c] for c in cols) for r in found.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_sample_bound_with_repeated_ids(spark):
    from corpusforge.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    found = sorted(tuple(r) for r in labelled_sample(docs, labels, "quality", 10).collect())
    assert found == [(1, "text 0", 1), (2, "", 0)]
    assert labelled_sample(docs, labels, "quality", 1).count() == 1
