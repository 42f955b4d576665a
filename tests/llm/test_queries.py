import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tickloom.llm import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = frame.map(lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))
    return sorted(map(repr, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_one_query_an_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None
