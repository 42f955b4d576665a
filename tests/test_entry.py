import importlib.util
import sys

import __spark_entry__ as entry
from tickloom.plans import oracle, queries


def test_registry():
    assert set(queries.QUERIES) == set(oracle.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_llm_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tickloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tickloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    spec = importlib.util.spec_from_file_location("bare", entry.__file__)
    bare = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(bare)
    assert set(bare.queries()) == set(queries.QUERIES) and set(bare.oracle_sql()) == set(oracle.ORACLE_SQL)


def test_queries_match_duckdb(spark):
    import duckdb
    import pandas as pd

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        plain = frame.map(lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))
        return sorted(map(repr, plain.itertuples(index=False, name=None)))

    for name, sql in oracle.ORACLE_SQL.items():
        ours, theirs = entry.queries()[name](spark, sf).toPandas(), con.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns), name
        assert rows(ours) == rows(theirs), name
