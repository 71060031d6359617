"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

from quillgraph.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return str(v) if not isinstance(v, (int, str, bool, type(None))) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, want.fetchall()) != []


def test_partitioning_changes_nothing(spark):
    for name in ("bm25_documents", "token_budget_trim", "fact_dedup", "resolve_questions"):
        seen = []
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name](spark, FOLDER)
            seen.append(rows(df.columns, [tuple(r) for r in df.collect()]))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert seen[0] == seen[1]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["key", "answer", "confidence", "trace"] and df.count() == 150
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hot_path_stays_in_the_jvm(spark):
    for name in ("walk_two_hop", "bm25_documents", "chunk_documents", "fact_rank_overlap"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
