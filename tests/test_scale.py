"""Plans whose memory of one task must not follow the size of the tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph import session
from quillgraph.operators import assemble, bm25, resolve, store
from quillgraph.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def facts(spark):
    f = spark.range(400).select(F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("s"), "id").alias("subject_id"), F.lit("is").alias("predicate"), F.lit(None).cast("string").alias("object_id"), F.lit("big").alias("object_value"))
    return f, spark.createDataFrame([("s1", "one")], "id string, name string")


def partitions(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_exact_resolution_compares_nothing(spark):
    e = spark.createDataFrame([("2", "kiln", ["oven"]), ("1", "kiln", []), ("3", "x", ["Kiln"])], "id string, name string, aliases array<string>")
    df = resolve.resolve(spark.createDataFrame([("kiln",), ("OVEN",), ("none",)], "mention string"), e, threshold=101)
    assert {r.mention: (r.entity_id, r.how) for r in df.where("how <> 'new'").collect()} == {"kiln": ("1", "exact"), "OVEN": ("2", "alias")}
    assert "Python" not in plan(df) and "Window" not in plan(df) and df.count() == 3


def test_facts_without_an_object_are_spread(spark):
    f, e = facts(spark)
    df = store.with_names(f, e)
    assert partitions(df) == 4 and df.where("subject_name = 'one' AND object_name IS NULL").count() == 1 and df.count() == 400


def test_lookups_are_not_shuffled_by_predicate(spark):
    f, e = facts(spark)
    df = store.reverse_lookup(f, e, spark.createDataFrame([(1, "is", "BIG")], "qid int, predicate string, needle string"))
    assert partitions(df) == 4 and df.count() == 400


def test_trim_lets_rows_go_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["token_budget_trim"](spark, FOLDER))
    f, e = facts(spark)
    named = store.with_names(f.withColumn("predicate", F.when(F.col("id") < "f398", F.col("predicate"))), e).withColumn("confidence", F.when(F.col("id") == "f399", 0.1).otherwise(0.5))
    qs = spark.createDataFrame([(1, "one big kiln")], "qid long, text string")
    asked = named.crossJoin(F.broadcast(qs.select("qid")))
    every = assemble.rank(asked, qs)
    rows = lambda df: sorted((r.id, r["rank"], r.spent) for r in df.collect())
    assert sorted(r["rank"] for r in every.collect()) == list(range(1, 401))
    assert rows(assemble.trim(every, 30)) == rows(assemble.trim(assemble.rank(asked, qs, assemble.most_lines(30)), 30)) != []


def test_estimate_lets_rows_go_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["token_estimate"](spark, FOLDER))


def test_hydrated_facts_are_one_join(spark):
    f, _ = facts(spark)
    df = store.hydrate(f.union(f.where("id = 'f1'")), spark.createDataFrame([("f1",), ("f1",), ("f2",)], "id string"))
    assert plan(df).count("SortMergeJoin") == 1
    assert sorted(r.id for r in df.collect()) == ["f1", "f1", "f2"] and df.columns == f.columns


def test_pages_are_parsed_by_few_rows(spark):
    df = QUERIES["html_text"](spark, FOLDER)
    assert "BatchEvalPython" in plan(df) and "ArrowEvalPython" not in plan(df)


def test_document_search_reads_texts_once_and_shuffles_no_pairs(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(bm25, "materialise", lambda df, name: (plans.append(plan(df)), session.materialise(df, name))[1], raising=False)
    plans.append(plan(QUERIES["bm25_documents"](spark, FOLDER)))
    assert sum(p.count("sf0.001/documents.parquet") for p in plans) == 1
    assert not re.search(r"hashpartitioning\(qid#\w+, id#", "".join(plans))


@pytest.mark.parametrize("pairs", [1, 500_000])
def test_document_search_of_odd_rows(spark, tmp_path, monkeypatch, pairs):
    monkeypatch.setattr(bm25, "PAIRS", pairs, raising=False)
    texts = [(1, "kiln kiln oven"), (1, "kiln"), (2, None), (3, ""), (None, "oven"), (None, "Kiln, oven!"), (4, "oven"), (5, "oven"), (6, "the the the " * 40), (7, "dust ñ"), (7, "dust ñ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "kiln oven oven"), (2, None), (3, "none"), (4, "the dust"), (4, "dust"), (None, "oven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["bm25_documents"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(ORACLE_SQL["bm25_documents"]).fetchall(), key=repr) != []


def test_document_search_without_documents(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert bm25.search_documents(none, spark.createDataFrame([(1, "kiln")], "qid long, text string")).count() == 0
