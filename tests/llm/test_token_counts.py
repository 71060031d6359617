from quillgraph.llm.bpe import encoding
from quillgraph.llm.token_counts import count_tokens, read_cache, tokenizer_version
from tests.llm.fixtures import awkward, clashing, docs, row


def norm(t):
    import re

    return re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", t.replace("\r\n", "\n").replace("\r", "\n"))


def want(rows):
    return sorted(((r[0], None if r[1] is None else len(encoding().encode_ordinary(norm(r[1])))) for r in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_tokens) for r in df.collect()), key=str)


def test_cold_and_warm(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = awkward() + [row(20, "a\r\nb "), row(21, " a\nb")]
    assert got(count_tokens(docs(spark, rows), cache)) == want(rows)
    n = spark.read.parquet(cache).count()
    assert n == len({norm(r[1]) for r in rows if r[1] is not None})
    more = rows + [row(30, "new words")]
    assert got(count_tokens(docs(spark, more), cache)) == want(more)
    # Only the one new content was appended.
    assert spark.read.parquet(cache).count() == n + 1


def test_hits_are_read_not_encoded(spark, tmp_path):
    from pyspark.sql import functions as F

    cache = f"file://{tmp_path}/cache"
    planted = spark.createDataFrame([("hello", 777)], "t string, n_tokens long").select(F.unhex(F.md5("t")).alias("digest"), "n_tokens", F.lit(tokenizer_version()).alias("tokenizer"))
    planted.write.partitionBy("tokenizer").parquet(cache)
    assert got(count_tokens(docs(spark, [row(1, "hello"), row(2, "hello there")]), cache)) == [(1, 777), (2, 2)]
    # Another version of the tokenizer sees none of it.
    assert read_cache(spark, cache, "other").count() == 0


def test_empty_and_clashing(spark, tmp_path):
    assert got(count_tokens(docs(spark, []), f"file://{tmp_path}/c1")) == []
    assert got(count_tokens(clashing(spark), f"file://{tmp_path}/c2")) == want(awkward())
