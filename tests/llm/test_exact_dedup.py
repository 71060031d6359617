from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.exact_dedup import exact_dedup, frequent_digests, shrink
from tests.llm.fixtures import awkward, clashing, docs, row


def brute(rows):
    best, out = {}, []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 1))
            continue
        first, n = best.get(r[1], (None, 0))
        ids = [x for x in (first, r[0]) if x is not None]
        best[r[1]] = (min(ids) if ids else None, n + 1)
    return Counter(out + [(d, t, n) for t, (d, n) in best.items()])


def run(df, **k):
    return Counter((r.doc_id, r.text, r.k_copies) for r in exact_dedup(df, copies="k_copies", **k).collect())


def test_against_brute_force(spark):
    rows = awkward() + [row(100 + i, "hot") for i in range(300)] + [row(1000 + i, f"warm {i % 40}") for i in range(400)] + [row(None, "hot")]
    for k in (1, 4, 1024):
        assert run(docs(spark, rows).repartition(5), k=k) == brute(rows)


def test_heavy_hitters_are_found(spark):
    from pyspark.sql import functions as F

    rows = [(b"%05d" % (i % 700),) for i in range(1400)] + [(b"h%d" % (i % 3),) for i in range(900)]
    df = spark.createDataFrame(rows, "digest binary").repartition(6)
    found = frequent_digests(df, 16)
    assert {b"h0", b"h1", b"h2"} <= set(found) and len(found) <= 17
    assert frequent_digests(df.where(F.lit(False)), 16) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([bytes([i]) for i in range(12)]), max_size=200), st.integers(1, 6))
def test_misra_gries_bound(stream, k):
    counts = {}
    for x in stream:
        counts[x] = counts.get(x, 0) + 1
        counts = shrink(counts, k)
    true = Counter(stream)
    assert len(counts) <= k
    for x, n in true.items():
        assert n - len(stream) / (k + 1) <= counts.get(x, 0) <= n


def test_empty_and_clashing(spark):
    assert exact_dedup(docs(spark, [])).collect() == []
    df = clashing(spark)
    out = exact_dedup(df)
    assert out.columns == df.columns and out.count() == sum(brute(awkward()).values())
