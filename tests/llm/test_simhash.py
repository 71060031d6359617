import random

import numpy as np

from quillgraph.llm.common import connected_components
from quillgraph.llm.simhash import MAX_DISTANCE, WordHashes, fingerprint, fingerprints, near_dedup, near_edges, near_groups, near_pairs
from tests.llm.fixtures import awkward, clashing, docs, prose, row


def edited(text, share, seed):
    rng = random.Random(seed)
    words = text.split()
    for i in rng.sample(range(len(words)), int(len(words) * share)):
        words[i] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def corpus():
    rows = [row(i, prose(i, 40 + 7 * i)) for i in range(60)]
    for i in range(40):
        rows.append(row(100 + i, edited(rows[i][1], (0.02, 0.05, 0.1, 0.12)[i % 4], i)))
    return rows


def distances(rows):
    sig = {r[0]: fingerprint(r[1], WordHashes())[1].view(np.uint64) for r in rows}
    ids = sorted(sig)
    return {(a, b): int(np.bitwise_count(sig[a] ^ sig[b]).sum()) for n, a in enumerate(ids) for b in ids[n + 1 :]}


def test_pairs_against_brute_force(spark):
    rows = corpus()
    want = {p for p, d in distances(rows).items() if d <= MAX_DISTANCE}
    prints = fingerprints(docs(spark, rows)).withColumnRenamed("doc_id", "id")
    got = {(r.a, r.b): r.distance for r in near_pairs(prints).collect()}
    assert set(got) <= want and len(got) >= 0.95 * len(want) and len(want) >= 36
    assert all(d == distances(rows)[p] for p, d in list(got.items())[:3])


def test_edges_connect_what_pairs_connect(spark):
    rows = corpus() + [row(500 + i, edited(prose(77, 200), (0.04, 0.1)[i % 2], i)) for i in range(60)]
    prints = fingerprints(docs(spark, rows)).withColumnRenamed("doc_id", "id").cache()
    groups = lambda e: {(r.node, r.root) for r in connected_components(e.select("a", "b")).collect()}
    pairs, edges = near_pairs(prints), near_edges(prints)
    assert groups(edges) == groups(pairs)
    assert edges.where("a >= 500").count() < 0.5 * pairs.where("a >= 500").count()


def test_pairs_at_every_distance(spark):
    """Nine tenths of the pairs within the distance are found, in every band of it."""
    rows = []
    for i in range(400):
        base = prose(7000 + i, 60 + i % 200)
        rows += [row(2 * i, base), row(2 * i + 1, edited(base, 0.02 + 0.2 * (i % 20) / 20, i))]
    far = {}
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        x, y = (fingerprint(r[1], WordHashes())[1].view(np.uint64) for r in (a, b))
        far[a[0], b[0]] = int(np.bitwise_count(x ^ y).sum())
    prints = fingerprints(docs(spark, rows)).withColumnRenamed("doc_id", "id")
    got = {(r.a, r.b) for r in near_pairs(prints).select("a", "b").collect()}
    for low, high in ((0, 48), (48, 72), (72, 88), (88, MAX_DISTANCE + 1)):
        band = {p for p, d in far.items() if low <= d < high}
        assert len(band) >= 20 and len(band & got) >= 0.9 * len(band), (low, len(band), len(band & got))


def test_verdict_on_a_pair_is_the_same_in_every_table(spark):
    """A header over texts of their own, short and long beside it: alone, in small tables and in large ones."""
    header = prose(900, 30)
    short = [row(i, f"{header}\n{prose(1000 + i, 4)}") for i in range(150)]
    long = [row(1000 + i, f"{header}\n{prose(4000 + i, 90)}") for i in range(150)]
    twins = [row(5000, prose(1, 50)), row(5001, edited(prose(1, 50), 0.06, 1))]
    filler = [row(10_000 + i, prose(50_000 + i, 20)) for i in range(9_000)]
    for n, more in ((2, 0), (50, 0), (51, 0), (150, 9_000)):
        kept = {r.doc_id for r in near_dedup(docs(spark, short[:n] + long[:n] + twins + filler[:more])).collect()}
        assert {x for x in kept if x < 1000} == {0} and {x for x in kept if 1000 <= x < 5000} == {1000 + i for i in range(n)}
        assert 5000 in kept and 5001 not in kept and len([x for x in kept if x >= 10_000]) == more


def test_one_of_each_group_stays(spark):
    rows = corpus()
    kept = {r.doc_id for r in near_dedup(docs(spark, rows)).collect()}
    assert set(range(60)) <= kept and len(kept - set(range(60))) <= 4


def test_awkward_rows(spark):
    out = near_dedup(docs(spark), group_size="members").collect()
    ids = [r.doc_id for r in out]
    # 1 and 2 are copies; texts without words, and rows without an id, stay.
    assert 1 in ids and 2 not in ids and {3, 4, 5, 6, 7, 8, 10} <= set(ids) and ids.count(None) == 2 and ids.count(9) == 2
    assert {r.members for r in out if r.doc_id == 1} == {2}
    repeated = [row(5, "one more text"), row(5, "one more text"), row(6, "One more text!")]
    assert [r.doc_id for r in near_dedup(docs(spark, repeated)).collect()] == [5]


def test_empty_and_clashing(spark):
    assert near_dedup(docs(spark, [])).collect() == [] and near_groups(docs(spark, [])).collect() == []
    df = clashing(spark)
    out = near_dedup(df)
    assert out.columns == df.columns and out.count() == near_dedup(docs(spark)).count()


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (14, 3), (20, 21), (7, 7), (None, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 1 for n in (1, 2, 3, 10, 11, 12, 13, 14)}, 20: 20, 21: 20}


def test_awkward_fixture_is_awkward():
    assert any(r[1] is None for r in awkward()) and any(r[0] is None for r in awkward())


def test_large_group_of_copies_with_one_shared_line(spark):
    body = prose(3000, 60)
    group = [row(10000 + i, f"{prose(5000 + i, 3)} {i}\n{body}") for i in range(3000)]
    others = [row(i, f"{prose(20000 + i, 12)}\n{prose(30000 + i, 40)}") for i in range(300)]
    df = docs(spark, group + others)
    kept = [r.doc_id for r in near_dedup(df).collect()]
    assert [x for x in kept if x >= 10000] == [10000] and sorted(x for x in kept if x < 10000) == list(range(300))
