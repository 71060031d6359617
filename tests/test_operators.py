import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.operators import assemble, bm25, graph, resolve, resolver, store, synth
from quillgraph.operators.extract import parse_facts, scan_objects
from quillgraph.plans import samples
from quillgraph.plans.engine import parse_subquestions
from quillgraph.plans.queries import sample_kb


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=14), st.text("abc ", max_size=14))
def test_indel_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    want = 200 * table[-1][-1] / (len(a) + len(b)) if a and b else 0.0
    assert resolve.indel_ratio(a, b) == pytest.approx(want)


def test_indel_by_hand():
    assert resolve.indel_ratio("apple inc", "apple inc.") == pytest.approx(94.7368, abs=1e-3)


def test_fuzzy_blocking_loses_nothing(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    e = spark.createDataFrame([(f"e{i}", n, []) for i, n in enumerate(names)], "id string, name string, aliases array<string>")
    mentions = [n[:-1] + rng.choice("abcde") for n in names[:40]]
    got = {(r.mention, r.entity_id) for r in resolve.fuzzy_pairs(spark.createDataFrame([(m,) for m in mentions], "mention string"), e).collect()}
    want = {(m, f"e{i}") for m in mentions for i, n in enumerate(names) if resolve.indel_ratio(m, n) >= 85}
    assert got == want


def test_copies_are_compared_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return pd.Series([resolve.indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    assert not resolve.indel_similarity.deterministic
    monkeypatch.setattr(resolve, "indel_similarity", counted.asNondeterministic())
    e = spark.createDataFrame([(f"e{i}", f"{w} bolt", [f"bolt {w}"]) for w, ids in (("large", range(50)), ("hot", range(50, 100))) for i in ids], "id string, name string, aliases array<string>")
    m = spark.createDataFrame([("LARGE BOLTS",), ("bolts large",)], "mention string")
    got = [tuple(r) for r in resolve.fuzzy_pairs(m, e).collect()]
    score = resolve.indel_ratio("bolts large", "bolt large")
    assert sorted(got) == sorted((x, f"e{i}", score) for x in ("LARGE BOLTS", "bolts large") for i in range(50))
    assert seen.value == 1


def test_resolution_ladder(spark):
    e = spark.createDataFrame([("1", "Ostrava Kilns", ["the kilns"]), ("2", "lumen drift", []), ("3", "Ostrava Kiln", [])], "id string, name string, aliases array<string>")
    m = spark.createDataFrame([(x,) for x in ("Ostrava Kilns", "Lumen Drift", "THE KILNS", "Kilns Ostravas", "Nobody", "  ", "Nobody")], "mention string")
    got = {r.mention: (r.entity_id, r.how) for r in resolve.resolve(m, e).collect()}
    assert got["Ostrava Kilns"] == ("1", "exact") and got["Lumen Drift"] == ("2", "exact") and got["THE KILNS"] == ("1", "alias")
    assert got["Kilns Ostravas"][1] == "fuzzy" and got["Nobody"][1] == got["unknown"][1] == "new" and len(got) == 6


def test_online_resolution_sees_its_own_creations(spark):
    e = spark.createDataFrame([], "id string, name string, aliases array<string>")
    m = spark.createDataFrame([(1, "Harrow Tidal"), (2, "Harrow Tidals"), (3, "Basalt Union"), (4, "harrow tidal")], "seq long, mention string")
    got = {r.seq: (r.entity_id, r.how) for r in resolve.resolve_online(m, e).collect()}
    assert got[1][1] == "new" and got[2] == (got[1][0], "fuzzy") and got[3][1] == "new" and got[4] == (got[1][0], "exact")


def test_online_resolution_against_a_scan_of_everything(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name").collect()
    rows = [(r.p_partkey, r.p_name + ("s" if r.p_partkey % 3 == 0 else "")) for r in parts]
    rows += [(10**6, "cold plate"), (10**6 + 1, "old plate"), (10**6 + 2, "Plates old")]
    want, exact, names = {}, {}, []
    for seq, mention in sorted(rows):
        form = " ".join(sorted(mention.lower().split()))
        found, how = exact.get(mention.lower()), "exact"
        if found is None:
            score, best = max(((resolve.indel_ratio(form, n), -i) for i, (n, _) in enumerate(names)), default=(0, 0))
            found, how = (names[-best][1], "fuzzy") if score >= 85 else (f"first {seq}", "new")
        exact.setdefault(mention.lower(), found)
        names.append((form, found))
        want[seq] = (found, how)
    e = spark.createDataFrame([], "id string, name string, aliases array<string>")
    out = {r.seq: (r.entity_id, r.how) for r in resolve.resolve_online(spark.createDataFrame(rows, "seq long, mention string"), e).collect()}
    named = {eid: f"first {seq}" for seq, (eid, how) in out.items() if how == "new"}
    assert {seq: (named[eid], how) for seq, (eid, how) in out.items()} == want


def test_chunker_against_a_loop(spark):
    import math
    import re

    rng = random.Random(2)
    text = " ".join(" ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))) + rng.choice(".!?") for _ in range(60))
    want, open_, n = [], [], 0
    for s in re.split(r"(?<=[!?.])\s+", text):
        open_.append(s)
        n += math.floor(len(s.split()) * 1.3)
        if n >= 80:
            want.append(" ".join(open_))
            open_, n = [], 0
    if open_:
        want.append(" ".join(open_))
    assert one(spark, tx.chunks(F.col("t"), 80), t=text) == want


def test_text_by_hand(spark):
    assert one(spark, tx.normalise(F.col("t")), t="\n A  b\tC \n") == "a b c"
    assert one(spark, tx.is_year(F.col("t")), t=" 1999 ") and not one(spark, tx.is_year(F.col("t")), t="19") and not one(spark, tx.is_year(F.col("t")), t=None)
    assert one(spark, tx.synth_fragment(F.col("t"), F.lit("Which kiln?")), t="with care") and not one(spark, tx.synth_fragment(F.col("t"), F.lit("Which kiln?")), t="kiln")
    assert one(spark, tx.split_questions(F.col("t")), t="A?\nB? C") == ["A?", "B?", "C?"]


def test_upserts_and_merge(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "id string, name string, entity_type string")
    new = spark.createDataFrame([("9", "b", None), ("3", "c", "z")], "id string, name string, entity_type string")
    assert sorted(tuple(r) for r in store.upsert_entities(old, new).collect()) == [("1", "a", "x"), ("2", "b", None), ("3", "c", "z")]
    e = spark.createDataFrame([("1", "A", None, ["x"]), ("2", "B", "firm", ["y"])], "id string, name string, entity_type string, aliases array<string>")
    f = spark.createDataFrame([("f", "2", "1")], "id string, subject_id string, object_id string")
    pairs = spark.createDataFrame([("1", "2")], "keep_id string, drop_id string")
    merged, facts = resolve.merge(e, f, pairs)
    assert [tuple(r) for r in merged.collect()] == [("1", "A", "firm", ["B", "x", "y"])] and [tuple(r) for r in facts.collect()] == [("f", "1", "1")]


def test_as_of_is_half_open(spark):
    f = spark.sql("SELECT * FROM VALUES ('a', 's', timestamp'2020-01-01', timestamp'2021-01-01'), ('b', 's', timestamp'2021-01-01', null), ('c', 's', null, null) AS t(id, subject_id, valid_from, valid_until)")
    at = lambda x: {r.id for r in store.as_of(f, None, F.lit(x).cast("timestamp")).collect()}
    assert at("2020-06-01") == {"a", "c"} and at("2021-01-01") == {"b", "c"} and at("2019-01-01") == {"c"}


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, f"f{i}", "p", 1.0, "d") for i, (a, b) in enumerate(pairs)], "src string, dst string, fact_id string, predicate string, confidence double, source_doc string")


def test_graph_searches_against_loops(spark):
    rng = random.Random(9)
    pairs = [(str(rng.randrange(30)), str(rng.randrange(30))) for _ in range(45)]
    e = edges(spark, pairs)
    dist = {"0": 0}
    for d in range(1, 4):
        dist |= {b: d for a, b in [*pairs, *[(y, x) for x, y in pairs]] if dist.get(a) == d - 1 and b not in dist}
    nodes, touched = graph.subgraph(e, spark.createDataFrame([("0",)], "node string"), 3)
    assert {r.node: r.depth for r in nodes.collect()} == dist
    inner = {n for n, d in dist.items() if d < 3}
    assert {r.fact_id for r in touched.collect()} == {f"f{i}" for i, (a, b) in enumerate(pairs) if (a in inner or b in inner)}
    out = {"0": ["0"]}
    for _ in range(3):
        for n, p in list(out.items()):
            for b in sorted(y for x, y in pairs if x == n):
                if b not in out or (len(out[b]) == len(p) + 1 and p + [b] < out[b]):
                    out[b] = p + [b]
    ask = spark.createDataFrame([("0", n) for n in dist], "a string, b string")
    got = {r.b: r.path for r in graph.hop_chains(e, ask).collect()}
    assert {n: len(p) for n, p in got.items()} == {n: len(p) for n, p in out.items() if len(p) <= 4}


def test_seeded_subgraph_keeps_the_last_ring(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("a", "y")])
    seeds = spark.createDataFrame([("a", 0), ("d", 1)], "node string, seq int")
    nodes, _ = graph.subgraph(e, seeds, hops=1, max_nodes=2, mode="seeded")
    assert {r.node for r in nodes.collect()} == {"a", "b", "x", "y", "d", "c"}
    with pytest.raises(ValueError):
        graph.subgraph(e, seeds, mode="other")


def test_walk_prefers_exact_predicates_and_shapes(spark):
    e, f = sample_kb(spark)
    got = {r.qid: r for r in resolver.resolve_questions(spark.createDataFrame(samples.QUESTIONS, "qid long, text string"), f, e).collect()}
    assert {k: (r.answer, r.fact_ids) for k, r in got.items()} == samples.ANSWERS
    assert got[2].trace == ["Ostrava Kilns --was founded by--> Edda Quill", "Edda Quill --was born in--> Brno"] and got[2].confidence == 0.9
    off = f.withColumn("is_active", F.col("id") != "f02")
    assert 2 not in {r.qid for r in resolver.resolve_questions(spark.createDataFrame(samples.QUESTIONS, "qid long, text string"), off, e).collect()}


def test_predicates_match_whole_words(spark):
    # "is" is a word of neither "this" nor "exists".
    intents = spark.createDataFrame([("industry", ["is"], "industry")], "intent string, predicates array<string>, shape string")
    f = spark.createDataFrame([("1", "s", "exists", "tech company"), ("2", "s", "is a", "glass company")], "id string, subject_id string, predicate string, object_value string").withColumns({"object_id": F.lit(None).cast("string"), "object_name": F.lit(None).cast("string"), "subject_name": F.lit("S"), "confidence": F.lit(0.9)})
    starts = spark.createDataFrame([("k", "s", "industry")], "key string, subject_id string, intent string")
    assert [r.fact_id for r in resolver.follow(starts, f, intents).collect()] == ["2"]


def test_zero_scores_only_on_request(spark):
    e, _ = sample_kb(spark)
    qs = spark.createDataFrame([(1, "basalt")], "qid long, text string")
    assert [r.id for r in bm25.search_entities(e, qs, 3).collect()] == ["k4"]
    assert [r.id for r in bm25.search_entities(e, qs, 3, positive_only=False).orderBy("rank").collect()] == ["k4", "c1", "c2"]


def test_budget_is_a_prefix(spark):
    rows = [(1, i, "s", "p", "word " * n) for i, n in enumerate((10, 400, 1), 1)]
    f = spark.createDataFrame(rows, "qid long, rank int, subject_name string, predicate string, object_value string").withColumn("object_name", F.lit(None).cast("string"))
    # The third would fit, but what is beyond the second is out.
    assert [r["rank"] for r in assemble.trim(f, 100).collect()] == [1]


def test_context_stands_in_for_a_missing_object(spark):
    none = F.lit(None).cast("string")
    row = lambda value, context: one(spark, synth.render_fact(F.lit(1), F.lit("S"), F.lit("p"), F.col("v"), none, F.col("c")), v=value, c=context)
    assert row("x", "said") == "F1: S -- p --> x" and row(None, "said so") == "F1: S -- p (context: said so)" and row("?", "") == "F1: S -- p --> ?"
    assert row(None, "y" * 300).endswith("y...)") and len(row(None, "y" * 300)) == len("F1: S -- p (context: )") + 162


def test_model_texts():
    assert [f["subject"] for f in parse_facts('x {"subject": "a", "predicate": "b"} y {"subject": "c", "predicate": "d"}')] == ["a", "c"]
    assert scan_objects('{"a": {"b": 1}} {"c": ') == [{"a": {"b": 1}}] and parse_facts(None) == []
    assert parse_subquestions('["a?", " ", "b?"]', 5) == ["a?", "b?"] and parse_subquestions("1. Who is it?\n2. Why so?", 1) == ["Who is it?"]
    assert parse_subquestions("x, y", 5) == ["x", "y"] and parse_subquestions("x and y", 5) == ["x", "y"] and parse_subquestions("", 5) == []
