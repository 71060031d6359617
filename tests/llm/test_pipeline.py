"""The whole pipeline against brute force on a small corpus."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
from quillgraph.llm.bpe import encoding
from quillgraph.llm.mixing import SEED, TEMPERATURES
from quillgraph.llm.quality import RULES, STOP_WORDS, SYMBOLS
from quillgraph.llm.simhash import MAX_DISTANCE, WordHashes, fingerprint
from tests.llm.fixtures import awkward, clashing, docs, prose, row
from tests.llm.test_simhash import edited


def corpus():
    rng = random.Random(4)
    rows = [row(i, prose(i, 60 + i), source=f"s{i % 3}") for i in range(120)]
    rows += [row(200 + i, rows[i][1], source="s1") for i in range(30)]
    rows += [row(300 + i, edited(rows[i + 40][1], 0.06, i), source="s2") for i in range(30)]
    rows += [row(400 + i, f"%%% *** junk{i} ### " * 9, source="s0") for i in range(10)]
    rows += [row(500, None), row(501, ""), row(502, "word " * 90, source="s0")]
    rng.shuffle(rows)
    return rows


def passes(text):
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip(" ")]
    n = len(words)
    m = {
        "n_words": n, "mean_word_chars": len(text) / max(n, 1), "symbol_ratio": sum(c in SYMBOLS for c in text) / max(len(text), 1),
        "stop_ratio": sum(w.lower() in STOP_WORDS for w in words) / max(n, 1), "distinct_word_ratio": len(set(words)) / max(n, 1),
        "distinct_line_ratio": len(set(lines)) / max(len(lines), 1), "table_line_ratio": sum(" | " in x for x in lines) / max(len(lines), 1),
    }
    return not any((m[r.metric] < r.threshold if r.op == "<" else m[r.metric] > r.threshold) and n >= r.min_words and (r.max_words is None or n <= r.max_words) for r in RULES)


def brute(rows):
    rows = [r for r in rows if passes(r[1])]
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(r[1], r)
    rows = sorted(first.values(), key=lambda r: r[0])
    bits = [np.unpackbits(fingerprint(r[1], WordHashes())[1].view(np.uint8)) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (bits[i] != bits[j]).sum() <= MAX_DISTANCE:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return [r for i, r in enumerate(rows) if root[i] == i]


def in_training_order(rows):
    """Ids in order of their position under the default schedule, with room for every document of every source."""
    tokens = lambda r: -(-len(r[1].encode()) // 4)
    supply = Counter()
    for r in rows:
        supply[r[3]] += tokens(r)
    knots = [(t, {s: n**p for s, n in supply.items()}) for t, p in TEMPERATURES]
    knots = [(t, {s: w / sum(ws.values()) for s, w in ws.items()}) for t, ws in knots]

    def area(s, t):
        total = 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
            h = max(0.0, min(t, t1) - t0)
            total += a[s] * h + (b[s] - a[s]) * h * h / (2 * (t1 - t0))
        return total

    budget = max(n / area(s, 1) for s, n in supply.items())
    at = {}
    for s in supply:
        c = 0
        for h, r in sorted((hashlib.md5(f"{SEED}|{r[0]}".encode()).hexdigest(), r) for r in rows if r[3] == s):
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if budget * area(s, mid) < c else (lo, mid)
            at[r[0]] = (round(hi, 7), h)
            c += tokens(r)
    return sorted(at, key=at.get)


def test_run_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    # Adaptive execution would join so small a result to one file: here it is several.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = corpus_pipeline.run(spark, str(tmp_path))
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.training_order >> 42 for r in got}) > 1 and len({r.training_order for r in got}) == len(got)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.training_order)] == in_training_order(brute(rows))
    text = {r[0]: r for r in rows}
    for r in got:
        assert tuple(r)[:5] == text[r.doc_id]
        assert r.tokens == encoding().encode_ordinary(r.text) and r.n_tokens == len(r.tokens) and r.round_trip


def test_awkward_rows(spark, tmp_path):
    """Nulls in every column, very long texts, repeated rows, one id twice, and extra columns with names of the operators' own."""
    long = " ".join("the" if i % 12 == 0 else f"word{i}" for i in range(40_000))
    df = clashing(spark, [*awkward(), row(20, long)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Left: one of the copies 1, 2, 2; one of the rows without an id; 6; the long 20; the short texts. Gone by the rules: 3, 4, 5, 7 (few distinct words) and 8 (one long word).
    kept = Counter(r.doc_id for r in got)
    assert kept == {1: 1, None: 1, 6: 1, 9: 2, 10: 1, 20: 1}
    by_id = {r.doc_id: r for r in got}
    assert by_id[20].text == long and by_id[20].tokens == encoding().encode_ordinary(long)
    assert by_id[6].source is None and by_id[6].lang is None and by_id[None].text == prose(2, 80)
    assert set(df.columns) <= {*got[0].asDict(), "Tokens"} and by_id[1]["position"] == 5 and by_id[1]["a.b"] == 16
    assert all(r.round_trip for r in got)


def test_order_of_a_frame_that_is_no_file(spark):
    df = docs(spark, [row(i, prose(i, 60)) for i in (3, 1, 2)]).coalesce(1)
    got = dict(corpus_pipeline.STAGES)["byte-level BPE encoding and decoding"](spark, df, "").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.training_order)] == [3, 1, 2]


def test_stages_one_by_one(spark, tmp_path):
    rows = corpus()
    df = docs(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    got = stages["quality rules"](spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows if passes(r[1]))
    for name in list(stages)[:-1]:
        df = stages[name](spark, df, "")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "SimHash near-dedup":
            assert sorted(r.doc_id for r in df.collect()) == sorted(r[0] for r in brute(rows))


def test_empty_corpus(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
