import hashlib
from collections import defaultdict

import pytest

from quillgraph.llm.mixing import SEED, fixed_schedule, mix
from tests.llm.fixtures import clashing, docs, prose, row


def corpus():
    rows = [row(i, prose(i, 20 + i % 50), source="big") for i in range(300)]
    rows += [row(1000 + i, prose(i, 30), source="small") for i in range(60)]
    return rows + [row(2000 + i, prose(i, 25), source=None) for i in range(80)]


def brute(rows, weights):
    """weights: source -> (w0, w1), linear; positions by bisection on the integral."""
    tokens = lambda t: -(-len((t or "").encode()) // 4)
    total = [sum(w[k] for w in weights.values()) for k in (0, 1)]
    w = {s: (a / total[0], b / total[1]) for s, (a, b) in weights.items()}
    area = lambda s, t: w[s][0] * t + (w[s][1] - w[s][0]) * t * t / 2
    supply = defaultdict(int)
    for r in rows:
        supply[r[3]] += tokens(r[1])
    budget = min(supply[s] / area(s, 1) for s in w if area(s, 1) > 0)
    out = {}
    for s in w:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(f"{SEED}|{r[0]}".encode()).hexdigest())
        c = 0
        for r in own:
            if c < budget * area(s, 1):
                lo, hi = 0.0, 1.0
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if budget * area(s, mid) < c else (lo, mid)
                out[r[0]] = hi
            c += tokens(r[1])
    return out


def test_against_bisection(spark):
    rows = corpus()
    weights = {"big": (1.0, 0.2), "small": (0.0, 0.6), None: (0.4, 0.4)}
    schedule = fixed_schedule(spark, [(s, t, w) for s, ws in weights.items() for t, w in zip((0, 1), ws, strict=True)])
    got = mix(docs(spark, rows), schedule, position="at").collect()
    want = brute(rows, weights)
    assert {r.doc_id for r in got} == set(want)
    assert all(abs(r["at"] - want[r.doc_id]) < 1e-6 for r in got)
    assert [r["at"] for r in got] == sorted(r["at"] for r in got)
    # A source without weight at the start comes late.
    late = [r["at"] for r in got if r.source == "small"]
    assert sum(x > 0.5 for x in late) > 0.6 * len(late)


def test_default_schedule_uses_every_source(spark):
    got = mix(docs(spark, corpus()), position="at").collect()
    assert {r.source for r in got} == {"big", "small", None} and 0 <= min(r["at"] for r in got) and max(r["at"] for r in got) < 1


def test_schedule_is_checked(spark):
    for bad in ([("a", 0, 1.0)], [("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0)], [("a", 0, -1.0), ("a", 1, 1.0)]):
        with pytest.raises(ValueError):
            fixed_schedule(spark, bad)


def test_unnamed_and_missing_sources(spark):
    schedule = fixed_schedule(spark, [("big", 0, 1), ("big", 1, 1), ("absent", 0, 1), ("absent", 1, 1)])
    assert {r.source for r in mix(docs(spark, corpus()), schedule).collect()} == {"big"}


def test_awkward_empty_and_clashing(spark):
    assert mix(docs(spark, [])).collect() == []
    out = mix(docs(spark), position="at").collect()
    assert all(0 <= r["at"] <= 1 for r in out)
    same = [row(1, "tie text here", source="t")] * 3
    assert [r.doc_id for r in mix(docs(spark, same)).collect()] == [1, 1, 1]
    df = clashing(spark)
    assert mix(df).columns == df.columns and mix(df).count() == len(out)


def test_a_stray_row_takes_nothing_from_the_pipeline(spark):
    import corpus_pipeline

    rows = [row(i, prose(i, 200), source=f"s{i % 20}") for i in range(400)] + [row(1000, prose(7, 4), source=None)]
    got = dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == [*range(400), 1000]
