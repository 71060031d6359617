import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.suffix_dedup import common_words, longest_previous_factors, remove_repeats, repeated_spans
from tests.llm.fixtures import clashing, docs, prose, row

L, K = 12, 6


def brute(rows, size=L):
    """Spans by comparing every window of ``size`` words with all earlier ones."""
    texts = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            texts[r[0]] = min(texts.get(r[0], r[1]), r[1])
    first, out = {}, set()
    for d in sorted(texts):
        words, span = texts[d].split(), None
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in first:
                if span and i <= span[1]:
                    span[1] = i + size
                else:
                    span and out.add((d, *span))
                    span = [i, i + size, *first[key]]
            else:
                first[key] = (d, i)
        span and out.add((d, *span))
    return out


def run(df, size=L, k=K):
    rows = [(r.doc_id, r.start_word, r.end_word, r.source_doc_id, r.source_word) for r in repeated_spans(df, size, k).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(500 + i, rng.randrange(L, 60)) for i in range(6)]
    rows = []
    for d in range(60):
        parts = [prose(1000 + 50 * seed + d, rng.randrange(1, 80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng.randrange(10**6), rng.randrange(1, 30))]
        rows.append(row(d, "\n".join(parts)))
    return rows + [row(200, rows[7][1]), row(201, "so so " * 40), row(202, "x " + rows[3][1])]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        want = brute(rows)
        assert len(want) > 20 and run(docs(spark, rows).repartition(5)) == want


def test_default_lengths(spark):
    passage = prose(7, 55)
    rows = [row(1, prose(1, 90) + " " + passage + " then " + prose(2, 20)), row(2, passage + " but " + prose(3, 70)), row(3, prose(4, 300))]
    assert run(docs(spark, rows), 50, 25) == {(2, 0, 55, 1, 90)} == brute(rows, 50)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=14), st.randoms())
def test_lpf(text, rng):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    common = [0] + [shared(text[order[i - 1] :], text[order[i] :]) for i in range(1, len(order))]
    got = longest_previous_factors(order, common)
    for i, p in enumerate(order):
        assert got[i] == max((shared(text[q:], text[p:]) for q in range(p)), default=0)


def test_common_words():
    assert common_words("a b c ", "a b d ") == 2 and common_words("ab c ", "abc d ") == 0 and common_words("a b ", "a b c ") == 2


def test_remove_keeps_the_first(spark):
    passage = prose(7, 30)
    rows = [row(1, "one " + passage + " end"), row(2, "  two\n" + passage + "\nafter  it"), row(3, None), row(None, passage), row(4, passage)]
    got = {r.doc_id: r.text for r in remove_repeats(docs(spark, rows), L, K).collect()}
    assert got == {1: rows[0][1], 2: "  two\nafter  it", 3: None, None: passage, 4: ""}


def test_awkward_empty_and_clashing(spark):
    from tests.llm.fixtures import awkward

    assert run(docs(spark)) == brute(awkward()) != set()
    assert run(docs(spark, [])) == set()
    df = clashing(spark)
    assert run(df) == brute(awkward())
    out = remove_repeats(df, L, K)
    assert out.columns == df.columns and out.count() == df.count()
