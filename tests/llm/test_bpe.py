from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.bpe import bpe_decode, bpe_encode, encode, encoding, safe_parts
from tests.llm.fixtures import awkward, clashing, docs, prose

ALPHABET = st.sampled_from(list("ab 1,'s\n\t é漢🦆") + ["'ll", "  ", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join), st.integers(1, 12))
def test_parts_encode_as_the_whole(text, size):
    enc = encoding()
    parts = safe_parts(text, size)
    assert "".join(parts) == text
    assert encode(text, enc, size) == enc.encode_ordinary(text)


def test_long_texts_are_cut():
    text = prose(5, 20_000)
    assert len(safe_parts(text)) > 3 and max(map(len, safe_parts(text))) < 33_000
    assert safe_parts("y" * 100_000) == ["y" * 100_000]


def test_round_trip(spark):
    df = bpe_encode(docs(spark), verify=True)
    out = bpe_decode(df).collect()
    assert len(out) == len(awkward())
    for r in out:
        if r.text is None:
            assert r.tokens is None and r.n_tokens is None and r.decoded is None and r.round_trip is None
        else:
            assert bytes(r.decoded) == r.text.encode() and r.n_tokens == len(r.tokens) and r.round_trip
            assert r.tokens == encoding().encode_ordinary(r.text)


def test_empty_and_clashing(spark):
    assert bpe_encode(docs(spark, [])).collect() == []
    df = clashing(spark)
    out = bpe_encode(df)
    assert out.count() == df.count() and out.columns == [c for c in df.columns if c.lower() not in ("tokens", "n_tokens")] + ["tokens", "n_tokens"]
    assert bpe_decode(out).count() == df.count()
