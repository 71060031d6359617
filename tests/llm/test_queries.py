"""The registered queries over whole small tables: against SQL where there is any, else against brute force."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece

import __spark_entry__
from quillgraph.llm import bpe, lattice_lm, simhash
from quillgraph.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_token_counts import want as token_counts
from tests.test_queries import FOLDER, TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall()) != []


def test_names():
    found = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_simhash_query(spark, texts):
    """All pairs by complete distance, closed to groups."""
    seen = simhash.WordHashes()
    prints = {d: np.unpackbits(f[1].view(np.uint8)) for d, t in texts if (f := simhash.fingerprint(t, seen))}
    ids = sorted(prints)
    bits = np.stack([prints[i] for i in ids]).astype(np.int32)
    far = (bits[:, None, :] != bits[None, :, :]).sum(2)
    root = {i: i for i in ids}
    for a, b in zip(*np.where(far <= simhash.MAX_DISTANCE), strict=True):
        x, y = sorted((root[ids[a]], root[ids[b]]))
        root = {k: x if v == y else v for k, v in root.items()}
    want = {d for d, _ in texts if root.get(d, d) == d}
    got = {r.doc_id: r.group_size for r in QUERIES["op2_simhash_near_dedup"](spark, FOLDER).collect()}
    # Approximate: nothing beside the groups is removed, and of what they remove nineteen of twenty are.
    assert want <= set(got) and len(texts) - len(got) >= 0.95 * (len(texts) - len(want)) > 0
    assert sum(got.values()) == len(texts)


def test_lattice_query(spark, texts):
    """Nothing of the operator but its smoothing: the tokenizer's own counts, and a forward pass over whole texts."""
    sp = sentencepiece.SentencePieceProcessor(model_file=lattice_lm.MODEL)
    n = sp.get_piece_size()
    counts = Counter(i for _, t in texts for i in sp.encode(t))
    byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
    piece = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    total = sum(counts.values()) + lattice_lm.ALPHA * (len(byte) + len(piece))
    log = [math.log((counts[i] + lattice_lm.ALPHA) / total) for i in range(n)]
    got = {r.doc_id: r.log_prob for r in QUERIES["op3_lattice_likelihood"](spark, FOLDER).collect()}
    assert set(got) == {d for d, _ in texts}
    for d, t in texts:
        s = "\u2581" + t.replace(" ", "\u2581")
        alpha = [0.0] + [-math.inf] * len(s)
        for i in range(len(s)):
            ways = [(i + 1, sum(log[byte[b]] for b in s[i].encode()))] if s[i] not in piece else []
            ways += [(j, log[piece[s[i:j]]]) for j in range(i + 1, min(len(s), i + 16) + 1) if s[i:j] in piece]
            for j, x in ways:
                hi, lo = max(alpha[j], alpha[i] + x), min(alpha[j], alpha[i] + x)
                alpha[j] = hi + math.log1p(math.exp(lo - hi))
        assert got[d] == pytest.approx(alpha[-1])


def test_bpe_query(spark, texts):
    enc = bpe.encoding()
    got = {r.doc_id: (r.tokens, r.n_tokens, r.round_trip) for r in QUERIES["op4_bpe_encode_decode"](spark, FOLDER).collect()}
    assert got == {d: (t := enc.encode_ordinary(x), len(t), True) for d, x in texts}


def test_token_count_query(spark, texts):
    got = sorted(((r.doc_id, r.n_tokens) for r in QUERIES["op10_token_counts"](spark, FOLDER).collect()), key=str)
    assert got == token_counts(texts)
