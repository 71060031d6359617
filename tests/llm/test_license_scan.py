import textwrap

from quillgraph.llm.license_scan import SENTENCES, scan
from tests.llm.fixtures import clashing, docs, prose, row


def found(df):
    return sorted((r.doc_id, r.license, r.rule, r.hits) for r in scan(df).collect())


def mit(wrap=None):
    paragraphs = [SENTENCES["mit-grant"], SENTENCES["mit-notice"], SENTENCES["as-is-software"] + " " + SENTENCES["no-liability"]]
    if wrap:
        paragraphs = ["\n".join(textwrap.wrap(p, wrap)) for p in paragraphs]
    return "\n\n".join(["MIT License", "Copyright (c) 2031 A Person", *paragraphs])


def test_sequences(spark):
    bsd = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]
    rows = [
        row(1, mit()),
        row(2, mit(wrap=60)),
        row(3, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text"),
        row(4, "\n".join(SENTENCES[k] for k in bsd)),
        row(5, "\n".join(SENTENCES[k] for k in [*bsd[:3], "bsd-endorse", bsd[3]])),
        row(6, prose(1, 100)),
        row(7, "released UNDER the mit license"),
        row(8, "Released under the MIT License.\n" * 2),
        row(9, "We talk about the MIT License here."),
    ]
    assert found(docs(spark, rows)) == [
        (1, "MIT", "mit-name", 1), (1, "MIT", "mit-text", 1), (2, "MIT", "mit-name", 1), (2, "MIT", "mit-text", 1),
        (3, "Apache-2.0", "apache-short", 1), (4, "BSD-2-Clause", "bsd-2-text", 1), (5, "BSD-3-Clause", "bsd-3-text", 1),
        (7, "MIT", "mit-released", 1), (8, "MIT", "mit-released", 2),
    ]


def test_a_gap_breaks_a_sequence(spark):
    filler = lambda n: "\n".join(f"Filler line {i}" for i in range(n))
    ids = ["mit-grant", "mit-notice", "as-is-software", "no-liability"]
    text = lambda n: f"\n{filler(n)}\n".join(SENTENCES[k] for k in ids)
    assert [r[2] for r in found(docs(spark, [row(1, text(2))]))] == ["mit-text"]
    assert [r[2] for r in found(docs(spark, [row(1, text(3))]))] == ["mit-grant"]


def test_awkward_empty_and_clashing(spark):
    assert found(docs(spark)) == [] and found(docs(spark, [])) == []
    line = "Licensed under CC BY-NC 4.0."
    rows = [row(None, line), row(2, line), row(2, line), row(3, prose(1, 40_000) + "\n" + line)]
    got = scan(clashing(spark, rows)).collect()
    assert len(got) == 4 and {r.license for r in got} == {"CC-BY-NC-4.0"}
    assert "Exchange" not in scan(docs(spark))._jdf.queryExecution().executedPlan().toString()
