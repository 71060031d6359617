from quillgraph.llm.quality import RULES, Rule, quality_filter, score
from tests.llm.fixtures import awkward, clashing, docs, prose, row


def kept(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda x: (x is None, x))


def test_rules_reject_what_they_name(spark):
    rows = [
        row(1, prose(1, 60)),
        row(2, "###*** %%% $$$ the of"),
        row(3, "echo " * 50),
        row(4, " ".join(f"zq{i}" for i in range(60))),
        row(5, "\n".join(f"cell{i} | other{i} | third{i}" for i in range(9))),
        row(6, "A few words only."),
    ]
    df, _, failed = score(docs(spark, rows))
    got = {r.doc_id: set(r[failed]) for r in df.collect()}
    assert got[1] == set() and got[6] == set()
    assert "symbols" in got[2] and "repeated_words" in got[3] and got[4] == {"few_stop_words"} and "table_lines" in got[5]
    assert kept(quality_filter(docs(spark, rows))) == [1, 6]


def test_awkward_rows(spark):
    got = kept(quality_filter(docs(spark)))
    # Null, empty and blank texts have no words; one word of 60,000 letters is too long.
    assert not {3, 4, 5, 8} & set(got)
    assert got.count(2) == 2 and got.count(None) == 2 and got.count(9) == 2


def test_extra_columns_and_empty_table(spark):
    df = clashing(spark)
    out = quality_filter(df)
    assert out.columns == df.columns and out.count() == quality_filter(docs(spark)).count()
    assert quality_filter(docs(spark, [])).collect() == []


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = quality_filter(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_custom_table(spark):
    rules = (Rule("short", "n_words", "<", 3),)
    assert 10 not in kept(quality_filter(docs(spark, awkward()), rules=rules)) and len(RULES) > 5
