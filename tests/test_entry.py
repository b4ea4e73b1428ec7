"""Driver contract: entry runs, every SQL-checked key has a query."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"run_id", "subtask", "rouge1", "rouge2", "rougeL", "model"} <= set(df.columns)


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_annotate_rejects_small(spark):
    from corpusforge.operators import annotate as ann
    df = spark.createDataFrame([(1, "short"), (2, "x" * 50)], "doc_id long, input string")
    a = ann.materialize(ann.annotate(df, "P: {input}", "out", lambda: ann.PrefixModel(4, max_prompt_chars=20),
                                     batch_size=2, attempts=2))
    good, bad = ann.split_rejects(a, "out")
    assert [(r.doc_id, r.out) for r in good.collect()] == [(1, "P: s")]
    b = bad.collect()
    assert [(r.doc_id, r.attempts) for r in b] == [(2, 2)]
