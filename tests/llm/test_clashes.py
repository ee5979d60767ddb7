"""Columns of the input that are named as what operators use inside."""

import corpus_pipeline
from gleanery.llm.langid import identify
from gleanery.llm.mixing import emitted, mix
from gleanery.llm.quality import clean_lines

INNER = "_row _gone _verdict _lang _src _id _slice _class _i _stratum _copy _c0 _d0 size taken score lang_pred key".split()


def table(spark, n):
    line = "Dies ist eine Zeile Text von einiger Laenge, Nummer "
    rows = [(i, None if i == 3 else "" if i == 4 else f"{line}{i // 2} und mehr davon.\nThis is another line of English text, no. {i * 7919}.", "ab"[i % 2] if i % 5 else None, "de", *[f"{c}{i}" for c in INNER]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in INNER))


def intact(df, *but):
    rows = df.collect()
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in INNER if c not in but)
    return rows


def test_operators_keep_clashing_columns(spark):
    df = table(spark, 20)
    assert len(intact(clean_lines(df))) == 20
    assert len(intact(identify(df, {"labels": []}), "score", "lang_pred")) == 20
    assert len(intact(mix(df), "size", "taken")) == 20
    assert len(intact(emitted(df))) >= 10


def test_stages_keep_clashing_columns_and_take_empty_tables(spark):
    df = table(spark, 20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, None)
        assert out.columns == df.columns, name
        assert intact(out)
        assert stage(spark, df.limit(0), None).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, None).count() >= 20
