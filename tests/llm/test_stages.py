"""The pipeline's stages on rows that are seldom there."""

import corpus_pipeline
from kindred.llm import shared as S

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score string, _lines int, component_id string"


def test_stages_on_odd_rows(spark):
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 300 and 2000").orderBy("doc_id").limit(12).collect()
    whole = "\n".join(r.text for r in prose)
    texts = [(i, r.text) for i, r in enumerate(prose)] + [(5, prose[5].text), (6, "another text of a taken id"), (None, prose[7].text), (None, None), (90, None), (91, ""), (92, " \n "), (93, whole * 40)]
    df = spark.createDataFrame([(i, t, None, None, None, "clash", 1, "x") for i, t in texts], SCHEMA)
    ids = lambda d: sorted((r.doc_id is not None, r.doc_id or 0) for r in d.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    kept = S.stage_table(stages["quality"](spark, df, SF), "t")
    assert kept.columns == corpus_pipeline.COLUMNS and set(ids(kept)) <= set(ids(df))
    lines = S.stage_table(stages["lines"](spark, df, SF), "t")
    assert lines.columns == corpus_pipeline.COLUMNS and ids(lines) == ids(df)  # lines go, documents stay
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = S.stage_table(stages["near_copies"](spark, df, SF), "t")
    assert near.columns == corpus_pipeline.COLUMNS
    assert ids(near) == sorted([(False, 0)] * 2 + [(True, i) for i, _ in texts if i is not None and i not in (91, 92)])  # equal empty texts are copies, rows without an id stay
    leaks = stages["leaks"](spark, df, SF)
    assert leaks.columns == corpus_pipeline.COLUMNS and set(ids(leaks)) <= set(ids(df))
    packed = stages["packing"](spark, df, SF).collect()
    assert sum(r.length for r in packed if r.start == 0 and r.doc_id == 91) == 1
    assert len({(r.doc_id, r.doc_tokens) for r in packed}) == len({(i, t or "") for i, t in texts})


def test_stages_on_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, SF).collect() == []
