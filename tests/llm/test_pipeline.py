import pytest

import corpus_pipeline
from sieveline.llm import fm_dedup, ngram_join, quality, stages, toxicity
from sieveline.llm.tables import table

SF = "/root/testdata/sf0.001"
NAMES = [n for n, _ in corpus_pipeline.STAGES]


def keys(rows):
    return sorted(repr((r.doc_id, r.text)) for r in rows)


def test_stage_names_and_order():
    assert NAMES == ["toxicity", "quality_rules", "ngram_join", "substring_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_what_operators_say(spark):
    docs = table(spark, SF, "documents")
    bad = {r.doc_id for r in toxicity.toxicity(docs, table(spark, SF, "labels")).where("rejected").collect()}
    rows = docs.collect()
    kept = stages.reject_toxic(spark, docs, SF).collect()
    assert kept and keys(kept) == keys(r for r in rows if r.doc_id not in bad)
    bad = {r.doc_id for r in quality.quality(docs).where("not kept").collect()}
    assert bad and keys(stages.reject_low_quality(spark, docs, SF).collect()) == keys(r for r in rows if r.doc_id not in bad)
    first = {r.component_id for r in ngram_join.jaccard_classes(docs).collect()}
    assert keys(stages.one_of_each_group(spark, docs, SF).collect()) == keys(r for r in rows if r.doc_id in first)
    cut = {r.doc_id: r.kept for r in fm_dedup.dedup_substrings(docs).where("n_removed > 0").collect()}
    for r in stages.cut_repeats(spark, docs, SF).collect():
        assert r.text == cut.get(r.doc_id, r.text) and (r.doc_id not in cut or r.n_chars == len(r.text))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, table_of, odd_rows, name, stage):
    docs = table_of(odd_rows)
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name != "packing":
        assert out.columns == docs.columns and (rows or name == "quality_rules")  # words with digits are no plain words
    if name == "ngram_join":
        assert [r.doc_id for r in rows if r.text == "one two"] == [4]
        assert len([r for r in rows if not (r.text or "").strip()]) == 4


def test_run_ends_in_pieces(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.length > 0 for r in rows)
