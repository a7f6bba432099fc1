import pytest

import corpus_pipeline
from talewright.llm import pieces, queries, templates

from .test_text_operators import _base_spans, _brute_similar


def test_every_stage_against_plain_versions(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    good = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert good.columns == columns
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op5_quality"](spark, sf_dir).collect()}
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i, p in scores.items() if p == 1}

    good = docs.where(docs.doc_id.isin(list(kept)))
    distinct = corpus_pipeline.keep_distinct(spark, good, sf_dir)
    low = _brute_similar({i: rows[i].text for i in kept})
    assert distinct.columns == columns and {r.doc_id for r in distinct.collect()} == {i for i in kept if low[i] == i}

    clean = corpus_pipeline.keep_uncontaminated(spark, docs, sf_dir)
    bench = [r.text for r in corpus_pipeline.table(spark, sf_dir, "benchmark").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and not left & {i for i, r in rows.items() if any(b in r.text for b in bench)}
    assert left == set(rows) - {r.doc_id for r in templates.contamination(docs, corpus_pipeline.table(spark, sf_dir, "benchmark")).collect()}

    safe = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, sf_dir).collect()}
    assert set(safe) == set(rows)
    for i, r in rows.items():
        spans = _base_spans(r.text)
        assert not _base_spans(safe[i].text) and safe[i].n_chars == len(safe[i].text)
        if not spans:
            assert safe[i].text == r.text

    coded = corpus_pipeline.encode(spark, docs, sf_dir)
    back = {r.doc_id: r.decoded for r in pieces.decode(coded).collect()}
    assert back == {i: r.text for i, r in rows.items()}


def test_run_applies_the_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "encode"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < corpus_pipeline.table(spark, sf_dir, "documents").count()
    assert out.columns == ["doc_id", "ids", "n_tokens", "scores", "lengths", "lang", "source"]


def test_stages_take_an_empty_table(spark, sf_dir, no_documents):
    docs = no_documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_stages_keep_the_columns_of_odd_rows(spark, sf_dir, odd_documents):
    """Columns that are named like the operators' own, nulls in every column and repeated rows go through as they are."""
    names = ("diff", "shrink", "_id", "_kinds", "_bad", "_gone", "_t", "hash", "pos", "node", "component_id", "_starts")
    docs = odd_documents.selectExpr("*", *(f"'{n} of its own' AS `{n}`" for n in names))
    before = {str(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = [str(r) for r in out.collect()]
        assert set(rows) <= before and rows, name
        if name == "secrets":
            assert len(rows) == 10
        if name == "near_duplicates":  # copies and texts without words are one group each; rows without an id stay
            assert sorted(str(r.doc_id) for r in out.collect()) == ["-8", "2", "5", "7", "None", "None"]
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == 10


def test_no_local_folder_stands_in_for_a_shared_one(spark, monkeypatch):
    from talewright.llm import common

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda name, default: None)

    with pytest.raises(ValueError):
        common.shared_folder(Elsewhere)
