"""The pipeline's stages on the small tables: each does its part, and keeps the rest."""

import re

import corpus_pipeline as pipeline
from marlstone.llm import decontaminate, pieces, pii, quality, setjoin
from marlstone.session import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "benchmark_decontamination", "pii_surrogates", "sentence_pieces"]
    out = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.written(stage(spark, docs, SF), "test")
        out[name] = {r.doc_id: r for r in docs.collect()}
        if name != "sentence_pieces":
            assert docs.columns == list(pipeline.COLUMNS)
        if name == "quality_rules":
            assert set(out[name]) == {r.doc_id for r in quality.judge(before).where("kept").collect()}
        elif name == "near_duplicates":
            assert set(out[name]) == {r.component_id for r in setjoin.digest(before).collect()}
        elif name == "benchmark_decontamination":
            dirty = {r.doc_id for r in decontaminate.digest(before, table(spark, SF, "benchmark")).where("contaminated").collect()}
            assert set(out[name]) == {r.doc_id for r in before.collect()} - dirty
        elif name == "pii_surrogates":
            old = {r.doc_id: r.text for r in before.collect()}
            for i, r in out[name].items():
                found = [m.group(0) for m in re.finditer(pii.EMAIL, old[i])]
                assert not any(x in r.text for x in found) and r.n_chars == len(r.text)
                if not re.search(r"[0-9@]", old[i]):
                    assert r.text == old[i]
        else:
            p = pieces.pieces()
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(p.decode(r.ids) == texts[i] and r.n_tokens == len(r.ids) for i, r in out[name].items())
    assert {r.doc_id for r in pipeline.run(spark, SF).collect()} == set(docs.toPandas().doc_id)


def test_entry():
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and sum(n.startswith("op") for n in e.queries()) == 13
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stages_on_edges(spark, edge, edge_rows, empty):
    """Nulls, empty and very long texts, ties, repeats, extra columns and no rows at all, stage by stage."""
    wide = edge.selectExpr("*", "'mine' AS n_words", "'mine' AS _th", "'mine' AS _d", "'mine' AS kept")
    for name, stage in pipeline.STAGES:
        got = stage(spark, wide, SF)
        n = got.count()
        assert stage(spark, empty, SF).count() == 0
        if name == "sentence_pieces":
            assert n == len(edge_rows) and got.columns == ["doc_id", "ids", "n_tokens"]
            assert got.where("ids IS NULL").count() == sum(r[1] is None for r in edge_rows)
            continue
        assert got.columns == list(pipeline.COLUMNS) and n <= len(edge_rows)
        texts = [r.text for r in got.collect()]
        if name == "quality_rules":
            assert None not in texts and "" not in texts
        else:
            assert texts.count(None) == sum(r[1] is None for r in edge_rows) and texts.count("") == 1
        if name == "pii_surrogates":
            assert n == len(edge_rows)
