"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import corpus_pipeline as pipeline
from tests.conftest import SMALL
from tests.llm import brute
from tidemark.llm import leaks, queries


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "best_fit_packing"]
    stage = dict(pipeline.STAGES)

    kept = stage["quality_rules"](spark, docs, SMALL).cache()
    assert kept.columns == docs.columns
    assert set(texts(kept)) == {r["doc_id"] for r in queries.op2_quality_rules(spark, SMALL).where("kept").collect()}

    before = texts(kept)
    lined = stage["line_dedup"](spark, kept, SMALL).cache()
    gone = brute.removed_lines(before)
    rest = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in before.items()}
    assert texts(lined) == {i: t for i, t in rest.items() if brute.words(t)}
    assert lined.columns == docs.columns and lined.where("n_chars <> length(text)").count() == 0

    before = texts(lined)
    near = stage["near_dedup"](spark, lined, SMALL).cache()
    assert set(texts(near)) == {i for i, (_, c) in brute.near_components(before).items() if c == i}

    before = texts(near)
    clean = stage["benchmark_decontamination"](spark, near, SMALL).cache()
    items = [leaks.normalise(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(t in leaks.normalise(x) for x in texts(clean).values() for t in items)
    assert set(before) - set(texts(clean)) == {i for i, t in before.items() if any(leaks.myers(p, leaks.normalise(t), leaks.budget(len(p))) for p in items)}

    packed = stage["best_fit_packing"](spark, clean, SMALL)
    assert {r["doc_id"] for r in packed.collect()} == set(texts(clean))
    assert pipeline.run(spark, SMALL).count() == packed.count()


def test_an_empty_corpus_passes_every_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_awkward_rows_pass_every_stage(spark):
    """Null and repeated ids, repeated rows, null and empty texts, and a column with a name that operators use."""
    prose = " ".join(f"word{i} then" for i in range(60))
    other = " ".join(f"other{i} text" for i in range(60))
    rows = [(None, prose), (None, prose), (1, prose), (1, prose), (1, other), (2, other + " more"), (3, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean")
    stage = dict(pipeline.STAGES)
    judged = stage["quality_rules"](spark, docs, SMALL)
    assert judged.columns == docs.columns and all(r["text"] for r in judged.collect())
    lined = stage["line_dedup"](spark, docs, SMALL)
    # rows of equal doc_id and text are one document; null ids come first
    assert sorted((r["doc_id"] or 0, r["text"]) for r in lined.collect()) == [(0, prose), (0, prose), (1, other)] and lined.columns == docs.columns
    near = stage["near_dedup"](spark, docs, SMALL)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near.collect()) == [(0, ""), (1, other), (1, prose), (3, ""), (4, "")] and near.columns == docs.columns
    clean = stage["benchmark_decontamination"](spark, docs, SMALL)
    assert clean.count() == len(rows) and clean.columns == docs.columns
    packed = stage["best_fit_packing"](spark, docs, SMALL)
    assert packed.count() == len(rows) and packed.where("n_tokens < 1").count() == 0
