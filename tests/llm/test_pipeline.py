"""The pipeline's stages in order, on documents and on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from textveil.llm.common import table, written


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name != "mixing":
            assert 0 < docs.count() <= n
        n = docs.count()
    assert docs.where("n_pieces <> size(piece_ids)").count() == 0


def test_odd_rows_and_no_rows(spark, sf_dir):
    rows = [(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (1, "a b d", "en", "x", 5), (None, None, None, None, None), (2, "", "en", "y", 0), (3, "word " * 30000, "en", "y", 0), (None, "zz a@b.com", "de", "x", 1)]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (full, full.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == ["doc_id", "source", "piece_ids", "n_pieces"]


def test_no_name_clashes(spark, sf_dir):
    """Extra columns named like helpers come back as they were."""
    names = ("rep f g h b size band bands key base found seen id t toxic toxic_score toxic_predicted toxic_text __id __size __source __gone __twice __row __key __spans __toxic "
             "jaccard_id jaccard_row span_key spans mix_key mix_place mix_copies mix_copy k n u e tier copies taken target source_size p label host path").split()
    rows = [(i, f"document {i} of some words that are its own {i * 7} and more a{i}@b.com", "en", "xyz"[i % 3], 0) for i in range(60)] + [(3, "twice the same id", "en", "x", 0), (3, "twice the same id", "en", "x", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(
        "*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        for r in docs.collect():
            assert all(r[n] == f"{n}:{'null' if r['doc_id'] is None else r['doc_id']}" for n in names), name
    assert docs.count() > 30
