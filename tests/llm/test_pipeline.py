import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logwarden.llm.decontaminate import find_leaks
from logwarden.llm.line_quality import keep_clean, measure_lines
from logwarden.llm.pii import key_of, replace_entities

from .test_near_dedup import first_of_groups

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}

    clean = keep_clean(docs)  # the texts that the quality stage leaves, their failing lines removed
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {r.doc_id for r in measure_lines(docs).collect() if r.kept}
    single = first_of_groups(texts)
    left = clean.filter(F.col("doc_id").isin(single))
    leaks = {r.doc_id for r in find_leaks(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    left = clean.filter(F.col("doc_id").isin(single - leaks))
    assert set(final) == single - leaks and 0 < len(final) < docs.count()

    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    for r in replace_entities(left, key=key_of(spark)).collect():
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(final[r.doc_id].ids) == ids and final[r.doc_id].n_tokens == len(ids) // 4 and final[r.doc_id].decodes


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    rows = [(None, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "a b " * 200, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns and out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
