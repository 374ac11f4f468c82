"""Columns of a table that have the names of an operator's helpers come back as they were."""

from functools import partial

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logwarden.llm.line_quality import keep_clean
from logwarden.llm.near_dedup import one_per_group
from logwarden.llm.pii import replace_entities as replace

replace_entities = partial(replace, key=b"a key of tests")

NAMES = ("_text", "_redrawn", "_row", "_cut", "_mark", "kept", "_again", "_twice", "whole", "_loser", "row", "_before", "rest", "before")
WORDS = [f"{a}{b}{c}" for a in ("mar", "tol", "sen", "vik") for b in ("e", "o", "ai") for c in ("n", "st", "ld", "rm", "k", "t", "sh", "p")]
PROSE = "\n".join(" ".join(["The", *WORDS[i : i + 12]]) + "." for i in range(0, 96, 12))


@pytest.fixture(scope="module")
def docs(spark):
    mails = [(i, f"{PROSE}\nMail {i}@host.example.com about the {i + 1} old letters {'w' * i} of last year.", "s", 1) for i in range(4)]
    plain = spark.createDataFrame([*mails, mails[0], (None, None, "s", 0)], "doc_id bigint, text string, source string, n_chars int")
    return plain.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})


def kept(rows):
    return sorted((r["doc_id"], *[r[n] for n in NAMES]) for r in rows.filter("doc_id is not null").collect())


@pytest.mark.parametrize("stage", [keep_clean, one_per_group, replace_entities])
def test_other_columns_come_back(docs, stage):
    out = stage(docs)
    assert out.dtypes == docs.dtypes
    assert set(kept(out)) <= set(kept(docs)) and out.count() > 0
    if stage is replace_entities:
        assert kept(out) == kept(docs) and out.filter("text like '%host.example%'").count() == 0


def test_redrawn_entities_with_clashing_names(spark):
    rows = [(i, f"from {1 + i % 9}.{1 + i // 9 % 9}.{1 + i // 81 % 9}.5 end", f"t{i}", f"r{i}") for i in range(729)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, _redrawn string")
    out = replace_entities(docs).collect()
    assert {(r.doc_id, r["_text"], r["_redrawn"]) for r in out} == {(i, a, b) for i, _, a, b in rows}
    assert len({r.text for r in out}) == 729 and not {r.text for r in out} & {t for _, t, *_ in rows}


def test_stage_of_surrogates(spark, docs):
    out = corpus_pipeline.pii_surrogates(spark, docs, "")
    assert out.columns == docs.columns and kept(out) == kept(docs)
