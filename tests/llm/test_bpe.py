import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logwarden.llm import bpe
from logwarden.llm.common import batch_groups

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TOOL = bpe.Encoder(PATH)

CASES = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "Hello world", "aaaaaaaaa", "don't we'll I'M", "\x1c a\x1d",
    "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "naïve café 12 345², Ⅻ", "日本語 テキスト", "tab\tand\r\nline   nbsp",
    "😀 é ​ z", "the " * 3000, "\n\n\n  mixed \t\t spaces   end  ",
]


def library(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_cases_match_the_library():
    assert TOOL.encode(CASES) == [library(t) for t in CASES]
    assert [TOOL.decode(library(t)) for t in CASES] == [
        LIBRARY.decode(LIBRARY.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in CASES
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab 'ns\n\t é1", max_size=60)), max_size=4))
def test_any_text_matches_the_library(texts):
    assert TOOL.encode(texts) == [library(t) for t in texts]
    assert [TOOL.decode(x) for x in TOOL.encode(texts)] == texts


def test_small_tables_give_the_same(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "LAYOUT", 5)
    tool = bpe.Encoder(PATH)
    for _ in range(3):
        assert tool.encode(CASES) == [library(t) for t in CASES]


def test_documents_match_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = bpe.encode_documents(docs, PATH, decode=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: bytes(r.ids) for r in found} == {i: library(t) for i, t in texts.items()}
    assert {r.doc_id: r.decoded for r in found} == texts
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert {r.doc_id: r.decoded for r in back.collect()} == texts


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (1, None), (1, None)]])
def test_nulls_repeats_and_empty_tables(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string")
    found = bpe.encode_documents(docs, PATH, decode=True).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in found) == sorted((i or 0, t or "") for i, t in rows)


def test_few_texts_are_objects_at_once():
    texts = ["a" * 10, None, "é" * 30, "", "b" * 5000, "c", *["d" * 40] * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    parts = [p.column(1).to_pylist() for p in batch_groups(batch, rows=20, size=100)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) <= 20 and (len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 100) for p in parts)
    assert not list(batch_groups(batch.slice(0, 0)))
