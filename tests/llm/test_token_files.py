import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logwarden.llm import token_files as tf
from logwarden.llm.common import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CASES = [None, "", " ", "Hello World's END", "a\x1cb \x1d", "<|endoftext|> x<|startoftext|>y", "é ÉA K İI",
         "ΣΣ Σ", "1234 ½ a_b--c", "  x　y", "w " * 5000, "a<|b a<"]


def library(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_words_match_the_library():
    tool = tf.WordEncoder(PATH)
    assert tool.encode(CASES) == [library(t) for t in CASES]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_matches_the_library(text):
    assert tf.word_encoder(PATH).encode([text]) == [library(text)]


def test_new_words_are_split_and_merged_together(monkeypatch):
    texts = [" ".join(f"{chr(a)}x{chr(b)}'s{a}," for b in range(33, 256, 7)) for a in range(33, 256)]
    tool = tf.WordEncoder(PATH)
    expected = [library(t) for t in texts]
    asked = []
    lookup = tool.pieces.lookup
    monkeypatch.setattr(tool.pieces, "lookup", lambda groups: asked.append(len(groups)) or lookup(groups))
    assert tool.encode(texts) == expected
    assert asked == [1]  # one list of pieces for all words of a group, not one for each


def test_ids_are_dealt_out_in_order_and_learned_once():
    learned = []
    table = tf.IdTable(lambda new: learned.append(new) or pa.array([w.encode() * 2 for w in new], pa.large_binary()), 3)
    groups = [["b", "a", "b"], [], ["c", "a"]]
    for _ in range(2):
        found = table.lookup(groups)
        assert found.to_pylist() == [b"bb", b"aa", b"bb", b"cc", b"aa"]
    assert learned == [["b", "a", "c"], ["c"]]  # what came once is not kept
    assert tf.regroup(found, np.array([3, 3, 5])).to_pylist() == [b"bbaabb", b"", b"ccaa"]
    assert tf.regroup(table.lookup([]), np.array([0, 0])).to_pylist() == [b"", b""]


def test_small_table_gives_the_same(monkeypatch):
    monkeypatch.setattr(tf, "CACHE", 2)
    tool = tf.WordEncoder(PATH)
    for _ in range(2):
        assert tool.encode(CASES) == [library(t) for t in CASES]


class Store(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


DOCS = [(None, b"\1\0\0\0"), (3, b""), (4, b"\2\0\0\0" * 10), (9, b"\3\0\0\0" * 700_000), (9, b"\4\0\0\0"), (12, b"\5\0\0\0" * 5)]


def test_frames_are_independent_and_checked():
    store = Store()
    totals = tf.write_file(store, DOCS)
    assert totals["n_docs"] == 6 and totals["first_doc"] == 3 and totals["last_doc"] == 12
    assert [d for f in tf.read_frames(store) for d in f] == DOCS
    frames = list(tf.read_frames(store))
    assert len(frames) == 3
    only = list(tf.read_frames(store, {4}))
    assert len(only) == 1 and (4, DOCS[2][1]) in only[0]
    broken = bytearray(store.getvalue())
    broken[-9 - 12 * 3 + 8] ^= 1  # checksum of the first frame
    with pytest.raises(ValueError):
        list(tf.read_frames(Store(bytes(broken))))
    assert list(tf.read_frames(Store(bytes(broken)), {12})) != []


def expected(rows):
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(text) + (2).to_bytes(4, "little")
        out.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [(r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in tf.round_trip(docs, PATH).collect()]
    assert sorted(found) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_fetch_nulls_repeats_and_empty_tables(spark):
    rows = [(7, "x y", 1), (None, "n", 1), (2, None, 1), (7, "x y", 1), (1, CASES[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    folder = scratch(spark, "tokens")
    files = tf.write_documents(docs, PATH, 2, folder)
    found = [(r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in tf.read_documents(files, folder).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(found, key=key) == expected([r[:2] for r in rows])
    assert {(r.doc_id, bytes(r.ids)) for r in tf.fetch_documents(files, folder, [2, 5]).collect()} == {(2, b"\2\0\0\0")}
    assert tf.round_trip(docs.limit(0), PATH).count() == 0
