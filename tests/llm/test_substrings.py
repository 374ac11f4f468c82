import random

import numpy as np
import pytest

from logwarden.llm import substring_dedup as sd
from logwarden.llm.substring_dedup import intervals, pack, remove_repeats, unpack, window_hashes

SIZE = 13


def words_of(text):
    text = text or ""
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows):
    owner, out = {}, []
    for i, text in rows:
        words = words_of(text)
        for k in range(len(words) - SIZE + 1 if i is not None else 0):
            key = tuple(words[k : k + SIZE])
            owner[key] = min(owner.get(key, i), i)
    for i, text in rows:
        words = words_of(text)
        gone = set()
        for k in range(len(words) - SIZE + 1 if i is not None else 0):
            if owner[tuple(words[k : k + SIZE])] < i:
                gone.update(range(k, k + SIZE))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in frame.collect()), key=str)


def test_hashes_tell_windows_apart():
    draw = random.Random(1)
    words = [draw.choice([b"a", b"b"]) for _ in range(3000)]
    first, second = window_hashes(words)
    keys = [tuple(words[i : i + SIZE]) for i in range(len(words) - SIZE + 1)]
    assert len(first) == len(keys) == len(second)
    assert len(set(keys)) == len(set(first.tolist()))
    assert len(window_hashes(words[:12])[0]) == 0


def test_parts_come_back():
    rng = np.random.default_rng(2)
    hashes = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    columns = (hashes, rng.integers(0, 2**16, 1000).astype(np.uint16), rng.integers(-5, 2**40, 1000),
               rng.integers(0, 3, 1000).astype(np.uint32), rng.integers(0, 99, 1000).astype(np.uint32))
    assert all((a == b).all() for a, b in zip(columns, unpack(pack(*columns), 1000)))


def test_intervals_are_maximal():
    assert intervals(np.array([0, 1, 5, 18, 40], np.uint32)) == [(0, 31), (40, 53)]
    assert intervals(np.array([0, 14], np.uint32)) == [(0, 13), (14, 27)]
    assert intervals(np.array([], np.uint32)) == []


@pytest.mark.parametrize(("bucket", "batch"), [(24_000_000, 24_000_000), (20_000, 30_000)])
def test_documents_match_brute_force(spark, monkeypatch, bucket, batch):
    monkeypatch.setattr(sd, "BUCKET_CHARS", bucket)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(remove_repeats(docs)) == expected
    assert found(remove_repeats(docs.repartition(5))) == expected
    assert any(r[2] for r in expected)


def test_nulls_repeats_and_empty_tables(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(None, passage), (4, passage), (4, passage), (2, "x " + passage + "\x0by"), (9, None), (8, ""), (7, passage[:30]),
            (3, "r " * 500), (5, "r " * 13), (-1, "r\n" * 12)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, parts int")
    assert found(remove_repeats(docs)) == brute(rows)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_are_cleaned_each_by_its_own_words(spark):
    draw = random.Random(3)
    shared = " ".join(draw.choices("abcdefgh", k=30))
    mine, other = (" ".join(f"{x}{i}" for i in range(30)) for x in "uv")
    rows = [(1, shared), (5, f"{shared} {mine}"), (5, other), (5, other), (5, f"{other} {shared}"), (6, other), (None, shared), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(remove_repeats(frame)) == brute(rows)
    kept = {r.kept for r in remove_repeats(frame).filter("doc_id = 5").collect()}
    assert kept == {mine, other, ""}
