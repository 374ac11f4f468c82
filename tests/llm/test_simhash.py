import random

import pytest
import xxhash
from pyspark.sql import functions as F

from logwarden.llm import simhash
from logwarden.llm.simhash import fingerprint, links, near_duplicates, one_per_group


def slow_mark(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(marks):
    """Smallest id reachable over marks within two bits."""
    root = {i: i for i in marks}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(marks)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: top(i) for i in ids}


def test_fingerprints_match_definition():
    texts = [None, "", " ", "One", "one TWO", "a b c", "a b c d e É é", "x y\x85z q", "r " * 400]
    assert [fingerprint(t.encode() if t else None) for t in texts] == [slow_mark(t) for t in texts]


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = {r.doc_id: slow_mark(r.text) for r in docs.collect()}
    groups = slow_groups(marks)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert found == {i: (f"{marks[i]:016x}", groups[i]) for i in marks}
    assert len(set(groups.values())) < len(groups)


@pytest.mark.parametrize("dense", [64, 3, 1])
def test_links_connect_what_is_within_two_bits(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    draw = random.Random(dense)
    marks = {}
    for _ in range(12):  # chains and clouds around random centres
        mark = draw.getrandbits(64)
        for _ in range(10):
            marks[len(marks)] = mark
            for bit in draw.sample(range(64), draw.choice([1, 1, 2, 2, 3])):
                mark ^= 1 << bit
    for i in range(40):
        marks[len(marks)] = draw.getrandbits(64)
    marks = {i: m for m, i in {m: i for i, m in marks.items()}.items()}
    rows = [(i, m - (1 << 64) if m >> 63 else m) for i, m in marks.items()]
    edges = [tuple(r) for r in links(spark.createDataFrame(rows, "rep bigint, mark bigint")).collect()]
    assert all((marks[a] ^ marks[b]).bit_count() <= 2 for a, b in edges)
    root = {i: i for i in marks}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    assert {i: top(i) for i in marks} == slow_groups(marks)


def test_nulls_repeats_hot_groups_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_LEAST", 2)
    rows = [(5, None, 1), (3, "", 1), (None, " ", 1), (7, "same text here now", 1), (7, "same text here now", 1),
            (None, "alone in the world", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark int")
    found = sorted(map(tuple, near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert found == sorted([(5, 3), (3, 3), (None, 3), (7, 7), (7, 7), (None, None)], key=str)
    kept = one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 3, 7, 7]
    assert near_duplicates(docs.filter(F.lit(False))).count() == 0
