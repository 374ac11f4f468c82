import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from logwarden.llm import lexical_search as S

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    total, size = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c in counted:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)) & set(c):
                df = sum(t in d for _, d in counted)
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * total // size)))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus(n, seed=5):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Été", "ÉTÉ", "a_b", "x-9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.randrange(60)))) for i in range(n)]
    rows += [(1000 + i, "w1 w2 W3") for i in range(40)] + [(3, "w5 w5 rare"), (3, "w6"), (None, "w1 rare w2"), (None, None), (9, " -- ")]
    items = [(i, " ".join(draw.choices(words, k=12))) for i in range(12)]
    return rows, items + [(1, "w1 rare"), (1, "w1 rare"), (1, "w2"), (None, "w7 w8"), (50, ""), (51, None), (52, "unseen")]


def test_matches_brute_force(spark):
    docs, items = corpus(300)
    index = S.build_index(spark.createDataFrame(docs, DOCS).repartition(5))
    found = S.search(index, spark.createDataFrame(items, ITEMS), top=7)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 7)


@pytest.mark.parametrize("window", [16, 10_000])
def test_search_of_a_shard_in_windows_of_any_size(monkeypatch, window):
    """Every list, split into essential and other ones as the needed score grows, against plain sums."""
    monkeypatch.setattr(S, "WINDOW", window)
    draw = np.random.default_rng(window)
    for _ in range(40):
        n = int(draw.integers(1, 1500))
        norm = draw.integers(50, 300, n)
        lists, sums = [], np.zeros(n, np.int64)
        for _ in range(int(draw.integers(1, 9))):
            docs = np.flatnonzero(draw.random(n) < draw.random() ** 2)
            if not len(docs):
                continue
            tf = draw.integers(1, 400, len(docs))
            packed, starts = S.pack(np.column_stack([np.diff(docs, prepend=0), tf]).ravel())
            first = np.arange(0, len(docs), S.BLOCK)
            gain = S.impacts(tf, norm[docs])
            p = S.Postings(len(docs), np.maximum.reduceat(gain, first), docs[np.minimum(first + S.BLOCK, len(docs)) - 1],
                           starts[2 * first], packed.tobytes(), norm)
            w = int(draw.integers(1, 9000))
            lists.append((p, w))
            sums[docs] += w * gain
        best = S.Best(np.empty(0, np.int64), np.empty(0, np.int64), 10)
        if lists:
            S.search_shard(lists, np.arange(n), best)
        want = sorted((-s, i) for i, s in enumerate(sums.tolist()) if s > 0)[:10]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want


def test_blocks_that_cannot_reach_the_score_stay_packed():
    n = 20_000
    norm = np.full(n, 100)

    def postings(docs, tf):
        packed, starts = S.pack(np.column_stack([np.diff(docs, prepend=0), tf]).ravel())
        first = np.arange(0, len(docs), S.BLOCK)
        return S.Postings(len(docs), np.maximum.reduceat(S.impacts(tf, norm[docs]), first),
                          docs[np.minimum(first + S.BLOCK, len(docs)) - 1], starts[2 * first], packed.tobytes(), norm)

    common = postings(np.arange(n), np.ones(n, np.int64))
    rare = postings(np.arange(0, n, 500), np.full(40, 5))
    best = S.Best(np.empty(0, np.int64), np.empty(0, np.int64), 3)
    S.search_shard([(common, 10), (rare, 9000)], np.arange(n), best)
    assert best.ids.tolist() == [0, 500, 1000] and common.open.sum() < len(common.open) / 2


def test_varints_round_trip():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_151, 2_097_152, 1 << 30, (1 << 35) - 1])
    packed, starts = S.pack(values)
    assert S.unpack(packed.tobytes()).tolist() == values.tolist() and starts[-1] == len(packed)


def test_many_query_blocks_and_shards_give_the_same(spark, monkeypatch):
    docs, items = corpus(80, 9)
    monkeypatch.setattr(S, "QUERY_BLOCK", 4)
    index = S.build_index(spark.createDataFrame(docs, DOCS).repartition(11))
    found = S.search(index, spark.createDataFrame(items, ITEMS), top=4)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 4)


def test_empty_tables_and_clashing_columns(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w1", 5)], ITEMS + ", rank int")
    assert S.search(S.build_index(none), items).collect() == []
    docs = spark.createDataFrame([(4, "w1 w2", "s", 1), (5, "w2", "s", 2)], DOCS + ", shard string, term int")
    assert S.search(S.build_index(docs), spark.createDataFrame([], ITEMS)).collect() == []
    found = S.search(S.build_index(docs), items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute([(4, "w1 w2"), (5, "w2")], [(1, "w1")], 50)


def test_index_holds_every_term_of_every_document(spark):
    docs, _ = corpus(50)
    index = S.build_index(spark.createDataFrame(docs, DOCS))
    want = Counter(t.encode() for _, text in docs for t in set(terms(text)))
    got = Counter()
    for r in index.table.filter("octet_length(term) > 0").collect():
        got[bytes(r.term)] += r.found
    assert got == want and index.terms == sum(len(terms(t)) for _, t in docs)
