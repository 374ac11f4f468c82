import hashlib
import heapq
import random

import pytest

from logwarden.llm import warc
from logwarden.llm.common import scratch


def brute(pages):
    big = {}
    for page, html in pages:
        if len((html or "").encode()) >= 1000 and page is not None:
            big[html] = max(big.get(html, page), page)
    out = []
    for page, html in pages:
        data = (html or "").encode()
        holder = big.get(html)
        revisit = holder is not None and holder != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", holder if revisit else None))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


def test_loser_tree_merges_like_a_heap():
    draw = random.Random(3)
    for k in range(9):
        runs = [sorted(draw.randrange(50) for _ in range(draw.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


PAGES = [
    (1, "http://www.B.example.com:80/x#top", "é" * 500), (9, "https://a.example.com", "é" * 500), (4, None, "é" * 500),
    (None, "b", "é" * 500), (2, "u\r\nWARC-Type: x y", None), (3, "u", ""), (5, "u", "q" * 999), (6, "u", "q" * 999),
    (7, "u", "z" * 50_000), (7, "u", "z" * 50_000), (8, "u", "\r\n\r\nHTTP" * 200), (None, "c", "n" * 2000), (None, "c", "n" * 2000),
]


@pytest.mark.parametrize(("block", "size"), [(500, 100_000), (2, 3)])
def test_round_trip_and_global_order(spark, monkeypatch, block, size):
    monkeypatch.setattr(warc, "BLOCK", block)
    monkeypatch.setattr(warc, "RANGE", size)
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, part int").repartition(3)
    assert found(warc.archive_round_trip(pages)) == brute([(p, h) for p, _, h in PAGES])
    folder = scratch(spark, "warc")
    index = warc.merge_runs(warc.write_runs(warc.capture_rows(pages), folder), folder)
    rows = index.orderBy("part", "position").collect()
    keys = [(r.urlkey, r.stamp, -1 if r.page_id is None else r.page_id) for r in rows]
    assert keys == sorted(keys) and len(keys) == len(PAGES)
    assert ("com,example,b)/x", 1, 1) in keys and len({r.part for r in rows}) == (1 if size > 3 else len({r.part for r in rows}))


def test_pages_match_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert found(warc.archive_round_trip(pages)) == brute([(r.page_id, r.html) for r in pages.collect()])


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_round_trip(pages).count() == 0
