import random

import numpy as np
import pyarrow as pa

from logwarden.llm import near_dedup
from logwarden.llm.near_dedup import common_shingles, one_per_group


def shingles(text):
    words = (text or "").lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def first_of_groups(texts):
    """Smallest ids over pairs of at least 0.8."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i for i in texts if top(i) == i}


def test_near_copies_at_080_leave(spark):
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for group in range(30):
        words = draw.choices(vocabulary, k=400)
        texts[len(texts)] = " ".join(words)
        for changed in (1, 4, 8, 12):  # 8 changed words are above 0.8, 12 below
            copy = list(words)
            for at in draw.sample(range(0, 400, 12), changed):
                copy[at] = "changed"
            texts[len(texts)] = " ".join(copy)
    chain = draw.choices(vocabulary, k=400)
    for step in range(80):  # a group whose ends differ
        chain[5 * step] = f"step{step}"
        texts[len(texts)] = " ".join(chain)
    texts |= {1000: "", 1001: None, 1002: "one two"}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id bigint, text string, source string")
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == first_of_groups(texts)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = first_of_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in one_per_group(docs).collect()} == expected
    assert one_per_group(docs.limit(0)).count() == 0


def test_repeated_rows_null_ids_and_shared_ids(spark):
    same, other, third = ("same text here now and then", "quite another text than the first one", "a third one of its own kind")
    rows = [(7, same, "b"), (7, same, "a"), (7, same, "a"), (None, same, "c"), (None, other, "d"), (None, other, "d"),
            (9, third, "e"), (9, same, "f"), (None, None, "g"), (3, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [(7, same, "a"), (None, other, "d"), (9, third, "e"), (3, "", "h")], key=str)


def test_common_shingles_are_counted(monkeypatch):
    monkeypatch.setattr(near_dedup, "_COLUMNS", 7)
    draw = np.random.default_rng(3)
    left, right = ([np.unique(draw.integers(-40, 40, n)) for n in sizes] for sizes in ((30, 1, 90, 5), (12, 60, 3)))
    for one, two in ((left, right), (left, left), ([np.array([1])], [np.array([2])])):
        assert common_shingles(one, two).tolist() == [[len(np.intersect1d(a, b)) for b in two] for a in one]


def test_a_key_of_many_unlike_texts_is_cut_into_cells(spark, monkeypatch):
    """Copies of one text, most of them below 0.8 of each other: many share keys, few are linked."""
    monkeypatch.setattr(near_dedup, "SLICE", 6 * near_dedup.LEAST)
    draw = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(160):
        copy = list(base)
        for at in draw.sample(range(0, 300, 5), draw.choice((3, 4, 4, 6, 9))):
            copy[at] = f"x{i % 40}at{at}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    expected = first_of_groups(texts)
    assert 1 < len(expected) < 160
    assert {r.doc_id for r in one_per_group(docs).collect()} == expected


def test_fingerprints_link_without_minhash_keys(spark):
    """Sets of one fingerprint or two near ones are linked over the pivot table and verified on the sets."""
    draw = random.Random(5)
    texts = {}
    for _ in range(20):
        words = draw.choices([f"w{i}" for i in range(3000)], k=2000)
        for changed in (None, 1000):
            texts[len(texts)] = " ".join("changed" if i == changed else w for i, w in enumerate(words))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values()), "row": list(texts)})
    built = [r for part in near_dedup._sets(iter([batch])) for r in part.to_pylist()]
    fingers = [r["finger"] & (1 << 64) - 1 for r in built]
    near = [bin(a ^ b).count("1") <= 2 for a, b in zip(fingers[::2], fingers[1::2])]
    assert sum(near) >= 5
    schema = "doc_id bigint, row bigint, mark bigint, finger bigint, size int, keys array<bigint>"
    rows = spark.createDataFrame([(r["doc_id"], r["row"], r["mark"], r["finger"], r["size"], []) for r in built], schema)
    named = spark.createDataFrame(list(texts.items()), "row bigint, text string")
    roots = {r.mark: r.root for r in near_dedup.near_groups(rows, named, rows.select("row").limit(0)).collect()}
    found = [roots.get(a["mark"], 0) == roots.get(b["mark"], 1) for a, b in zip(built[::2], built[1::2])]
    assert found == near


def test_tools_of_other_operators_are_freed():
    from logwarden.llm.common import worker_tool

    tool = worker_tool(lambda path: [path])
    first = tool("a")
    assert tool("a") is first
    list(near_dedup._only_sets(iter([pa.RecordBatch.from_pydict({"mark": [1], "text": ["a b"]})])))
    assert tool("a") is not first
