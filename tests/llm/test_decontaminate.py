import random
import re
from collections import Counter

from pyspark.sql import functions as F

from logwarden.llm import decontaminate
from logwarden.llm.decontaminate import drop_leaks, find_leaks


def grams(words, size):
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """Best similarity over all windows as long as the item."""
    out = {}
    for i, text in docs:
        words = split(text)
        for item, passage in items:
            want = split(passage)
            size = min(5, len(want))
            if not size:
                continue
            target, have = grams(want, size), grams(words, size)
            if not set(target) & set(have):
                continue
            for start in range(len(have)):
                window = Counter(have[start : start + len(target)])
                both = sum((window & Counter(target)).values())
                sim = both / (sum(window.values()) + len(target) - both)
                if sim >= 0.8 and sim > out.get((i, item), (0, 0))[0]:
                    out[i, item] = (sim, start)
    return {k: (v[1], round(v[0], 9)) for k, v in out.items()}


def found(frame):
    return {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in frame.collect()}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(find_leaks(docs, items)) == expected and expected


def test_planted_and_edited_passages(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(draw.choices(vocabulary, k=n))) for i, n in enumerate([60, 40, 7, 3, 1, 5, 200])] + [(99, None), (98, "- !")]
    docs = []
    for i, passage in items[:7]:
        words = passage.split()
        filler = [" ".join(draw.choices(vocabulary, k=30)) for _ in range(2)]
        edited = list(words)
        edited[len(words) // 2] = "changed"
        docs += [(10 * i, passage), (10 * i + 1, f"{filler[0]}\n{passage.upper()}!! {filler[1]}"),
                 (10 * i + 2, f"{filler[0]} {' '.join(edited)} {filler[1]}"),
                 (10 * i + 3, f"{filler[0]} {' '.join(words[:-2])}"), (10 * i + 4, f"{filler[0]} {' '.join(words[: len(words) // 2])}")]
    docs += [(900, None), (901, ""), (902, "x " * 20_000), (903, items[0][1] + " ; " + items[1][1])]
    frame = spark.createDataFrame([(*d, "y") for d in docs], "doc_id bigint, text string, mark string")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, n int")
    expected = brute(docs, items)
    assert found(find_leaks(frame, bench)) == expected
    assert {(0, 0), (1, 0), (2, 0), (903, 0), (903, 1), (32, 3)} - set(expected) <= {(32, 3)}
    kept = drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in expected}


def test_nulls_repeats_and_empty_tables(spark):
    passage = "one two three four five six seven eight"
    docs = spark.createDataFrame([(None, passage), (1, passage), (1, passage), (1, "other"), (None, "clean")],
                                 "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, passage)], "item_id bigint, text string")
    leaks = sorted((r.doc_id or 0, r.item_id, r.start) for r in find_leaks(docs, bench).collect())
    assert leaks == [(0, 5, 0), (1, 5, 0)]
    assert sorted(r.text for r in drop_leaks(docs, bench).collect()) == ["clean", "other"]
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0
    assert drop_leaks(docs, bench.limit(0)).count() == 5


def test_reordered_and_trimmed_passages(spark):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    swapped, trimmed, repeated = (draw.choices(vocabulary, k=n) for n in (100, 200, 30))
    repeated = repeated * 4  # every shingle several times
    filler = draw.choices(vocabulary, k=60)
    docs = [
        (1, [*swapped[50:], *swapped[:50]]), (2, [*filler, *swapped[50:], *swapped[:50], *filler]),
        (3, [*filler, *trimmed[8:100], *draw.choices(vocabulary, k=14), *trimmed[100:192], *filler]),
        (4, [*filler, *repeated[10:], *repeated[:10]]), (5, [*filler, *repeated, *repeated, *filler]), (6, repeated[:70]),
    ]
    docs = [(i, " ".join(w)) for i, w in docs]
    items = [(i, " ".join(w)) for i, w in enumerate((swapped, trimmed, repeated))]
    expected = brute(docs, items)
    assert {(1, 0), (2, 0), (3, 1)} <= set(expected)
    frame, bench = (spark.createDataFrame(x, f"{c} bigint, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
    assert found(find_leaks(frame, bench)) == expected


def test_random_windows_match_brute_force(spark):
    draw = random.Random(12)
    items = [(i, " ".join(draw.choices("ab", k=draw.randint(1, 40)))) for i in range(8)]
    docs = [(i, " ".join(draw.choices("ab", k=draw.randint(0, 60)))) for i in range(60)]
    docs += [(100 + i, " ".join(draw.choices("abc", weights=(9, 9, 1), k=20)) + " " + draw.choice(items)[1]) for i in range(60)]
    frame, bench = (spark.createDataFrame(x, f"{c} bigint, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
    assert found(find_leaks(frame, bench)) == brute(docs, items)


def test_null_and_repeated_item_ids(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "red green blue black white grey pink")
    bench = spark.createDataFrame([(None, one), (4, two), (4, three), (4, three), (None, None)], "item_id bigint, text string")
    halves = " ".join([*two.split()[:6], "stop", *three.split()[:6]])  # half of either item is no leak
    docs = spark.createDataFrame([(1, one), (2, two), (3, three), (5, halves)], "doc_id bigint, text string")
    leaks = sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in find_leaks(docs, bench).collect())
    assert leaks == [(1, None, 0, 1.0), (2, 4, 0, 1.0), (3, 4, 0, 1.0)]
    assert [r.doc_id for r in drop_leaks(docs, bench).collect()] == [5]


def test_every_window_goes_through_fingerprints(spark, monkeypatch):
    """All starts that share a shingle are fingerprinted, those of short items too; few votes lose no leak."""
    seen, near = [], decontaminate._near_windows

    def recorded(rows, windows, items, size):
        seen.extend((r.doc_id, r.item_id, r.start) for r in windows.collect())
        return near(rows, windows, items, size)

    monkeypatch.setattr(decontaminate, "_near_windows", recorded)
    draw = random.Random(5)
    long, short, other = ([f"{c}{i}" for i in range(n)] for c, n in (("l", 30), ("s", 7), ("o", 60)))
    beat = [("on", "off")[i % 2] for i in range(14)]
    items = [(i, " ".join(w)) for i, w in enumerate((long, short, beat[:13], beat[1:], draw.choices("xy", k=30)))]
    docs = [(0, [*other, *long[:10], *other]), (1, [*other, *short, *other]), (2, beat[:13]), (3, beat[1:]), (4, [*beat[1:], *other])]
    docs = [(i, " ".join(w)) for i, w in docs]
    frame, bench = (spark.createDataFrame(x, f"{c} bigint, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
    expected = brute(docs, items)
    # equal but for one place of two shingles: a similarity of 0.8, while 45 bits differ
    assert {(2, 2), (2, 3), (3, 2), (3, 3), (4, 2), (4, 3), (1, 1)} == set(expected) and expected[4, 2] == (0, 0.8)
    assert found(find_leaks(frame, bench)) == expected
    want = set()
    for i, text in docs:
        for item, passage in items:
            size, have = len(split(passage)) - 4, grams(split(text), 5)
            shared = set(grams(split(passage), 5))
            want |= {(i, item, s) for s in range(len(have)) if shared & set(have[s : s + size])}
    assert sorted(seen) == sorted(want) and (0, 0, 40) in want
    marks = spark.range(1, 70).select("id", F.transform(F.sequence(F.lit(1), "id"), lambda k: F.xxhash64(k % 9)).alias("h"))
    for r in marks.select("h", decontaminate.simhash(F.col("h")).alias("mark")).collect():
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))
        assert r.mark & (1 << 64) - 1 == bits
