import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from logwarden.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        often = {p: n for p, n in found.items() if len(p) > 1 and n >= least}
        kept = []
        for p, a in often.items():
            if any(100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, n in often.items() if len(q) > len(p)):
                continue
            score, k = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed=3, n=60):
    draw = random.Random(seed)
    words = ["Ab", "b", "c", "dé", "e", "ab\x1f", "g", "#"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "?"]
    rows = [(i, "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(40))), draw.choice(["en", None, "fr"]))
            for i in range(n)]
    copies = [(100 + i, "c b c b e e e", "en") for i in range(25)]
    return rows + copies + copies[:3] + [(None, None, "en"), (7, "", None), (8, " .,; ", "xx")]


@pytest.mark.parametrize(("sample_least", "top"), [(1, 2000), (3, 5), (10**9, 2000)])
def test_matches_brute_force_whatever_the_sample_proposes(spark, sample_least, top):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = C.collocations(docs, top=top, least=4, sample_least=sample_least)
    assert sorted(map(tuple, found.collect())) == brute(rows, 4, top)


def test_small_groups_and_partitions_do_not_matter(spark):
    rows = corpus(11, 30)
    found = [sorted(map(tuple, C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(n), least=3, sample_least=2).collect()))
             for n in (1, 9)]
    assert found[0] == found[1] == brute(rows, 3, 2000)


def test_empty_tables_clashing_columns_and_a_long_text(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b " * 40_000, "en", "x", 1, 1.0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", phrase string, n bigint, score double")
    assert sorted(map(tuple, C.collocations(docs).collect())) == brute([r[:3] for r in rows], 30, 2000)


def test_filter_holds_what_it_was_given(spark):
    marks = np.random.default_rng(1).integers(0, 1 << 63, 5_000).astype(np.uint64)
    bits = C.filter_of(spark.createDataFrame([(int(m),) for m in marks], "h bigint"))
    assert C._holds(bits, marks).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert C._holds(bits, others).mean() < 0.001 and not C._holds(C.no_phrases(), marks).any()


def test_words_of_a_group():
    at, words = C.split_words([b"A b, c", b"", b" b\tA\x0bz "])
    assert [words[i] if i >= 0 else None for i in at] == ["a", "b", None, "c", None, None, "b", "a", None, "z"]
