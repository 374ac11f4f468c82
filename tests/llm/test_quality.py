import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logwarden.llm.line_quality import keep_clean, measure_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
    return (*base, len(words) < 50 or 100 * len(hit) > 50 * len(words))


CASES = [
    None, "", " \n\t ", "a", "a b", "a b c a b c", "x x x x x", "é è ü\n\n é è ü", "#a *b $c |d\n#a *b $c |d\n",
    "\x0bword\x0c one\r\n two\x85three", "one line. " * 40, " ".join(f"w{i}" for i in range(60)) + ".", "t " * 30_000,
]


def test_base_measures_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string")
    found = {r["doc_id"]: tuple(r[c] for c in BASE) for r in measure_lines(docs).collect()}
    assert found == {i: brute(t) for i, t in enumerate(CASES)}


def test_base_measures_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r["doc_id"]: tuple(r[c] for c in BASE) for r in measure_lines(docs).collect()}
    assert found == {i: brute(t) for i, t in texts.items()}


PROSE = "\n".join(f"Line{i} tells thing{i} about place{i} with colour{i} then sound{i} near river{i}." for i in range(10))


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        (PROSE, True),
        (PROSE + "\nHome | About | Contact | Help", True),
        (PROSE + "\nAccept cookies to read on.", True),
        (PROSE.replace(".", ""), False),
        ("\n".join(" | ".join(f"item{i}{k}" for k in range(9)) for i in range(12)), False),
        ("\n".join(f"word{i}### other{i}*** thing{i}$$$ last{i}." for i in range(30)), False),
        ("\n".join(f"Please log in number {i} to read more." for i in range(30)), False),
        (PROSE.split("\n")[0], False),
    ],
)
def test_verdict(spark, text, kept):
    docs = spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, kept string")
    assert measure_lines(docs).first()["kept"] is kept
    left = keep_clean(docs)
    assert left.columns == docs.columns and left.count() == int(kept)


def test_failing_lines_are_removed(spark):
    text = PROSE + "\nHome | About | Contact\nno end"
    row = measure_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["clean_text"] == PROSE and row["n_lines"] - row["n_lines_kept"] == 2


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, PROSE), (1, PROSE), (1, PROSE)], "doc_id bigint, text string")
    assert [r["kept"] for r in measure_lines(docs).collect()] == [True] * 3 and keep_clean(docs).count() == 3
    assert measure_lines(docs.filter(F.lit(False))).count() == 0 and keep_clean(docs.limit(0)).count() == 0


def test_kept_documents_lose_their_failing_lines(spark):
    spaced = PROSE.replace("\n", "\n\n")
    rows = [(1, PROSE + "\nHome | About | Contact\nno end", "s", 5), (None, spaced, "s", len(spaced)), (3, "no", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    left = keep_clean(docs)
    assert left.dtypes == docs.dtypes
    assert sorted(map(tuple, left.collect()), key=str) == [(1, PROSE, "s", len(PROSE)), (None, spaced, "s", len(spaced))]
    assert [r.text for r in keep_clean(docs.select("text").limit(1)).collect()] == [PROSE]
