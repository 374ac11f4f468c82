"""Quality rules: clean line by line first, then judge what is left of the document.

Every line with a word is tried against three rules: it must end like a sentence,
it must not be navigation, it must not be boilerplate. Failing lines are removed.
A document that fails the base measures, or loses too large a share of its
characters to the line rules, is rejected. All of it is expressions on the row:
no shuffle, no Python.

Defined results: a null text counts as empty (no words, so rejected); ties do not
occur; repeated rows are judged alike, each on its own; an empty table gives an
empty result; columns besides id and text are neither read nor touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import SPACE, words_of

# fixed values: characters counted as symbols
SYMBOLS = "#*$%&|<>"
# characters a sentence may end with, closing quotes and brackets included
ENDINGS = (".", "!", "?", "…", "。", "！", "？", '"', "”", "’", "'", "»", ")", "]", ":", ";")
SEPARATORS = "[|•·»›]"
BOILERPLATE = (
    r"(?i)\b(?:java ?script|cookies?|privacy policy|terms of (?:use|service)|all rights reserved|click here|"
    r"read more|subscribe|newsletter|sign (?:in|up)|log ?in|share this|lorem ipsum|skip to content|site ?map)\b"
)


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeat_percent: int = 50  # words inside repeated three-word windows
    separators: int = 2  # so many separators make a line navigation
    boilerplate_chars: int = 200  # longer lines only mention such a phrase
    symbols_per_word: float = 0.34  # more symbols than this is no sentence
    max_lost: float = 0.5  # share of word characters the line rules may remove


_BLANK = "[\\x20\\x09-\\x0D]+"
FEW = 16  # repeated windows looked up one by one; more are found by a sort of all windows


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line breaks one of the line rules."""
    last = F.substring(line, -1, 1)
    last = F.when(last.isin(*SPACE), F.substring(F.rtrim(line, F.lit(SPACE)), -1, 1)).otherwise(last)
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))
    noise = (symbols > 0) & (symbols > rules.symbols_per_word * F.size(words_of(line)))
    navigation = F.regexp_count(line, F.lit(SEPARATORS)) >= rules.separators
    boilerplate = (F.char_length(line) <= rules.boilerplate_chars) & line.rlike(BOILERPLATE)
    return ~last.isin(*ENDINGS) | navigation | noise | boilerplate


def _window_hashes(words: Column) -> Column:
    """Hash of every three-word window, in order."""
    return F.transform(
        F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )


def _repeated(ordered: Column) -> Column:
    """Values that occur at least twice in a sorted array."""
    return F.array_distinct(F.filter(ordered, lambda x, k: F.coalesce(F.get(ordered, k + 1) == x, F.lit(False))))


def _sorted_pairs(hashes: Column) -> Column:
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _positions(hashes: Column, repeated: Column, pairs: Column) -> Column:
    """Ascending positions of the windows that occur at least twice."""

    def twice(x: Column, k: Column) -> Column:
        before = F.get(pairs, F.when(k > 0, k - 1).otherwise(F.lit(-1)))
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)
        )

    looked_up = F.filter(
        F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda i: i.isNotNull()
    )
    return (
        F.when(F.size(repeated) == 0, F.array().cast("array<int>"))
        .when(pairs.isNull(), looked_up)
        .otherwise(F.sort_array(F.transform(F.filter(pairs, twice), lambda x: x["i"])))
    )


def measure_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: LineRules = LineRules()
) -> DataFrame:
    """Base measures, the lines that pass and the verdict, one row per row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_lines_kept, chars_lost, base_failed, kept, clean_text``.
    """
    body = F.coalesce(F.col("_text"), F.lit(""))
    zero = F.lit(0).cast("bigint")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    rows = rows.withColumn("_words", words_of(F.col("_text"))).withColumn(
        "_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    )
    rows = rows.withColumn("_hashes", _window_hashes(F.col("_words"))).withColumn(
        "_fails", F.transform("_lines", lambda x: line_fails(x, rules))
    )
    rows = rows.withColumn("_ordered", F.sort_array("_hashes")).withColumn("_repeated", _repeated(F.col("_ordered")))
    rows = rows.withColumn("_pairs", F.when(F.size("_repeated") > FEW, _sorted_pairs(F.col("_hashes"))))
    rows = rows.withColumn("_twice", _positions(F.col("_hashes"), F.col("_repeated"), F.col("_pairs")))
    starts, fails = F.col("_twice"), F.col("_fails")
    steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    lost = F.filter("_lines", lambda x, k: F.get(fails, k))
    measured = rows.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(steps, zero, lambda s, x: s + x).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("_fails", lambda x: ~x)).cast("bigint").alias("n_lines_kept"),
        F.aggregate(
            lost, zero, lambda s, x: s + F.char_length(F.regexp_replace(x, _BLANK, "")).cast("bigint")
        ).alias("chars_lost"),
        F.array_join(F.filter("_lines", lambda x, k: ~F.get(fails, k)), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("chars_lost") <= rules.max_lost * F.col("word_chars"))
    )


def keep_clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` whose text passes, without its failing lines.

    A text that loses lines becomes its ``clean_text``, and ``n_chars``, if there is
    such a column, the length of that; texts without failing lines and all other
    columns stay as they are. The verdict is taken from the row itself, so rows without
    id or with a repeated id are judged like any other.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    judged = measure_lines(docs.select(whole, docs["text"]), doc_id="_row", rules=rules)
    cut = F.when(F.col("n_lines_kept") < F.col("n_lines"), F.col("clean_text")).alias("_cut")
    # conditions are not pushed below a random column; there the optimizer would repeat the
    # shared word and line arrays once for each use
    marked = judged.select("doc_id", "kept", cut, F.rand().alias("_mark"))
    left = marked.filter("kept and _mark >= 0")
    new = {"text": F.col("_cut"), "n_chars": F.char_length("_cut")}
    kinds = dict(docs.dtypes)
    old = {c: F.col("doc_id")[c] for c in docs.columns}  # the whole row, so that no column of it meets a helper's name
    return left.select(*[
        (F.when(F.col("_cut").isNotNull(), new[c].cast(kinds[c])).otherwise(old[c]) if c in new else old[c]).alias(c)
        for c in docs.columns])
