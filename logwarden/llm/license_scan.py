"""License scans with ordered signature rules.

A text is brought to lower-case words. Each rule is a regular expression over those
words with a keyword, a label, a priority and a score. Rules run only on texts that
hold their keyword, and no rule runs on texts that hold neither a general license
word, nor a short name together with a form it may stand in, nor the keyword of a
signature. Signatures of license bodies, notices, deeds and addresses are written by
hand (``license_texts``); names of licenses are crossed with the sentences they stand in.
Overlapping detections are resolved by intervals: a detection inside another one
that is longer, or as long and of better priority, is suppressed. Base phrases are
rules as well; they are counted at every place and never suppressed.

DataFrame functions only. Detections leave the row as numbers (place, length, rule),
so one shuffle of small rows brings the detections of a row together.

Defined results: a null or empty text has no words, no places, null first and last
word, empty labels and score 0; equal intervals keep the rule of better priority,
then the one listed first; repeated rows and rows without id stay rows of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.license_texts import SIGNATURES

_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # before lower-casing

# fixed values: base phrases and their labels
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# (label, keyword, names as patterns over words); names with spaces stand for words in a row
NAMES: list[tuple[str, str, str]] = [
    ("mit", "mit", "mit"),
    ("mit-0", "mit", "mit (?:no attribution|0)"),
    ("x11", "x11", "x11"),
    ("apache-1.1", "apache", "apache (?:software )?(?:license )?(?:version |v)?1 1"),
    ("apache-2", "apache", "apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?"),
    ("gpl-2", "2", "(?:gnu )?(?:general public license|gpl) ?(?:version |v)?2(?: 0)?(?: only)?"),
    ("gpl-2-or-later", "2", "(?:gnu )?(?:general public license|gpl) ?(?:version |v)?2(?: 0)? or (?:any )?later(?: version)?"),
    ("gpl-3", "3", "(?:gnu )?(?:general public license|gpl) ?(?:version |v)?3(?: 0)?(?: only)?"),
    ("gpl-3-or-later", "3", "(?:gnu )?(?:general public license|gpl) ?(?:version |v)?3(?: 0)? or (?:any )?later(?: version)?"),
    ("lgpl-2.1", "2 1", "(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?2 1"),
    ("lgpl-3", "3", "(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2", "library", "(?:gnu )?library general public license(?: version)? 2(?: 0)?"),
    ("agpl-3", "3", "(?:gnu )?(?:affero general public license|agpl) ?(?:version |v)?3(?: 0)?"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation license(?: version)? 1 3"),
    ("gfdl-1.2", "documentation", "(?:gnu )?free documentation license(?: version)? 1 2"),
    ("bsd-0-clause", "bsd", "(?:0 clause|zero clause) bsd|0bsd"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version)? 1 1"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("cddl-1", "distribution", "common development and distribution license(?: version)? 1(?: 0)?"),
    ("cpl-1", "common", "common public license(?: version)? 1(?: 0)?"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: version| v)? ?1 2"),
    ("artistic-2", "artistic", "artistic license(?: version)? 2(?: 0)?"),
    ("artistic-1", "artistic", "artistic license(?: version)? 1(?: 0)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost-1", "boost", "boost software license(?: version)? 1(?: 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "what the", "do what the [a-z]+ you want to public license"),
    ("python-2", "python", "python software foundation license(?: version)?(?: 2)?"),
    ("python-2", "psf", "psf license(?: version)?(?: 2)?"),
    ("php-3", "php", "php license(?: version)? 3(?: 0| 01)?"),
    ("ruby", "ruby", "ruby"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: version)? 1 1"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("upl-1", "universal", "universal permissive license(?: version)? 1(?: 0)?"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("osl-3", "open software", "open software license(?: version)? 3(?: 0)?"),
    ("afl-3", "academic", "academic free license(?: version)? 3(?: 0)?"),
    ("qpl-1", "q public", "q public license(?: version)? 1(?: 0)?"),
    ("odbl-1", "database", "(?:open data commons )?open database license(?: v| version)? ?1(?: 0)?"),
    ("pddl-1", "public domain", "public domain dedication and license(?: v| version)? ?1(?: 0)?"),
    ("cc0-1", "cc0", "(?:creative commons )?cc0(?: 1(?: 0)?)?"),
    ("cc-by-4", "cc", "cc by 4 0"),
    ("cc-by-3", "cc", "cc by 3 0"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by", "creative", "creative commons attribution(?: [1-4] 0)?(?: international| unported)?"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?(?: international| unported)?"),
    ("proprietary", "rights reserved", "all rights reserved"),
    ("public-domain", "public domain", "(?:dedicated to|placed in|released into) the public domain"),
]
# how a name stands in a text: (priority, score, pattern around {name}); smaller priority is better
FORMS: list[tuple[int, float, str]] = [
    (1, 1.0, "spdx license identifier (?:{name})(?: licen[cs]e)?"),
    (2, 0.95, "(?:re)?licensed under (?:the )?(?:terms of the )?(?:{name})(?: licen[cs]e)?"),
    (3, 0.9, "(?:released|distributed|available|provided|published|made available|used) under (?:the )?(?:terms of the )?(?:{name})(?: licen[cs]e)?"),
    (4, 0.85, "(?:subject to|governed by|covered by|under) the (?:terms of the )?(?:{name})(?: licen[cs]e)?"),
    (5, 0.8, "licen[cs]e (?:is )?(?:the )?(?:{name})(?: licen[cs]e)?"),
    (6, 0.7, "(?:the )?(?:{name}) licen[cs]e"),
]
# full names that identify a license without any words around them
PLAIN = (7, 0.6, "(?:{name})")
_NEEDS_FORM = {"mit", "x11", "isc", "ruby", "postgresql", "openssl", "zlib", "ncsa", "ms-pl", "ms-rl", "unlicense"}
# a full name holds one of these words, and so does every form that ends or begins with "license"
GATES = ("licen", "public domain", "rights reserved", "cc by", "cc0", "creative commons", "public license", "gpl", "apache",
         "bsd", "mit no", "mit 0")
# a short name in any other form holds one of these and its keyword as a word
SHORT_FORMS = (" under ", " subject to ", " governed by ", " covered by ")
SHORT_NAMES = tuple(sorted({key for label, key, _ in NAMES if label in _NEEDS_FORM}))


def _first_words() -> str:
    """What any text with a match holds before it is brought to words: one alternation, by first letter."""
    words = {"licen", "cc", "gpl", "apache", "bsd", "domain", "reserved", "commons", *SHORT_NAMES}
    words |= {max(key.split(), key=len) for _, key, *_ in SIGNATURES}
    least = [w for w in words if not any(o != w and o in w for o in words)]
    letters = {w[0]: sorted(o[1:] for o in least if o[0] == w[0]) for w in sorted(least)}
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in letters.items())


FIRST = _first_words()


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """All rules in order: number, label, keyword, pattern over words, priority, score."""
    found = [(label, phrase.split()[-2], phrase, 0, 1.0) for phrase, label in BASE.items()]
    found += [(label, key, form.format(name=name), rank, score)
              for rank, score, form in FORMS for label, key, name in NAMES]
    found += [(label, key, PLAIN[2].format(name=name), PLAIN[0], PLAIN[1])
              for label, key, name in NAMES if label not in _NEEDS_FORM]
    found += SIGNATURES
    return [(i, label, key, f"(?<= )(?:{pattern})(?= )", rank, score)
            for i, (label, key, pattern, rank, score) in enumerate(found)]


def _rule_rows() -> Column:
    kinds = ("int", "string", "string", "string", "int", "double")
    names = ("rule", "label", "keyword", "pattern", "rank", "score")
    return F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(r, kinds, names)]) for r in rules()])


def may_match(norm: Column) -> Column:
    """False only for texts that hold no rule's match."""

    def any_of(words: Iterable[str]) -> Column:
        return reduce(Column.__or__, [F.contains(norm, F.lit(w)) for w in words])

    signed = any_of(sorted({key for _, key, *_ in SIGNATURES}))
    return any_of(GATES) | signed | (any_of(SHORT_FORMS) & any_of(f" {w} " for w in SHORT_NAMES))


def _blanks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _detect(norm: Column) -> Column:
    """Matches of all rules whose keyword is in the text: for each match the blanks before it since the last one."""
    tried = F.filter(_rule_rows(), lambda r: F.contains(norm, r["keyword"]))

    def matches(r: Column) -> Column:
        gaps = F.split(norm, r["pattern"], -1)
        return F.transform(
            F.regexp_extract_all(norm, r["pattern"], F.lit(0)),
            lambda m, k: F.struct(
                r["rule"].alias("rule"), r["label"].alias("label"), r["rank"].alias("rank"), r["score"].alias("score"),
                k.alias("k"), _blanks(F.get(gaps, k)).alias("gap"), (_blanks(m) + 1).alias("words"),
            ),
        )

    return F.flatten(F.transform(tried, matches))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, base places and labels, all labels, and the best score."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")
    )
    lower = F.lower(F.coalesce("_text", F.lit("")))
    rows = rows.select(
        "_row", "doc_id",
        F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(_WORD)).cast("bigint").alias("n_words"),
        F.when(F.lower(F.coalesce("_text", F.lit(""))).rlike(FIRST),
               F.concat(F.lit(" "), F.regexp_replace(lower, _BREAKS, " "), F.lit(" "))).alias("_norm"),
    )
    # a text that starts or ends with a break has a second blank there
    rows = rows.withColumn("_norm", F.regexp_replace("_norm", "^ +| +$", " "))
    hits = rows.select("_row", "doc_id", "n_words", F.when(may_match(F.col("_norm")), _detect(F.col("_norm"))).alias("_hits"))
    # small rows from here on; one dealing by row serves both windows and the aggregation
    each = hits.select("_row", "doc_id", "n_words", F.explode_outer("_hits").alias("h")).select(
        "_row", "doc_id", "n_words", "h.*").repartition("_row")

    # blanks before a match: those of all gaps up to it and of all matches before it
    order = Window.partitionBy("_row", "rule").orderBy("k")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.col("words") - 1).over(upto) - F.col("words")
    placed = each.withColumn("start", start).withColumn("end", F.col("start") + F.col("words"))
    is_base = F.col("rule") < len(BASE)

    # in this order whatever contains an interval stands before it
    outer = Window.partitionBy("_row").orderBy("start", F.desc("end"), "rank", "rule")
    reach = F.max("end").over(outer.rowsBetween(Window.unboundedPreceding, -1))
    kept = placed.withColumn("_kept", F.col("rule").isNotNull() & (is_base | reach.isNull() | (F.col("end") > reach)))
    label = F.when(F.col("_kept"), F.col("label"))
    base = F.when(is_base, F.col("start"))
    return kept.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count(base).alias("n_base"),
        F.min(base).cast("bigint").alias("first_word"),
        F.max(base).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("_kept"), F.col("score"))), F.lit(0.0)).alias("score"),
    ).drop("_row")
