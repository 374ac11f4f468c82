import re
import re._constants as op
import re._parser as parser

import pytest
from pyspark.sql import functions as F

from logwarden.llm import license_scan
from logwarden.llm.license_scan import BASE, rules, scan_licenses

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words))
              if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({b for _, b in places})))


CASES = [
    None, "", " -- ", "x", "under the MIT License.", "Under_the/mit-license Apache License, Version 2.0",
    "CC BY-NC 4.0 cc by nc, CC-BY\nNC", "xunder the mit license under the mit licenses", "é cc by ncé", "ÀPACHE license version 2",
    "apache license version 2 " * 300, "word " * 20_000 + "cc by nc", "cc by nc cc by nc cc by nc", "cc by cc by nc",
]


def found_in(frame):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in frame.collect()}


def test_base_matches_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string")
    assert found_in(scan_licenses(docs)) == {i: brute(t) for i, t in enumerate(CASES)}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert found_in(scan_licenses(docs)) == expected and any(v[1] for v in expected.values())


def test_rules_are_many_and_compile():
    table = rules()
    assert len(table) > 300 and [r[0] for r in table] == list(range(len(table)))
    assert all(re.compile(r[3]) for r in table)


TEXTS = {
    "This work is licensed under the GNU General Public License, version 3.": ("gpl-3", 0.95),
    "licensed under the GNU GPL v3 or any later version": ("gpl-3-or-later", 0.95),
    "SPDX-License-Identifier: BSD-3-Clause": ("bsd-3-clause", 1.0),
    "distributed under the GNU Lesser General Public License version 2.1": ("lgpl-2.1", 0.9),
    "CC BY-NC-SA 4.0": ("cc-by-nc,cc-by-nc-sa", 1.0),
    "CC BY-SA 4.0": ("cc-by-sa", 0.6),
    "Released under the MIT License.": ("mit", 1.0),
    "Mozilla Public License 2.0": ("mpl-2", 0.6),
    "the admit licenses of a ruby": ("", 0.0),
}


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. """
GNU = "it is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, "
# texts as they stand in files, each with all its labels
BODIES = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
    files (the "Software"), to deal in the Software without restriction""": "mit",
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
    files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
    merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
    to do so.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY""": "mit-0",
    BSD: "bsd-2-clause",
    BSD + "3. Neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    BSD + """3. All advertising materials mentioning features or use of this software must display the following acknowledgement: x.
    4. Neither the name of the copyright holder""": "bsd-4-clause",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
    that the above copyright notice and this permission notice appear in all copies.""": "isc",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
    THE SOFTWARE IS PROVIDED "AS IS\"""": "bsd-0-clause",
    GNU.format("") + "either version 3 of the License, or (at your option) any later version.": "gpl-3-or-later",
    GNU.format("") + "version 3 of the License.": "gpl-3",
    GNU.format("Lesser ") + "either version 2.1 of the License, or (at your option) any later version.": "lgpl-2.1-or-later",
    GNU.format("Affero ") + "either version 3 of the License, or any later version.": "agpl-3-or-later",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License.""": "apache-2",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "see https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "Unauthorized copying of this file, via any medium is strictly prohibited": "proprietary",
    "He asked permission to use the copy of the documentation files": "",
    "the materials were reproduced in compliance with what the authors published": "",
}


def test_bodies_and_notices(spark):
    docs = spark.createDataFrame([(i, "x " * (i * 3) + t + " y") for i, t in enumerate(BODIES)], "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in scan_licenses(docs).collect()} == dict(enumerate(BODIES.values()))


def test_labels_and_suppression(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    found = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs).collect()}
    assert found == dict(enumerate(TEXTS.values()))


@pytest.mark.parametrize("rows", [[], [(None, "cc by nc", 1), (1, None, 1), (2, "cc by nc", 1), (2, "cc by nc", 1)]])
def test_nulls_repeats_and_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rule int")
    found = sorted((r.doc_id or 0, r.base_labels) for r in scan_licenses(docs).collect())
    assert found == sorted((i or 0, "cc-by-nc" if t else "") for i, t, _ in rows)


def one_match(parsed, branch):
    """The shortest match of a parsed pattern that takes the given branch of every choice."""
    out = ""
    for kind, value in parsed:
        if kind is op.LITERAL:
            out += chr(value)
        elif kind is op.IN:
            first, x = value[0]
            out += chr(x if first is op.LITERAL else x[0])
        elif kind is op.NOT_LITERAL:
            out += "x"
        elif kind is op.SUBPATTERN:
            out += one_match(value[3], branch)
        elif kind is op.BRANCH:
            out += one_match(value[1][branch % len(value[1])], branch)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            out += one_match(value[2], branch) * value[0]
        else:
            assert kind is op.ASSERT
    return out


def test_gates_let_every_match_through(spark, monkeypatch):
    texts = {}
    for _, _, keyword, pattern, _, _ in rules():
        for branch in range(7):
            text = one_match(parser.parse(pattern), branch)
            assert re.search(pattern, f" {text} ") and keyword in text, (keyword, text)
            texts[text] = None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    gated = sorted(map(tuple, scan_licenses(docs).collect()), key=str)
    assert all(r[-2] and r[-1] > 0 for r in gated)
    monkeypatch.setattr(license_scan, "FIRST", "")
    monkeypatch.setattr(license_scan, "may_match", lambda norm: F.lit(True))
    assert sorted(map(tuple, scan_licenses(docs).collect()), key=str) == gated
