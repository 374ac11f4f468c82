import hashlib
import math
import random
import re
from collections import Counter

from logwarden.llm.secret_scan import high_entropy, joined, scan, scan_secrets


def brute_base(text):
    text = text or ""
    found = []
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    pattern = re.compile("(password|passwd|secret|token|apikey|api_key)[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)")
    found += [("assign", *m.span()) for m in pattern.finditer(low) if len(m[2]) > 5]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() > 19]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() > 23]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


CASES = [
    None, "", "nothing here", "password=abc", "password=abcdef", "PassWord' : \"abc.def-1\"", "api_key=token=abcdefgh",
    "apikey = 'x' token: yyyyyy", "AKIA" + "A" * 15, "AKIA" + "Z9" * 8 + "x", "é" * 3 + "ab" * 12, "0" * 24,
    "passwd=" + "a1" * 20, "toKen=abcdefg", "ſecret=abcdefg", "token\t=abcdefg", "x" * 100_000 + " secret=" + "q" * 9,
]


def test_base_spans_match_brute_force():
    for text in CASES:
        assert sorted(scan(text)[0]) == sorted(brute_base(text)), text


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = Counter()
    for r in scan_secrets(docs).collect():
        base = brute_base(texts[r.doc_id])
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = Counter(k for k, _, _ in base)
        seen += counts
        assert (r.n_assign, r.n_access, r.n_hex) == (counts["assign"], counts["access"], counts["hex"])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(r.spans.split(","))
    assert len(seen) >= 2


def test_entropy_matches_definition():
    draw = random.Random(5)
    for _ in range(50):
        text = "".join(draw.choice("abcdef0123456789"[: draw.randint(2, 16)]) for _ in range(draw.randint(1, 80)))
        hit = set()
        for i in range(len(text) - 15):
            counts = Counter(text[i : i + 16]).values()
            if -sum(c / 16 * math.log2(c / 16) for c in counts) >= 3.0 - 1e-12:
                hit.update(range(i, i + 16))
        got = {i for a, b in high_entropy(text, 16, 3.0) for i in range(a, b)}
        assert got == hit


def test_entropy_finds_random_strings_and_leaves_words():
    key = "q9Xv2LmT7zRb4KpW8sYd3NfH"
    text = f"the key {key} was found"
    assert joined(scan(text)[1]) == f"entropy-base64:8:{8 + len(key)}"
    for clean in ("internationalization_of_everything", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "my_EXAMPLE_Key_0123456789abc",
                  "zzzzzzzzzzzzzzzzzzzzzzzz1Z", "ThisIsSomeCamelCaseName"):
        assert scan(clean)[1] == []
    assert [k for k, _, _ in scan("id 9f86d081884c7d65")[1]] == ["entropy-hex"]


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "token=abcdef", 1), (1, "token=abcdef", 1)],
                                 "doc_id bigint, text string, spans int")
    found = [(r.doc_id, r.n_assign, r.spans) for r in scan_secrets(docs).collect()]
    assert sorted(found, key=str) == [(1, 1, "assign:0:12"), (1, 1, "assign:0:12"), (None, 0, "")]
    assert scan_secrets(docs.limit(0)).count() == 0


def test_allowed_matches_hide_only_what_they_touch():
    draw = random.Random(9)
    key = "".join(draw.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwyz23456789", k=40))
    uuid = "3f2504e0-4f89-11d3-9a0c-0305e82c3301"
    for text, least in ((f"/samples/build/{key}", 40), (f"{key}_example", 40), (f"{uuid}-{key}", 40), (f"my-dummy-{key}-{uuid}", 40),
                        ("b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAB" + key, 40)):
        spans = [(a, b) for k, a, b in scan(text)[1] if k == "entropy-base64"]
        at = text.index(key)
        assert sum(max(0, min(b, at + 40) - max(a, at)) for a, b in spans) >= least, text
        for word in ("sample", "example", uuid, "AAAAAAAAA", "dummy"):
            if word in text:
                x = text.index(word)
                assert not any(a < x + len(word) and x < b for a, b in spans), text
    assert scan(f"/x/{uuid}")[1] == [] and scan("sample_" + uuid)[1] == []
