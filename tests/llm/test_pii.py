import re

from logwarden.llm import pii
from logwarden.llm.pii import (
    distinct_entities, entities, entities_and_surrogates, normal, render, replace_entities, replace_text, resolve, surrogate,
)

KEY = b"a key of tests"
TEXT = ("Write to Anna.Bo-7@Mail3.example.com or call +1 (386) 555-3733, host 44.161.181.40, card 4944339490429605 "
        "or 4111-1111-1111-1111, id 123-45-6789, DE89 3704 0044 0532 0130 00. Mrs. Maria López met Mr John O'Neil.")


def parts(text):
    return [(k, text[a:b]) for k, a, b in entities(text)]


def test_kinds_are_found():
    assert parts(TEXT) == [
        ("email", "Anna.Bo-7@Mail3.example.com"), ("phone", "+1 (386) 555-3733"), ("ip", "44.161.181.40"),
        ("card", "4944339490429605"), ("card", "4111-1111-1111-1111"), ("ssn", "123-45-6789"),
        ("iban", "DE89 3704 0044 0532 0130 00"), ("given_f", "Maria"), ("surname", "López"), ("given_m", "John"), ("surname", "O'Neil")]
    for clean in (None, "", "Plain text, 12 words in 2024.", "v1.2.3.4.5", "a@b", "token 0641917ea4e9feb9cda8", "Herr ist da"):
        assert entities(clean) == []


def test_surrogates_keep_type_and_format():
    new = replace_text(TEXT, {}, KEY)
    assert [k for k, _ in parts(new)] == [k for k, _ in parts(TEXT)]
    for (kind, old), (_, fresh) in zip(parts(TEXT), parts(new)):
        assert fresh != old
        if kind.startswith("given"):
            assert fresh.lower() in pii.GIVEN["LATIN", kind[-1]].split() and fresh.istitle()
            continue
        assert [c.isdigit() for c in fresh] == [c.isdigit() for c in old]
        assert [c.isupper() for c in fresh] == [c.isupper() for c in old]
        if kind == "surname":
            assert fresh[-1] == old[-1]
        if kind == "iban":
            assert pii._account(normal(kind, fresh)) == 1
    cards = [normal(k, t) for k, t in parts(new) if k == "card"]
    assert pii._luhn(cards[1][:-1]) == int(cards[1][-1])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new) and new.count("@") == 1 and ".com" in new
    her, him = (replace_text(t, {}, KEY) for t in ("Госпожа Иванова", "Господин Иванов"))
    assert re.fullmatch("Госпожа [А-Я][а-я]+ова", her) and her.split()[1] == him.split()[1] + "а" and "Иванов" not in her


def test_coreference_and_key():
    a, b = replace_text("call +1 (386) 555-3733", {}, KEY), replace_text("call +1-386-555-3733 now", {}, KEY)
    assert normal("phone", a[5:]) == normal("phone", b[5:20])
    assert surrogate("ip", "1.2.3.4", 0, KEY) != surrogate("ip", "1.2.3.4", 0, b"other") or surrogate("ip", "9.8.7.6", 0, KEY) != surrogate("ip", "9.8.7.6", 0, b"other")
    assert render("John O'Neil", "surname", "abcdefghi") == "Abcd E'Fghi"


def test_collisions_are_redrawn(spark):
    # 9^4 addresses of one-digit octets are dense enough to collide
    rows = [(i, f"from {1 + i % 9}.{1 + i // 9 % 9}.{1 + i // 81 % 9}.5 end") for i in range(729)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = resolve(distinct_entities(docs), KEY).collect()
    assert len(found) == 729 == len({r.surrogate for r in found}) and any(r.attempt for r in found)
    assert not {r.surrogate for r in found} & {r.form for r in found}
    new = {r.doc_id: r.text for r in replace_entities(docs, key=KEY).collect()}
    by_form = {r.form: r.surrogate for r in found}
    assert new == {i: f"from {by_form[t.split()[1]]} end" for i, t in rows}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = {r.doc_id: r.text for r in docs.collect()}
    out = replace_entities(docs, key=KEY)
    assert out.columns == docs.columns
    new = {r.doc_id: r.text for r in out.collect()}
    mapping, changed = {}, 0
    for i, text in old.items():
        before, after = entities(text), entities(new[i])
        assert before == after and len(new[i]) == len(text)
        changed += bool(before)
        for k, a, b in before:
            form = normal(k, text[a:b])
            assert mapping.setdefault((k, form), normal(k, new[i][a:b])) == normal(k, new[i][a:b])
            assert form not in new[i]
    assert changed and len(set(mapping.values())) == len(mapping)
    both = {r.doc_id: (r.n_entities, r.text) for r in entities_and_surrogates(docs, key=KEY).collect()}
    assert both == {i: (len(entities(t)), new[i]) for i, t in old.items()}


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a@b.example.com", "k"), (1, None, "k"), (1, "x", "k"), (1, "x", "k")],
                                 "doc_id bigint, text string, kind string")
    out = replace_entities(docs, key=KEY)
    assert out.columns == docs.columns and out.count() == 4
    assert sorted(r.text or "" for r in out.collect())[0] == "" and out.filter("text = 'x'").count() == 2
    assert replace_entities(docs.limit(0), key=KEY).count() == 0


def test_full_formats_give_every_entity_a_value_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    names = [*letters, *(a + b for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou")]
    texts = [f"saw Dr. {n}, then" for n in names] + [f"from {a}.{b}.1.1 end" for a in range(1, 10) for b in range(1, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    forms = {(k, normal(k, t[a:b])) for t in texts for k, a, b in entities(t)}
    found = resolve(distinct_entities(docs), KEY).collect()
    assert {(r.kind, r.form) for r in found} == forms and len(found) == len(forms)
    new = {(r.kind, r.surrogate) for r in found}
    assert len(new) == len(found) and not new & forms
    by_form = {(r.kind, r.form): r.surrogate for r in found}
    for r in entities_and_surrogates(docs, key=KEY).collect():
        ((kind, a, b),) = entities(texts[r.doc_id])
        assert r.spans == f"{kind}:{a}:{b}" and r.n_entities == 1
        ((_, c, d),) = entities(r.text)
        assert normal(kind, r.text[c:d]) == by_form[kind, normal(kind, texts[r.doc_id][a:b])]


def test_one_person_in_many_spellings():
    text = "Mr John Smith met Mrs Ann-Marie Smith. Mr Smith sat, JOHN SMITH and J. Smith left; John smiled at Ann-Marie. A smith, Johnson and Mr. Long."
    new = replace_text(text, {}, KEY)
    pattern = (r"Mr (?P<j>\w+) (?P<s>\w+) met Mrs (?P<a>\w+) (?P=s)\. Mr (?P=s) sat, (?P<J>[A-Z]+) (?P<S>[A-Z]+) and (?P<i>[A-Z])\. (?P=s) left; "
               r"(?P=j) smiled at (?P=a)\. A smith, Johnson and Mr\. (?P<l>\w+)\.")
    m = re.fullmatch(pattern, new)
    assert m and (m["J"], m["S"], m["i"]) == (m["j"].upper(), m["s"].upper(), m["j"][0])
    assert m["j"].lower() in pii.GIVEN["LATIN", "m"].split() and m["a"].lower() in pii.GIVEN["LATIN", "f"].split()
    assert not {m["j"], m["s"], m["a"], m["l"]} & {"John", "Smith", "Ann", "Long"}
    assert re.fullmatch(r"Mr\. [A-Z]\.[A-Z]\. (?!Smith)\w{4}h", replace_text("Mr. J.R. Smith", {}, KEY))
    for clean in ("John Smith without a title", "Paris Hall and Long Street", "Mr and Mrs, said the drum", "Frau, Herr und Dr."):
        assert replace_text(clean, {}, KEY) == clean
    nested = replace_text("Frau Dr. Müller, Prof. J. van der Berg", {}, KEY)
    assert re.fullmatch(r"Frau Dr\. [A-Z]\w{4}r, Prof\. [A-Z]\. van der [A-Z]\w\wg", nested) and "Berg" not in nested


def test_people_of_a_corpus_against_their_own_list(spark):
    """Texts are written from a list of people, so who stands where is known without the patterns."""
    given = [(n, g) for (script, g), names in pii.GIVEN.items() if script == "LATIN" and g != "u" for n in names.title().split()]
    family = [f"{a}{b}" for a in ("Bar", "Kel", "Mor", "Tan", "Wes", "Ho", "Li") for b in ("den", "ler", "by", "ston", "o", "ck")]
    people = [(*given[(7 * i) % len(given)], family[(5 * i + i // 42) % len(family)]) for i in range(150)]
    title = {"m": "Mr", "f": "Mrs"}
    rows, slots = [], []
    for i, (name, gender, last) in enumerate(people):
        other = people[(i + 1) % len(people)]
        pieces = ["We met ", title[gender], " ", ("g", name, gender), " ", ("s", last), "; later ", ("g", name, gender), " ", ("s", last), " and ",
                  title[other[1]], " ", ("g", other[0], other[1]), " ", ("s", other[2]), " left. ", title[gender], " ", ("s", last), " wrote."]
        slots.append(pieces)
        rows.append((i, "".join(x if isinstance(x, str) else x[1] for x in pieces)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    new = {r.doc_id: r.text for r in replace_entities(docs, key=KEY).collect()}
    seen = {}
    for i, pieces in enumerate(slots):
        found = re.fullmatch("".join(re.escape(x) if isinstance(x, str) else r"(\w+)" for x in pieces), new[i])
        assert found, (rows[i], new[i])
        for slot, fresh in zip((x for x in pieces if not isinstance(x, str)), found.groups()):
            assert seen.setdefault(slot, fresh) == fresh != slot[1]
    assert len(set(seen.values())) == len(seen)
    assert not {v for k, v in seen.items() if k[0] == "s"} & set(family)
    other_key = {r.doc_id: r.text for r in replace_entities(docs, key=b"another").collect()}
    assert other_key != new
