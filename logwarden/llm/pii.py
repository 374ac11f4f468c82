"""Personal data replaced by surrogates of the same type, gender, script and format.

Detected entities are brought to a normal form (digits of a number, lower-case
letters), and a keyed hash of (kind, normal form, attempt) draws the surrogate:
digits for digits, vowels for vowels and consonants for consonants of the same
script, upper case for upper case. Cards and bank accounts keep valid check digits;
phone numbers keep their country code, addresses their top-level domain. One entity
has one surrogate everywhere, so references stay linked.

Names are those of people. A title brings a person in; inside of the document its
surname, its given name and an initial are then found without the title as well, and
so is a listed given name before a known surname. Given names and surnames are
entities of their own, so "Mr John Smith", "Mr Smith" and "John Smith" keep what they
share. A given name is drawn from those of its script and gender, which the title
decides, else the lists, else names of both; surnames are as long as before, spoken
in the letters of their script, with the same last letter, and of a Slavic pair
(Иванов, Иванова) both have one stem. An initial becomes the initial of the given
name it stands for.

Collisions are checked in Spark over the distinct entities of the corpus: of
several entities with one surrogate all but the first draw again, as does an entity
whose surrogate is another real entity, until none is left. Given names may be those
of other people, as surnames never are, but not their own. Only the few redrawn
entities are joined to the documents that hold them; all others are computed where
the text is read.

Defined results: a null text stays null, a text without entities is unchanged;
overlapping patterns resolve to the leftmost, then the one listed first; a word that
is a name of the document counts as one wherever it stands with a capital; repeated
rows and rows without id are replaced alike; if a format has fewer values than the
corpus has entities of it, or none is free after ``ROUNDS`` redraws, the free ones are
given out in order, then those of wider formats (any letter of the script, then one more
place), so no entity keeps its value, shares a surrogate or gets a real one (initials may); an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.common import settle

ROUNDS = 20
FIRST_VALUES, PIECE = 1_000, 10_000  # values of a format listed in the first step after the rounds, and by one row
BROADCAST_ROWS = 100_000  # redrawn entities of about 100 bytes each; more are joined by shuffle
TRIAL_KEY = b"logwarden-surrogates"  # for trial data only: whoever has the key can test guesses
KEY_SETTING = "spark.logwarden.surrogateKey"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# fixed values: titles and common given names by gender, particles of surnames
TITLES = {
    "m": ("Mr", "Herrn", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Госпожа", "Κυρία"),
    "u": ("Dr", "Prof"),
}
GIVEN = {
    ("LATIN", "m"): "adam arthur carlos daniel david edward felix frank george hans henry hugo jack james jean john jose "
                    "karl louis lucas luis manuel mark martin max michael miguel oscar otto paul pedro peter philip pierre "
                    "ralph richard robert simon stefan thomas victor walter william",
    ("LATIN", "f"): "alice amelie anna barbara carla carmen catherine charlotte clara diana elena elizabeth ella emma eva "
                    "greta hannah helen ines irene isabel jane julia karin laura lena lucia luise margaret maria marie "
                    "martha mary monica nina nora olivia paula rosa ruth sarah sofia susan teresa ursula vera",
    ("LATIN", "u"): "alex ariel casey charlie chris dominique eden jamie kim luca morgan noel pat quinn robin sam sascha terry toni",
    ("CYRILLIC", "m"): "алексей андрей борис виктор дмитрий иван игорь максим николай олег павел пётр сергей юрий",
    ("CYRILLIC", "f"): "анна вера галина елена ирина лариса мария наталья ольга светлана софья татьяна юлия",
    ("GREEK", "m"): "αλέξανδρος ανδρέας γιώργος δημήτρης κώστας νίκος παύλος πέτρος",
    ("GREEK", "f"): "άννα ελένη ειρήνη κατερίνα μαρία σοφία χριστίνα",
}
_OF = r"(?:(?:van|von|vom|de|der|den|des|del|della|di|da|dos|du|la|le|las|los|ter|ten|zu|zur|y)\x20){0,3}"

_GENDER_OF_TITLE = {t: g for g, titles in TITLES.items() for t in titles}
_GENDER_OF_NAME = {n: g for (_, g), names in GIVEN.items() for n in names.split()}
_TITLES = "|".join(sorted(_GENDER_OF_TITLE, key=len, reverse=True))
_CAPITAL = r"[^\W\d_a-zа-яα-ω]"
_NAME = rf"{_CAPITAL}[^\W\d_]*(?:[-'’][^\W\d_]+)?"
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_TITLE = re.compile(_TITLES)
_GAP = re.compile(rf"(?:\.|\.?\x20){_OF}")  # between a given name and the next word of the name
# fixed order: the first pattern wins where several start
PATTERNS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    ("card", r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
              r"|(?<!\w)\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\w)"),
    ("name", rf"(?<!\w)(?P<title>(?:(?:{_TITLES})\.?\x20)+)(?P<who>(?!(?:{_TITLES})\b)(?:{_CAPITAL}\.\x20?(?={_OF}{_CAPITAL}[\w.]))*"
             rf"{_OF}{_NAME}(?:\x20{_CAPITAL}\.)*(?:\x20{_OF}{_NAME})?)"),
)
ENTITY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))
_HINT = re.compile(rf"[0-9@]|(?:{_TITLES})\.? ")


def _people(text: str, titled: list[re.Match], taken: list[tuple[int, int]]) -> list[tuple[str, int, int, str]]:
    """Given names and surnames of the people that titles bring in, wherever they stand outside of ``taken``."""
    mentions = []
    for m in titled:
        words = [w.span() for w in _WORD.finditer(text, *m.span("who"))]
        titles = _TITLE.findall(m["title"])
        gender = next((g for g in map(_GENDER_OF_TITLE.get, titles) if g != "u"), "u")
        mentions.append((words, gender, titles[-1] in ("Don", "Doña")))

    def form(span: tuple[int, int]) -> str:
        return normal("surname", text[slice(*span)])

    alone = {form(words[0]) for words, _, given in mentions if len(words) == 1 and not given}
    genders: dict[str, str] = {}
    surnames, whole = set(alone), {}
    for words, gender, only_given in mentions:
        if len(words) == 2 and form(words[0]) in alone and form(words[1]) not in alone:
            continue  # a surname, and a word that begins with a capital for another reason
        last = None if len(words) == 1 and only_given else form(words[-1])
        surnames |= {last} - {None}
        for w in words if last is None else words[:-1]:
            if genders.get(form(w), "u") == "u":
                genders[form(w)] = gender
            whole.setdefault((last, form(w)[:1]), []).append(form(w))

    words = [w.span() for w in _WORD.finditer(text)]
    inside = [False] * len(words)
    at = 0
    for i, (a, b) in enumerate(words):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        inside[i] = at < len(taken) and taken[at][0] < b
    forms = ["" if x else form(w) for w, x in zip(words, inside)]
    # from right to left: a given name stands before its surname or another given name
    out, owner = [], None
    for i in range(len(words) - 1, -1, -1):
        a, b = words[i]
        before_name = owner is not None and _GAP.fullmatch(text, b, words[i + 1][0])
        word = forms[i]
        if not word:
            owner = None
        elif before_name and (len(word) == 1 or word in _GENDER_OF_NAME or word in genders):
            full = next((x for x in whole.get((owner, word), ()) if len(x) > 1), word) if len(word) == 1 else word
            whole.setdefault((owner, word[:1]), []).append(word)
            out.append((a, b, full))
        elif word in surnames:
            owner = word
            out.append((a, b, None))
        elif word in genders and len(word) > 1:
            owner = None
            out.append((a, b, word))
        else:
            owner = None
    kind = {g: "given_" + (x if x != "u" else _GENDER_OF_NAME.get(g, "u")) for g, x in genders.items()}
    return [("surname", a, b, form((a, b))) if given is None else
            (kind.get(given, "given_" + _GENDER_OF_NAME.get(given, "u")), a, b, given) for a, b, given in reversed(out)]


def mentions(text: str | None) -> list[tuple[str, int, int, str]]:
    """Kind, place and normal form of every entity; of a name its words one by one."""
    if not text or not _HINT.search(text):
        return []
    found = list(ENTITY.finditer(text))
    titled = [m for m in found if m["name"]]
    out = [(m.lastgroup, *m.span(), normal(m.lastgroup, m[0])) for m in found if not m["name"]]
    if titled:
        out = sorted(out + _people(text, titled, [(a, b) for _, a, b, _ in out]), key=lambda x: x[1])
    return out


def entities(text: str | None) -> list[tuple[str, int, int]]:
    """Kind and place of every entity."""
    return [(kind, a, b) for kind, a, b, _ in mentions(text)]


def normal(kind: str, text: str) -> str:
    """What is the same in all spellings of an entity."""
    if kind in ("email", "ip"):
        return text.lower()
    kept = "".join(c for c in text if c.isalnum())
    return kept.upper() if kind == "iban" else kept.lower()


class _Draws:
    """Numbers from a keyed hash, as many as needed."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self.key, self.seed, self.block, self.held = key, "\x00".join(parts).encode(), 0, b""

    def below(self, bound: int) -> int:
        if len(self.held) < 4:
            data = self.seed + self.block.to_bytes(4, "little")
            self.held += hashlib.blake2b(data, key=self.key, digest_size=64).digest()
            self.block += 1
        value, self.held = int.from_bytes(self.held[:4], "little"), self.held[4:]
        return value % bound


# letters by script; others stay within their own script's list
_LETTERS = {
    "LATIN": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "CYRILLIC": ("аеиоу", "бвгджзклмнпрстфхцч"),
    "GREEK": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
}
_ENDS = {"f": "a", "m": "n", "u": "i"}  # of given names beyond the lists
_SLAVIC = ("ов", "ев", "ёв", "ин", "ын")


def _script(text: str) -> str:
    return unicodedata.name(text[0], "LATIN").split(" ")[0] if text else "LATIN"


def stem_and_end(kind: str, form: str) -> tuple[str, str]:
    """The part of a name that surrogates replace, and the ending that a woman's surname adds to it."""
    return (form[:-1], "а") if kind == "surname" and form.endswith("а") and form[:-1].endswith(_SLAVIC) else (form, "")


def _letter(c: str, draws: _Draws) -> str:
    script = unicodedata.name(c, "LATIN").split(" ")[0]
    if script not in _LETTERS:  # scripts without vowels and cases: a neighbour of the same kind
        return next((x for x in (chr(ord(c) + d) for d in (draws.below(16) + 1, 1, -1, 0))
                     if unicodedata.category(x) == unicodedata.category(c)), c)
    vowels, consonants = _LETTERS[script]
    plain = unicodedata.normalize("NFD", c)[0]
    letters = vowels if plain in vowels else consonants
    return letters[draws.below(len(letters))]


def _luhn(digits: str) -> int:
    """Check digit that makes ``digits`` plus it valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _account(text: str) -> int:
    """Remainder of a bank account number; valid ones have 1."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def surrogate(kind: str, form: str, attempt: int, key: bytes) -> str:
    """Normal form of the surrogate, as long as ``form`` and with the same kinds of characters."""
    draws = _Draws(key, kind, form, str(attempt))

    def swap(text: str, source: _Draws) -> str:
        return "".join(str(source.below(10)) if c.isdigit() else _letter(c, source) if c.isalpha() else c for c in text)

    if kind == "email":
        local, _, domain = form.partition("@")
        host, _, top = domain.rpartition(".")
        # the host is drawn by itself, so that addresses of one host stay together
        return f"{swap(local, draws)}@{swap(host, _Draws(key, 'host', host))}.{top}"
    if kind == "ip":
        ranges = {1: (1, 9), 2: (10, 90), 3: (100, 124)}
        return ".".join(str(a + draws.below(n)) for a, n in (ranges[len(o)] for o in form.split(".")))
    if kind == "card":
        body = form[0] + swap(form[1:-1], draws)
        return body + (str(_luhn(body)) if _luhn(form[:-1]) == int(form[-1]) else str(draws.below(10)))
    if kind == "iban":
        body = "".join(c.upper() for c in swap(form[4:].lower(), draws))
        check = 98 - _account(form[:2] + "00" + body) if _account(form) == 1 else draws.below(100)
        return f"{form[:2]}{check:02d}{body}"
    if kind == "phone":
        keep = max(0, len(form) - 10)  # country code
        return form[:keep] + str(2 + draws.below(8)) + swap(form[keep + 1 :], draws)
    if kind == "surname" or kind.startswith("given"):
        # the lists of given names are short: from the third draw on names grow
        wider = 0 if kind == "surname" else max(0, attempt - 2)
        places = map(_options, alphabets(kind, form, wider, key))
        return "".join(p[draws.below(len(p))] for p in places)
    return swap(form, draws)


_DIGITS = "0123456789"


def _options(place: str) -> list[str]:
    return place.split(" ") if " " in place else list(place)


def alphabets(kind: str, form: str, wider: int, key: bytes) -> list[str]:
    """What may stand at each place of a surrogate: first as drawn by ``surrogate``, then wider.

    One step wider any letter of the script, any first digit and octets of any length
    may stand; each further step adds a place, except to addresses (223**4 values).
    """
    def choice(c: str) -> str:
        if c.isdigit():
            return _DIGITS
        if not c.isalpha():
            return c
        script = unicodedata.name(c, "LATIN").split(" ")[0]
        if script not in _LETTERS:
            near = (chr(x) for x in range(max(0, ord(c) - 16), ord(c) + 17))
            return "".join(x for x in near if unicodedata.category(x) == unicodedata.category(c))
        vowels, consonants = _LETTERS[script]
        if wider:
            return vowels + consonants
        return vowels if unicodedata.normalize("NFD", c)[0] in vowels else consonants

    if kind == "ip":
        ranges = {1: range(1, 10), 2: range(10, 100), 3: range(100, 224)}
        octets = [" ".join(map(str, range(1, 224) if wider else ranges[len(o)])) for o in form.split(".")]
        return octets
    if kind == "email":
        local, _, domain = form.partition("@")
        more = [_LETTERS["LATIN"][0] + _LETTERS["LATIN"][1]] * max(0, wider - 1)
        return [*map(choice, local), *more, *surrogate(kind, form, 0, key)[len(local) :]]
    if kind == "card":
        return [form[0], *map(choice, form[1:-1]), *[_DIGITS] * max(0, wider - 1)]
    if kind == "iban":
        return [*form[:2], *(choice(c.lower()).upper() for c in form[4:]), *[_DIGITS] * max(0, wider - 1)]
    if kind == "phone":
        keep = max(0, len(form) - 10)
        return [*form[:keep], _DIGITS if wider else _DIGITS[2:], *map(choice, form[keep + 1 :]), *[_DIGITS] * max(0, wider - 1)]
    if kind.startswith("given") and _script(form) in _LETTERS:
        script = _script(form)
        vowels, consonants = _LETTERS[script]
        names = GIVEN.get((script, kind[-1]), "")
        if names and not wider:
            return [names]
        end = _ENDS[kind[-1]]
        if script != "LATIN":
            end = {"f": vowels[0], "m": consonants[-5], "u": vowels[3]}[kind[-1]]
        return [*[consonants, vowels] * (1 + wider), consonants, end]
    places = [choice(c) for c in form]
    if kind == "surname" and _script(form) in _LETTERS and form.isalpha():
        vowels, consonants = _LETTERS[_script(form)]
        keep = 2 if form.endswith(_SLAVIC) else 0 if wider or len(form) < 2 else 1
        first = unicodedata.normalize("NFD", form)[0] in vowels
        if not wider or keep == 2:
            body = [(consonants, vowels)[(i + first) % 2] for i in range(max(0, wider - 1) + len(form) - keep)]
            return [*(body if not wider else [vowels + consonants] * len(body)), *(form[-keep:] if keep else "")]
        places = [vowels + consonants] * len(form)
    return [*places, *[places[-1] if places[-1] != form[-1] else _DIGITS] * max(0, wider - 1)]


def format_of(kind: str, form: str, key: bytes) -> str:
    """Equal for entities whose surrogates come from the same values."""
    return "\x1f".join([*alphabets(kind, form, 0, key), str(_valid(kind, form))])


def _valid(kind: str, form: str) -> bool:
    return (kind == "card" and _luhn(form[:-1]) == int(form[-1])) or (kind == "iban" and _account(form) == 1)


def values(kind: str, form: str, start: int, stop: int, key: bytes) -> Iterator[str]:
    """The values ``start`` to ``stop`` of a format, without end: wider formats follow when it has no more."""
    wider, passed, valid = 0, 0, _valid(kind, form)
    while start < stop:
        places = [*map(_options, alphabets(kind, form, wider, key))]
        size = math.prod(map(len, places))
        for n in range(start - passed, min(stop - passed, size)):
            out = []
            for p in reversed(places):
                n, k = divmod(n, len(p))
                out.append(p[k])
            out.reverse()
            if kind == "ip":
                yield ".".join(out)
            elif kind == "card":
                body = "".join(out)
                yield body + (str(_luhn(body)) if valid else str((_luhn(body) + 1) % 10))
            elif kind == "iban":
                head, body = "".join(out[:2]), "".join(out[2:])
                check = 98 - _account(f"{head}00{body}")
                yield f"{head}{check if valid else (check + 1) % 100:02d}{body}"
            else:
                yield "".join(out)
        start, passed, wider = max(start, passed + size), passed + size, wider + 1


def render(original: str, kind: str, form: str) -> str:
    """Write the surrogate in the spelling of the original."""
    if kind == "ip":
        return form
    if kind.startswith("given"):
        if len(original) == 1:  # an initial
            return form[0].upper()
        return form.upper() if original.isupper() else form.capitalize()
    letters = iter(form)
    out = []
    for c in original:
        if kind == "email" or c.isalnum():
            new = next(letters, c)
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join([*out, *letters])  # of a wider format


def replace_text(text: str | None, redrawn: dict[tuple[str, str], str], key: bytes) -> str | None:
    found = mentions(text)
    if not found:
        return text
    out, at = [], 0
    for kind, a, b, form in found:
        stem, end = stem_and_end(kind, form)
        new = redrawn.get((kind, stem)) or surrogate(kind, stem, 0, key)
        out += [text[at:a], render(text[a:b], kind, new + end)]
        at = b
    return "".join([*out, text[at:]])


def distinct_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind, form`` of all entities of the corpus."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = sorted({(k, stem_and_end(k, f)[0]) for t in batch.column(0).to_pylist() for k, _, _, f in mentions(t)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.string()), pa.array([f for _, f in found], pa.string())],
                ["kind", "form"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, form string").distinct()


def _draw(forms: DataFrame, key: bytes) -> DataFrame:
    """Add ``surrogate`` to ``kind, form, attempt``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            new = [surrogate(k, f, n, key) for k, f, n in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())],
                                             ["kind", "form", "attempt", "surrogate"])

    return forms.select("kind", "form", "attempt").mapInArrow(
        run, "kind string, form string, attempt int, surrogate string")


def _paired() -> Column:
    """Reads like the second of a Slavic pair, which only the stem of the pair may give."""
    return F.expr(f"kind = 'surname' and surrogate rlike '({'|'.join(_SLAVIC)})а$'")


def resolve(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, form, attempt, surrogate`` of distinct entities, with collisions redrawn."""
    drawn = settle(_draw(found.withColumn("attempt", F.lit(0)), key), "surrogates")
    # given names may be those of others
    real = drawn.filter(~F.col("kind").startswith("given")).select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("_real"))
    taken = F.coalesce("_real", F.lit(False)) | (F.col("form") == F.col("surrogate")) | _paired()
    for _ in range(ROUNDS):
        first = Window.partitionBy("kind", "surrogate").orderBy("attempt", "form")
        checked = settle(drawn.join(real, ["kind", "surrogate"], "left").withColumn(
            "_again", taken | (F.row_number().over(first) > 1)))
        again = checked.filter("_again")
        if again.isEmpty():
            break
        redrawn = _draw(again.withColumn("attempt", F.col("attempt") + 1), key)
        drawn = settle(checked.filter("not _again").select(*drawn.columns).unionByName(redrawn), "surrogates")
    else:
        first = Window.partitionBy("kind", "surrogate").orderBy("attempt", "form")
        checked = settle(drawn.join(real, ["kind", "surrogate"], "left").withColumn(
            "_again", taken | (F.row_number().over(first) > 1)))
        drawn = _assign(checked.select(*drawn.columns, "_again"), key)
    return drawn


def _assign(checked: DataFrame, key: bytes) -> DataFrame:
    """Give the entities marked ``_again`` unused values of their formats in order, until none is left."""

    def formats(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            new = [format_of(k, f, key) for k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "form", "format"])

    def listed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "format", "at", "surrogate"]
        for batch in rows:
            for r in batch.to_pylist():
                new = list(values(r["kind"], r["example"], r["start"], r["stop"], key))
                size = len(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["kind"]] * size, pa.string()), pa.array([r["format"]] * size, pa.string()),
                     pa.array(range(r["start"], r["start"] + size), pa.int64()), pa.array(new, pa.string())], names)

    done = settle(checked.filter("not _again").select("kind", "form", "attempt", "surrogate"), "surrogates")
    forms = checked.select("kind", "form")
    left = settle(checked.filter("_again").select("kind", "form").mapInArrow(
        formats, "kind string, form string, format string"))
    seen, more, attempt = 0, FIRST_VALUES, ROUNDS + 1
    while not left.isEmpty():
        # each format lists more values than it has entities left, in pieces that tasks share
        need = left.groupBy("kind", "format").agg(F.min("form").alias("example"), F.count("*").alias("_left"))
        piece = F.explode(F.sequence(*[F.lit(x).cast("bigint") for x in (seen, seen + more - 1, PIECE)]))
        pieces = need.select("kind", "format", "example", piece.alias("start")).withColumn(
            "stop", F.least(F.col("start") + PIECE, F.lit(seen + more))).repartition("kind", "format", "start")
        used = done.select("kind", "surrogate").unionByName(forms.select("kind", F.col("form").alias("surrogate")))
        free = settle(pieces.mapInArrow(listed, "kind string, format string, at bigint, surrogate string").join(
            used, ["kind", "surrogate"], "left_anti").filter(~_paired()))
        # a value of several formats goes to one of them, to each alike often
        one = Window.partitionBy("kind", "surrogate").orderBy(F.xxhash64("format", "surrogate"), "format", "at")
        free = free.withColumn("_one", F.row_number().over(one)).filter("_one = 1")
        by = Window.partitionBy("kind", "format")
        ranked = settle(left.withColumn("_rank", F.row_number().over(by.orderBy("form"))))
        given = settle(ranked.join(
            free.withColumn("_rank", F.row_number().over(by.orderBy("at"))), ["kind", "format", "_rank"]
        ).select("kind", "form", F.lit(attempt).alias("attempt"), "surrogate"))
        done = settle(done.unionByName(given), "surrogates")
        left = settle(left.join(given.select("kind", "form"), ["kind", "form"], "left_anti"))
        seen, more, attempt = seen + more, more * 8, attempt + 1
    return done


def _replace(docs: DataFrame, redrawn: DataFrame, text: str, key: bytes) -> DataFrame:
    """``docs`` with new texts; ``redrawn`` holds its rows as ``_row`` and the redrawn entities of each."""
    names, place = docs.columns, docs.columns.index(text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            again = [{(r["kind"], r["form"]): r["surrogate"] for r in x or ()} for x in batch.column(len(names)).to_pylist()]
            new = [replace_text(t, x, key) for t, x in zip(batch.column(place).to_pylist(), again)]
            columns = [pa.array(new, pa.string()) if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    extra = "_redrawn"
    while extra in map(str.lower, names):
        extra += "_"
    rows = redrawn.select(*[F.col("_row")[c].alias(c) for c in names], F.col("_redrawn").alias(extra))
    return rows.mapInArrow(run, docs.schema)


def key_of(spark: SparkSession) -> bytes:
    """The key that the session holds as ``KEY_SETTING``, else the one for trial data."""
    held = spark.conf.get(KEY_SETTING, None)
    return held.encode() if held else TRIAL_KEY


def replace_entities(docs: DataFrame, text: str = "text", *, key: bytes) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; columns and rows as before."""
    surrogates = resolve(settle(distinct_entities(docs, text), "entities"), key)
    again = settle(surrogates.filter("attempt > 0").select("kind", "form", "surrogate"))
    count = again.count()
    if not count:
        empty = F.array().cast("array<struct<kind:string,form:string,surrogate:string>>")
        return _replace(docs, docs.select(F.struct(*docs.columns).alias("_row"), empty.alias("_redrawn")), text, key)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = {(i, k, stem_and_end(k, f)[0]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                   for k, _, _, f in mentions(t)}
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["_text", "kind", "form"])

    # texts that hold a redrawn entity, by the hash of the text: equal texts have equal entities
    hashed = docs.select(F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
    held = hashed.mapInArrow(run, "_text bigint, kind string, form string")
    held = held.join(F.broadcast(again) if count <= BROADCAST_ROWS else again, ["kind", "form"])
    lists = settle(held.groupBy("_text").agg(F.collect_set(F.struct("kind", "form", "surrogate")).alias("_redrawn")))
    small = F.broadcast(lists) if lists.count() <= BROADCAST_ROWS else lists
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(text).alias("_text"))
    return _replace(docs, rows.join(small, "_text", "left"), text, key)


def entities_and_surrogates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, key: bytes) -> DataFrame:
    """``doc_id, n_entities, spans`` of the original and the new ``text`` of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "n_entities", "spans", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [entities(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in found], pa.int64()),
                 pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in found], pa.string()), batch.column(1)],
                names)

    marked = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_entities bigint, spans string, text string")
    return replace_entities(marked, key=key)
