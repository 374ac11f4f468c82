"""Parsing and masking of log text as column expressions.

Java regexes are spelled with explicit Unicode classes so that they agree with
Unicode-aware patterns: ``W`` is a word character, ``D`` a decimal digit, ``S``
a whitespace character. A word edge is written with lookarounds because Java's
own ``\\b`` differs between releases.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.config import NON_IDENTITIES

W = r"\p{L}\p{N}_"
D = r"\p{Nd}"
S = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
AFTER_WORD = f"(?![{W}])"
EDGE = f"(?:(?<=[{W}])(?![{W}])|(?<![{W}])(?=[{W}]))"
BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# The accepted line format and the variable fields to find or mask.
# A pattern tests its first character before it looks behind it: most positions
# of a line fail on that character alone.
LINE_HEAD = (
    f"^[{W}]{{3}}[{S}]+{D}{{1,2}}[{S}]+{D}{{2}}:{D}{{2}}:{D}{{2}}[{S}]+"
    f"[^{S}]+[{S}]+"
    f"[{W}\\-/.]+(?:\\[{D}+\\])?:[{S}]+"
)
FIRST_DIGIT = f"{D}(?<![{W}]{D})"
IP = f"{FIRST_DIGIT}{D}{{0,2}}\\.(?:{D}{{1,3}}\\.){{2}}{D}{{1,3}}{AFTER_WORD}"
PORT = f"port (?<![{W}]port ){D}+{AFTER_WORD}"
BRACKETED_PID = f"\\[{D}+\\]"
NUMBER = f"{FIRST_DIGIT}{D}*{AFTER_WORD}"
USER_FIELD = f"[uU](?<![{W}][uU])[sS\\x{{17f}}][eE][rR][= ]([{W}\\-]+){EDGE}"
USER_IN_LOGIN = f"for ([{W}\\-]+) from"
MONTHS = " jan feb mar apr may jun jul aug sep oct nov dec "
UNKNOWN_USER = "unknown"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only blanks."""
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Split at whitespace of every kind."""
    rare = text.rlike(f"[{S}&&[^ ]]")
    plain = F.when(rare, F.regexp_replace(text, f"[{S}]+", " ")).otherwise(text)
    return F.array_remove(F.split(plain, " "), "")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def event_time(month: Column, day: Column, clock: Column, year: Column) -> Column:
    """A syslog date plus a year; an impossible date or time gives null."""
    at = F.instr(F.lit(MONTHS), F.concat(F.lit(" "), F.lower(month), F.lit(" ")))
    number = F.when(at > 0, F.floor(at / 4) + 1).cast("int")
    hour, minute, second = (F.substring(clock, start, 2).try_cast("int") for start in (1, 4, 7))
    made = F.try_make_timestamp_ntz(year, number, day.try_cast("int"), hour, minute, second.cast("decimal(16,6)"))
    return F.when(second < 60, made)


def user_of(message: Column) -> Column:
    return F.coalesce(
        empty_to_null(F.regexp_extract(message, USER_FIELD, 1)),
        empty_to_null(F.regexp_extract(message, USER_IN_LOGIN, 1)),
        F.lit(UNKNOWN_USER),
    )


def ip_of(message: Column) -> Column:
    return F.when(message.contains("."), F.regexp_substr(message, F.lit(IP)))


def template_of(message: Column) -> Column:
    """Mask addresses, ports, bracketed pids and free-standing numbers, in that order."""
    # the plain search in front spares most lines the pattern
    for needle, pattern, mask in (
        (".", IP, "<IP>"),
        ("port ", PORT, "port <PORT>"),
        ("[", BRACKETED_PID, "[<PID>]"),
    ):
        message = F.when(message.contains(needle), F.regexp_replace(message, pattern, mask)).otherwise(message)
    return F.regexp_replace(message, NUMBER, "<NUM>")


def subnet(ip: Column, octets: int = 2) -> Column:
    return F.substring_index(ip, ".", octets)


def _unless(text: Column, placeholders: Iterable[str]) -> Column:
    trimmed = strip(text.cast("string"))
    return F.when(~F.lower(trimmed).isin(*placeholders), trimmed)


def identity_of(value: Column) -> Column:
    """A user or address two events may be joined on; placeholders give null."""
    return _unless(value, ("", *NON_IDENTITIES))


def field_of(value: Column) -> Column:
    """A value fit to be shown in a prompt; missing values give null."""
    return _unless(value, ("", "nan", "none", "unknown"))


def mentions(message: Column, *phrases: str) -> Column:
    """Case-insensitive search for any of the phrases; null counts as no."""
    lowered = F.lower(message)
    found = F.lit(False)
    for phrase in phrases:
        found = found | lowered.contains(phrase)
    return F.coalesce(found, F.lit(False))


def is_failed_login(message: Column) -> Column:
    return mentions(message, "failed password")


def is_accepted_login(message: Column) -> Column:
    return mentions(message, "accepted password")
