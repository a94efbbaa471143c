"""Text expressions: all run inside the JVM, none needs a Python worker."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a browser's trim() removes, which is more than spaces.
BLANK = r"[\s\x{FEFF}\p{Z}]"
WORD_GAP = r"[^\p{L}\p{N}]+"

# Patterns start with a cheap test of one character and look back only where that
# test holds, so that plain text is skipped at the speed of a scan.

# A match may start only where a run of address characters starts, or where the
# last match ended, so a long run is read once.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))"
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
)
PHONE = (
    r"(?:\+(?<![0-9A-Za-z+]\+)[0-9]|[0-9](?<![0-9A-Za-z+][0-9]))"
    r"(?:[ ().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])"
)

CAPS_WORD = r"\p{Lu}(?<![\p{L}\p{N}].)\p{Lu}{3,}+(?![\p{L}\p{N}])"
PUNCTUATION_RUN = r"[!?*#%]{3,}"
# Both in one pass, for their sum; they share no character.
SHOUTED = f"{CAPS_WORD}|{PUNCTUATION_RUN}"
# From the first digit of a word to its end: one match per word with a digit.
NUMBER_WORD = r"\p{N}[\p{L}\p{N}]*+"

# What a page reader drops, in one pass: comments, script and style bodies, tags. A comment
# or a body that is never closed goes on to the end; a tag that is never closed is text. A
# tag starts with a letter, a slash or a mark: "a < b" is text. Values in quotes may hold
# any sign. Possessive, so that no start is tried twice over the same stretch.
MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b[^<>]*+>.*?(?:</script\s*>|\z)"
    r"|<style\b[^<>]*+>.*?(?:</style\s*>|\z)"
    r"|<[a-z/!?](?:[^<>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>"
)

# Names of character references, with and without the closing semicolon.
CLOSED_NAMES = {name: char for name, char in html5.items() if name.endswith(";")}
OPEN_NAMES = {name: char for name, char in html5.items() if not name.endswith(";")}
# Numbers 128 to 159 mean the signs that Windows has there.
WINDOWS_SIGNS = {
    str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)
}
UNKNOWN_SIGN = "\ufffd"


def browser_trim(text: Column) -> Column:
    """Trim like a browser does: all white space, not only blanks."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def or_default(value: Column, default: str) -> Column:
    """`default` for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return words_in(F.lower(text))


def words_in(lowered: Column) -> Column:
    """Words of a text that is in lower case already."""
    return F.array_remove(F.split(lowered, WORD_GAP), "")


def skill_words(text: Column) -> Column:
    """Lower-case words of a text in which `+`, `#` and a leading dot belong to a word."""
    ended = F.regexp_replace(F.lower(text), r"([\p{L}\p{N}+#])\.", "$1 ")
    return F.regexp_extract_all(ended, F.lit(r"\.?[\p{L}\p{N}][\p{L}\p{N}+#]*"), F.lit(0))


def phrases(tokens: str, max_words: int) -> Column:
    """Distinct runs of 1 to `max_words` words from the array column `tokens`.

    Takes a column name: the words must be a stored column, or they would be
    split anew for every run.
    """
    if max_words < 1:
        raise ValueError("max_words must be at least 1")
    runs = [F.col(tokens)]
    for n in range(2, max_words + 1):
        count = F.greatest(F.array_size(tokens) - (n - 1), F.lit(0))
        runs.append(
            F.zip_with(
                F.slice(runs[-1], F.lit(1), count),
                F.slice(F.col(tokens), F.lit(n), count),
                lambda run, word: F.concat_ws(" ", run, word),
            )
        )
    return F.array_distinct(F.concat(*runs)) if max_words > 1 else F.array_distinct(runs[0])


def same_text_key(text: Column) -> Column:
    """Fingerprint that ignores case, punctuation and spacing."""
    return F.sha2(F.array_join(words(text), " "), 256)


def emails(text: Column) -> Column:
    """All mail addresses in order. Only a text with an @ is searched."""
    found = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    return F.when(text.contains("@"), found).otherwise(F.array().cast("array<string>"))


def email_domains(text: Column) -> Column:
    """Lower-case domains of all mail addresses in order."""
    return F.transform(emails(text), lambda e: F.lower(F.substring_index(e, "@", -1)))


def literal_list(choices: Iterable[str]) -> list[str]:
    """Lower-case entries with single spaces; refuses an empty list."""
    cleaned = [" ".join(p.lower().split()) for p in choices if p.strip()]
    if not cleaned:
        raise ValueError("a word list holds at least one entry")
    return cleaned


def _quoted(word: str) -> str:
    """The word as it stands, whatever signs it holds."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in word)


def _may_hold(lowered: Column, listed: Sequence[str]) -> Column:
    """A byte search for the first words; it settles most texts without a pattern."""
    tests = [lowered.contains(w) for w in sorted({p.split()[0] for p in listed})]
    # Joined two by two: a long chain would be too deep to plan.
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i:i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def phrase_hits(text: Column, choices: Iterable[str]) -> Column:
    """How often any of the phrases occurs, at word ends, over folded white space."""
    return phrase_hits_in(F.lower(text), choices)


def phrase_hits_in(lowered: Column, choices: Iterable[str]) -> Column:
    """Phrase hits of a text that is in lower case already."""
    listed = literal_list(choices)
    body = "|".join(r"\s+".join(map(_quoted, p.split())) for p in listed)
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{body})(?![\p{{L}}\p{{N}}])"
    count = F.regexp_count(lowered, F.lit(pattern))
    return F.when(_may_hold(lowered, listed), count).when(lowered.isNotNull(), 0)


@cache
def _by_first_letter(closed: bool) -> str:
    """The reference names as JSON, dealt by first letter: a map is searched in order."""
    dealt: dict[str, dict[str, str]] = {}
    for name, char in (CLOSED_NAMES if closed else OPEN_NAMES).items():
        dealt.setdefault(name[0], {})[name] = char
    return json.dumps(dealt)


def _named(name: Column, closed: bool) -> Column:
    """What a reference name stands for, else null. The map is a constant of the plan."""
    table = F.from_json(F.lit(_by_first_letter(closed)), "map<string,map<string,string>>")
    return F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), name)


def _numbered(digits: Column, base: int) -> Column:
    """The sign of a number; one that is none gives the sign for unknown."""
    # The greatest sign has 7 digits; leading zeros are gone already.
    short = F.when(F.length(digits) <= 7, F.conv(digits, base, 10))
    code = F.coalesce(short.try_cast("bigint"), F.lit(0))
    windows = F.from_json(F.lit(json.dumps(WINDOWS_SIGNS)), "map<string,string>")
    none = (code <= 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(none, UNKNOWN_SIGN).when(
        code.between(0x80, 0x9F), F.try_element_at(windows, code.cast("string"))
    ).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _decoded(part: Column) -> Column:
    """A stretch of text that followed an ampersand, its reference decoded."""

    def after(pattern: str, group: int, sign) -> Column:
        found = F.regexp_extract(part, pattern, 0)
        rest = F.substr(part, F.length(found) + 1)
        return F.concat(sign(F.regexp_extract(part, pattern, group)), rest)

    hexadecimal, decimal = r"^#[xX](?=[0-9a-fA-F])0*+([0-9a-fA-F]*+);?", r"^#(?=[0-9])0*+([0-9]*+);?"
    longest_first = sorted(OPEN_NAMES, key=len, reverse=True)
    return (
        F.when(part.startswith("amp;"), F.concat(F.lit("&"), F.substr(part, F.lit(5))))
        .when(part.rlike(hexadecimal), after(hexadecimal, 1, lambda d: _numbered(d, 16)))
        .when(part.rlike(decimal), after(decimal, 1, lambda d: _numbered(d, 10)))
        .otherwise(F.coalesce(
            after(r"^[A-Za-z][A-Za-z0-9]*;", 0, lambda name: _named(name, True)),
            after(f"^(?:{'|'.join(longest_first)})", 0, lambda name: _named(name, False)),
            F.concat(F.lit("&"), part),
        ))
    )


def references_decoded(text: Column) -> Column:
    """Text with character references decoded once, as browsers do.

    All names count, also the old ones without a semicolon, and numbers in both bases. What
    is no reference stays as it stands.
    """
    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), _decoded)
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(text)


def html_text(html: Column) -> Column:
    """Plain text of a page: no scripts, styles, comments or tags, one-space gaps."""
    out = references_decoded(F.regexp_replace(html, MARKUP, " "))
    return browser_trim(F.regexp_replace(out, rf"{BLANK}+", " "))


def masked(text: Column, email_mark: str = "[email]", phone_mark: str = "[phone]") -> Column:
    """Text with mail addresses and phone numbers replaced."""
    no_mail = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, email_mark)).otherwise(text)
    return F.regexp_replace(no_mail, PHONE, phone_mark)
