"""Name and season functions. What SQL can say stays SQL; whole Unicode normal forms are vectorised helpers."""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: letters that lose their mark, for both languages' names
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: zero-width characters, soft hyphen and byte-order mark
INVISIBLE = "[\\u00AD\\u200B-\\u200F\\u2060\\uFEFF]"


def fold_latin(name: Column) -> Column:
    """Lower case without Latin accents, punctuation as spaces, single spaces."""
    plain = F.translate(F.lower(name), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "['.]", ""), "[-\\s]+", " "))


@F.pandas_udf(StringType())
def fold_unicode(names: pd.Series) -> pd.Series:
    """Lower case without combining marks of any script, invisible characters gone, single spaces; null stays null."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        kept = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        return " ".join(kept.lower().split())

    return names.map(one)


@F.pandas_udf(StringType())
def role_key(names: pd.Series) -> pd.Series:
    """Character references decoded, marks off, what is not ASCII dropped, lower case, trimmed; null stays null."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", html.unescape(s)).encode("ascii", "ignore").decode().lower().strip())


@F.pandas_udf(StringType())
def fold_audit(names: pd.Series) -> pd.Series:
    """As fold_unicode, with control characters as spaces."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        spaced = "".join(" " if unicodedata.category(c) == "Cc" else c for c in unicodedata.normalize("NFKD", s))
        return " ".join("".join(c for c in spaced if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower().split())

    return names.map(one)


def invisible(name: Column) -> Column:
    """Array of the reasons why a name has to be cleaned: no-break spaces, soft hyphens, zero-width characters, controls, spaces at its ends or doubled."""
    reasons = {"nbsp": "\\u00A0", "shy": "\\u00AD", "zero-width": "[\\u200B-\\u200F\\u2060\\uFEFF]", "control": "[\\x00-\\x1F\\x7F]", "space": "^ | $|  "}
    return F.array_compact(F.array(*[F.when(name.rlike(pattern), F.lit(code)) for code, pattern in reasons.items()]))


@cache
def ascii_parts() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition has one ASCII character, and those with more, with what they give; by rule, not by list."""
    found = {chr(k): unicodedata.normalize("NFKD", chr(k)).encode("ascii", "ignore").decode() for k in range(0x80, 0x20000)}
    return {c: a for c, a in found.items() if len(a) == 1}, {c: a for c, a in found.items() if len(a) > 1}


def to_ascii(name: Column) -> Column:
    """Decomposed, with what is not ASCII dropped: marks go, letters stay, ligatures and fractions are spelled out. All on the JVM.

    Characters that give one are translated in a pass. Only texts that hold one of
    those that give more are taken apart, character by character, through a map.
    """
    one, more = ascii_parts()
    plain = F.translate(name, "".join(one), "".join(one.values()))
    keys, odd = "".join(more), "[" + "".join(f"\\x{{{ord(c):x}}}" for c in more) + "]"
    spelled = F.str_to_map(F.lit("\x01".join(f"{c}\x02{a}" for c, a in more.items())), F.lit("\x01"), F.lit("\x02"))
    apart = F.transform(F.split(plain, ""), lambda c: F.when((c != "") & (F.instr(F.lit(keys), c) > 0), F.try_element_at(spelled, c)).otherwise(c))
    return F.regexp_replace(F.when(plain.rlike(odd), F.array_join(apart, "")).otherwise(plain), "[^\\x00-\\x7F]", "")


def slug(name: Column) -> Column:
    """Lower-case ASCII letters and digits of the decomposed name, runs of anything else as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(to_ascii(name)), "[^a-z0-9]+", "-"), "^-|-$", "")


@F.pandas_udf(StringType())
def composed(names: pd.Series) -> pd.Series:
    """Letters and their marks as one character where there is one (NFC), which no built-in function does; null stays null."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def clean_name(name: Column) -> Column:
    """Composed, without no-break spaces and invisible characters, white space as single spaces, trimmed."""
    bare = F.regexp_replace(composed(name), "[\\u00A0\\u00AD\\u200B-\\u200D\\uFEFF]", "")
    return F.trim(F.regexp_replace(bare, "(?U)\\s+", " "))


def display_name(first: Column, last: Column) -> Column:
    """The surname is added only where it is there and the name does not have it."""
    return F.when(last.isNull() | (last == ""), first).when(F.contains(F.lower(first), F.lower(last)), first).otherwise(F.concat_ws(" ", first, last))


def without_double_surname(name: Column) -> Column:
    return F.regexp_replace(name, "( \\w+)\\1+$", "$1")


# fixed values: letters without a decomposition, as market lists write them
LETTERS, SPELLED = "ıłøđ", "ilod"


def market_name(name: Column) -> Column:
    """The decomposed name in lower-case ASCII, hyphens and apostrophes as spaces, trimmed, and a last word that is said twice said once."""
    plain = to_ascii(F.translate(F.lower(name), LETTERS, SPELLED))
    return without_double_surname(F.trim(F.translate(plain, "-'", "  ")))


def season_label(start: Column) -> Column:
    """1997 -> 1997-98."""
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def season_of(day: Column) -> Column:
    """Start year of the season of a day; seasons begin in July."""
    return F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)


def age_in_years(born: Column, at: Column) -> Column:
    return F.round(F.datediff(at, born) / 365.25, 2)
