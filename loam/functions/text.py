"""Text measures. Offsets and lengths are bytes of UTF-8 throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, in Java's regular expressions.
SPACE = r"\p{IsWhite_Space}"
#: The 32 ASCII punctuation characters.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_len(text: Column) -> Column:
    return F.octet_length(text)


def word_tokens(text: Column) -> Column:
    """Whitespace-separated words: the token estimate of merging, metrics, intents and enrichment."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def block_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up: the token estimate of blocks."""
    return F.ceil(byte_len(text) / 4).cast("int")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))


def trim_punctuation(word: Column) -> Column:
    return F.btrim(word, F.lit(ASCII_PUNCTUATION))


def first_word(text: Column) -> Column:
    """The first word in lower case without ASCII punctuation around it; empty if there is none."""
    return F.lower(trim_punctuation(F.regexp_extract(text, f"([^{SPACE}]+)", 1)))


def left_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+", "")


def is_upper(char: Column) -> Column:
    return char.rlike(r"^\p{Lu}")


def char_class(delimiters: str) -> str:
    """A regular-expression class of these ASCII characters, inner part only."""
    return "".join("\\" + c if re.match(r"[\[\]\\^&~\-]", c) else c for c in delimiters)


def parse_escapes(value: str) -> str:
    r"""``\n``, ``\t``, ``\r`` and ``\\`` become the characters they name; other escapes stay as written."""
    named = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}
    return re.sub(r"\\(.)", lambda m: named.get(m[1], m[0]), value, flags=re.S)


def parse_patterns(value: str) -> list[str]:
    """Comma-separated patterns; empty ones are left out."""
    return [parse_escapes(p) for p in value.split(",") if p]
