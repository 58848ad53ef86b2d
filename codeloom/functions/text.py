"""Small text and array expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.regex import SPACE_CHARS, SPACE_RANGES, WORD, WORD_BEHIND, java_regex, plain


def strip(text: Column) -> Column:
    """Python's str.strip(): any Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def newlines(text: Column) -> Column:
    return _removed(text, "\n")


def _removed(text: Column, part: str) -> Column:
    """How often replacing takes the part out; byte lengths are known without a scan."""
    bytes_removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))
    size = len(part.encode())
    return bytes_removed if size == 1 else (bytes_removed / F.lit(size)).cast("int")


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(text.contains(part), _removed(text, part)).otherwise(0)


def split_lines(text: Column) -> Column:
    """Number of pieces that splitting on line feeds gives; 0 for empty text."""
    return F.when(F.octet_length(text) > 0, F.size(lines_of(text))).otherwise(F.lit(0))


def iterated_lines(text: Column) -> Column:
    """Number of lines a file iteration yields: a final line feed opens no further line."""
    return newlines(text) + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def filled_lines(text: Column) -> Column:
    """Number of lines with a character that is not white space, in one pass. ASCII text takes plain
    character classes, which Java looks up in a table. Of each line only its first such character is taken out."""
    return F.size(matches(text, f"([^{SPACE_RANGES}])[^\\n]*+", 1))


def identifiers(text: Column) -> Column:
    """All whole words that are ASCII identifiers; every keyword is one of them."""
    ascii_only = r"\b[A-Za-z_][A-Za-z0-9_]*+"
    general = f"(?<!{WORD_BEHIND})[A-Za-z_][A-Za-z0-9_]*+(?!{WORD})"
    return F.when(is_ascii(text), F.regexp_extract_all(text, F.lit(ascii_only), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(general), F.lit(0))
    )


def matches(text: Column, regex: str, group: int = 0) -> Column:
    """All matches of a Java pattern, by its ``plain`` form where the text is all ASCII."""
    general = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    if plain(regex) == regex:
        return general
    return F.when(is_ascii(text), F.regexp_extract_all(text, F.lit(plain(regex)), F.lit(group))).otherwise(general)


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(all_matches(text, pattern))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return matches(text, java_regex(pattern), group)


def count_where(items: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, predicate))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def banded(value: Column, bands: Iterable[tuple[str, float | None]]) -> Column:
    """First label whose upper bound lies above the value; a bound of None is open."""
    out = None
    for label, upper in bands:
        hit = F.lit(True) if upper is None else value < upper
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def title_case(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def clean(raw: Column) -> Column:
    """Text as a universal-newline UTF-8 reader that drops bad bytes sees it."""
    valid = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
    return F.when(valid.contains("\r"), F.regexp_replace(valid, "\r\n?", "\n")).otherwise(valid)
