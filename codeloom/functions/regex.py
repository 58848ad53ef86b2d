"""Regular expressions and whitespace with Python's meaning on the JVM."""

from __future__ import annotations

import re

# Characters that Python's str.strip() and \s treat as white space.
SPACE_RANGES = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
# The same without the line feed, for patterns that stay within a line.
INLINE_SPACE_RANGES = SPACE_RANGES.replace(r"\t-\r", r"\t\x{b}-\r")
WORD_RANGES = r"\p{L}\p{N}_"
WORD = f"[{WORD_RANGES}]"

# For look-behinds: the letter outside the basic plane, a letter anyway, makes Java step back by
# code points instead of surrogate halves.
WORD_BEHIND = f"[{WORD_RANGES}\U0001d400]"

_BOUNDARY = f"(?:(?<={WORD_BEHIND})(?!{WORD})|(?<!{WORD_BEHIND})(?={WORD}))"
_ESCAPES = {
    r"\w": WORD,
    r"\s": f"[{SPACE_RANGES}]",
    r"\d": r"\p{Nd}",
    r"\b": _BOUNDARY,
}


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite a Python pattern for Java: Unicode word, space and digit classes, and `.` up to a
    line feed only. Escapes inside bracket classes are left alone."""
    out = re.sub(
        r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\.",
        lambda m: _ESCAPES.get(m.group(0), m.group(0)),
        pattern,
    )
    return ("(?iud)" if ignore_case else "(?d)") + out


def plain(pattern: str) -> str:
    """A pattern of ``java_regex`` for text that is all ASCII, where it matches the same: classes that Java looks up in a
    table, and its own word boundary."""
    for general, ascii_only in (
        (_BOUNDARY, r"\b"),
        (SPACE_RANGES, r"\t-\r\x1c-\x20"),
        (INLINE_SPACE_RANGES, r"\t\x0b-\r\x1c-\x20"),
        (WORD_BEHIND, "[A-Za-z0-9_]"),
        (WORD, "[A-Za-z0-9_]"),
        (r"\p{Nd}", "[0-9]"),
        ("(?iud)", "(?id)"),
    ):
        pattern = pattern.replace(general, ascii_only)
    return pattern


def glob_regex(glob: str) -> str:
    """A whole-name regular expression for a file glob (`*` and `?` only)."""
    return "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in glob)
