"""Character classes and folding tables, built from rules over Unicode.

The engine's word and white-space rules are those of Python's Unicode tables.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

#: From this code point on everything counts as a letter.
ALL_LETTERS = 0x2600
# Letters with no decomposition and what they sort as.
SORTS_AS = {
    "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ø": "o", "ð": "d", "đ": "d", "ħ": "h", "ł": "l", "ŧ": "t", "ı": "i", "ĸ": "k",
}


def is_letter(char: str) -> bool:
    """Whether a character is part of words: letters and non-spacing marks, without ª and º, and all from U+2600 on."""
    if ord(char) >= ALL_LETTERS:
        return True
    kind = unicodedata.category(char)
    return (kind[0] == "L" or kind == "Mn") and char not in "ªº"


@functools.cache
def letter_class() -> str:
    """The inside of a Python character class of the characters of words."""
    low, out, first = [is_letter(chr(c)) for c in range(ALL_LETTERS)], [], None
    for c, letter in enumerate([*low, False]):
        if letter and first is None:
            first = c
        elif not letter and first is not None:
            out.append(f"{re.escape(chr(first))}-{re.escape(chr(c - 1))}")
            first = None
    return "".join(out) + f"{chr(ALL_LETTERS)}-{chr(sys.maxunicode)}"


def base_letters(char: str) -> str:
    """What a character sorts as: its decomposition without combining marks, special letters spelled out."""
    kept = (c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
    return "".join(SORTS_AS.get(c, c) for c in kept)


@functools.cache
def folding() -> tuple[str, str, dict[str, str]]:
    """Source and target of a translation (targets end before deletions begin), and characters that become several.

    Hangul syllables, which a rule decomposes, are left out.
    """
    single, gone, several = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        base = base_letters(char)
        if base == char:
            continue
        if not base:
            gone.append(char)
        elif len(base) == 1:
            single.append((char, base))
        else:
            several[char] = base
    return "".join([c for c, _ in single] + gone), "".join(b for _, b in single), several
