"""HTML to visible text.

The steps and their order are part of the meaning. A step is skipped where a
plain search shows that it has nothing to do, so most texts are scanned by few
patterns. Three ideas carry the rest:

* Tags are found once, by one pattern; a text is split at them and joined
  again, each tag being a line break for block elements and nothing for
  others. So no later pattern can see half a tag.
* The contents of preformatted and raw elements are made safe in place: every
  character that a later step would act on is exchanged for a noncharacter,
  and exchanged back at the end. Nesting needs nothing more.
* Tag bodies are possessive: a tag of any length costs no stack.

The rules are plain Python over Arrow batches: HTML5 character references need
Python anyway, and a chain of JVM patterns, each of which decodes and encodes
the whole text, was measured at a fifth of the speed.
"""

from __future__ import annotations

import functools
import html
import re
import time

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.functions.overtime import Overtime, time_limit

#: Longest text that is cleaned, in characters.
MAX_CHARS = 40 * 1024 * 1024
# Elements that break lines.
BLOCKS = """
    address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup
    option p pre section summary table tbody td tfoot th thead title tr ul
""".split()
# The patterns that say what markup is.
_COMMENT = re.compile("<!--.*?-->", re.S)
_HIDDEN = re.compile(r"<(script|style|template|noscript)\b[^>]*+>.*?</\1\s*+>", re.I | re.S)
_UNCLOSED = re.compile(r"<(?:script|style)\b[^>]*+>.*\Z", re.I | re.S)
_BODY = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=(?!\s*+["']))*+"""  # a quote opens a value only behind an equals sign
_RAW = re.compile(rf"<(?:(?:xmp|listing)\b{_BODY}>(.*?)(?:</(?:xmp|listing)\s*+>|\Z)|plaintext\b{_BODY}>(.*)\Z)", re.I | re.S)
_PRE = re.compile(rf"<pre\b{_BODY}>(.*?)(?:</pre\s*+>|\Z)", re.I | re.S)
_LINE_BREAK = re.compile(rf"<br\b{_BODY}>", re.I)
_TAG = re.compile(rf"<(?=/?([^\W_]*+))[a-zA-Z/!?]{_BODY}>")
_BROKEN = re.compile(r"<(?=([^\W_]*+))[a-zA-Z][a-zA-Z0-9]*+\s++[a-zA-Z\-]++\s*+=[^>]*+>")
_DECLARATION = re.compile("<![^>]*+>")
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*+\Z")
# Control characters that are dropped, and white space within a line that becomes one space.
_CONTROLS = "".join(map(chr, [*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]))
_BLANKS = "\t\r\f\x0b\xa0"

#: Elements that need more than the usual steps.
_SELDOM = re.compile(r"<(?:script|style|xmp|listing|plaintext|pre)\b", re.I)
# Noncharacters: around preformatted content, and for an ampersand that stays one.
_EDGE, _AMPERSAND = "\U0002fffe", "\U0002ffff"
#: What later steps act on: markup, and white space but for what is dropped as a control character anyway.
_UNSAFE = "<>&\"'=" + "".join(chr(c) for c in range(0x110000) if chr(c).isspace() and c not in (*range(0x0B, 0x0D), *range(0x1C, 0x20)))
_SAFE = "".join(chr(0xFDD0 + k) for k in range(len(_UNSAFE)))
_MARKS = re.compile(f"[\ufdd0-\ufdef{_EDGE}{_AMPERSAND}]")
_PROTECT, _EXPOSE = str.maketrans(_UNSAFE, _SAFE), str.maketrans(_SAFE + _AMPERSAND, _UNSAFE + "&")
_VERBATIM = _PROTECT | {ord("&"): _AMPERSAND}
_SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


class _Gaps(dict):
    """What stands where a tag was, by the tag's name."""

    def __missing__(self, name: str) -> str:
        return self.get(name.lower(), "") if not name.islower() else ""


_GAPS = _Gaps.fromkeys(BLOCKS, "\n")


def _untagged(text: str, pattern: re.Pattern) -> str:
    """text without the tags that pattern finds; their names are its group."""
    parts = pattern.split(text)
    parts[1::2] = map(_GAPS.__getitem__, parts[1::2])
    return "".join(parts)


def _without_controls(text: str) -> str:
    for c in _CONTROLS:
        if c in text:
            text = text.replace(c, "")
    return text


def _shrunk(text: str, run: str, to: str) -> str:
    while run in text:
        text = text.replace(run, to)
    return text


def _raw(found: re.Match) -> str:
    return f"\n{_without_controls(found[1] or found[2] or '').translate(_VERBATIM)}\n"


def _preformatted(found: re.Match) -> str:
    """Contents lose their tags and stay between marks, since their references are still to be decoded."""
    return f"\n{_EDGE}{_TAG.sub('', _LINE_BREAK.sub(chr(10), found[1])).translate(_PROTECT)}{_EDGE}\n"


def _referenced(text: str, marked: bool) -> str:
    """Character references decoded, once; inside preformatted contents too, which stay protected."""
    if not marked or _EDGE not in text:
        return html.unescape(text) if "&" in text else text
    return "".join(
        _without_controls(html.unescape(p.translate(_EXPOSE))).translate(_PROTECT) if k % 2 else html.unescape(p)
        for k, p in enumerate(text.split(_EDGE))
    )


def visible(source: str) -> str:
    """The visible text of HTML."""
    text, marked = source, False
    if "<" in text:
        if "<!--" in text:
            text = _COMMENT.sub("\n", text)
        text = _HIDDEN.sub("\n", text)
        if _SELDOM.search(text):
            marked = True
            text = _UNCLOSED.sub("\n", _MARKS.sub("", text))
            text = _PRE.sub(_preformatted, _RAW.sub(_raw, text))
        text = _untagged(text, _TAG)
        if "<" in text:
            text = _DECLARATION.sub("\n", _untagged(text, _BROKEN))
            text = _CUT_OFF.sub("\n", text)
    text = _without_controls(_referenced(text, marked))
    for c in _BLANKS:
        if c in text:
            text = text.replace(c, " ")
    text = _shrunk(text, "  ", " ")
    if "\n" in text:
        text = _shrunk("\n".join(map(str.strip, text.split("\n"))), "\n\n\n", "\n\n")
    if marked:
        text = _shrunk(text.translate(_EXPOSE), "\n\n\n", "\n\n")
    return text.strip()


_CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType()), T.StructField("seconds", T.DoubleType())])


@functools.cache
def _cleaner(timeout: float | None):
    @F.arrow_udf(_CLEANED)
    def cleaned(source: pa.Array) -> pa.Array:
        """Visible texts, why there is none, and the seconds each took; null for null."""
        texts, errors, seconds = [], [], []
        with time_limit(timeout) as limited:
            for value in source:
                text = error = None
                began = time.perf_counter()
                if value.is_valid:
                    try:
                        with limited():
                            text = visible(value.as_py())
                    except Overtime as e:
                        error = str(e)
                texts.append(text)
                errors.append(error)
                seconds.append(time.perf_counter() - began)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string()), pa.array(seconds, pa.float64())], ["text", "error", "seconds"])

    return cleaned


def clean_text(source: Column) -> Column:
    """The visible text of HTML; null for null."""
    return _cleaner(None)(source)["text"]


def strip(text: Column) -> Column:
    """A text without white space, as Python takes it, at both ends."""
    return F.trim(text, F.lit(_SPACES))


def clean_error(source: Column, max_chars: int = MAX_CHARS) -> Column:
    """Why a text isn't cleaned; null if it is."""
    size = F.char_length(source)
    too_long = F.concat(F.lit("texto demasiado largo ("), size.cast("string"), F.lit(" caracteres)"))
    return F.when(source.isNull(), F.lit("entrada nula")).when(size > max_chars, too_long)


def timed_clean(source: Column, max_chars: int = MAX_CHARS, timeout: float | None = None) -> Column:
    """A struct of text, error (one of them null) and seconds that cleaning took.

    Texts over the limit never reach a pattern; a text that takes more than
    ``timeout`` seconds is given up.
    """
    error = clean_error(source, max_chars)
    done = _cleaner(timeout)(F.when(error.isNull(), source))
    return F.struct(done["text"].alias("text"), F.coalesce(error, done["error"]).alias("error"), done["seconds"].alias("seconds"))


def clean(source: Column, max_chars: int = MAX_CHARS) -> Column:
    """A struct of text and error, one of them null."""
    done = timed_clean(source, max_chars)
    return F.struct(done["text"].alias("text"), done["error"].alias("error"))


def is_empty(text: Column) -> Column:
    """Whether a text shows nothing."""
    return strip(F.coalesce(text, F.lit(""))) == ""
