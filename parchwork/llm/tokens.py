"""Encoding by pre-token with a worker-wide cache.

The two public BPE files cut a text into pre-tokens and encode each by itself,
so a text's ids are the concatenation of its pre-tokens' ids. An ``Encoder``
remembers what a pre-token gives and asks the library only for new ones. Texts
of characters for which the cutting rule below is known to agree with the
library's are cut by it; the library itself normalises and cuts other texts,
whose pre-tokens are remembered likewise. Only texts that hold an added
token's string go to the library whole.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from array import array
from collections.abc import Callable, Iterable

# Letters and other characters whose class, and lower case, is the same in every Unicode version and library, and which no
# neighbour composes with: Latin, Cyrillic, kana, Han, Hangul; punctuation, symbols, faces; the space that doesn't break.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ\u0100-\u012f\u0131-\u0148\u014a-\u017e\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_OTHERS = "\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u2010-\u2027\u2030-\u205e\u20ac\u2122\u3001-\u3003\u3008-\u3011\U0001f600-\U0001f64f"
_LATIN_1 = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Plain texts; those of Latin-1 letters and ASCII, which most are, are cut by quicker rules.
_PLAIN, _NARROW = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}{_OTHERS}]*+"), re.compile(rf"[\t\n\r\x20-\x7e{_LATIN_1}]*+")
_APOSTROPHE = "'(?:s|t|re|ve|m|ll|d)"
_BYTE_CUT, _BYTE_CUT_NARROW = (
    re.compile(rf" ?[{x}]+|{_APOSTROPHE}| ?[0-9]+| ?[^\s{x}0-9]+|\s+(?!\S)|\s+").findall for x in (_LETTERS, _LATIN_1)
)
_WORD_CUT, _WORD_CUT_NARROW = (re.compile(rf"[{x}]+|{_APOSTROPHE}|[0-9]|[^\s{x}0-9]+").findall for x in (_LETTERS, _LATIN_1))
# The pre-tokenizer patterns the two rules above stand for.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cutters(path: str) -> tuple[Callable, Callable] | None:
    """How the file cuts plain texts, and those of Latin-1 letters and ASCII; None if its rule isn't one of the two."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"].get("type") != "BPE" or spec["model"].get("ignore_merges"):
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return _BYTE_CUT, _BYTE_CUT_NARROW
    steps = pre.get("pretokenizers") or [{}]
    lowers = norm and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if lowers and steps[0].get("pattern", {}).get("Regex") == _WORD_PATTERN and steps[0].get("invert"):
        return (lambda text: _WORD_CUT(text.lower())), (lambda text: _WORD_CUT_NARROW(text.lower()))
    return None


class Encoder:
    """Values (a count, or ids) of texts under one tokenizer file.

    ``value`` makes of a pre-token's ids what is kept. At most ``capacity`` pre-tokens are
    remembered beside ``table``.
    """

    def __init__(self, path: str, value: Callable, capacity: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cutters = _cutters(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.specials = [t.content for t in added]
        # An added token that is sought in normalised text may be hidden in a text as it stands.
        self.cuts = not any(t.normalized for t in added) or self.tok.normalizer is None
        self.value, self.capacity, self.table = value, capacity, {}
        self.cache: dict = {}  # by pre-token as it stands in plain texts
        self.pieces: dict = {}  # by pre-token as the library's own cutting writes it

    def seed(self, table: dict) -> None:
        """Make table the part of the cache that is never forgotten."""
        if self.table is not table:
            self.table = table
            self.cache.update(table)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def rule(self, text: str) -> Callable[[str], list[str]] | None:
        """How to cut a plain text; None for other texts."""
        if self.cutters is None or any(s in text for s in self.specials):
            return None
        if _NARROW.fullmatch(text) is not None:
            return self.cutters[1]
        return self.cutters[0] if _PLAIN.fullmatch(text) is not None else None

    def is_plain(self, text: str) -> bool:
        return self.rule(text) is not None

    def cut_by_library(self, text: str) -> list[str]:
        """The text's pre-tokens, as the model is given them."""
        norm, pre = self.tok.normalizer, self.tok.pre_tokenizer
        if norm is not None:
            text = norm.normalize_str(text)
        return [piece for piece, _ in pre.pre_tokenize_str(text)] if pre is not None else [text]

    def _of_pieces(self, text: str) -> list:
        """Values of the pre-tokens of a text that the library cuts."""
        out, model = [], self.tok.model
        for piece in self.cut_by_library(text):
            value = self.pieces.get(piece)
            if value is None:
                value = self.value([t.id for t in model.tokenize(piece)])
                if len(self.pieces) < self.capacity // 4:
                    self.pieces[piece] = value
            out.append(value)
        return out

    def values(self, texts: Iterable[str]) -> list[list]:
        """Of each text, the values of its pre-tokens in order (or one of the whole text, if it holds an added token)."""
        out: list = []
        late: list[tuple[int, list[str]]] = []
        whole: list[tuple[int, str]] = []
        missing: set[str] = set()
        get = self.cache.get
        for text in texts:
            if not text:
                out.append([])
            elif (cut := self.rule(text)) is not None:
                parts = cut(text)
                got = list(map(get, parts))
                if None in got:
                    missing.update(p for p, v in zip(parts, got) if v is None)
                    late.append((len(out), parts))
                out.append(got)
            elif self.cuts and not any(s in text for s in self.specials):
                out.append(self._of_pieces(text))
            else:
                whole.append((len(out), text))
                out.append(None)
        if missing:
            fresh = list(missing)
            new = dict(zip(fresh, map(self.value, self.ids(fresh))))
            for k, parts in late:
                out[k] = [new[p] if v is None else v for p, v in zip(parts, out[k])]
            if len(self.cache) + len(new) <= self.capacity:  # what came first includes what is frequent, so it stays
                self.cache.update(new)
        for k, text in whole:
            out[k] = [self.value(self.ids([text])[0])]
        return out


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else struct.pack(f"<{len(ids)}I", *ids)
