"""Words of a text and the order they sort in."""

from __future__ import annotations

import functools
import re
import time
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.functions.overtime import Overtime, time_limit
from parchwork.functions.unicode import folding, letter_class

# The jamo that Hangul syllables decompose into start here; counts of vowels and finals.
_LEAD, _VOWEL, _FINAL, _VOWELS, _FINALS = 0x1100, 0x1161, 0x11A7, 21, 28
#: Pieces of text that a worker remembers the words of, the longest of them, and distinct words that a task holds back.
_PIECES, _LONGEST, _HELD = 200_000, 64, 100_000


class Splitter(dict):
    """From what stands between spaces to its lower-cased words, remembered."""

    def __init__(self):
        super().__init__()
        self.word = re.compile(f"[{letter_class()}]+").findall

    def __missing__(self, piece: str) -> tuple[str, ...]:
        found = tuple(map(str.lower, self.word(piece)))
        if found == (piece,):
            found = (piece,)
        if len(piece) <= _LONGEST:
            if len(self) >= _PIECES:
                self.clear()
            self[piece] = found
        return found

    def distinct(self, text: str) -> dict[str, None]:
        """The distinct words of a text, in order of first appearance."""
        pieces = dict.fromkeys(text.replace("\n", " ").split(" "))
        return dict.fromkeys(chain.from_iterable(map(self.__getitem__, pieces)))


@functools.cache
def splitter() -> Splitter:
    """The one of this process."""
    return Splitter()


_FOUND = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()), T.StructField("seconds", T.DoubleType())])


@functools.cache
def _finder(timeout: float | None):
    @F.arrow_udf(_FOUND)
    def found(text: pa.Array) -> pa.Array:
        """Distinct words, why there are none, and the seconds that took; null for null."""
        words, errors, seconds = [], [], []
        distinct = splitter().distinct
        with time_limit(timeout) as limited:
            for value in text:
                own = error = None
                began = time.perf_counter()
                if value.is_valid:
                    try:
                        with limited():
                            own = list(distinct(value.as_py()))
                    except Overtime as e:
                        error = str(e)
                words.append(own)
                errors.append(error)
                seconds.append(time.perf_counter() - began)
        return pa.StructArray.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(errors, pa.string()), pa.array(seconds, pa.float64())], ["words", "error", "seconds"])

    return found


def timed_words(text: Column, timeout: float | None = None) -> Column:
    """A struct of words, error (where ``timeout`` seconds weren't enough) and seconds that finding them took."""
    return _finder(timeout)(text)


def words(text: Column) -> Column:
    """The distinct lower-cased words of a text, in order of first appearance; null for null.

    A word is a maximal run of letters and non-spacing marks; everything from
    U+2600 on counts as a letter. Case is lowered after splitting.
    """
    return timed_words(text)["words"]


def words_by_task(docs: DataFrame, text_col: str) -> DataFrame:
    """The words of all texts, each once for (nearly) each task that has it: what is worth exchanging."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, held, empty = splitter().distinct, set(), True
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["word"])
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    held.update(distinct(value.as_py()))
                if len(held) > _HELD:
                    yield pack()
                    held, empty = set(), False
        if held or empty:
            yield pack()

    return docs.select(text_col).mapInArrow(gather, "word string")


def word_error(text: Column) -> Column:
    """Why a text has no words to give; null if it has."""
    return F.when(text.isNull(), F.lit("entrada nula"))


def _hangul(char: Column) -> Column:
    index = F.ascii(char) - 0xAC00
    lead = F.array(*(F.lit(chr(_LEAD + k)) for k in range(19)))
    vowel = F.array(*(F.lit(chr(_VOWEL + k)) for k in range(_VOWELS)))
    final = F.array(*(F.lit(chr(_FINAL + k) if k else "") for k in range(_FINALS)))
    at = lambda table, k: F.element_at(table, (k + 1).cast("int"))
    return F.concat(
        at(lead, F.floor(index / (_VOWELS * _FINALS))), at(vowel, F.floor(index % (_VOWELS * _FINALS) / _FINALS)), at(final, index % _FINALS)
    )


def sort_base(word: Column) -> Column:
    """A word without diacritics, special letters spelled out: the first part of its sort key.

    Most words hold nothing to fold, which their length in bytes tells; most
    others hold only Latin letters, which need no search for rare ones.
    """
    source, target, several = folding()
    short = {k: v for k, v in several.items() if k in "æœßþ"}
    latin = F.translate(word, *_up_to("\u017f", source, target))
    for char, base in short.items():
        latin = F.replace(latin, F.lit(char), F.lit(base))
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    slow = F.array_join(
        F.transform(
            F.split(word, ""),
            lambda c: F.when(c.between("가", "힣"), _hangul(c)).otherwise(F.coalesce(table[c], F.translate(c, source, target))),
        ),
        "",
    )
    return F.when(F.octet_length(word) == F.char_length(word), word).when(word.rlike("[^\\x{0}-\\x{17f}]"), slow).otherwise(latin)


def _up_to(last: str, source: str, target: str) -> tuple[str, str]:
    """The part of a translation that concerns characters up to ``last``."""
    pairs = [(c, target[k] if k < len(target) else "") for k, c in enumerate(source) if c <= last]
    pairs.sort(key=lambda p: not p[1])  # deletions come last
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def sort_key(word: Column) -> list[Column]:
    """Columns to order words by: diacritics don't count, but decide between words that differ only in them."""
    return [sort_base(word), word]
