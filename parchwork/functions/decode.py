"""Bytes to text: which encoding, and decoding that never fails.

A byte order mark decides, then a declared charset if it is one of the known
ones, then whether the bytes are valid UTF-8; anything else is cp1252. Valid
UTF-8 is decoded in the JVM; other bytes go through Python's decoders, whose
replacement of malformed input the results must equal.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes searched for a declared charset.
SNIFFED = 2048
# Encodings that are decoded, by name.
CODECS = (
    "ascii utf-8 utf-8-sig utf-16 utf-16-le utf-16-be utf-32 utf-32-le utf-32-be cp1252 cp1251 cp1250 cp850 cp437 latin-1 "
    "iso-8859-1 iso-8859-2 iso-8859-9 iso-8859-15 koi8-r shift_jis euc-jp euc-kr gbk gb2312 big5"
).split()
# Declared names that stand for others.
ALIASES = {"latin-1": "cp1252", "latin1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "us-ascii": "ascii", "utf8": "utf-8"}
# Byte order marks; the longer ones first, since UTF-16's begins UTF-32's.
MARKS = (
    (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"),
    (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"),
)
# Characters that don't show, and separators that become line breaks.
INVISIBLE = "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2061, 0x2065), *range(0x2066, 0x206A), 0xFEFF]))
SEPARATORS = "  "
_META = r"""(?i)<meta[^>]{0,200}?charset[ \t\n\r\f\x0b]*=[ \t\n\r\f\x0b]*["']?[ \t\n\r\f\x0b]*([a-zA-Z0-9_\-]{1,40})"""


def declared_charset(content: Column) -> Column:
    """The charset that a meta element near the start declares, lower-cased; empty if none does."""
    head = F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")
    return F.lower(F.regexp_extract(head, _META, 1))


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def _let(value: Column, use) -> Column:
    """use(value), the value being computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _mark(content: Column) -> Column:
    """The codec that a byte order mark names; null without one."""
    out = F.when(F.lit(False), F.lit(""))
    for mark, codec in MARKS:
        out = out.when(F.substring(content, 1, len(mark)) == F.lit(mark), F.lit(codec))
    return out


def detect(content: Column) -> Column:
    """A struct of the codec and the reason for it; null for null."""
    aliases = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    facts = F.struct(
        _mark(content).alias("mark"), declared_charset(content).alias("declared"),
        F.when(is_utf8(content), F.lit("utf-8")).otherwise(F.lit("cp1252")).alias("guess"),
    )
    struct = lambda codec, reason: F.struct(codec.alias("codec"), reason.alias("reason"))

    def choose(x: Column) -> Column:
        named = F.coalesce(aliases[x["declared"]], x["declared"])
        rejected = F.concat(F.lit("meta '"), x["declared"], F.lit("' rechazado -> "), x["guess"])
        guessed = F.when(x["guess"] == "utf-8", F.lit("utf-8 validado")).otherwise(F.lit("no es utf-8 valido -> cp1252"))
        return (
            F.when(x["mark"].isNotNull(), struct(x["mark"], F.lit("BOM")))
            .when(named.isin(*CODECS), struct(named, F.concat(F.lit("meta charset="), x["declared"])))
            .when(x["declared"] != "", struct(x["guess"], rejected)).otherwise(struct(x["guess"], guessed))
        )

    return F.when(content.isNotNull(), _let(facts, choose))


@F.pandas_udf(T.StringType())
def _decode_any(content: pd.Series, codec: pd.Series) -> pd.Series:
    """Content under its codec, malformed input replaced; null where either is null."""
    # A lone surrogate, which some decoders let through, has no place in a Spark string.
    def one(own, name):
        text = bytes(own).decode(name, errors="replace")
        return text.encode("utf-8", "replace").decode("utf-8")

    return pd.Series([None if own is None or name is None else one(own, name) for own, name in zip(content, codec)], dtype=object)


def decode(content: Column, encoding: Column | None = None) -> Column:
    """A struct of text, error and codec.

    Empty content is empty text under the codec ``vacio``. Invisible and
    bidirectional characters are deleted and separators become line breaks. An
    explicit encoding must be one of the known ones, by that name; it is not
    aliased.
    """
    codec = encoding if encoding is not None else detect(content)["codec"]
    known = codec.isin(*CODECS)
    plain = codec.isin("utf-8", "utf-8-sig") & is_utf8(content)
    skip_mark = F.when((codec == "utf-8-sig") & (F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf")), F.expr("3")).otherwise(0)
    direct = F.substr(content, skip_mark + 1, F.octet_length(content)).cast("string")
    other = _decode_any(F.when(~plain & known, content), F.when(~plain & known, codec))
    text = F.translate(F.when(plain, direct).otherwise(other), SEPARATORS + INVISIBLE, "\n\n")
    empty = F.octet_length(content) == 0
    error = (
        F.when(content.isNull(), F.lit("la entrada no son bytes")).when(empty, None)
        .when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("codec no permitido: "), codec))
    )
    return F.struct(
        F.when(content.isNull(), None).when(empty, F.lit("")).when(known, text).alias("text"),
        error.alias("error"),
        F.when(content.isNull(), F.lit("")).when(empty, F.lit("vacio")).otherwise(codec).alias("codec"),
    )
