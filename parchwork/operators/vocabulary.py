"""Vocabularies: distinct words over documents, in diacritic-insensitive order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchwork.functions.words import sort_key, words, words_by_task
from parchwork.operators.ranks import with_place


def document_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document and distinct word of it."""
    return docs.select(id_col, F.explode(words(F.col(text_col))).alias("word"))


def vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """All distinct words. Each task's are made distinct before they are exchanged."""
    return words_by_task(docs, text_col).where("word != ''").distinct()


def sorted_vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """The vocabulary in order; range-partitioned, so that partitions in turn are the sorted list."""
    return vocabulary(docs, text_col).orderBy(*sort_key(F.col("word")))


def with_positions(vocabulary: DataFrame) -> DataFrame:
    """Each word and its place in the order, from 1."""
    base, _ = sort_key(F.col("word"))
    return with_place(vocabulary.select("word", base.alias("base")), [F.col("base"), F.col("word")], "pos").select("word", "pos")


def vocabulary_size(docs: DataFrame, text_col: str, by: list[str] | None = None) -> DataFrame:
    """The number of distinct words, of all documents or for each group."""
    if not by:
        return vocabulary(docs, text_col).agg(F.count("*").alias("words"))
    each = docs.select(*by, F.explode(words(F.col(text_col))).alias("word"))
    return each.groupBy(*by).agg(F.countDistinct("word").alias("words"))


def ends(vocabulary: DataFrame, first: int, last: int) -> DataFrame:
    """The first and last words of the order, each with its end and place from there."""
    keyed = vocabulary.select("word", sort_key(F.col("word"))[0].alias("base"))
    out = []
    for end, count, order in (("first", first, [F.asc("base"), F.asc("word")]), ("last", last, [F.desc("base"), F.desc("word")])):
        some = keyed.orderBy(*order).limit(count)
        place = F.row_number().over(Window.orderBy(*order))
        out.append(some.select(F.lit(end).alias("end"), place.cast("long").alias("place"), "word"))
    return out[0].unionByName(out[1])
