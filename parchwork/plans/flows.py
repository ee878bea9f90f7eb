"""The three programs as plans: open files, strip documents, gather words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.functions import clean as cleaning
from parchwork.functions import decode as decoding
from parchwork.functions import paths
from parchwork.functions.words import timed_words
from parchwork.sources import html_corpus


def open_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path, bytes_read, seconds and error of the files of a folder."""
    html_corpus.register(spark)
    rows = spark.read.format("htmlcorpus").option("follow", "true").option("maxBytes", str(1 << 62)).option("content", str(content)).load(folder)
    return rows.select("path", F.col("length").alias("bytes_read"), "seconds", "error")


def read_documents(spark: SparkSession, folder: str, max_bytes: int = html_corpus.MAX_BYTES, partitions: int = 0, held_bytes: int = html_corpus.HELD_BYTES) -> DataFrame:
    """path, length, content, seconds and error of all documents below a folder.

    A URL of another store than the file system is read by Spark's own reader,
    which lists it in parallel; that one leaves out names that begin with a
    dot or an underscore, measures no seconds and fails on what can't be read.
    """
    if "://" in folder and not folder.startswith("file://"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        files = files.where(paths.is_markup(F.col("path"))).select("path", "length", "content")
        small, large = files.where(F.col("length") <= max_bytes), files.where(F.col("length") > max_bytes)
        read, error = F.lit(None).cast("double").alias("seconds"), html_corpus.too_large(F.col("length"), max_bytes)
        return small.select("*", read, F.lit(None).cast("string").alias("error")).unionByName(
            large.select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"), read, error.alias("error"))
        )
    html_corpus.register(spark)
    reader = spark.read.format("htmlcorpus").option("recursive", "true").option("confine", "true").option("maxBytes", str(max_bytes))
    return reader.option("partitions", str(partitions)).option("heldBytes", str(held_bytes)).load(folder.removeprefix("file://"))


def spread(rows: DataFrame, least: int = 16 << 20) -> DataFrame:
    """rows dealt over all cores where a core's share is less than ``least`` bytes.

    So small a table may lie in a single row group, which one task would read
    and work on alone. Larger tables keep the splits that they are read in.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * least else rows


def _staged(stage: str, error: Column) -> Column:
    return F.when(error.isNotNull(), F.concat(F.lit(f"{stage}: "), error))


def strip_bytes(raw: DataFrame, timeout: float | None = None) -> DataFrame:
    """path, bytes, codec, seconds (of reading, where raw has them), clean_seconds, text, empty and error of raw (path, content, error).

    The first stage that fails names itself in the error; a document with an
    error has no text. One that takes more than ``timeout`` seconds to clean
    is given up.
    """
    decoded = raw.withColumn("decoded", decoding.decode(F.col("content"))).withColumnRenamed("error", "read_error")
    cleaned = decoded.withColumn("cleaned", cleaning.timed_clean(F.col("decoded.text"), timeout=timeout))
    error = F.coalesce("read_error", _staged("decodificar", F.col("decoded.error")), _late("limpiar", F.col("cleaned.error")))
    text = F.when(error.isNull(), F.col("cleaned.text"))
    return cleaned.select(
        "path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes"), F.col("decoded.codec").alias("codec"),
        *(["seconds"] if "seconds" in raw.columns else []), F.col("cleaned.seconds").alias("clean_seconds"), text.alias("text"),
        (error.isNull() & (F.col("cleaned.text") == "")).alias("empty"), error.alias("error"),
    )


def _late(stage: str, error: Column) -> Column:
    """An error with its stage's name, but for that of a document given up."""
    return F.when(error.startswith("excedio "), error).otherwise(_staged(stage, error))


def strip_table(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, text, empty and error of a table's documents."""
    cleaned = docs.select(id_col, cleaning.clean(F.col(html_col)).alias("cleaned"))
    return cleaned.select(
        id_col, F.col("cleaned.text").alias("text"),
        (F.col("cleaned.error").isNull() & (F.col("cleaned.text") == "")).alias("empty"), F.col("cleaned.error").alias("error"),
    )


def document_words(stripped: DataFrame, timeout: float | None = None) -> DataFrame:
    """stripped with words, each document's distinct ones, and word_seconds; in one narrow stage with all before."""
    found = stripped.withColumn("found", timed_words(F.col("text"), timeout)).withColumnRenamed("error", "clean_error")
    error = F.coalesce("clean_error", _late("extraer", F.col("found.error")))
    names = [c for c in stripped.columns if c != "error"]
    return found.select(*names, F.when(error.isNull(), F.col("found.words")).alias("words"), F.col("found.seconds").alias("word_seconds"), error.alias("error"))
