"""A vocabulary that grows as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchwork.functions.words import words


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Documents of the Parquet files that appear in a folder, so many files in flight at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_words(stream: DataFrame, text_col: str) -> DataFrame:
    """Each word once, when a document first has it.

    Words are made distinct within documents before they meet the state, which
    holds one entry for each word; there is no event time to forget them by.
    """
    return stream.select(F.explode(words(F.col(text_col))).alias("word")).dropDuplicates(["word"])


def start(words_stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append new words to a Parquet table, until what is there has been read."""
    return (
        words_stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
