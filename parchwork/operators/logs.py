"""Reading run logs back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1) and line of one text file, of any size.

    Lines are numbered within the blocks that the file is read in; blocks are
    told apart by where they begin, and one row for each meets in one task.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = lines.join(F.broadcast(blocks.select("block", "first", before.alias("before"))), "block")
    return joined.select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def timings(lines: DataFrame, suffixes: str = "html?") -> DataFrame:
    """line_no, path and seconds of the lines that begin with a document's path and a number."""
    tokens = F.split(F.trim("line"), r"\s+")
    number = F.expr("try_cast(token as double)")
    return (
        lines.select("line_no", tokens[0].alias("path"), F.get(tokens, F.lit(1)).alias("token"))
        .where(F.col("path").rlike(rf"\.{suffixes}\z"))
        .select("line_no", "path", number.alias("seconds")).where(F.col("seconds").isNotNull())
    )


def totals(lines: DataFrame, first_token: bool = True) -> DataFrame:
    """key and value of the lines ``key: value`` that aren't about a document; the last of equal keys counts."""
    parts = F.split("line", ":", 2)
    value = F.trim(parts[1])
    pairs = lines.where(F.contains(F.col("line"), F.lit(":")) & ~F.split(F.trim("line"), r"\s+")[0].rlike(r"\.html\z"))
    pairs = pairs.select("line_no", F.trim(parts[0]).alias("key"), (F.split(value, r"\s+")[0] if first_token else value).alias("value"))
    return pairs.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))


def head(lines: DataFrame, count: int) -> DataFrame:
    return lines.orderBy("line_no").limit(count)


def tail(lines: DataFrame, count: int) -> DataFrame:
    """The last lines, in order."""
    return lines.orderBy(F.desc("line_no")).limit(count).orderBy("line_no")
