"""Counts, sizes and timings of a run, and the report lines made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.functions import formats


def successes(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull())


def failures(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNotNull())


def status_counts(rows: DataFrame) -> DataFrame:
    """One row: files, errors, empty ones and successes of rows with error and empty."""
    return rows.agg(
        F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.coalesce(F.col("empty"), F.lit(False))).alias("empty"), F.count_if(F.col("error").isNull()).alias("ok"),
    )


def size_stats(rows: DataFrame, value: Column) -> DataFrame:
    """One row: least, largest, mean and sum of a value."""
    return rows.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.sum(value).alias("sum"))


def mebibytes(rows: DataFrame, size: Column) -> DataFrame:
    """One row: bytes, and the same in MiB."""
    return rows.agg(F.sum(size).alias("bytes"), (F.sum(size) / 1024 / 1024).alias("mib"))


def by_worker(rows: DataFrame, worker: Column, value: Column) -> DataFrame:
    """Count, sum and mean of a value for each worker, the busiest first."""
    return (
        rows.groupBy(worker.alias("worker")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
        .orderBy(F.desc("total"), "worker")
    )


def stage_seconds(rows: DataFrame, stages: list[str]) -> DataFrame:
    """One row: the seconds of each stage, summed over documents; zero without any."""
    return rows.agg(*(F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in stages))


def phase_scalars(totals: DataFrame, phase: str, other: str, parts: list[str]) -> DataFrame:
    """One row of key and value lines: how many times the other's seconds a phase took, and the sum of several parts."""
    seconds = lambda key: F.max(F.when(F.col("key") == key, F.regexp_extract("value", r"[0-9.]+", 0).cast("double")))
    return totals.agg((seconds(phase) / seconds(other)).alias("ratio"), sum((seconds(p) for p in parts[1:]), seconds(parts[0])).alias("together"))


def overhead(phase: Column, cpu: Column, workers: Column, union: Column | None = None) -> Column:
    """Seconds of a phase that neither the workers' even share of CPU time nor the union explains; not below zero."""
    rest = phase - cpu / workers
    return F.greatest(F.lit(0.0), rest - union if union is not None else rest)


def largest_first(rows: DataFrame, size: str, path: str) -> DataFrame:
    """Rows by size, the largest first, unknown sizes as zero; ties by path."""
    return rows.orderBy(F.coalesce(F.col(size), F.lit(0)).desc(), path)


def open_log(rows: DataFrame) -> DataFrame:
    """path and line of the opening log for rows with path, seconds and error, in the order of paths."""
    width = rows.agg(F.coalesce(F.max(F.length("path")), F.lit(0)).alias("width"))
    return rows.select("path", formats.open_line(F.col("path"), width.scalar(), F.col("seconds"), F.col("error")).alias("line")).orderBy("path")


def timing_report(rows: DataFrame, least_width: int = 24) -> DataFrame:
    """part (0 successes, 1 failures), path and line of the timing report: successes by path, then failures by path."""
    width = rows.agg(F.greatest(F.coalesce(F.max(F.length("path")), F.lit(0)), F.lit(least_width)).alias("width"))
    line = formats.timing_line(F.col("path"), width.scalar(), F.col("seconds"), F.col("error"))
    part = F.col("error").isNotNull().cast("int").alias("part")
    return rows.select(part, "path", line.alias("line")).orderBy("part", "path")


def compare_runs(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """metric and one column for each run, from rows of run, metric and value."""
    return metrics.groupBy("metric").pivot("run", runs).agg(F.first("value"))
