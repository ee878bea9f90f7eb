"""Writing results: one text file a document, sorted word lists, report lines."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.plans import shared_folder


def collisions(named: DataFrame) -> DataFrame:
    """Output names that several documents share, with how many do."""
    return named.groupBy("name").agg(F.count("*").alias("documents")).where("documents > 1")


def write_texts(named: DataFrame, folder: str) -> DataFrame:
    """name and error of each row of (name, text), written by executors to folder/name as UTF-8.

    The folder must be on storage that all executors see. A file is written
    beside its name and renamed, so that a task that runs again leaves whole
    files. Of rows that share a name one wins; see ``collisions``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, errors = batch.column("name").to_pylist(), []
            for name, text in zip(names, batch.column("text").to_pylist()):
                try:
                    part = os.path.join(folder, f".{name}.{os.getpid()}")
                    with open(part, "w", encoding="utf-8", newline="") as f:
                        f.write(text or "")
                    os.replace(part, os.path.join(folder, name))
                    errors.append(None)
                except OSError as e:
                    errors.append(f"error de E/S ({e.errno}): {e.strerror}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(errors, pa.string())], ["name", "error"])

    return named.select("name", "text").mapInArrow(write, "name string, error string")


def write_parts(lines: DataFrame, column: str, folder: str) -> None:
    """An ordered column as text files that in turn are its values, each a line; for lists of any size."""
    lines.select(column).write.mode("overwrite").text(folder)


def write_lines(lines: DataFrame, column: str, path: str) -> int:
    """An ordered column as one local UTF-8 file, each value a line; how many lines it has.

    Executors write the parts to the shared folder; the driver only appends
    their bytes to one another.
    """
    folder = shared_folder.fresh(lines.sparkSession, "lines")
    write_parts(lines, column, folder)
    parts, count = shared_folder.local(folder), 0
    with open(path, "wb") as out:
        for name in sorted((n for n in os.listdir(parts) if n.startswith("part-")), key=lambda n: int(n.split("-")[1])):
            with open(os.path.join(parts, name), "rb") as part:
                while chunk := part.read(1 << 20):
                    count += chunk.count(b"\n")
                    out.write(chunk)
    shutil.rmtree(parts, ignore_errors=True)
    return count
