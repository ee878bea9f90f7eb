"""A data source for folders of HTML files in which a bad file is a row, not a failed job.

``spark.read.format("htmlcorpus")`` with the options below gives path, length,
content, seconds and error. Built-in binaryFile drops empty and hidden files,
follows symbolic links and fails on the first unreadable file.

Options: ``recursive`` (false: the files in the folder itself, .html and .htm;
true: all below it that end so or in .xhtml, symbolic links to folders not
followed), ``maxBytes``, ``confine`` (true: files outside the folder are
errors), ``follow`` (true: symbolic links to files are read), ``content``
(false: only lengths), ``partitions`` and ``heldBytes`` (what a task holds of
files before it hands them on). Executors read the files, so the folder must
be on storage that they all see.
"""

from __future__ import annotations

import os
import re
import stat
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, content binary, seconds double, error string"
MAX_BYTES = 20 * 1024 * 1024
_CHUNK = 1 << 20
HELD_BYTES = 8 << 20
_FLAT, _DEEP = re.compile(r".+\.html?\Z", re.I | re.S), re.compile(r".*\.(?:html?|xhtml)\Z", re.I | re.S)


class CorpusError(ValueError):
    """A folder that can't be listed."""


def list_flat(folder: str) -> list[str]:
    """The HTML files of a folder, sorted; fails if it is missing, no folder, or without any."""
    if not os.path.exists(folder):
        raise CorpusError(f"La carpeta no existe: {folder}")
    if not os.path.isdir(folder):
        raise CorpusError(f"La ruta no es una carpeta: {folder}")
    with os.scandir(folder) as entries:
        # As pathlib sees it, a name that is only a suffix has none.
        found = sorted(e.path for e in entries if _FLAT.match(e.name) and e.is_file())
    if not found:
        raise CorpusError(f"No se encontraron archivos HTML en: {folder}")
    return found


def _entries(folder: str) -> tuple[list[str], list[tuple[int, str]]]:
    """Folders in a folder, without links, and the size and path of its HTML files; both empty if it can't be read."""
    below, files = [], []
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    below.append(e.path)
                elif _DEEP.match(e.name) and not e.is_dir():
                    try:
                        files.append((e.stat().st_size, e.path))
                    except OSError:
                        files.append((0, e.path))
    except OSError:
        pass
    return below, files


def sizes_deep(folder: str, threads: int = 16) -> list[tuple[int, str]]:
    """Size and path of the HTML files below a folder; its folders are listed side by side, links to folders aren't followed."""
    found, level = [], [folder]
    with ThreadPoolExecutor(threads) as pool:
        while level:
            listed = list(pool.map(_entries, level))
            found += [f for _, files in listed for f in files]
            level = [b for below, _ in listed for b in below]
    return found


def list_deep(folder: str) -> list[str]:
    """The HTML files below a folder, sorted by path."""
    return sorted(path for _, path in sizes_deep(folder))


def too_large(size, max_bytes: int):
    """The error of a file of more than max_bytes, for a column of sizes."""
    return F.concat(F.lit("excede el limite ("), size.cast("string"), F.lit(f" > {max_bytes})"))


def read_file(path: str, root: str | None, max_bytes: int, follow: bool) -> tuple[bytes | None, str | None]:
    """A file's bytes, or why it has none.

    The size is asked of the open file and decides before anything is read;
    no more than that is read, should the file grow meanwhile.
    """
    try:
        if root is not None:
            real, top = os.path.realpath(path), os.path.realpath(root)
            if os.path.commonpath([real, top]) != top:
                return None, "fuera de la raiz permitida"
        handle = os.open(path, os.O_RDONLY | os.O_CLOEXEC | (0 if follow else os.O_NOFOLLOW))
    except OSError as e:
        return None, _message(e)
    try:
        seen = os.fstat(handle)
        if not stat.S_ISREG(seen.st_mode):
            return None, "no es un archivo regular"
        if seen.st_size > max_bytes:
            return None, f"excede el limite ({seen.st_size} > {max_bytes})"
        chunks, left = [], seen.st_size
        while left and (chunk := os.read(handle, min(left, _CHUNK))):
            chunks.append(chunk)
            left -= len(chunk)
        return b"".join(chunks), None
    except OSError as e:
        return None, _message(e)
    except MemoryError:
        return None, "sin memoria suficiente"
    finally:
        os.close(handle)


# Messages for system errors.
_MESSAGES = {
    "ENOENT": "no existe", "EISDIR": "es un directorio", "EACCES": "sin permisos de lectura", "EPERM": "sin permisos de lectura",
    "ELOOP": "es un symlink (rechazado por O_NOFOLLOW)", "EMFILE": "demasiados descriptores abiertos",
}


def _message(e: OSError) -> str:
    import errno

    name = errno.errorcode.get(e.errno or 0, "")
    return _MESSAGES.get(name) or f"error de E/S ({e.errno}): {e.strerror}"


def _size(path: str) -> int:
    try:
        return os.stat(path).st_size
    except OSError:
        return 0


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def deal(sizes: list[tuple[int, str]], count: int) -> list[list[str]]:
    """Paths in ``count`` lists of about equal total size: each file, the largest first, to the list with least so far."""
    import heapq

    heap = [(0, k) for k in range(count)]
    out: list[list[str]] = [[] for _ in range(count)]
    for size, path in sorted(sizes, key=lambda x: (-x[0], x[1])):
        total, k = heapq.heappop(heap)
        out[k].append(path)
        heapq.heappush(heap, (total + size + 1, k))
    return [sorted(x) for x in out if x]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.folder = options.get("path") or ""
        self.recursive, self.content = flag("recursive", "false"), flag("content", "true")
        self.confine, self.follow = flag("confine", "false"), flag("follow", "false")
        self.max_bytes = int(options.get("maxbytes", options.get("maxBytes", MAX_BYTES)))
        self.count = int(options.get("partitions", 0))
        self.held = int(options.get("heldbytes", options.get("heldBytes", HELD_BYTES)))

    def partitions(self) -> list[_Files]:
        sizes = sizes_deep(self.folder) if self.recursive else [(_size(p), p) for p in list_flat(self.folder)]
        # About 16 MB or a thousand files to a task, unless told otherwise.
        count = self.count or max(8, sum(s for s, _ in sizes) >> 24, len(sizes) // 1000)
        return [_Files(x) for x in deal(sizes, max(1, min(count, len(sizes))))]

    def read(self, partition: _Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("seconds", pa.float64()), ("error", pa.string())])
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            start = time.perf_counter()
            content, error = read_file(path, self.folder if self.confine else None, self.max_bytes, self.follow)
            took = time.perf_counter() - start
            rows.append((path, len(content or b""), content if self.content else None, took, error))
            held += len(content or b"")
            if held > self.held or len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class HtmlCorpus(DataSource):
    """Files of a folder as rows."""

    @classmethod
    def name(cls) -> str:
        return "htmlcorpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HtmlCorpus)
