"""Command line: ``open``, ``strip`` and ``words`` over folders of HTML files.

Exit codes are those of three programs that grew apart: for ``open`` 1 is a
fatal error and 2 means that some files failed; for ``strip`` and ``words`` it
is the other way round, and a folder without documents is no error.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.functions import paths
from parchwork.operators import reports
from parchwork.operators import vocabulary as vocab
from parchwork.plans import flows
from parchwork.sources import html_corpus, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="parchwork", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    opened = commands.add_parser("open", help="open every file and log how long it takes")
    opened.add_argument("--carpeta", default="~/Downloads/Files")
    opened.add_argument("--matricula", default="corpus")
    opened.add_argument("--salida", default="salida")
    for name, kind in (("strip", "salida"), ("words", "palabras")):
        command = commands.add_parser(name)
        command.add_argument("carpeta")
        command.add_argument(f"--{kind}", default="salida" if name == "strip" else "palabras.txt")
        command.add_argument("--tiempos", default="a2.txt" if name == "strip" else "a3.txt")
        command.add_argument("-w", "--workers", type=int, default=os.cpu_count() or 1, help="partitions that read at a time")
        command.add_argument("--reservar", type=int, default=0, help="workers to leave unused")
        command.add_argument("--limite-mb", type=float, default=20)
        command.add_argument("--carga-en-worker", action="store_true", help="always so here: executors read their own files")
        command.add_argument("--ram-mb", type=int, default=2048, help="bytes of files that all readers together hold back")
        command.add_argument("--timeout", type=int, default=30, help="seconds for a document in each stage; 0 for no limit")
    return parser


def workers(asked: int, reserved: int, cores: int, files: int) -> int:
    """Partitions for a run: what was asked for less the reserve, no more than cores or files, one at least."""
    return max(1, min(max(1, asked - reserved), cores, files))


def _session() -> SparkSession:
    return SparkSession.builder.appName("parchwork").getOrCreate()


def _print_failures(rows: DataFrame) -> None:
    """Every failed file, by path, on stderr; they come to the driver a partition at a time."""
    for r in reports.failures(rows).select("path", "error").orderBy("path").toLocalIterator():
        print(f"{r.path}: {r.error}", file=sys.stderr)


def _open(args: argparse.Namespace) -> int:
    student = args.matricula.strip()
    if not student:
        print("La matricula no puede estar vacia", file=sys.stderr)
        return 1
    folder = os.path.expanduser(args.carpeta)
    began = time.perf_counter()
    try:
        html_corpus.list_flat(folder)
    except html_corpus.CorpusError as e:
        print(e, file=sys.stderr)
        return 1
    rows = flows.open_files(_session(), folder).persist()
    try:
        count, failed, total = rows.agg(F.count("*"), F.count("error"), F.sum("seconds")).first()
        took = time.perf_counter() - began
        path = os.path.join(args.salida, f"a1_{student}.txt")
        try:
            os.makedirs(args.salida, exist_ok=True)
            sinks.write_lines(reports.open_log(rows), "line", path)
            with open(path, "a", encoding="utf-8") as f:
                f.write(f"\nTotal de archivos: {count}\nArchivos con error: {failed}\nTiempo total de apertura: {total:.6f} s\nTiempo total de ejecucion: {took:.6f} s\n")
        except OSError as e:
            print(f"No se pudo escribir {path}: {e.strerror}", file=sys.stderr)
            return 1
        print(f"{count} archivos, {failed} con error, {total:.6f} s; {path}")
        _print_failures(rows)
        return 2 if failed else 0
    finally:
        rows.unpersist()


def _report(rows: DataFrame, root: str, path: str, facts: list[str]) -> None:
    short = paths.short_name(paths.relative(F.col("path"), F.lit(root)), F.lit(root))
    sinks.write_lines(reports.timing_report(rows.select(short.alias("path"), F.col("clean_seconds").alias("seconds"), "error")), "line", path)
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in facts)


def _gather(args: argparse.Namespace) -> int:
    folder = os.path.realpath(os.path.expanduser(args.carpeta))
    if not os.path.isdir(folder):
        print(f"No es una carpeta: {args.carpeta}", file=sys.stderr)
        return 2
    spark, cores, gathers = _session(), os.cpu_count() or 1, args.command == "words"
    began = time.perf_counter()
    count = workers(args.workers, args.reservar, cores, 1 << 31)
    held = max(1, int(args.ram_mb * 1024 * 1024 / count))
    raw = flows.read_documents(spark, folder, int(args.limite_mb * 1024 * 1024), count, held)
    done = flows.strip_bytes(raw, args.timeout or None).withColumn("worker", F.spark_partition_id())
    if gathers:
        done = flows.document_words(done, args.timeout or None)
    done = done.persist()  # its text or words are used once more, its counts twice
    try:
        status = reports.status_counts(done).first()
        if not status.files:
            print("No hay documentos HTML")
            return 0
        count = min(count, status.files)
        mib = reports.mebibytes(done, F.col("bytes")).first().mib
        phase = time.perf_counter() - began
        if gathers:
            at = time.perf_counter()
            words = done.select(F.explode("words").alias("word")).where("word != ''").distinct().persist()
            unique = words.count()
            union, at = time.perf_counter() - at, time.perf_counter()
            sinks.write_lines(words.orderBy(*vocab.sort_key(F.col("word"))), "word", args.palabras)
            words.unpersist()
            wrote, failed = time.perf_counter() - at, status.errors
        else:
            name = paths.output_name(paths.relative(F.col("path"), F.lit(folder)))
            written = sinks.write_texts(reports.successes(done).select(name.alias("name"), "text"), os.path.abspath(args.salida))
            union, failed = None, status.errors + written.where("error is not null").count()
        stages = reports.stage_seconds(done, ["seconds", "clean_seconds", *(["word_seconds"] if gathers else [])]).first()
        work = stages.clean_seconds + (stages.word_seconds if gathers else 0.0)
        rest = spark.range(1).select(reports.overhead(F.lit(phase), F.lit(work), F.lit(count))).first()[0]
        facts = [
            f"tiempo total en eliminar las etiquetas HTML: {phase:.6f} segundos", f"tiempo total de ejecucion: {time.perf_counter() - began:.6f} segundos",
            f"archivos procesados: {status.ok}", f"archivos con error: {failed}", f"archivos vacios: {status.empty}", f"nucleos de la maquina: {cores}", f"procesos lanzados: {count}",
            *([f"palabras unicas encontradas: {unique}"] if gathers else []), "desglose:",
            f"  lectura de disco (sumada): {stages.seconds:.6f} s ({mib:.1f} MB)", f"  limpieza pura (suma de CPU): {stages.clean_seconds:.6f} s",
            *([f"  extraccion pura (suma de CPU): {stages.word_seconds:.6f} s"] if gathers else []), f"  fase de limpieza (tiempo real): {phase:.6f} s",
            *([f"  union del vocabulario: {union:.6f} s", f"  ordenar y escribir palabras: {wrote:.6f} s"] if gathers else []), f"  sobrecoste de reparto: {rest:.6f} s",
        ]
        each = reports.by_worker(reports.successes(done), F.col("worker"), F.col("clean_seconds")).collect()  # one row for each partition
        if len(each) > 1:
            facts += ["reparto real por proceso:", *(f"  {r.worker}: {r.n} archivos, {r.total:.6f} s, media {r['mean']:.6f} s" for r in each)]
        _report(done, folder, args.tiempos, facts)
        print(f"{status.ok} archivos, {failed} con error, {status.empty} vacios, {phase:.6f} s; {args.tiempos}")
        _print_failures(done)
        return 1 if failed else 0
    finally:
        done.unpersist()


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    return _open(args) if args.command == "open" else _gather(args)


if __name__ == "__main__":
    sys.exit(main())
