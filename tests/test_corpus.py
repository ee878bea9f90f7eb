"""The file source, sinks, streams and command line over temporary folders."""

import os

import pytest
from pyspark.sql import functions as F

from parchwork import cli
from parchwork.plans import flows
from parchwork.sources import html_corpus, sinks
from parchwork.streaming import vocabulary as streaming

PAGE = "<html><body><p>Hola mundo</p></body></html>"


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "d.html").mkdir()
    for name in ("001.html", "002.html", "pagina.HTM", "x.xhtml", "notas.txt", "_u.html", ".h.html", ".html", "sub/007.html"):
        (root / name).write_text(PAGE)
    (root / "vacio.html").write_bytes(b"")
    (root / "big.html").write_text("x" * 5000)
    (root / "ln.html").symlink_to(root / "002.html")
    (root / "lnd").symlink_to(root / "sub")
    return root


def names(paths, root):
    return [os.path.relpath(p, root) for p in paths]


def test_flat_listing(corpus):
    assert names(html_corpus.list_flat(str(corpus)), corpus) == [".h.html", "001.html", "002.html", "_u.html", "big.html", "ln.html", "pagina.HTM", "vacio.html"]


def test_deep_listing(corpus):
    want = [".h.html", ".html", "001.html", "002.html", "_u.html", "big.html", "ln.html", "pagina.HTM", "sub/007.html", "vacio.html", "x.xhtml"]
    assert names(html_corpus.list_deep(str(corpus)), corpus) == want


def test_listing_errors(tmp_path):
    for folder in (tmp_path / "none", tmp_path):
        with pytest.raises(html_corpus.CorpusError):
            html_corpus.list_flat(str(folder))
    (tmp_path / "f").write_text("")
    with pytest.raises(html_corpus.CorpusError):
        html_corpus.list_flat(str(tmp_path / "f"))


def test_open_files(spark, corpus):
    rows = {os.path.basename(r.path): r for r in flows.open_files(spark, str(corpus)).collect()}
    assert rows["vacio.html"].bytes_read == 0 and rows["vacio.html"].error is None
    assert rows["ln.html"].bytes_read == len(PAGE) and rows["001.html"].seconds >= 0


def test_read_errors_are_rows(spark, corpus):
    rows = {os.path.basename(r.path): r for r in flows.read_documents(spark, str(corpus), max_bytes=4000).collect()}
    assert rows["big.html"].error == "excede el limite (5000 > 4000)" and rows["big.html"].content is None
    assert rows["ln.html"].error == "es un symlink (rechazado por O_NOFOLLOW)"
    assert bytes(rows["vacio.html"].content) == b"" and bytes(rows["007.html"].content) == PAGE.encode()


def test_confinement(corpus, tmp_path):
    (tmp_path / "out.html").write_text(PAGE)
    assert html_corpus.read_file(str(tmp_path / "out.html"), str(corpus), 10**6, False) == (None, "fuera de la raiz permitida")
    assert html_corpus.read_file(str(corpus / "none.html"), str(corpus), 10**6, False) == (None, "no existe")
    assert html_corpus.read_file(str(corpus / "sub"), None, 10**6, False)[1] == "no es un archivo regular"


def test_files_are_dealt_evenly():
    parts = html_corpus.deal([(10, "a"), (1, "b"), (9, "c"), (2, "d")], 2)
    assert sorted(map(sorted, parts)) == [["a", "b"], ["c", "d"]]


def test_strip_and_sink(spark, corpus, tmp_path):
    done = flows.strip_bytes(flows.read_documents(spark, str(corpus), max_bytes=4000))
    rows = {os.path.basename(r.path): r for r in done.collect()}
    assert rows["001.html"].text == "Hola mundo" and rows["vacio.html"].empty and rows["vacio.html"].codec == "vacio"
    assert rows["big.html"].text is None and not rows["big.html"].empty
    named = spark.createDataFrame([("a.txt", "uno"), ("b.txt", ""), ("a.txt", "dos")], "name string, text string")
    out = tmp_path / "out"
    assert sinks.write_texts(named, str(out)).where("error is not null").count() == 0
    assert sorted(os.listdir(out)) == ["a.txt", "b.txt"] and (out / "b.txt").read_bytes() == b""
    assert [tuple(r) for r in sinks.collisions(named).collect()] == [("a.txt", 2)]


def test_write_lines(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",)], "w string").orderBy("w")
    assert sinks.write_lines(df, "w", str(tmp_path / "w")) == 2 and (tmp_path / "w").read_text() == "a\nb\n"
    assert sinks.write_lines(df.limit(0), "w", str(tmp_path / "e")) == 0 and (tmp_path / "e").read_text() == ""


def test_stream_adds_each_word_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    for text in ("uno dos", "dos tres"):
        spark.createDataFrame([(text,)], "text string").write.mode("append").parquet(folder)
        stream = streaming.document_stream(spark, folder, "text string")
        streaming.start(streaming.new_words(stream, "text"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.word for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["dos", "tres", "uno"]


def test_cli_open(spark, corpus, tmp_path, capsys):
    out = str(tmp_path / "s")
    assert cli.main(["open", "--carpeta", str(corpus), "--matricula", "M1", "--salida", out]) == 0
    lines = open(os.path.join(out, "a1_M1.txt")).read().splitlines()
    assert lines[8] == "" and "Total de archivos: 8" in lines and lines[0].startswith(f"{corpus}/.h.html")
    assert cli.main(["open", "--carpeta", str(tmp_path / "none")]) == 1
    assert cli.main(["open", "--carpeta", str(corpus), "--matricula", "  "]) == 1


def test_cli_strip_and_words(spark, corpus, tmp_path):
    times, out, found = str(tmp_path / "t.txt"), str(tmp_path / "out"), str(tmp_path / "p.txt")
    assert cli.main(["strip", str(corpus), "--salida", out, "--tiempos", times]) == 1  # the symbolic link fails
    assert "sub_007.txt" in os.listdir(out) and "ERROR  (es un symlink" in open(times).read()
    os.remove(corpus / "ln.html")
    assert cli.main(["words", str(corpus), "--palabras", found, "--tiempos", times]) == 0
    assert open(found).read() == "hola\nmundo\n" + "x" * 5000 + "\n"
    assert cli.main(["words", str(tmp_path / "none")]) == 2
    (tmp_path / "empty").mkdir()
    assert cli.main(["strip", str(tmp_path / "empty")]) == 0


def test_workers():
    assert [cli.workers(10, 0, 8, 100), cli.workers(4, 6, 8, 100), cli.workers(8, 2, 8, 3)] == [8, 1, 3]


def test_plans_push_down(spark, tmp_path):
    spark.createDataFrame([(1, "a", "b")], "id long, text string, other string").write.parquet(str(tmp_path / "t"))
    from parchwork.operators.vocabulary import vocabulary

    plan = vocabulary(spark.read.parquet(str(tmp_path / "t")), "text")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # Words are made distinct by each task, in Python, before the only exchange.
    assert "ReadSchema: struct<text:string>" in plan and plan.count("Exchange hashpartitioning") <= 1 and "MapInArrow" in plan


def test_a_document_that_takes_too_long(spark, corpus, monkeypatch):
    import time

    from parchwork.functions.overtime import Overtime, time_limit

    with time_limit(0.05) as limited:
        with pytest.raises(Overtime, match="excedio 0.05s"), limited():
            time.sleep(2)
        with limited():
            pass
    with time_limit(None) as limited, limited():
        pass
    slow = spark.createDataFrame([("/a.html", bytearray(b"<script>" * 40_000), None), ("/b.html", bytearray(b"<p>b"), None)], "path string, content binary, error string")
    rows = {r.path: r for r in flows.document_words(flows.strip_bytes(slow, 0.2), 0.2).collect()}
    assert rows["/a.html"].error == "excedio 0.2s" and rows["/a.html"].text is None and rows["/a.html"].words is None
    assert rows["/b.html"].error is None and rows["/b.html"].words == ["b"] and rows["/b.html"].clean_seconds < 0.2


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    path = tmp_path / "lines.txt"
    want = [f"line {k} " + "x" * (k % 50) for k in range(20_000)]
    path.write_text("\n".join(want) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        from parchwork.operators import logs

        lines = logs.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 3 and [r.line for r in sorted(lines.collect())] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_every_failure_is_printed(spark, tmp_path, capsys):
    root = tmp_path / "many"
    root.mkdir()
    for k in range(30):
        (root / f"{k:02d}.html").write_text("x" * 3000)
    assert cli.main(["strip", str(root), "--salida", str(tmp_path / "o"), "--tiempos", str(tmp_path / "t"), "--limite-mb", "0.001"]) == 1
    assert capsys.readouterr().err.count("excede el limite") == 30
    report = (tmp_path / "t").read_text()
    assert "archivos con error: 30" in report and "limpieza pura (suma de CPU): " in report and report.count("ERROR  (") == 30


def test_places_over_many_partitions(spark):
    from parchwork.operators.ranks import with_place

    rows = [(k * 7919 % 5000, "x") for k in range(5000)]
    placed = with_place(spark.createDataFrame(rows, "k long, y string").repartition(6), [F.desc("k")], "pos")
    assert sorted((r.pos, r.k) for r in placed.collect()) == [(k + 1, 4999 - k) for k in range(5000)]
    assert with_place(spark.createDataFrame([], "k long"), [F.col("k")], "pos").collect() == []
