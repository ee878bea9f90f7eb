"""The package's queries, their SQL, and the pipeline."""

import os

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from parchwork.llm import catalogue, minhash, scratch
from tests.llm import helpers
from tests.test_queries import rows


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), con.execute(catalogue.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_operator_has_a_query():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def staged(spark, docs):
    """What each stage returns, each written and read again."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, None)
        path = f"{scratch.scratch_root(spark)}/test-{os.urandom(6).hex()}"
        done.write.parquet(path)
        docs = out[name] = spark.read.schema(done.schema).parquet(path)
    return out


def test_stages(spark):
    stages = staged(spark, helpers.clashing(helpers.documents(spark)))
    for name in list(stages)[:-1]:
        assert tuple(stages[name].columns) == corpus_pipeline.COLUMNS
    ids = lambda name: sorted((r.doc_id for r in stages[name].collect()), key=repr)
    # Without text or letters documents go; near-duplicates go but for the least id, and one of two equal rows.
    assert ids("language_id") == sorted([0, 1, 5, 6, 7, 9, 9, None], key=repr)
    assert ids("near_duplicates") == ids("secret_scan") == sorted([0, 5, 6, 9, None], key=repr)
    mixed = stages["mix_sources"].groupBy("doc_id").count().collect()
    assert mixed and all(r["count"] <= 2 for r in mixed)
    tokens = stages["pack"].selectExpr("sum(length) as n").first().n
    assert tokens == sum(len(encoded(r.text)) + 1 for r in stages["mix_sources"].collect())


def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def test_stages_of_no_documents(spark):
    assert all(df.collect() == [] for df in staged(spark, helpers.documents(spark, [])).values())


def test_secrets_leave_the_pipeline(spark):
    rows_ = [(1, "my password = hunter22222 and more words here", "en", "a"), (2, "clean words only in this text", "en", "a"), (3, None, None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secret_scan(spark, helpers.documents(spark, rows_), None).collect()}
    assert got == {1: ("my [assign] and more words here", 31), 2: (rows_[1][1], len(rows_[1][1])), 3: (None, None)}


def test_mixed_parts_are_whole_words(spark):
    rows_ = [(k, f"  a{k} b  c\nd e f g  ", "en", s) for k, s in enumerate("aaaaabbbbbccccc")]
    got = corpus_pipeline.mix_sources(spark, helpers.documents(spark, rows_), None).collect()
    texts = {k: t for k, t, _, _ in rows_}
    assert all(texts[r.doc_id].startswith(r.text) and len(r.text) == r.n_chars for r in got)
    words = sum(len(r.text.split()) for r in got)
    assert abs(words - 1.5 * 7 * 15) <= 3


def test_pipeline_over_the_table(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert pieces.where("length(ids) != 4 * length or length <= 0").count() == 0
    full = pieces.groupBy("sequence_id").sum("length").where("`sum(length)` != 4096").count()
    assert full <= 1


def tables(spark):
    root = scratch.scratch_root(spark).removeprefix("file://") + "/parchwork"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_the_pipeline_deletes_its_own_tables_only(spark, sf_dir):
    held = minhash.near_duplicates(helpers.documents(spark))
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, helpers.documents(spark), "a")
    found = stages["near_duplicates"](spark, first, "a")
    scanned = stages["secret_scan"](spark, found, "a")  # reads tables of the stage before, which was never written
    before = tables(spark)
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert len(tables(spark) - before) == 1 and pieces.count() > 0  # the table that pieces reads
    assert len(held.collect()) == len(helpers.DOCS) and scanned.count() == 5
    mixed = stages["mix_sources"](spark, spark.createDataFrame(scanned.collect(), scanned.schema), "a")
    assert mixed.count() > 0 and len(held.collect()) == len(helpers.DOCS)
