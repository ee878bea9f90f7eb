"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents; other columns of the input are dropped at the start.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchwork.llm import langid, minhash, mixing, packing, scratch, secrets
from parchwork.llm.scratch import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose language is less sure than this are rejected.
LEAST_SCORE = 0.3
#: The scopes of stages that were called on their own, by sf_dir and number.
_left: dict[tuple[str | None, int], scratch.Scope] = {}
#: No stage before the last can be written as one SQL statement (hashing, inferred grammars, a trained model).
ORACLE_SQL = None


def _stage(f: Callable) -> Callable:
    """A stage that deletes the intermediate tables of the stage before, if that was called for the same sf_dir.

    A stage's result is lazy, so its tables can go only when the next stage
    reads the result from where it was written. If its docs read them still,
    they stay. No other tables are deleted.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = [name for name, _ in STAGES].index(f.__name__)
        before = _left.pop((sf_dir, place - 1), None)
        if before is not None and not before.is_read_by(docs):
            before.end()
        own = _left[sf_dir, place] = scratch.Scope()
        with own.recording():
            return f(spark, docs, sf_dir)

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with it as lang where that was null.

    Rejected: null texts, texts without a letter, texts of no clear language.
    Learned from the documents' own labels; without any label nothing is known
    and only texts without letters are rejected.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    named = langid.identify(docs, model, keep=list(COLUMNS))
    sure = named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Of rows that share an id one stays, the least by all columns. Rows with a
    null id stay, since no group can name them.
    """
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs)
    ids = stash(found.where("kept and doc_id is not null").groupBy("doc_id").count(), "kept")
    stay = docs.join(ids.where("count = 1"), "doc_id", "left_semi").select(*COLUMNS)
    again = ids.where("count > 1")
    if not again.isEmpty():
        rows = docs.join(again, "doc_id", "left_semi")
        least = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
        stay = stay.unionByName(least.select("doc_id", "row.*").select(*COLUMNS))
    return stay.unionByName(docs.where("doc_id is null"))


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by the name of its kind; n_chars follows."""
    clean = secrets.redact(docs.select(*COLUMNS), secrets.learn(secrets.labelled_credentials()))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice; where it takes part of one, its first words.

    Documents of which nothing is taken, such as those without words, go.
    """
    rows = stash(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    mixed = mixing.mix(rows, keep=("_row",)).where("taken > 0").select("_row", "size", "taken")
    # Words with the white space behind them; white space before the first word is a piece of its own.
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.col("text").rlike(r"^[\x20\x09-\x0D]").cast("int")
    part = F.array_join(F.slice(pieces, 1, (F.col("words") + lead).cast("int")), "")
    copies = F.transform(F.sequence(F.lit(0), F.expr("(taken - 1) div size")), lambda k: F.least(F.col("size"), F.col("taken") - k * F.col("size")))
    out = rows.join(mixed, "_row").withColumn("words", F.explode(copies))
    text = F.when(F.col("words") < F.col("size"), part).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(F.col("words") < F.col("size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*COLUMNS)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, packed into sequences along the space-filling curve."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the packed pieces, read from the one table that is left."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        own, path = scratch.Scope(), scratch.fresh(spark, f"pipeline-{name}")
        with own.recording():
            done = stage.__wrapped__(spark, docs, sf_dir)
        done.write.parquet(path)
        own.end()
        if before is not None:
            scratch.remove(before)
        docs, before = spark.read.schema(done.schema).parquet(path), path
    return docs
