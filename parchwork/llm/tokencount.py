"""Token counts by a two-tier lookup on the map side.

The first tier is a broadcast table of frequent pre-tokens and their lengths
in tokens, of at most ``table_size`` entries, all that come at least a certain
number of times. All texts are counted for it, each task keeping a bounded
summary of its own. The second is a cache in each Python worker, filled by
encoding pre-tokens that neither tier has. No pre-token of a text is shuffled;
the only exchange is the one that merges the tasks' summaries.

The tiers decide how fast a count is found, never what it is, so a summary may
forget what is rare in its task.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.llm.scratch import discard, stash
from parchwork.llm.tokens import Encoder
from parchwork.llm.workers import shared

#: Texts encoded together; keeps what a worker holds at once small.
_GROUP = 256
_CAPACITY = 800_000
#: A task's summary forgets its rarer half when it has so many times the entries of the first tier.
_SUMMARY = 16


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _GROUP):
            part = batch.slice(at, _GROUP)
            yield part, part.column(column).to_pylist()


def frequent_lengths(docs: DataFrame, path: str, text_col: str, table_size: int) -> dict[str, int]:
    """Token lengths of the pre-tokens that are frequent in all rows."""
    if not path.endswith(".json"):
        return {}
    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    most = _SUMMARY * table_size

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared((path, "count"), lambda: Encoder(path, len, _CAPACITY))
        seen: Counter = Counter()
        for _, texts in _texts(batches, "text"):
            for text in texts:
                if text and (cut := encoder.rule(text)) is not None:
                    seen.update(cut(text))
                    if len(seen) > most:
                        seen = Counter(dict(seen.most_common(most // 2)))
        best = seen.most_common(table_size)
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in best], pa.string()), pa.array([v for _, v in best], pa.int64())], ["part", "n"]
            )

    counts = stash(rows.mapInArrow(top, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")), "frequent")
    # How many pre-tokens come at least so often, by powers of two, says from where on they fit into the table.
    by_power = {r.power: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()}
    least, held = 64, 0
    for power in sorted(by_power, reverse=True):
        held += by_power[power]
        if held > table_size:
            break
        least = power
    best = counts.where(F.col("n") >= 2.0**least).select("part").collect()
    discard(counts)
    encoder = Encoder(path, len, _CAPACITY)
    parts = [r.part for r in best]
    return dict(zip(parts, map(len, encoder.ids(parts)))) if parts else {}


def token_counts(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 512, table_size: int = 20_000,
) -> DataFrame:
    """Bytes and tokens of every text under the tokenizer file at the path ``tokenizer``.

    A ``.json`` file is read by tokenizers, a ``.model`` file by sentencepiece,
    both at their defaults for special strings, without begin, end or added
    special tokens, truncation or padding.

    One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit). A null text counts as empty (0, 0, false); null and
    repeated ids are kept as they are; other columns are ignored; an empty
    table gives an empty result. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    lengths = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text_col, table_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            numbers = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            encoder = shared((tokenizer, "count"), lambda: Encoder(tokenizer, len, _CAPACITY))
            encoder.seed(lengths.value)
            numbers = lambda texts: list(map(sum, encoder.values(texts)))
        for part, texts in _texts(batches, "text"):
            n = numbers([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
