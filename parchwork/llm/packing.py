"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's token ids give a hashed vector; a fixed random projection
takes it to three dimensions, whose cells a Hilbert curve visits. Documents in
curve order follow one another in one stream of tokens that is cut every
``length`` tokens, so neighbours on the curve share sequences and only the
last sequence is padded.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.llm.prefix import running_total
from parchwork.llm.scratch import stash
from parchwork.llm.tokens import Encoder, packed
from parchwork.llm.workers import shared

#: Cells of the hashed vector, dimensions of the projection, bits of each.
HASHED, DIMS, BITS = 256, 3, 10
_GROUP = 128
_CAPACITY = 1_200_000
_UINT = np.dtype("<u4")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of rows of integer coordinates below 2**bits.

    Skilling's transform (AIP Conf. Proc. 707, 2004), over all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(n):
            set_ = (x[k] & q) != 0
            t = np.where(set_, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            x[k] ^= t
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | ((x[k] >> bit) & 1)
    return key


class Projection:
    """Token ids to curve positions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.matrix = rng.normal(size=(HASHED, DIMS))

    def keys(self, ids: list[np.ndarray]) -> np.ndarray:
        """Curve positions of documents that each have an id at least."""
        mixed = np.concatenate(ids).astype(np.uint32) * np.uint32(2654435761)
        sign = np.where(mixed & np.uint32(1 << 23), 1.0, -1.0)
        owner = np.repeat(np.arange(len(ids)) * HASHED, [len(x) for x in ids])
        hashed = np.bincount(owner + (mixed >> np.uint32(24)), weights=sign, minlength=len(ids) * HASHED).reshape(-1, HASHED)
        points = hashed @ self.matrix / np.maximum(np.linalg.norm(hashed, axis=1, keepdims=True), 1e-12)
        return hilbert(np.clip((points + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1), BITS)


def encoded(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """row, id, key (curve position), n (ids) and ids (little-endian unsigned 32-bit) of each document, its last id ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = shared((tokenizer, "ids"), lambda: Encoder(tokenizer, packed, _CAPACITY))
        projection, end = Projection(), packed([end_id])
        gc.disable()  # nothing below makes cycles, and the cache is large to go through
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, _GROUP):
                    part = batch.slice(at, _GROUP)
                    blobs = [b"".join(x) + end for x in encoder.values(part.column("text").to_pylist())]
                    keys = projection.keys([np.frombuffer(b, _UINT) for b in blobs])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), part.column("id"), pa.array(keys, pa.int64()), pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array(blobs, pa.binary())],
                        ["row", "id", "key", "n", "ids"],
                    )
        finally:
            gc.enable()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {kind}, key long, n long, ids binary")


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    One row per piece: the id column, start (the document's ids before it),
    length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset in the sequence. All ids of a document, the closing
    ``end_id`` included, lie in its pieces, once each.

    A null or empty text is a document of ``end_id`` alone. Null and repeated
    ids are packed as rows of their own; ties on the curve go by id, then by
    row; other columns are ignored; an empty table gives an empty result. A
    long document is cut into as many pieces as it needs.
    """
    tokens = stash(encoded(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id), "tokens")
    order = [F.col("key"), F.col("id").asc_nulls_first(), F.col("row")]
    placed = running_total(tokens.select("row", "id", "key", "n"), order, "n", "place")
    at = placed.select("row", "place").hint("shuffle_hash")
    whole = F.explode(F.sequence(F.expr(f"place div {length}"), F.expr(f"(place + n - 1) div {length}")))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * length)
    stop = F.least(F.col("place") + F.col("n"), (F.col("sequence_id") + 1) * length)
    return (
        tokens.select("row", "id", "n", "ids").join(at, "row")
        .select("id", "place", "n", "ids", whole.alias("sequence_id"))
        .select(
            F.col("id").alias(id_col), (begin - F.col("place")).alias("start"), (stop - begin).alias("length"),
            F.col("n").alias("doc_tokens"), "sequence_id",
            (begin - F.col("sequence_id") * length).alias("offset"), "ids",
        )
        .withColumn("ids", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))"))
    )


def digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pieces with ids_crc32 in place of ids."""
    return pieces.select(
        id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
