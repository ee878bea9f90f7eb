"""Near-duplicate vectors by random-hyperplane sign hashing, confirmed by cosine.

Every vector gets a key of ``bits`` signs in each of several tables. Bits grow
with the logarithm of the number of vectors, so that hardly any bucket holds
unrelated ones; tables are as many as bring the chance that a pair at the
threshold shares no bucket to ``miss``. What goes to all tables is a vector's
number and bucket; the vector itself, with its keys as bytes, goes to the
buckets that it shares. There vectors are compared in double precision by
matrix products; a pair that shares several buckets counts in the first of its
tables only, which the keys of linked vectors tell, for many buckets at once.
No pairs are emitted: each vector's number of new links, and a forest that
connects what is linked.

A bucket larger than ``block`` is split by hash into blocks, and pairs of
blocks are compared apart. Equal vectors are compared once, for all copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.llm.cells import by_cell
from parchwork.llm.components import components
from parchwork.llm.scratch import stash

BLOCK = 1024


def usable(vector_col: str):
    """Whether a vector has only finite components, at least one of them not zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def table_plan(count: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits and tables for so many vectors: a sixteenth of an unrelated vector to a bucket."""
    bits = max(8, min(40, math.ceil(math.log2(max(count, 2)) + 4)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def _keys(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """vectors x tables integer keys."""
    out, weights = np.empty((len(vectors), tables), np.int64), np.int64(1) << np.arange(bits, dtype=np.int64)
    for t in range(tables):
        planes = np.random.default_rng([seed, t]).normal(size=(vectors.shape[1], bits))
        out[:, t] = (vectors @ planes > 0) @ weights
    return out


def _as_bytes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys as bytes, a row for each vector; all tables' keys have as many bytes as the bits need."""
    return keys.astype("<i8").view(np.uint8).reshape(*keys.shape, 8)[:, :, : -(-bits // 8)].reshape(len(keys), -1)


def _stack(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # keeps squares from overflowing
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class _Links:
    """Pairs of rows that are links, gathered from many buckets, as numbers and a forest."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, signs: np.ndarray):
        self.ids, self.n, self.signs = ids, n, signs  # of rows; signs are rows x tables x bytes
        self.pairs: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.held = 0

    def add(self, x: np.ndarray, y: np.ndarray, table: int) -> None:
        self.pairs.append((x, y, table))
        self.held += len(x)

    def _new(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share no earlier table's bucket."""
        x, y = (np.concatenate([p[k] for p in self.pairs]) for k in (0, 1))
        table = np.repeat([p[2] for p in self.pairs], [len(p[0]) for p in self.pairs])
        new, earlier = np.empty(len(x), bool), np.arange(self.signs.shape[1])[None, :]
        for at in range(0, len(x), 8192):
            own = slice(at, at + 8192)
            same = (self.signs[x[own]] == self.signs[y[own]]).all(axis=2)
            new[own] = ~(same & (earlier < table[own, None])).any(axis=1)
        return x[new], y[new]

    def flush(self) -> pa.RecordBatch | None:
        """a, links and null: each linked row's number of new links; a, 0 and b: edges that connect them."""
        if not self.held:
            return None
        x, y = self._new()
        self.pairs, self.held = [], 0
        if not len(x):
            return None
        ids, at = np.unique(self.ids[np.concatenate([x, y])], return_inverse=True)
        a, b = at[: len(x)], at[len(x) :]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, self.n[y])
        np.add.at(links, b, self.n[x])
        labels = np.arange(len(ids))
        while True:
            before = labels.copy()
            np.minimum.at(labels, a, labels[b])
            np.minimum.at(labels, b, labels[a])
            labels = labels[labels]
            if (labels == before).all():
                break
        out = np.flatnonzero(labels != np.arange(len(ids)))
        columns = ([*ids.tolist(), *ids[labels[out]].tolist()], [*links.tolist(), *[0] * len(out)], [*[None] * len(ids), *ids[out].tolist()])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "links", "b"])


def near_duplicate_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    miss: float = 1e-5, block: int = BLOCK, seed: int = 23,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is at least
    ``threshold``. n_links counts the other rows linked directly; component_id
    is the least id reachable, the row's own included; kept tells whether it is
    the row's own. A vector that is null, empty, zero or holds a null, NaN or
    infinite component links with nothing, and vectors of different lengths
    never link. Rows of equal id and vector are links of each other; rows with
    a null id link with nothing and keep a null component_id. Other columns are
    ignored; an empty table gives an empty result.
    """
    packed = np.dtype("<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = stash(rows.withColumn("ok", usable("v") & F.col("id").isNotNull()), "vectors")
    # A class is all rows of one vector: n of them, the least id, and the first row.
    copies = rows.where("ok").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("row").alias("class"))
    classes = stash(copies, "classes")
    bits, tables = table_plan(classes.count(), threshold, miss)
    width = -(-bits // 8)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = part.column("v").value_lengths().to_numpy()
                for size in np.unique(sizes):
                    own = part.take(pa.array(np.flatnonzero(sizes == size)))
                    raw = _stack(own.column("v"))
                    keys = _keys(_unit(raw), bits, tables, seed)
                    # A bucket is a key and, in its last ten bits, a table.
                    buckets = keys << 10 | np.arange(tables)
                    yield pa.RecordBatch.from_arrays(
                        [
                            own.column("class"), own.column("n"), pa.array([size] * len(raw), pa.int32()),
                            pa.array([x.tobytes() for x in raw.astype(packed)], pa.binary()),
                            pa.array([x.tobytes() for x in _as_bytes(keys, bits)], pa.binary()), pa.array(list(buckets), pa.list_(pa.int64())),
                        ],
                        ["class", "n", "size", "u", "signs", "buckets"],
                    )

    signed = stash(classes.mapInArrow(sign, "class long, n long, size int, u binary, signs binary, buckets array<long>"), "signed")
    placed = signed.select("class", "size", F.explode("buckets").alias("bucket"))
    counts = placed.groupBy("size", "bucket").count().where("count > 1")
    counts = stash(counts.withColumn("blocks", F.expr(f"cast((count + {block - 1}) div {block} as int)")).drop("count"), "counts")
    # Each class goes to the buckets that it shares; in a split bucket, to every pair of blocks that its own is in.
    own_block = F.expr("cast(pmod(xxhash64(class), blocks) as int)")
    dealt = (
        placed.join(counts, ["size", "bucket"])
        .withColumn("mine", own_block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("class", "bucket", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
        .join(signed.select("class", "n", "size", "u", "signs"), "class")
    )
    cell = ["size", "bucket", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, groups in by_cell(batches, cell):
            ids, n, mine, bucket, low, high, size = (rows.column(c).to_numpy() for c in ("class", "n", "mine", "bucket", "low", "high", "size"))
            signs = np.frombuffer(b"".join(rows.column("signs").to_pylist()), np.uint8).reshape(len(ids), tables, width)
            links, unit, begins = _Links(ids, n, signs), None, 0
            for a, b in groups:
                if unit is None or unit.shape[1] != size[a]:  # rows come sorted by size
                    begins, ends = np.searchsorted(size, [size[a], size[a] + 1])
                    raw = np.frombuffer(b"".join(rows.column("u").slice(begins, ends - begins).to_pylist()), packed)
                    unit = _unit(raw.astype(np.float64).reshape(-1, size[a]))
                if b - a < 2:
                    continue
                own = unit[a - begins : b - begins]
                if low[a] == high[a]:
                    x, y = np.nonzero(np.triu(own @ own.T >= threshold, 1))
                else:
                    left, right = np.flatnonzero(mine[a:b] == low[a]), np.flatnonzero(mine[a:b] != low[a])
                    x, y = np.nonzero(own[left] @ own[right].T >= threshold)
                    x, y = left[x], right[y]
                if len(x):
                    links.add(x + a, y + a, int(bucket[a] & 1023))
                    if links.held > 100_000 and (found := links.flush()) is not None:
                        yield found
            if (found := links.flush()) is not None:
                yield found

    sorted_ = dealt.select("class", "n", "u", "signs", "mine", *cell).repartition(*cell).sortWithinPartitions(*cell)
    found = stash(sorted_.mapInArrow(compare, "a long, links long, b long"), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    own = classes.select("class", "least", "n", "v").join(links, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
    own = own.withColumn("component", F.coalesce("component", "class"))
    # Classes were joined by their first rows; the component's id is the least of its classes'.
    own = stash(own, "own")
    least = stash(own.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    own = own.join(least, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # A row's vector finds its class; rows that take no part keep their own id.
    ties = rows.where("ok").select("row", "id", "v").join(own, "v").select("row", "id", "n_links", "component_id")
    rest = rows.where("not ok").select("row", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = ties.unionByName(rest)
    return out.select(F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
