"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes. Inner products become angles by one more component (rows: what their
norm lacks to the largest; queries: zero). Vectors are projected on their
principal directions and rotated so that signs lose least (iterative
quantisation), learned on ``sample`` rows; signs are the bits.

Index. Rows are dealt into shards, each once; in a shard, the code's 16-bit
substrings have a table each, from substring to rows sorted by it. Two codes
within Hamming radius r have a substring in which they differ by at most
r // tables bits (one less in all but the first r % tables + 1 tables), so
probing all buckets that near, in every table, retrieves every code within r:
nothing is lost to the index. Where the buckets to probe hold most rows anyway,
the shard's codes are compared directly, which retrieves the same. Only
queries are copied: each goes to every shard, and streams past its index.

What it retrieves is cut to the radius and reranked by the inner product of
the original vectors in double precision. The radius is the distance within
which ``recall`` of the true neighbours of ``trials`` queries lie, found by
comparing those queries with all rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from parchwork.llm.hyperplane import _stack, usable
from parchwork.llm.scratch import stash

WORD = 16
_PROBED = 128  # queries probed together


class Coder:
    """Vectors to packed binary codes."""

    def __init__(self, sample: np.ndarray, largest: float, bits: int, seed: int, turns: int = 30):
        self.largest, self.bits = largest, bits
        rows = self.raised(sample)
        _, directions = np.linalg.eigh(rows.T @ rows)
        directions = directions[:, ::-1]
        rng, parts, made = np.random.default_rng(seed), [], 0
        while made < bits:
            top = directions[:, : min(directions.shape[1], bits - made)]
            seen = rows @ top
            turn, _ = np.linalg.qr(rng.normal(size=(top.shape[1], top.shape[1])))
            for _ in range(turns):
                u, _, w = np.linalg.svd(np.where(seen @ turn > 0, 1.0, -1.0).T @ seen)
                turn = (u @ w).T
            parts.append(top @ turn)
            made += top.shape[1]
        self.planes = np.concatenate(parts, axis=1)

    def raised(self, rows: np.ndarray) -> np.ndarray:
        """Rows as unit vectors with one more component."""
        scaled = rows / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1, keepdims=True)))
        return np.concatenate([scaled, rest], axis=1)

    def codes(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """Packed codes, a row of bytes each; a query's own added component is zero."""
        raised = np.concatenate([rows / self.largest, np.zeros((len(rows), 1))], axis=1) if query else self.raised(rows)
        return np.packbits(raised @ self.planes > 0, axis=1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all pairs of packed codes."""
    out = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(a.view("<u8").T, b.view("<u8").T):
        out += np.bitwise_count(x[:, None] ^ y[None, :])
    return out


class Index:
    """Tables from each 16-bit substring of the codes to rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for words in codes.view("<u2").T:
            order = np.argsort(words, kind="stable")
            held, sizes = np.unique(words[order], return_counts=True)
            self.tables.append((order, held, np.concatenate([[0], np.cumsum(sizes)])))

    def probed(self, radius: int) -> list[np.ndarray] | None:
        """The differences to probe in each table; None if they are so many that most rows would be met."""
        count, out = len(self.tables), []
        for k in range(count):
            near = radius // count - (k > radius % count)
            if near > 2:
                return None
            out.append(_DIFFERENCES[: 0 if near < 0 else _WITHIN[near]])
        met = sum(len(d) for d in out) / (1 << WORD)
        return out if met < 0.5 else None

    def retrieve(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """queries x rows: whether the row's code is within the radius."""
        probes = self.probed(radius)
        if probes is None:
            return _distance(queries, self.codes) <= radius
        found = np.zeros((len(queries), len(self.codes)), bool)
        for words, (order, held, begin), differ in zip(queries.view("<u2").T, self.tables, probes):
            if not len(differ):
                continue
            sought = words[:, None] ^ differ[None, :]
            at = np.minimum(np.searchsorted(held, sought), len(held) - 1)
            query, probe = np.nonzero(held[at] == sought)
            at = at[query, probe]
            size = begin[at + 1] - begin[at]
            ends = np.cumsum(size)
            rows = order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[at] - (ends - size), size)]
            found[np.repeat(query, size), rows] = True
        query, row = np.nonzero(found)
        apart = np.zeros(len(query), np.int16)
        for x, y in zip(queries.view("<u8").T, self.codes.view("<u8").T):
            apart += np.bitwise_count(x[query] ^ y[row])
        far = apart > radius
        found[query[far], row[far]] = False
        return found


#: All differences of two substrings, those of fewest bits first, and how many have up to 0, 1 and 2 bits.
_DIFFERENCES = np.arange(1 << WORD, dtype=np.uint32)
_DIFFERENCES = _DIFFERENCES[np.argsort(np.bitwise_count(_DIFFERENCES), kind="stable")].astype(np.uint16)
_WITHIN = (1, 1 + WORD, 1 + WORD + WORD * (WORD - 1) // 2)
#: Hashes by which rows are sampled are below this.
_HASHES = 1 << 48


def _matrix(column: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    """A column of equally long binary values, a row for each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


class _Shard:
    """The index of a shard's rows and their vectors."""

    def __init__(self, parts: list[pa.RecordBatch], kind: np.dtype):
        table = pa.Table.from_batches(parts)
        ids = table.column("id").to_numpy()
        by = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by], table.column("row").to_numpy()[by]
        self.raw = _matrix(table.column("u"), kind)[by]
        self.index = Index(_matrix(table.column("code"), np.uint8)[by])

    def nearest(self, own: np.ndarray, raw: np.ndarray, codes: np.ndarray, radius: int, k: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query its number, the places of its k nearest retrieved rows, and their inner products."""
        found, reach = self.index.retrieve(codes, radius), radius
        while reach < bits and (short := np.flatnonzero(found.sum(axis=1) <= k)).size:
            reach += bits // WORD  # one more bit in every table
            found[short] = self.index.retrieve(codes[short], reach)
        for q, near in enumerate(found):
            at = np.flatnonzero(near)
            at = at[self.rows[at] != own[q]]
            exact = (self.raw[at].astype(np.float64) * raw[q]).sum(axis=1)
            if len(at) > 4 * k:  # what ties with the k-th stays
                top = exact >= np.partition(exact, -k)[-k]
                at, exact = at[top], exact[top]
            best = np.argsort(-exact, kind="stable")[:k]
            yield q, at[best], exact[best]


def search(
    vectors: DataFrame, *, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    bits: int = 128, recall: float = 0.97, sample: int = 4096, trials: int = 64, shard_rows: int = 65_536, seed: int = 29,
) -> DataFrame:
    """The k nearest of all other rows for each row whose id is divisible by ``every``.

    query_id, rank (from 1), vec_id, score: nearest by inner product of the
    original vectors in double precision, ties to the smaller id. In a shard
    with no more than k rows within the radius, a query's radius grows until
    there are more.

    Vectors that are null, empty, zero or hold a null, NaN or infinite
    component take no part, nor do rows with a null id. A query's candidates
    are the vectors of its own length; each length has an index of its own.
    Repeated rows are rows of their own, queries as well as candidates: only
    the query's own row is left out. Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    kind = np.dtype("<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = stash(rows.where(usable("v") & F.col("id").isNotNull()).withColumn("size", F.size("v")).withColumn("norm", F.sqrt(square)), "vectors")
    asked = (F.col("id") % every) == 0
    out = []
    facts = rows.groupBy("size").agg(F.count("*").alias("total"), F.count_if(asked).alias("asking"), F.max("norm").alias("largest"))
    for fact in facts.where("asking > 0").orderBy("size").collect():  # one row for each length
        found = _of_one_length(rows.where(F.col("size") == fact["size"]), fact, kind, every, k, bits, recall, sample, trials, shard_rows, seed)
        out.append(found)
    return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _of_one_length(rows: DataFrame, fact: Row, kind: np.dtype, every: int, k: int, bits: int, recall: float, sample: int, trials: int, shard_rows: int, seed: int) -> DataFrame:
    """``search`` among rows (row, id, v) of one length."""
    spark = rows.sparkSession

    def some(of: DataFrame, count: int, there: int) -> np.ndarray:
        """About ``count`` vectors by hash of their rows."""
        picked = of if there <= count else of.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(_HASHES)) < _HASHES * count // there)
        return np.array([r.v for r in picked.select("v").orderBy("v").limit(2 * count).collect()], np.float64).reshape(-1, fact["size"])

    coder = Coder(some(rows, sample, fact["total"]), fact["largest"], bits, seed)
    shared = spark.sparkContext.broadcast(coder)
    tried = spark.sparkContext.broadcast(some(rows.where((F.col("id") % every) == 0), trials, fact["asking"])[: 2 * trials])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw = _stack(part.column("v"))
                codes, sought = shared.value.codes(raw), shared.value.codes(raw, query=True)
                ids = part.column("id").to_numpy()
                pack = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                own = pa.array([r.tobytes() if q else None for r, q in zip(sought, ids % every == 0)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pack(raw.astype(kind)), pack(codes), own], ["row", "id", "u", "code", "sought"])

    coded = stash(rows.mapInArrow(encode, "row long, id long, u binary, code binary, sought binary"), "codes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distances of the trial queries' true neighbours among these rows."""
        best: list = [[] for _ in tried.value]
        codes = shared.value.codes(tried.value, query=True)
        for batch in batches:
            if batch.num_rows:
                scores = tried.value @ _matrix(batch.column("u"), kind).astype(np.float64).T
                apart = _distance(codes, _matrix(batch.column("code"), np.uint8).copy())
                for q, own in enumerate(scores):
                    top = np.argpartition(-own, min(k, len(own) - 1))[: k + 1]
                    best[q] = sorted(best[q] + list(zip(own[top].tolist(), apart[q, top].tolist())), reverse=True)[: k + 1]
        flat = [(q, s, a) for q, own in enumerate(best) for s, a in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.int32(), pa.float64(), pa.int32()))], ["q", "score", "apart"])

    near = Window.partitionBy("q").orderBy(F.desc("score"), "apart")
    trial = coded.select("u", "code").mapInArrow(compare, "q int, score double, apart int")
    # A trial query is its own nearest row, or about as good as it.
    seen = sorted(r.apart for r in trial.withColumn("n", F.row_number().over(near)).where(F.col("n").between(2, k + 1)).select("apart").collect())
    radius = seen[min(len(seen) - 1, int(recall * len(seen)))] if seen else bits

    # Shards of shard_rows; of fewer where that would leave cores without any.
    shards = max(-(-fact["total"] // shard_rows), min(-(-fact["total"] // 4096), 2 * spark.sparkContext.defaultParallelism))
    shard = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)).cast("int").alias("shard")
    held = coded.select("row", "id", "u", "code", F.lit(False).alias("asks"), shard)
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asks = coded.where("sought is not null").select("row", "id", "u", F.col("sought").alias("code"), F.lit(True).alias("asks"), every_shard)
    dealt = held.unionByName(asks).repartition("shard").sortWithinPartitions("shard", "asks")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's rows come first and make its index; its queries follow, however many."""
        now, rows, index = None, [], None
        for batch in batches:
            place = batch.column("shard").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for begin, end in zip(edges, edges[1:]):
                own, asking = divmod(int(place[begin]), 2)
                if own != now:
                    now, rows, index = own, [], None
                part = batch.slice(begin, end - begin)
                if not asking:
                    rows.append(part)
                    continue
                if index is None:
                    if not rows:
                        continue
                    index, rows = _Shard(rows, kind), []
                for at in range(0, part.num_rows, _PROBED):
                    some = part.slice(at, _PROBED)
                    asking_rows, ids = some.column("row").to_numpy(), some.column("id").to_numpy()
                    raw, codes = _matrix(some.column("u"), kind).astype(np.float64), _matrix(some.column("code"), np.uint8).copy()
                    columns: tuple = ([], [], [], [])
                    for q, there, exact in index.nearest(asking_rows, raw, codes, radius, k, bits):
                        for column, value in zip(columns, ([asking_rows[q]] * len(there), [ids[q]] * len(there), index.ids[there], exact)):
                            column.extend(value)
                    if columns[0]:
                        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["row", "query_id", "vec_id", "score"])

    found = dealt.mapInArrow(probe, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
