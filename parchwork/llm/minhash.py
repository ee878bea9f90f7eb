"""Near-duplicates by one-permutation MinHash, confirmed on full shingle sets.

A text's words are cut at ASCII white space after A-Z are lower-cased; its set
holds the distinct runs of five words (all words, if there are fewer). One
hash of each shingle gives the whole signature: the hash's leading bits are a
bin, the least hash in a bin its value, and empty bins copy a bin that a fixed
random order assigns (optimal densification). Bins are banded into buckets.

1. Texts with equal sets are one class, represented by its least id.
2. In every bucket each class is joined to one centre, a star: a bucket of n
   classes gives n - 1 candidate edges. The sets of all classes on an edge are
   made once; edges are confirmed on them, those of a centre in cells of
   bounded size, each of which holds the centre once.
3. Confirmed edges give components. A bucket whose classes, but for its
   centre, lie in several of them may hold links that no star has shown. Its
   commonest component needs no comparison within itself; all other classes
   are dealt into blocks, and pairs of blocks are compared, each in a cell of
   bounded size, leaving out what is connected already.

With ``rows`` bins in each of ``bands`` bands a pair of similarity s shares a
bucket with probability 1 - (1 - s**rows)**bands: over 0.99999 at s = 0.75.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchwork.llm.cells import by_cell as _by_cell
from parchwork.llm.components import components
from parchwork.llm.scratch import stash
from parchwork.llm.workers import shared

WIDTH = 5
BANDS, ROWS = 32, 4
#: A block holds about so many classes and shingles (4 MB); a cell holds two.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 500_000
_CAPACITY = 500_000
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of shingle hashes, remembering the hashes of words."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        got = list(map(self.words.get, words))
        if None in got:
            if len(self.words) > _CAPACITY:
                self.words = {}
            for w in set(words):
                if w not in self.words:
                    self.words[w] = xxhash.xxh3_64_intdigest(w)
            got = list(map(self.words.__getitem__, words))
        h = np.array(got, np.uint64)
        width = min(WIDTH, len(h))
        out = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            out = out * _M + h[k : len(h) - width + 1 + k]
        return np.unique(_mix(out + np.uint64(width)))


class Signer:
    """Shingle sets to bucket keys."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 3):
        bins = bands * rows
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bins = bands, rows, bins
        width = (1 << 64) // bins
        self.starts = np.array([k * width for k in range(bins)], np.uint64)
        self.order = np.array([rng.permutation(bins) for _ in range(bins)])  # where an empty bin looks, by bin
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _M)

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of a set that isn't empty."""
        at = np.searchsorted(shingles, self.starts)
        full = at < np.append(at[1:], len(shingles))  # sorted hashes: a bin's least is the first from its start
        value = shingles[np.minimum(at, len(shingles) - 1)]
        if not full.all():
            empty = np.flatnonzero(~full)
            donor = self.order[empty]
            value[empty] = value[donor[np.arange(len(empty)), full[donor].argmax(axis=1)]]
        key = self.salt.copy()
        for part in value.reshape(self.bands, self.rows).T:
            key = _mix(key * _M + part)
        return key.view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the set), set (a 128-bit hash of it, null if empty) and buckets of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = shared(("shingles",), Shingler), Signer()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingler.shingles(part.column("text")[k].as_py()) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(map(len, sets), pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signer.buckets(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "n", "set", "buckets"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, set binary, buckets array<long>")


def similar(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Whether sets of sizes a and b with so many common members have similarity 0.75 or more."""
    return 100 * common >= 75 * (a + b - common)


def linked(sets: list[np.ndarray], known: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of indices of sets that are links, enough to connect what all links connect; exact.

    Sets of one number in ``known`` are connected already; with ``side`` only
    sets of different sides are compared. Two sets of similarity 0.75 share a
    member among the rarest quarter of each, so only sets that do are compared,
    and none that are connected yet.
    """
    count = len(sets)
    labels = np.arange(count) if known is None else np.unique(known, return_inverse=True)[1]
    sizes = np.fromiter(map(len, sets), np.int64, count)
    members = np.concatenate(sets)
    owner = np.repeat(np.arange(count), sizes)
    _, member, often = np.unique(members, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    often = np.sort(often)
    ranked = rank[member]
    order = np.lexsort((ranked, owner))
    ranked = ranked[order]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(ranked)) - np.repeat(begin[:-1], sizes)
    ahead = (place < np.repeat(sizes - (3 * sizes + 3) // 4 + 1, sizes)) & (often[ranked] > 1)
    posted, poster = ranked[ahead], owner[ahead]
    by = np.argsort(posted, kind="stable")
    posted, poster = posted[by], poster[by]
    own_from = np.searchsorted(owner[ahead], np.arange(count + 1))
    own = ranked[ahead]
    mark = np.zeros(len(often), bool)
    out: list[tuple[int, int]] = []
    for x in range(count):
        keys = own[own_from[x] : own_from[x + 1]]
        if not len(keys):
            continue
        low, high = np.searchsorted(posted, keys), np.searchsorted(posted, keys, "right")
        found = np.unique(np.concatenate([poster[a:b] for a, b in zip(low, high)]))
        found = found[(found > x) & (labels[found] != labels[x])]
        if side is not None:
            found = found[side[found] != side[x]]
        found = found[(4 * sizes[found] >= 3 * sizes[x]) & (3 * sizes[found] <= 4 * sizes[x])]
        if not len(found):
            continue
        mine = ranked[begin[x] : begin[x + 1]]
        mark[mine] = True
        starts = np.concatenate([[0], np.cumsum(sizes[found])[:-1]])
        spread = np.repeat(begin[found] - starts, sizes[found]) + np.arange(sizes[found].sum())
        common = np.add.reduceat(mark[ranked[spread]].astype(np.int64), starts)
        mark[mine] = False
        near = found[similar(common, sizes[found], sizes[x])]
        if len(near):
            joined = np.unique(labels[near], return_index=True)[1]  # one link to each component
            out += [(x, int(y)) for y in near[joined]]
            labels[np.isin(labels, labels[near])] = labels[x]
    return out


def _members(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, set, shingles (sorted hashes, binary) of the classes in ids (id, set), from the documents (id, text) so called.

    An id may stand for other texts as well, whose sets are others; of copies
    each task gives one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = shared(("shingles",), Shingler), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), ([], [], [])
                for id_, digest, text in zip(part.column("id").to_pylist(), part.column("set").to_pylist(), part.column("text")):
                    if (id_, digest) not in seen:
                        own = shingler.shingles(text.as_py()).tobytes()
                        if xxhash.xxh3_128_digest(own) == digest:
                            seen.add((id_, digest))
                            for column, value in zip(out, (id_, digest, own)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["id", "set", "shingles"])

    return ids.join(docs, "id").select("id", "set", "text").mapInArrow(run, "id long, set binary, shingles binary")


def _stars(rows: DataFrame) -> DataFrame:
    """bucket, centre, id for the rows (bucket, id) of buckets with more than one class; the centre is the least id."""
    centres = rows.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("all")).where("all > 1")
    # Read from a table, the centres are exchanged anew for the join, so that a bucket with very many rows can be split.
    centres = stash(centres.select("bucket", "centre"), "centres")
    return rows.join(centres, "bucket").where("id != centre").select("bucket", "centre", "id")


def _blocks(classes: Column, shingles: Column, block_classes: int, block_shingles: int) -> Column:
    """How many blocks so many classes and shingles take."""
    return F.greatest(F.lit(1), F.ceil(classes / block_classes), F.ceil(shingles / block_shingles)).cast("int")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id", "set"), blocks).cast("int")


def _compared(cells: DataFrame, keys: list[str], run: Callable) -> DataFrame:
    """a, b of the links that run(rows of a cell) gives, for cells of rows (keys, id, set, shingles, label, side)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _by_cell(batches, keys):
            found = []
            for begin, end in groups:
                if end - begin > 1:
                    own = table.slice(begin, end - begin)
                    ids, label, side = (own.column(c).to_numpy() for c in ("id", "label", "side"))
                    once = list({(id_, digest, s): k for k, (id_, digest, s) in enumerate(zip(ids.tolist(), own.column("set").to_pylist(), side.tolist()))}.values())
                    sets = [np.frombuffer(own.column("shingles")[k].as_py(), np.uint64) for k in once]
                    found += [(ids[once[x]], ids[once[y]]) for x, y in run(sets, label[once], side[once])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    sorted_ = cells.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(each, "a long, b long").where("a != b")


def _with_centre(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of side 0, the centre's, and of side 1."""
    out = []
    for x in np.flatnonzero(side == 0):
        out += [
            (x, y) for y in np.flatnonzero(side == 1)
            if 4 * min(len(sets[x]), len(sets[y])) >= 3 * max(len(sets[x]), len(sets[y]))
            and similar(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]), len(sets[y]))
        ]
    return out


def _between_blocks(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what isn't yet; between the two blocks of a cell, or within its only one."""
    return linked(sets, label, side if side.any() else None)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Rows link when their sets' intersection is at least 0.75 of their union;
    component_id is the least id reachable, the row's own included; kept tells
    whether it is the row's own. A text without words (null, empty, white
    space) has an empty set and links with nothing. Rows of equal id are
    one document if their sets are equal; if not, each is compared and the id's
    component is that of all of them. Rows with a null id link with nothing:
    component_id is null, kept true. Other columns are ignored; an empty table
    gives an empty result; texts of any length are compared whole.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    sets = stash(signed(docs, id_col, text_col), "sets")
    named = sets.where("set is not null and id is not null")
    classes = stash(
        named.groupBy("set").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("buckets").alias("buckets")), "classes"
    )
    rows = classes.select(F.explode("buckets").alias("bucket"), "id", "set", "n")
    stars = stash(_stars(rows.select("bucket", "id")), "stars")
    edges = stash(stars.select("centre", "id").distinct(), "edges")
    on_edge = edges.select("centre").union(edges.select("id")).distinct().withColumnRenamed("centre", "id")
    members = stash(_members(classes.select("id", "set").join(on_edge, "id", "left_semi"), texts), "members")
    blocks = lambda classes_, shingles: _blocks(classes_, shingles, block_classes, block_shingles)

    # Each edge once, those of a centre in cells that hold the centre too.
    sizes = classes.groupBy("id").agg(F.sum("n").alias("n"))
    parts = edges.join(sizes, "id").groupBy("centre").agg(F.count("*").alias("many"), F.sum("n").alias("all"))
    parts = stash(parts.select("centre", blocks(F.col("many"), F.col("all")).alias("parts")), "parts")
    label = F.col("id").alias("label")
    ends = edges.join(parts, "centre").join(members, "id").select("centre", _dealt(F.col("parts")).alias("part"), "id", "set", "shingles", label, F.lit(1).alias("side"))
    heads = parts.select(F.col("centre").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(members, "id")
    heads = heads.select(F.col("id").alias("centre"), "part", "id", "set", "shingles", label, F.lit(0).alias("side"))
    links = [stash(_compared(ends.unionByName(heads), ["centre", "part"], _with_centre), "links")]

    # What stars can't tell: classes of a bucket, its centre aside, in several components.
    joined = stash(components(links[0]), "joined").select(F.col("node").alias("id"), "component")
    labelled = stars.select("bucket", "id").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_component = labelled.join(sizes, "id").groupBy("bucket", "component").agg(F.count("*").alias("many"), F.sum("n").alias("all"))
    open_ = by_component.groupBy("bucket").agg(
        F.count("*").alias("components"), F.sum("many").alias("many"), F.sum("all").alias("all"),
        F.max(F.struct("many", "component", "all")).alias("top"),
    ).where("components > 1")
    one = blocks(F.col("many"), F.col("all"))
    # Small buckets are one block; in others the commonest component's classes are blocks behind those of the rest.
    minor, major = blocks(F.col("many") - F.col("top.many"), F.col("all") - F.col("top.all")), blocks(F.col("top.many"), F.col("top.all"))
    open_ = stash(open_.select("bucket", F.col("top.component").alias("top"), F.when(one == 1, 1).otherwise(minor).alias("minor"), F.when(one == 1, 0).otherwise(major).alias("major")), "open")
    common = (F.col("component") == F.col("top")) & (F.col("major") > 0)
    own = F.when(common, F.col("minor") + _dealt(F.greatest(F.col("major"), F.lit(1)))).otherwise(_dealt(F.col("minor")))
    in_open = labelled.join(open_, "bucket").join(classes.select("id", "set"), "id").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.when(common, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1))
    in_open = in_open.withColumn("other", other).select("bucket", "id", "set", F.col("component").alias("label"), "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    cells = in_open.join(members, ["id", "set"]).select("bucket", "low", "high", "id", "set", "shingles", "label", (F.col("own") != F.col("low")).cast("int").alias("side"))
    links.append(stash(_compared(cells, ["bucket", "low", "high"], _between_blocks), "links"))

    # Ids that stand for several sets tie the classes of those sets together.
    several = named.groupBy("id").agg(F.min("set").alias("x"), F.max("set").alias("y")).where("x != y").select("id")
    ties = named.join(several, "id").select("id", "set").join(classes.select("set", F.col("id").alias("least")), "set")
    ties = ties.select(F.col("least").alias("a"), F.col("id").alias("b"))
    reached = stash(components(_every([*links, ties])), "reached")

    least = classes.select("set", F.col("id").alias("least"))
    least = least.join(reached.select(F.col("node").alias("least"), "component"), "least", "left")
    least = stash(least.select("set", F.coalesce("component", "least").alias("component")), "least")
    out = sets.select("id", "n", "set").join(least, "set", "left")
    of = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    kept = F.coalesce(of == F.col("id"), F.lit(True))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), of.alias("component_id"), kept.alias("kept"))


def _every(links: list[DataFrame]) -> DataFrame:
    out = links[0].select("a", "b")
    for more in links[1:]:
        out = out.unionByName(more.select("a", "b"))
    return out
