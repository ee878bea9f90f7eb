"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, in an order shuffled by hash, form a stream of
words that is cut into equal blocks. Golden-ratio points on [0, 1), mapped
through the sources' cumulative shares, say whose block comes next; a slot's
rank among its source's slots says which block of the (repeated) stream it is.
What each document contributes is what its blocks were used for.

Ranks and stream positions are running totals over range-sorted tables, so no
source, however large, meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.llm.prefix import running_total
from parchwork.llm.scratch import stash

GOLDEN = 0.6180339887498949
#: The unit interval in so many cells for the join of points to shares.
_CELLS = 4096
_WORDS = r"[^\x20\x09-\x0D]++"


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source, rank, source_size, target for a table with source and size.

    Sources by code point, null last, get the weights, which are above 0, in
    turn; targets share ``share`` of all words by weight, none above ``most``
    times its source's.
    """
    totals = stash(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = running_total(totals.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "rank", "source_size", weight.cast("long").alias("weight"), (most * F.col("source_size")).alias("limit"))
    ranked = stash(ranked, "ranked")
    size, weighed = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share * (size or 0)
    # Targets are min(limit, level * weight). A source is full once the level is limit / weight; by then those that fill
    # earlier hold their limits and all others that level times their weights.
    rise = F.col("limit") / F.col("weight")
    order = [rise, F.col("rank")]
    filling = running_total(running_total(ranked, order, "limit", "held"), order, "weight", "lighter")
    full = F.col("held") + rise * (F.lit(weighed) - F.col("lighter")) <= F.lit(wanted)
    held, free = filling.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
    level = (wanted - (held or 0)) / free if free else math.inf
    return ranked.select("source", "rank", "source_size", F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """slot, source rank and n: the n-th block of the source's repeated stream comes at this slot.

    A source gets as many slots as its ``need``. The points give it so many but
    for a few; slots beyond its need are left out and missing ones come last.
    """
    spark = sources.sparkSession
    slots = sources.agg(F.sum("need")).first()[0] or 0
    shares = running_total(sources.select("rank", "need"), [F.col("rank")], "need", "from")
    shares = stash(shares.where("need > 0"), "shares")
    low, high = F.col("from") / F.lit(float(slots or 1)), (F.col("from") + F.col("need")) / F.lit(float(slots or 1))
    cell = lambda x: F.least(F.floor(x * _CELLS), F.lit(_CELLS - 1)).cast("long")
    cells = shares.select("rank", "need", low.alias("low"), high.alias("high"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"))
    point = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("x")).withColumn("cell", cell(F.col("x")))
    drawn = points.join(cells, "cell").where("x >= low and x < high").select("slot", "rank", "need", F.lit(1).cast("long").alias("one"))
    ranked = running_total(stash(drawn, "drawn"), [F.col("rank"), F.col("slot")], "one", "place")
    counts = ranked.groupBy("rank").agg(F.min("place").alias("first"), F.count("*").alias("drawn"))
    counts = stash(shares.select("rank", "need").join(counts, "rank", "left"), "counts")
    used = ranked.join(counts.select("rank", "first"), "rank").select("slot", "rank", (F.col("place") - F.col("first")).alias("n"), "need").where("n < need")
    had = F.coalesce(F.col("drawn"), F.lit(0))
    late = counts.where(had < F.col("need")).select(
        F.lit(slots).cast("long").alias("slot"), "rank", F.explode(F.sequence(had, F.col("need") - 1)).alias("n"), "need"
    )
    return used.unionByName(late).select("slot", "rank", "n")


def _placed(
    docs: DataFrame, id_col: str, text_col: str, source_col: str,
    weights: tuple[int, ...], share: float, most: int, block: int, seed: int, keep: tuple[str, ...],
) -> DataFrame:
    """For each row and each block that it lies in (one row without a block where it has no words): the ``parts`` of it that the slots of that block take.

    A part says its slot, which use of the source's stream that is, where in
    the block the part begins, and its words in the document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = stash(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            *(F.col(c).alias(f"keep_{c}") for c in keep), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("size"),
        ),
        "sizes",
    )
    goals = targets(sizes, weights, share, most)
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    quota = F.least(F.round("target"), most * F.col("source_size")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0)
    goals = stash(
        goals.withColumn("quota", quota).withColumn("blocks", blocks).withColumn("full", epochs)
        .withColumn("rest", F.col("quota") - F.col("full") * F.col("source_size"))
        .withColumn("need", F.col("full") * F.col("blocks") + F.expr(f"(rest + {block - 1}) div {block}")),
        "goals",
    )

    order = [F.col("source").asc_nulls_last(), F.xxhash64(F.lit(seed), "id"), F.col("id"), F.col("size"), F.col("row")]
    placed = running_total(sizes, order, "size", "place")
    offsets = running_total(goals.select("rank", "source_size"), [F.col("rank")], "source_size", "begin")
    goals = stash(goals.join(offsets.select("rank", "begin"), "rank"), "offsets")
    # The largest n-th use of a block that is cut short is the last one of a source with a rest.
    slots = schedule(goals, block)
    uses = slots.join(goals.select("rank", "blocks", "full", "rest"), "rank").select(
        "rank", (F.col("n") % F.col("blocks")).alias("block"), "slot", "n",
        F.when(F.col("n") < F.col("full") * F.col("blocks"), block)
        .otherwise(F.least(F.lit(block), F.col("rest") - (F.col("n") - F.col("full") * F.col("blocks")) * block)).alias("cut"),
    )
    # The uses of a block and where each is cut: at most ``most`` entries.
    uses = uses.groupBy("rank", "block").agg(F.collect_list(F.struct("slot", "n", "cut")).alias("uses"))

    known = placed.join(goals.select("source", "rank", "source_size", "target", "begin"), placed["source"].eqNullSafe(goals["source"]))
    known = known.select("row", "id", *(f"keep_{c}" for c in keep), "size", "source_size", "target", "rank", (F.col("place") - F.col("begin")).alias("at"))
    whole = F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")))
    pieces = known.select("*", F.explode_outer(whole).alias("block"))
    first = F.col("block") * block - F.col("at")  # the document's word where the block begins
    low, high = F.greatest(-first, F.lit(0)), F.least(F.col("size") - first, F.lit(block))
    part = lambda use: F.struct(
        use.slot.alias("slot"), use.n.alias("n"), low.alias("offset"), (first + low).alias("start"), (F.least(high, use.cut) - low).alias("length")
    )
    taken = pieces.join(uses, ["rank", "block"], "left")
    return taken.withColumn("parts", F.filter(F.transform("uses", part), lambda p: p.length > 0)).drop("uses")


def mixture(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 1024, seed: int = 11, keep: tuple[str, ...] = (),
) -> DataFrame:
    """The mix itself: one row for each stretch of a document in a scheduled block.

    id, the columns ``keep``, slot, n (which block of its source's repeated
    stream the slot takes), offset (the stretch's place in the block), start
    and length (its words in the document), and rank (its source's place among
    the sources). Sorted by slot, rank, n and offset, the stretches follow one
    another as the mix has them: every prefix holds the sources in about their
    shares. Rows of which nothing is taken, such as
    those without words, have none; the rest is as for ``mix``.
    """
    placed = _placed(docs, id_col, text_col, source_col, weights, share, most, block, seed, keep)
    parts = placed.select("id", *(f"keep_{c}" for c in keep), "rank", F.explode("parts").alias("part"))
    return parts.select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), "rank", "part.*")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 1024, seed: int = 11, keep: tuple[str, ...] = (),
) -> DataFrame:
    """What a mix takes of each document: the lengths of its stretches in ``mixture``, summed.

    One row per input row: id, the columns ``keep``, size (words), source_size,
    target (of its source), taken (words, repeats counted) and first_slot (the
    earliest slot of the schedule that takes some of it; null if none). A
    source's taken words sum to its target, rounded; no document gives more
    than ``most`` times its size. Reruns on the same rows agree.

    A null text has no words and gives none; a null source is a source of its
    own, the last; null and repeated ids are rows of their own (ties in the
    shuffled order go by id, then size); other columns are ignored; an empty
    table gives an empty result. A long document spans as many blocks as it
    needs.
    """
    placed = _placed(docs, id_col, text_col, source_col, weights, share, most, block, seed, keep)
    part = F.aggregate("parts", F.lit(0).cast("long"), lambda total, p: total + p.length)
    placed = placed.withColumn("part", F.coalesce(part, F.lit(0))).withColumn("slot", F.array_min(F.transform("parts", lambda p: p.slot)))
    kept = ["id", *(f"keep_{c}" for c in keep), "size", "source_size", "target"]
    rows = placed.groupBy("row").agg(*(F.first(c).alias(c) for c in kept), F.sum("part").alias("taken"), F.min("slot").alias("first_slot"))
    return rows.select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), "size", "source_size", "target", "taken", "first_slot")
