"""Operators on vectors, URLs and graphs: awkward rows, and results against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchwork.llm import components, hyperplane, multiindex, prefix, scratch, urls

VECTORS = "vec_id long, embedding array<float>, label int"
AWKWARD = [
    (0, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [], 0),
    (6, [1.0, None, 0.0], 0), (7, [float("nan"), 1.0, 0.0], 0), (8, [float("inf"), 1.0, 0.0], 0), (None, [1.0, 0.0, 0.0], None),
    (9, [0.0, 1.0, 0.0], None), (9, [0.0, 1.0, 0.0], None), (10, [1.0, 0.0], 0), (11, [-1.0, 0.0, 0.0], 0),
]


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(int(k), [float(x) for x in v], 0) for k, v in zip(ids if ids is not None else range(len(vectors)), vectors)], VECTORS)


def clusters(seed, groups=12, each=30, dims=24, noise=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    out = [c / np.linalg.norm(c) + noise * rng.normal(size=dims) for c in centres for _ in range(each)] + list(rng.normal(size=(150, dims)))
    return np.float32(out)[rng.permutation(len(out))]


def brute_links(x, threshold=0.95):
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while True:
        new = np.array([min(least[k], *least[near[k]]) if near[k].any() else least[k] for k in range(len(x))])
        if (new == least).all():
            return near.sum(axis=1), least
        least = new


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicate_vectors_equal_brute_force(spark, block):
    x = clusters(1, noise=0.045)
    x = np.concatenate([x, x[:20], 3 * x[20:30]])
    links, least = brute_links(x)
    assert links.sum() > 500
    got = {r.vec_id: r for r in hyperplane.near_duplicate_vectors(frame(spark, x), block=block).collect()}
    assert [got[k].n_links for k in range(len(x))] == links.tolist()
    assert [got[k].component_id for k in range(len(x))] == least.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_duplicates_of_awkward_vectors(spark):
    got = sorted((tuple(r) for r in hyperplane.near_duplicate_vectors(spark.createDataFrame(AWKWARD, VECTORS)).collect()), key=repr)
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 10, 11)]
    want = [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (9, 1, 9, True), (9, 1, 9, True), (None, 0, None, True), *alone]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("operator", [hyperplane.near_duplicate_vectors, multiindex.search])
def test_no_vectors_and_other_columns(spark, operator):
    assert operator(spark.createDataFrame([], VECTORS)).collect() == []
    assert multiindex.search(spark.createDataFrame(AWKWARD[3:9], VECTORS)).collect() == []
    df = frame(spark, clusters(3, 3, 10))
    more = df.withColumns({c: F.lit("x") for c in ("row", "id", "v", "u", "n", "code", "size", "shard", "block", "score", "rank", "component")})
    plain, other = (sorted(map(tuple, operator(d).collect())) for d in (df, more))
    assert plain == other and plain


@pytest.mark.parametrize("shard_rows", [65_536, 100])
def test_search_recall_and_exact_scores(spark, shard_rows):
    x = np.concatenate([clusters(4), clusters(4) * 2.5])
    got: dict = {}
    for r in multiindex.search(frame(spark, x), shard_rows=shard_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    full, hits, queries = x.astype(np.float64), 0, range(0, len(x), 20)
    assert set(got) == set(queries)
    for q in queries:
        scores = full @ full[q]
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, 21)) and q not in {v for _, v, _ in own}
        assert all(s == pytest.approx(scores[v], abs=1e-12) for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        scores[q] = -np.inf
        hits += len({v for _, v, _ in own} & set(np.lexsort((np.arange(len(x)), -scores))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(queries)


def test_search_of_few_and_repeated_rows(spark):
    got = sorted(map(tuple, multiindex.search(spark.createDataFrame(AWKWARD, VECTORS), every=9).collect()))
    # Query 0 and the two rows of id 9; the other length, and rows that hold nothing to compare, are no candidates.
    assert [(q, v) for q, _, v, _ in got if q == 0] == [(0, 2), (0, 1), (0, 9), (0, 9), (0, 11)]
    assert [(v, s) for q, k, v, s in got if q == 9 and k == 1] == [(9, 1.0), (9, 1.0)]


def test_each_length_has_its_own_search(spark):
    rows = [(k, [float(k % 7 + 1), float(k), 1.0], 0) for k in range(40)] + [(100 + k, [float(k), 2.0], 0) for k in range(7)]
    got = sorted(map(tuple, multiindex.search(spark.createDataFrame(rows, VECTORS), k=3).collect()))
    vectors = {k: np.float64(v) for k, v, _ in rows}
    for q in (0, 20, 100):
        same = [k for k in vectors if k != q and len(vectors[k]) == len(vectors[q])]
        want = sorted(((-float(vectors[k] @ vectors[q]), k) for k in same))[:3]
        assert [(-s, v) for own, _, v, s in got if own == q] == want
    assert {q for q, *_ in got} == {0, 20, 100}


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, size=(3000, 16), dtype=np.uint8)
    codes[1000:2000] = codes[:1000]
    flips = rng.integers(0, 128, size=(1000, 12))
    for k, own in enumerate(flips):
        for bit in own:
            codes[1000 + k, bit // 8] ^= 1 << (bit % 8)
    index = multiindex.Index(codes)
    for radius in (0, 5, 13, 17, 40, 62):
        want = multiindex._distance(codes[:50], codes) <= radius
        assert (index.retrieve(codes[:50], radius) == want).all()


# --- graphs and running totals ---


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(rng.choice([60, 120, 300]))] + [(k, k + 1) for k in range(300, 340)]
    edges += [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)] + edges[:5]
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(len(least)):
        new = dict(least)
        for a, b in edges:
            if a is not None and b is not None and a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == least:
            break
        least = new
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(5), rng.randrange(100)) for k in range(500)]
    df = scratch.stash(spark.createDataFrame(rows, "k long, g long, n long").repartition(7), "t")
    got = {r.k: r.before for r in prefix.running_total(df, [F.col("g"), F.col("k")], "n", "before").collect()}
    total, want = 0, {}
    for k, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k] = total
        total += n
    assert got == want
    scratch.discard(df)


class Session:
    """What scratch_root asks of a session."""

    def __init__(self, **conf):
        self.conf, self.sparkContext = conf, self

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return None


def test_scratch_is_in_the_shared_folder():
    assert scratch.scratch_root(Session(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"
    with pytest.raises(ValueError):
        scratch.scratch_root(Session(**{"spark.master": "yarn"}))
    assert scratch.scratch_root(Session(**{"spark.master": "local[2]"})).startswith("file:///")


def test_a_scope_deletes_what_was_made_in_it(spark):
    scope, other = scratch.Scope(), scratch.stash(spark.range(2), "other")
    with scope.recording():
        own = scratch.stash(spark.range(3), "own")
    late = scratch.stash(spark.range(4), "late")
    assert scope.is_read_by(own.where("id > 1")) and not scope.is_read_by(other) and not scope.is_read_by(spark.range(1))
    scope.end()
    assert other.count() == 2 and late.count() == 4
    with pytest.raises(Exception):
        own.count()
    scratch.discard(other, late)


# --- URLs ---


def test_hosts_and_keys(spark):
    cases = {
        "HTTP://User:pw@Blog.Example.COM:8080/a/b/?q#f": ("blog.example.com", ["blog.example.com", "example.com", "com", "blog.example.com/a/b"]),
        "https://x.org": ("x.org", ["x.org", "org"]), "ftp://x.org./": ("x.org", ["x.org", "org"]), "/relative": ("", ["/relative"][:0]), "": ("", []), None: (None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    for r in df.select("u", urls.host(F.col("u")).alias("h"), urls.keys(F.col("u")).alias("k")).collect():
        assert (r.h, r.k) == cases[r.u]


def test_captures_against_what_was_listed_then(spark):
    entries = spark.createDataFrame(
        [("Bad.com", "l", "2024-01-10", True), ("bad.com", "l", "2024-02-10", False), ("bad.com", "l", "2024-03-10", True), ("x.org/p", "m", "2024-01-01", None), ("C.org/Path/A", "m", "2024-01-01", True),
         ("bad.com", "m", "2024-01-20", True), (None, "l", "2024-01-01", True), ("bad.com", "l", None, True), ("tie.net", "l", "2024-01-01", True), ("tie.net", "l", "2024-01-01", False)],
        "key string, list string, at string, listed boolean",
    ).withColumn("at", F.to_timestamp("at"))
    captures = spark.createDataFrame(
        [(1, "http://a.bad.com/", "2024-01-09"), (2, "http://a.bad.com/", "2024-01-10"), (3, "http://bad.com/", "2024-01-25"), (4, "http://bad.com/", "2024-02-10"),
         (5, "https://x.org/p/", "2024-06-01"), (6, "https://x.org/q", "2024-06-01"), (7, None, "2024-06-01"), (8, "http://bad.com", None), (None, "http://bad.com/", "2024-04-01"),
         (9, "http://tie.net", "2024-05-05"), (10, "http://c.ORG/Path/A", "2024-05-05"), (11, "http://c.org/path/a", "2024-05-05"), (5, "https://x.org/p/", "2024-06-01")],
        "page_id long, url string, at string",
    ).withColumn("at", F.to_timestamp("at"))
    got = urls.filter_urls(captures, entries, id_col="page_id", url_col="url", time_col="at")
    assert sorted(((r.page_id, r.n_lists, r.blocked) for r in got.collect()), key=repr) == sorted(
        [(1, 0, False), (2, 1, True), (3, 2, True), (4, 1, True), (5, 1, True), (5, 1, True), (6, 0, False), (7, 0, False), (8, 0, False), (9, 0, False), (10, 1, True), (11, 0, False), (None, 2, True)], key=repr
    )
    more = lambda d, *names: d.withColumns({c: F.lit("x") for c in names})
    other = urls.filter_urls(more(captures, "row", "key", "keys", "host", "fetched", "since", "list"), more(entries, "since", "until", "was", "row"), id_col="page_id", url_col="url", time_col="at")
    assert sorted(map(repr, other.collect())) == sorted(map(repr, got.collect()))
    assert urls.filter_urls(captures.limit(0), entries, id_col="page_id", url_col="url", time_col="at").collect() == []
    assert urls.filter_urls(captures, entries.limit(0), id_col="page_id", url_col="url", time_col="at").where("blocked").count() == 0
