"""The queries without SQL, over whole tables, against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from parchwork.llm import catalogue, langid
from tests.llm.test_documents import brute_components, library, plain_spans, plain_targets
from tests.llm.test_vectors_and_urls import brute_links


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    found = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    return [k for k, _ in found], np.float32([v for _, v in found])


def results(spark, sf_dir, query):
    return query(spark, sf_dir).collect()


def test_packing(spark, sf_dir, documents):
    tok = library(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: np.array(tok.encode(r.text, add_special_tokens=False).ids + [2], "<u4") for k, r in documents.items()}
    held, places = {}, {}
    for r in results(spark, sf_dir, catalogue.op1_packing):
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        held.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, own in held.items():
        assert sum(n for _, n in own) == len(ids[k]) and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:]))
    assert set(held) == set(ids)
    assert all(o == sum(n for _, n in sorted(own)[:k]) for own in places.values() for k, (o, _) in enumerate(sorted(own)))
    sizes = sorted(sum(n for _, n in own) for own in places.values())
    assert sizes[-1] == 4096 and all(n == 4096 for n in sizes[1:])


def test_near_duplicates(spark, sf_dir, documents):
    keys = sorted(documents)
    sets, least = brute_components([documents[k].text for k in keys])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in results(spark, sf_dir, catalogue.op2_near_duplicates)}
    assert got == {k: (len(s), keys[a], keys[a] == k) for k, s, a in zip(keys, sets, least)}


def test_secret_scan(spark, sf_dir, documents):
    got = results(spark, sf_dir, catalogue.op3_secret_scan)
    assert len(got) == len(documents)
    for r in got:
        want = plain_spans(documents[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",") if r.spans else [])


def test_mixing(spark, sf_dir, documents):
    got, sizes, taken = results(spark, sf_dir, catalogue.op4_mixing), {}, {}
    for k, r in documents.items():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    want = plain_targets(sizes)
    for r in got:
        source = documents[r.doc_id].source
        assert r.size == len(documents[r.doc_id].text.encode().split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    assert len(got) == len(documents) and all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, results(spark, sf_dir, catalogue.op4_mixing)))


def test_nearest_vectors(spark, sf_dir, vectors):
    keys, x = vectors
    full, hits, got = x.astype(np.float64), 0, {}
    for r in results(spark, sf_dir, catalogue.op6_nearest_vectors):
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    place = {k: n for n, k in enumerate(keys)}
    assert set(got) == {k for k in keys if k % 20 == 0}
    for q, own in got.items():
        scores = full @ full[place[q]]
        assert sorted(own) == list(range(1, 21)) and all(s == pytest.approx(scores[place[v]], abs=1e-12) for v, s in own.values())
        scores[place[q]] = -np.inf
        hits += len({v for v, _ in own.values()} & {keys[n] for n in np.lexsort((keys, -scores))[:20]})
    assert hits >= 0.9 * 20 * len(got)


def test_token_counts(spark, sf_dir, documents):
    tok = library(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(tok.encode(r.text, add_special_tokens=False).ids) for k, r in documents.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in results(spark, sf_dir, catalogue.op8_token_counts)}
    assert got == {k: (len(documents[k].text.encode()), n, n > 512) for k, n in want.items()}


def test_near_duplicate_vectors(spark, sf_dir, vectors):
    keys, x = vectors
    links, least = brute_links(x)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in results(spark, sf_dir, catalogue.op9_near_duplicate_vectors)}
    assert got == {k: (n, keys[a], keys[a] == k) for k, n, a in zip(keys, links.tolist(), least.tolist())}


def test_language_id(spark, sf_dir, documents):
    got = results(spark, sf_dir, catalogue.op10_language_id)
    assert len(got) == len(documents)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_language_id(spark, sf_dir, documents):
    """Spans give the best path of the plain recursion over every text, and the labels follow from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")
    model = langid.train(learned)
    got = results(spark, sf_dir, catalogue.op10_language_id)
    assert len(got) == len(documents)
    for r in got:
        text = documents[r.doc_id].text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        places, words = langid._places(text or ""), langid._words(text or "")
        if not words:
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, "")
            continue
        spans = [(int(a), int(b), c) for a, b, c in (x.split(":") for x in r.spans.split(","))]
        path = [next(model.langs.index(c) for a, b, c in spans if a <= start and end <= b) for start, end in places]
        at = model.index(words)
        scores = model.table[at]
        best = scores[0].copy()
        for row in scores[1:]:
            best = np.maximum(best, best.max() - model.penalty) + row
        value = sum(scores[k, j] for k, j in enumerate(path)) - model.penalty * (np.diff(path) != 0).sum()
        assert value == pytest.approx(best.max(), abs=1e-6)
        letters = np.bincount(path, weights=list(map(len, words)), minlength=len(model.langs))
        assert letters[model.langs.index(r.lang_pred)] == letters.max() and 0 <= r.score <= 1
        model.forget()
