"""Operators on documents: awkward rows, and results against plain versions."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parchwork.llm import grammars, langid, licences, minhash, mixing, packing, secrets, tokencount, tokens
from tests.llm import helpers

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
FORMATS = secrets.learn(secrets.labelled_credentials())


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OPERATORS = {
    "tokens": lambda d: tokencount.token_counts(d, BYTE),
    "secrets": lambda d: secrets.find_secrets(d, FORMATS),
    "language": lambda d: langid.identify(d, langid.train(d)),
    "licences": lambda d: licences.scan(d, licences.train()),
    "mixing": lambda d: mixing.mix(d),
    "packing": lambda d: packing.digests(packing.pack(d, WORD)),
    "minhash": lambda d: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](helpers.documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_and_reruns_change_nothing(spark, name):
    docs = helpers.documents(spark)
    plain, again = by_id(OPERATORS[name](docs)), by_id(OPERATORS[name](helpers.clashing(docs)))
    assert plain == again and len(plain) >= len(helpers.DOCS)


# --- token counts ---


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_token_counts_equal_the_library(spark, path):
    texts = [r[1] for r in helpers.DOCS] + [
        "a<|endoftext|>b", "it's we'll  two  spaces\n\n\nlines \t", "naïve Ünï ªº ² ½ µ", "日本語 мир ﬁ ǅ", "x\x1cy\x85z\xa0q", "é ΣΑΣ", "🙂🙂 a", "'s 're",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = library(path)
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.doc_id: r for r in tokencount.token_counts(df, path).collect()}
    assert [got[k].n_tokens for k in range(len(texts))] == want
    assert [got[k].n_bytes for k in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert [got[k].over_limit for k in range(len(texts))] == [n > 512 for n in want]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_any_text_is_encoded_by_pre_token(path):
    """Plain texts by the cutting rule, others by the library's; whole only with an added token inside."""
    encoder, tok, rng = tokens.Encoder(path, list, 10_000), library(path), random.Random(9)
    plain = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and encoder.is_plain(c)]
    common = "It’s “fine” – a\u00a0b… naïve Ünïcode ÆØÅ ĳ Šđ мир ВОЙНА 日本語、テスト。한국어 😀 €5 ™ × don't we'll 12 3.4\n\n \t"
    texts = [" ".join("".join(rng.choices(plain, k=8)) for _ in range(5)) for _ in range(300)] + ["".join(rng.choices(common, k=60)) for _ in range(500)] + [common]
    assert len(plain) > 20_000 and all(map(encoder.is_plain, texts))
    other = ["".join(rng.choices(common + "ée\u0301ΣΑΣς½²ªºǅﬁ\x85\x1c\u2028\u3000עבריתالعربيةไทย\u0130ſK", k=50)) for _ in range(500)]
    real, asked = encoder.ids, []
    encoder.ids = lambda some: asked.extend(some) or real(some)
    for some in (texts, other):
        got = [[i for x in own for i in x] for own in encoder.values(some)]
        want = [tok.encode(t, add_special_tokens=False).ids for t in some]
        assert got == want
    assert not set(asked) & set(texts + other) and max(map(len, asked)) < 40
    assert [i for x in encoder.values(["a<|endoftext|>b"])[0] for i in x] == tok.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_the_first_tier_is_bounded(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(300) if j % (k % 7 + 1) == 0)) for k in range(60)], "doc_id long, text string")
    found = tokencount.frequent_lengths(docs, BYTE, "text", 40)
    assert 0 < len(found) <= 40 and all(len(library(BYTE).encode(p).ids) == n for p, n in found.items())
    assert tokencount.frequent_lengths(docs, BYTE, "text", 10_000).keys() > found.keys()


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = helpers.documents(spark, helpers.DOCS[:5])
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = dict((r.doc_id, r.n_tokens) for r in tokencount.token_counts(df, path).collect())
    assert got == {r[0]: len(sp.encode(r[1] or "")) for r in helpers.DOCS[:5]}


def test_a_full_cache_changes_nothing():
    few, many = tokens.Encoder(BYTE, len, 3), tokens.Encoder(BYTE, len, 10**6)
    texts = [f"word{k} other{k * 7} the the" for k in range(50)]
    assert few.values(texts) == many.values(texts) == few.values(texts) and len(few.cache) <= 3


# --- packing ---


def test_packing_round_trip(spark):
    docs = helpers.documents(spark)
    tok = library(WORD)
    pieces = packing.pack(docs, WORD, length=64).collect()
    want = sorted(tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in helpers.DOCS)
    held: dict[int, list] = {}
    for p in pieces:
        held.setdefault(p.sequence_id, []).append(p)
        assert p.length == len(p.ids) // 4 > 0 and p.start + p.length <= p.doc_tokens
    for own in held.values():
        own.sort(key=lambda p: p.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:]))
    sizes = {k: sum(p.length for p in own) for k, own in held.items()}
    assert all(n == 64 for k, n in sizes.items() if k != max(sizes)) and sizes[max(sizes)] <= 64
    # In the order of the stream, pieces are whole documents one after another.
    got, now = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.start == len(now)
        now += np.frombuffer(p.ids, "<u4").tolist()
        if len(now) == p.doc_tokens:
            got.append(tuple(now))
            now = []
    assert sorted(got) == want and not now
    digest = {(r.doc_id, r.start, r.ids_crc32) for r in packing.digests(packing.pack(docs, WORD, length=64)).collect()}
    assert digest == {(p.doc_id, p.start, zlib.crc32(p.ids)) for p in pieces}


def test_hilbert_curve_steps_to_neighbours():
    cells = np.array(np.meshgrid(*[np.arange(16)] * 3, indexing="ij")).reshape(3, -1).T
    keys = packing.hilbert(cells, 4)
    assert sorted(keys) == list(range(16**3))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# --- near-duplicates ---


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_components(texts):
    """Least index reachable by similarity of at least 0.75."""
    sets, least = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * len(sets[a] | sets[b]) and least[a] != least[b]:
                old, new = max(least[a], least[b]), min(least[a], least[b])
                least = [new if x == old else x for x in least]
    return sets, least


def near_copies(seed, count=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(count):
        if texts and rng.random() < 0.6:
            own = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.choice([1, 3, 5, 6, 8, 20, 60, 120]))))
    return texts + ["One two THREE four", "one TWO three\tfour", None, "", " "]


@pytest.mark.parametrize("bound", [5_000, 16, 2])
def test_near_duplicates_equal_brute_force(spark, bound):
    texts = near_copies(1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, least = brute_components(texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, block_classes=bound).collect()}
    assert [got[k].n_shingles for k in range(len(texts))] == list(map(len, sets))
    assert [got[k].component_id for k in range(len(texts))] == least
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_a_large_group_of_copies(spark):
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(base)] * 50 + [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df, block_classes=10).collect()} == {0}


def test_near_duplicates_of_awkward_rows(spark):
    got = by_id(minhash.near_duplicates(helpers.documents(spark)))
    assert (None, 0, None, True) in got and (2, 0, 2, True) in got and (1, 7, 0, False) in got and (7, 9, 6, False) in got
    assert got.count((9, 10, 9, True)) == 2


def test_one_id_with_several_texts_is_one_document(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")]
    got = {r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1}


def test_exact_links_within_a_group():
    texts = [t for t in near_copies(5, 300) if t and t.strip()]
    _, least = brute_components(texts)
    shingler = minhash.Shingler()
    reached = list(range(len(texts)))
    for x, y in minhash.linked([shingler.shingles(t) for t in texts]):
        old, new = max(reached[x], reached[y]), min(reached[x], reached[y])
        reached = [new if z == old else z for z in reached]
    assert reached == least


def test_strangers_that_share_buckets(spark):
    """Most of each text is common to all, so that many share a bucket and few are links."""
    rng = random.Random(4)
    shared = " ".join(f"s{k}" for k in range(60))
    texts = []
    for k in range(150):
        tail = [f"t{k % 40}_{j}" for j in range(20)]
        tail[rng.randrange(20)] = f"x{k}"
        texts.append(" ".join([shared, *tail]))
    sets, least = brute_components(texts)
    assert 3 < len(set(least)) < 148
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bound in (5_000, 7):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, block_classes=bound).collect()}
        assert [got[k] for k in range(len(texts))] == least


# --- secrets ---


def plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate([("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]):
        for m in re.finditer(pattern, text):
            if (len(m[2]) >= 6) if name == "assign" else (len(m[0]) >= (20 if name == "access" else 24)):
                out.append((m.start(), kind, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans_equal_a_plain_search(spark):
    rng = random.Random(3)
    parts = ["Token = ", "PASSWORD:", "api_key='", "secret", "AKIA" + "Q" * 16, "AKIAQ", "a1" * 12, "abc", " = ", "é", "\n", "x" * 30, "ſecret=abcdefgh", "toKen=abcdefgh", "zz9+/_"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find_secrets(df, FORMATS).collect():
        want = plain_spans(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_learned


def test_learned_formats_find_fresh_credentials():
    fresh = secrets.labelled_credentials(200, seed=99)
    assert sum(FORMATS.best(c) == k for k, c in fresh) >= 0.95 * len(fresh)
    for run in ("internationalisation_of_things", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "https//example.com/ghp_abcdefgh", "1234567890123456789012"):
        assert FORMATS.best(run) is None


def test_learned_spans_and_redaction(spark):
    key = next(c for k, c in secrets.labelled_credentials(5, seed=7) if k == "github" and FORMATS.best(c))
    df = spark.createDataFrame([(0, f"see {key} and token=abcdef123 é"), (1, None), (2, "clean text")], "doc_id long, text string")
    assert secrets.find_secrets(df, FORMATS).where("doc_id = 0").first().spans == f"github:4:{4 + len(key)},assign:{9 + len(key)}:{24 + len(key)}"
    assert helpers.rows(secrets.redact(df, FORMATS)) == [(0, "see [github] and [assign] é"), (1, None), (2, "clean text")]


def test_credentials_behind_names_and_before_punctuation():
    fresh = dict(secrets.labelled_credentials(1, seed=5))
    google = fresh["google"][:-1]  # its last character is replaced
    cases = [("GITHUB_PAT=", "github", fresh["github"], ""), ("js?key=", "google", google + "x", "&v=1"), ("cfg/", "npm", fresh["npm"], "/x"), ("a=", "gitlab", fresh["gitlab"][:-1] + "q", ""),
             ("see ", "google", google + "-", " now"), ("id.", "jwt", fresh["jwt"][:-1] + "-", "."), ("gitlabglpat", "gitlab", fresh["gitlab"][5:], ""), ("", "stripe", fresh["stripe"], "...")]
    for before, kind, credential, after in cases:
        start = len(before) - 5 * before.endswith("glpat")
        want = (start, len(before) + len(credential), kind)
        assert [(s, e, k) for s, _, e, k in secrets.scan(before + credential + after, FORMATS)[1]] == [want], before
    both = f"A={fresh['npm']}/B={fresh['github']}"
    assert secrets.redacted(both, secrets.scan(both, FORMATS)[1]) == "A=[npm]/B=[github]"
    assert secrets.scan(f"x={fresh['github']}abc", FORMATS) == ([], [])  # a longer word


def test_credentials_of_lengths_that_no_label_has():
    rng = random.Random(12)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    jwts = [f"eyJhbGci{some(alnum, a)}.eyJzdWIi{some(alnum, b)}.{some(alnum + '_-', c)}" for a, b, c in [(28, 10, 43), (28, 33, 43), (40, 171, 86), (60, 900, 342), (90, 2500, 683), (12, 24, 64)]]
    slacks = [f"{head}{some('0123456789', a)}-{some('0123456789', b)}-{some(alnum, 24)}" for head in ("xoxb-", "xoxp-") for a, b in [(10, 10), (10, 13), (11, 12), (13, 11), (13, 13)]]
    assert FORMATS.best(f"xoxb-{some('0123456789', 26)}-{some('0123456789', 30)}-{some(alnum, 24)}") == "slack"  # digits that scan leaves to hex
    for kind, credentials in (("jwt", jwts), ("slack", slacks)):
        for c in credentials:
            text = f"TOKEN_IS {c}, x=/{c}."
            assert secrets.redacted(text, secrets.scan(text, FORMATS)[1]) == f"TOKEN_IS [{kind}], x=/[{kind}]."
    # A length that is fixed in all labels stays so, and so does the order of parts.
    for run in ("ghp_" + "a1" * 17, "ghp_" + "a1" * 19, "npm_internationalisation", "eyJhbGci" + "a1" * 60, "xoxb-" + "12" * 20, "xoxb-" + "ab" * 6 + "-" + "12" * 6 + "-" + "a1" * 12):
        assert secrets.scan(run, FORMATS)[1] == secrets.base_spans(run), run


def plain_learned(text):
    """Learned spans by trying every start and end in every run."""
    base = secrets.base_spans(text)
    covered = {k for start, _, end, _ in base for k in range(start, end)}
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", text):
        run, at = m[0], 0
        for start in range(len(run)):
            begins = start == 0 or not run[start - 1].isalnum() or any(run.startswith(h, start) for f in FORMATS.formats for h in f.heads if h)
            if start < at or not begins:
                continue
            found = []
            for f in FORMATS.formats:
                ends = [e for e in range(start + 1, len(run) + 1) if e == len(run) or not run[e].isalnum()]
                scored = [(f.score(run[start:e]), e) for e in ends]
                good = [(s, e) for s, e in scored if s >= f.least]
                if good:
                    score, end = max(good, key=lambda x: x[1])
                    if end - start >= 16 and covered.isdisjoint(range(m.start() + start, m.start() + end)):
                        found.append((score, end, f.kind))
            if found:
                _, at, kind = max(found)
                out.append((m.start() + start, m.start() + at, kind))
    return out


def test_learned_spans_equal_brute_force(spark, sf_dir):
    """Over the whole table, with credentials of all formats put behind names, paths and separators in some texts."""
    rng = random.Random(21)
    fresh = secrets.labelled_credentials(6, seed=77)
    rng.shuffle(fresh)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    frames = ["GH={}", "see {}.", "k: '{}'", "https://x.io/a/{}/b", "url?key={}&x=1", "({})", "x{}", "{}--", "a/{}=b", "{0} {0}"]
    for k, (_, c) in enumerate(fresh):
        id_, text = docs[k * 3 % len(docs)]
        docs[k * 3 % len(docs)] = (id_, text[: len(text) // 2] + " " + frames[k % len(frames)].format(c) + " " + text[len(text) // 2 :])
    texts, n = dict(docs), 0
    for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string"), FORMATS).collect():
        own = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        learned = [(int(a), int(b), k) for k, a, b in own if k not in ("assign", "access", "hex") or (int(a), int(b), k) in plain_learned(texts[r.doc_id])]
        want = [x for x in plain_learned(texts[r.doc_id])]
        assert sorted(learned) == sorted(want) and r.n_learned == len(want)
        n += len(want)
    assert n > 30


def test_many_beginnings_in_a_long_run():
    assert secrets.scan("eyJhbGci" * 20_000, FORMATS) == ([], [])


def test_inferred_automaton_generalises():
    samples = ["a" + "b" * k + "c" for k in range(1, 9) for _ in range(40 >> k or 1)]
    automaton = grammars.infer(samples)
    assert len(automaton.ends) < 8
    assert automaton.score("abbbbbbbbbbbbc") > -2 > automaton.score("acb")
    assert grammars.infer([]).score("a") <= grammars.FLOOR


# --- mixing ---


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, out = {s: weights[k % 3] for k, s in enumerate(order)}, dict.fromkeys(order), {}
    wanted = share * sum(sizes.values())
    while left:
        level = (wanted - sum(out.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] >= 2 * sizes[s]]
        for s in over:
            out[s] = 2.0 * sizes[s]
            del left[s]
        if not over:
            out |= {s: level * weight[s] for s in left}
            break
    return out


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mixing_reaches_its_targets(spark, block):
    rng = random.Random(8)
    docs = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 50, 700])), rng.choices(["a", "b", "Ü", None, "e"], [9, 3, 3, 1, 1])[0]) for k in range(150)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), block=block).collect()
    sizes: dict = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want, taken = plain_targets(sizes), {}
    source_of = {k: s for k, _, s in docs}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


@pytest.mark.parametrize("share", [0.0, 0.4, 1.5, 2.0, 3.0])
def test_targets_of_many_sources_equal_the_plain_ones(spark, share):
    rng = random.Random(int(share * 10))
    sizes = {f"s{k:02}": rng.choice([0, 1, 5, 10, 40, 1000, 30_000]) for k in range(40)} | {None: 7}
    rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size long"), (5, 2, 1), share, 2).collect()}
    want = plain_targets(sizes, share=share)
    assert {s: r.source_size for s, r in got.items()} == sizes
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)


@pytest.mark.parametrize("block", [3, 64])
def test_mixture_is_what_mix_takes_in_the_order_of_the_schedule(spark, block):
    rng = random.Random(5)
    docs = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 50, 300])), rng.choices(["a", "b", None], [9, 3, 1])[0]) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    digest = {r.doc_id: r for r in mixing.mix(df, block=block).collect()}
    parts = sorted(mixing.mixture(df, block=block).collect(), key=lambda r: (r.slot, r["rank"], r.n, r.offset))
    covered: dict = {}
    ends: dict = {}
    for r in parts:
        assert r.offset == ends.get((r.slot, r["rank"], r.n), 0) and r.offset + r.length <= block  # no gaps in a block
        ends[r.slot, r["rank"], r.n] = r.offset + r.length
        covered.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    for k, r in digest.items():
        assert len(covered.get(k, [])) == r.taken and set(covered.get(k, [])) <= set(range(r.size))
        assert all(covered[k].count(w) <= 2 for w in set(covered.get(k, [])))
        assert r.first_slot == min((p.slot for p in parts if p.doc_id == k), default=None)
    # Every prefix of the mix holds the sources in about their shares.
    total = sum(r.length for r in parts)
    shares = {}
    for r in parts:
        shares[r["rank"]] = shares.get(r["rank"], 0) + r.length / total
    so_far, n = dict.fromkeys(shares, 0), 0
    for r in parts:
        so_far[r["rank"]] += r.length
        n += r.length
        assert all(abs(so_far[k] - n * shares[k]) <= 6 * block for k in shares)


def test_schedule_spreads_sources_evenly(spark):
    sources = spark.createDataFrame([(0, 50), (1, 30), (2, 20), (3, 0)], "rank long, need long")
    got = sorted((r.slot, r.rank, r.n) for r in mixing.schedule(sources, 1).collect())
    assert [sum(r == k for _, r, _ in got) for k in range(4)] == [50, 30, 20, 0]
    for k in range(3):
        assert sorted(n for _, r, n in got if r == k) == list(range([50, 30, 20][k]))
    assert all(abs(sum(r == 0 for _, r, _ in got[:m]) - m / 2) <= 3 for m in range(10, 100, 10))


# --- languages ---


def test_viterbi_shortcut_equals_the_recursion():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, k = rng.integers(1, 12), rng.integers(1, 4)
        scores, penalty = rng.normal(size=(n, k)) * rng.choice([0.3, 1, 3]), rng.choice([0.5, 1.0, 2.0])
        best = scores[0].copy()
        for t in range(1, n):
            best = np.maximum(best, best.max() - penalty) + scores[t]
        path = langid.viterbi(scores, penalty)
        value = scores[np.arange(n), path].sum() - penalty * (np.diff(path) != 0).sum()
        assert value == pytest.approx(best.max())


def test_texts_together_stay_where_each_would_by_itself():
    rng, decided = np.random.default_rng(7), 0
    for _ in range(200):
        k, penalty = rng.integers(1, 5), rng.choice([1.0, 3.0])
        texts = [rng.normal(size=(rng.integers(1, 15), k)) * rng.choice([0.3, 1, 3]) for _ in range(rng.integers(1, 9))]
        counts = np.array(list(map(len, texts)))
        best = np.array([t.sum(axis=0).argmax() for t in texts])
        stays = langid._stay(np.concatenate(texts), np.cumsum(counts) - counts, counts, best, penalty)
        for scores, lang, stay in zip(texts, best, stays):
            if stay:
                decided += 1
                assert (langid.viterbi(scores, penalty) == lang).all()
                top = scores[0].copy()
                for row in scores[1:]:
                    top = np.maximum(top, top.max() - penalty) + row
                assert scores[:, lang].sum() == pytest.approx(top.max())
    assert decided > 100


def test_labels_are_the_same_in_any_company(spark, monkeypatch):
    """Together, one by one, or with words scored by the plain trigrams."""
    model = langid.train(helpers.documents(spark), penalty=3.0)
    texts = [r[1] for r in helpers.DOCS] + ["the cat sat on the mat. " * 30 + "le chat est sur la table " * 30, "naïve 日本 мир ﬁ", "x", None, ""]
    together = langid.labelled(model, texts)
    monkeypatch.setattr(langid, "_TOGETHER", 0)
    assert langid.labelled(model, texts) == together == [x for t in texts for x in langid.labelled(model, [t])]
    words = sorted({w for t in texts if t for w in langid._words(t)})
    at, starts = model._found(words)
    assert [x.tolist() for x in np.split(at, starts[1:])] == list(map(langid.cells, words))


def test_language_of_awkward_rows_and_spans(spark):
    docs = helpers.documents(spark)
    model = langid.train(docs, penalty=3.0)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (8, "und"), (0, "en"), (6, "fr"), (9, "de"), (None, "und"), (None, "en")} == {x for x in got if x[0] not in (1, 5, 7)}
    text = "the cat sat on the mat and looked at the dog. " + "le chat est sur la table et le chien est dans la rue"
    assert [s[2] for s in langid.spans(model, text)] == ["en", "fr"] and langid.spans(model, None) == []


def test_places_are_those_of_the_words():
    for text in ["a b", "", "x²y Ⅷ ½z", "ΑΣ και 3d_e", "été\u0301s 日本 語", "1 2"]:
        places, words = langid._places(text), langid._words(text)
        assert [text[start:end].lower() for start, end in places] == words
        if words:
            assert langid._ends(text) == (places[0][0], places[-1][1])
    # Lower-casing makes two characters of this letter, the second of which is no letter.
    assert langid._words("bİstanbul İ") == ["bi", "stanbul", "i"]
    assert langid._places("bİstanbul İ") == [(0, 2), (2, 9), (10, 11)]


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(f"text {k}", f"l{k}") for k in range(6)], "text string, lang string")
    assert len(langid.train(docs, most_langs=6).langs) == 6
    with pytest.raises(ValueError, match="more than 5 languages"):
        langid.train(docs, most_langs=5)


def test_scripts_narrow_languages(spark):
    docs = spark.createDataFrame([("мир и война", "ru"), ("hello world and peace", "en"), ("ειρήνη και πόλεμος", "el")], "text string, lang string")
    model = langid.train(docs)
    assert [x for x, _ in langid.labels(model, ["вопрос", "question", "ερώτηση"])] == ["ru", "en", "el"]
    assert [x for x, _ in langid.labels(model, ["½ ² Ⅷ 3", "x²", None])] == ["und", "en", "und"]


def test_a_rare_language_keeps_its_rows(spark):
    rows_ = [(f"the word number w{k} and the other one", "en") for k in range(2_000)] + [(f"das wort und die katze nummer {k}", "de") for k in range(900)] + [(f"talo ja metsä kissa {k}", "fi") for k in range(4)]
    model = langid.train(spark.createDataFrame(rows_, "text string, lang string"), train_docs=100)
    assert model.langs == ["de", "en", "fi"]
    assert [x for x, _ in langid.labels(model, ["kissa ja talo", "the other word", "die katze"])] == ["fi", "en", "de"]


def test_samples_by_language_are_bounded():
    assert langid.shares({"en": 60, "de": 40}, 100, 20) == langid.shares({}, 100, 20) == {}
    assert langid.shares({"en": 10**7, "de": 500, "fi": 7}, 1007, 20) == {"en": 500 / 10**7}
    counts = {"en": 5_000_000, "de": 90_000, "fi": 200}
    taken = {k: n * langid.shares(counts, 20_000, 20).get(k, 1) for k, n in counts.items()}
    assert taken == pytest.approx({"en": 9_900, "de": 9_900, "fi": 200})
    assert langid.shares({str(k): 1000 for k in range(50)}, 100, 20) == {str(k): 0.02 for k in range(50)}


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from parchwork.llm import catalogue

    got = catalogue.op10_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0


# --- licences ---


def test_licences_of_known_notices(spark):
    texts = ["Released under the MIT License.\nsome text", "All rights reserved.", "a b c\n\nLicensed under CC BY-NC 4.0.", "the license of the driver", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_paragraphs, r.n_confirmed, r.families) for r in licences.scan(df, licences.train()).collect()}
    assert got == {0: (2, 1, "mit"), 1: (1, 1, "reserved"), 2: (2, 1, "cc"), 3: (1, 0, ""), 4: (0, 0, ""), 5: (0, 0, "")}


#: Notices and other sentences that no training text holds.
UNSEEN = [
    ("gpl", "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version."),
    ("bsd", " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"),
    ("apache", "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("public-domain", "This is free and unencumbered software released\ninto the public domain."),
]
NOT_NOTICES = [
    "MIT researchers released a copy of their report.", "The public was free to use the gardens.", "The general gave permission to leave.", "Sources of the software industry said so.",
    "The Apache server was down on Monday.", "They reserved the rights to the film.", "A new version of the law was published.", "The warranty of the car had ended.",
]


def test_licences_of_unseen_wrapped_notices(spark):
    texts = [f"first words here\n\n{text}\n\nlast words" for _, text in UNSEEN] + NOT_NOTICES
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(df, licences.train()).collect()}
    assert [got[k].families.split(",") == [f] for k, (f, _) in enumerate(UNSEEN)] == [True] * len(UNSEEN)
    assert [got[len(UNSEEN) + k].n_confirmed for k in range(len(NOT_NOTICES))] == [0] * len(NOT_NOTICES)


def test_licence_scan_runs_no_python(spark, sf_dir):
    plan = licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), licences.train())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and os.path.exists(sf_dir)
