"""Language identification of mixed-language text.

A word's script narrows the languages it may belong to; hashed character
trigrams score it under each of those; a Viterbi path with a penalty for each
switch labels the words, so that runs of one language become spans.

Learned from labelled rows: trigram counts per language in ``FEATURES`` hashed
cells, and which languages write in which script. Only rows up to
``train_docs`` (chosen by hash within each language when there are more; see
``shares``) are learned from; the model holds languages x cells numbers
whatever the size of the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.llm.workers import shared

FEATURES = 1 << 15
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_GROUP = 256
_CAPACITY = 300_000
#: Texts are labelled together as long as their words x languages are no more; a longer text by itself.
_TOGETHER = 1 << 20
#: What rounding may add to sums that decide for many texts at once; closer cases are decided text by text.
_SLACK = 1e-3
#: A script counts as one a language writes in from this share of its letters.
_SCRIPT_SHARE = 0.01
#: Hashes by which rows are sampled are below this.
_HASHES = 1 << 40
# The first word of the Unicode names of letters, by script.
_SCRIPTS = (
    "LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU",
    "THAI", "GEORGIAN", "ETHIOPIC", "HANGUL", "HIRAGANA", "KATAKANA", "CJK",
)


def _words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # The pattern's letters include numerals such as fractions and powers.
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def script(letter: str) -> str:
    """The script of a letter; OTHER if it isn't one of the known ones."""
    if letter < "ɐ":
        return "LATIN"
    name = unicodedata.name(letter, "OTHER").split()[0]
    return name if name in _SCRIPTS else "OTHER"


def cells(word: str) -> list[int]:
    """The hashed cells of a lower-cased word's trigrams, its ends marked."""
    padded = f"^{word}$"
    return [_cell(padded[k : k + 3]) for k in range(len(padded) - 2)]


def _cell(trigram: str) -> int:
    return zlib.crc32(trigram.encode("utf-8", "surrogatepass")) % FEATURES


@dataclass
class Model:
    """Log-probabilities of cells by language, and the scripts of each language."""

    langs: list[str]
    logp: np.ndarray  # languages x FEATURES
    scripts: list[set[str]]
    penalty: float
    _ids: dict[str, int] = field(default_factory=dict)
    _cells: dict[int, int] = field(default_factory=dict)  # by trigram, as a number
    table: np.ndarray = field(default=None)
    sizes: np.ndarray = field(default=None)

    def __post_init__(self):
        self.table, self.sizes = np.empty((0, len(self.langs))), np.empty(0, np.int64)

    def _found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``cells`` gives for each word, one after another, and where each word's begin."""
        letters = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
        inside = np.ones(len(letters), bool)
        inside[ends - 1] = inside[ends - 2] = False
        at = np.flatnonzero(inside)
        keys, place = np.unique(letters[at] << 42 | letters[at + 1] << 21 | letters[at + 2], return_inverse=True)
        got = list(map(self._cells.get, keys.tolist()))
        for k in [k for k, c in enumerate(got) if c is None]:
            key = int(keys[k])
            trigram = "".join(chr(key >> bits & 0x1FFFFF) for bits in (42, 21, 0))
            got[k] = self._cells[key] = _cell(trigram)
        starts = np.concatenate([[0], ends[:-1]]) - 2 * np.arange(len(words))
        return np.array(got, np.int64)[place], starts

    def _score(self, words: list[str]) -> np.ndarray:
        """words x languages: summed log-probabilities of each word's trigrams below its best language's; far below where the script rules a language out."""
        at, starts = self._found(words)
        sums = np.add.reduceat(self.logp[:, at], starts, axis=1).T
        written = [script(w[0]) for w in words]
        allowed = {name: np.array([name in s for s in self.scripts]) for name in set(written)}
        for name, may in allowed.items():
            if may.any() and not may.all():
                rows = np.array([w == name for w in written])
                sums[np.ix_(rows, ~may)] -= 1e3
        return sums - sums.max(axis=1, keepdims=True)

    def index(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` for the words, which are scored if they are new."""
        fresh = list(set(words).difference(self._ids))
        if fresh:
            n = len(self._ids)
            if n + len(fresh) > len(self.table):
                more = 2 * len(fresh) + 4096
                self.table = np.concatenate([self.table[:n], np.empty((n + more, len(self.langs)))])
                self.sizes = np.concatenate([self.sizes[:n], np.empty(n + more, np.int64)])
            self.table[n : n + len(fresh)] = self._score(fresh)
            self.sizes[n : n + len(fresh)] = list(map(len, fresh))
            self._ids.update(zip(fresh, range(n, n + len(fresh))))
        return np.fromiter(map(self._ids.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        if len(self._ids) > _CAPACITY:
            self._ids = {}
            self.__post_init__()
        if len(self._cells) > _CAPACITY:
            self._cells = {}


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language for each word when every switch costs ``penalty``.

    A path that stays in one language is the best if no stretch gains more
    than one switch costs by leaving it, which prefix sums tell; only other
    texts take the recursion over words. Ties go to the earlier language.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    gain = np.concatenate([[0.0], np.cumsum(scores.max(axis=1) - scores[:, best])])
    if k == 1 or (gain - np.minimum.accumulate(gain)).max() <= penalty:
        return np.full(n, best)
    rest = np.delete(scores, best, axis=1) - scores[:, best : best + 1]
    sums = np.concatenate([np.zeros((1, k - 1)), np.cumsum(rest, axis=0)])
    rise = (sums - np.minimum.accumulate(sums, axis=0)).max()
    # Parts between stays in the best language pay a switch each, at least. A path of p > 1 parts that never comes there pays
    # p - 1 switches, which is at least half of one for each part; at most it gains what the best of the others gain by word.
    if rise <= penalty / 2 or (rise < penalty and rest.max(axis=1).sum() < penalty):
        return np.full(n, best)
    back = np.empty((n, k), dtype=np.int16)
    rows, at = scores.tolist(), list(scores[0])
    langs = range(k)
    back[0] = langs
    for t in range(1, n):
        top = max(langs, key=at.__getitem__)
        jump = at[top] - penalty
        come = [j if at[j] >= jump else top for j in langs]
        at = [(at[j] if come[j] == j else jump) + rows[t][j] for j in langs]
        back[t] = come
    path = np.empty(n, dtype=np.int64)
    path[-1] = max(langs, key=at.__getitem__)
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _stay(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """For texts whose words' scores follow one another: whether ``viterbi`` surely stays in the language ``best``.

    The same conditions as there, on all texts at once: before each text
    the running sums fall by more than any text's rise, so that their least
    value so far is one of the same text.
    """
    words, own = np.arange(len(scores)), np.repeat(best, counts)
    rest = scores - scores[words, own][:, None]
    gain = np.add.reduceat(rest.max(axis=1), starts)
    drop = 1 + np.add.reduceat(np.abs(rest), starts, axis=0).max()
    if drop * len(counts) > 1e9:
        return gain < penalty - _SLACK
    begins = starts + np.arange(len(starts))
    steps = np.empty((len(scores) + len(starts), scores.shape[1]))
    steps[begins] = -drop
    steps[words + np.repeat(np.arange(1, len(starts) + 1), counts)] = rest
    sums = np.cumsum(steps, axis=0)
    rise = np.maximum.reduceat((sums - np.minimum.accumulate(sums, axis=0)).max(axis=1), begins)
    rest[words, own] = -np.inf
    others = np.add.reduceat(rest.max(axis=1), starts)
    return (gain < penalty - _SLACK) | (rise < penalty / 2 - _SLACK) | ((rise < penalty - _SLACK) & (others < penalty - _SLACK))


def _places(text: str) -> list[tuple[int, int]]:
    """Where in the text the words of ``_words`` are: start and end, in code points."""
    low = text.lower()
    # Lower-casing makes some letters two characters, so positions may have to be led back.
    back = None if len(low) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()]
    out = []
    for m in _WORD.finditer(low):
        if m[0].isalpha():
            out.append(m.span())
            continue
        letters = "".join(c if c.isalpha() else " " for c in m[0])
        out += [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", letters)]
    return out if back is None else [(back[start], back[end - 1] + 1) for start, end in out]


def _ends(text: str) -> tuple[int, int]:
    """Where the text's first letter is, and behind its last one."""
    start = next(k for k, c in enumerate(text) if c.isalpha())
    return start, next(k for k in range(len(text), 0, -1) if text[k - 1].isalpha())


def _stretches(text: str, path: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, language) of the runs of one language on the path over the text's words."""
    turns = np.flatnonzero(np.diff(path)) + 1
    if not len(turns):
        return [(*_ends(text), int(path[0]))]
    places = _places(text)
    firsts = [0, *turns.tolist()]
    return [(places[a][0], places[b - 1][1], int(path[a])) for a, b in zip(firsts, [*firsts[1:], len(path)])]


def spans(model: Model, text: str | None) -> list[tuple[int, int, str]]:
    """Stretches of one language as (start, end, language), in code points from first to last letter."""
    return labelled(model, [text])[0][2]


def labelled(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Of each text, the language with most letters on the path, how sure that is, from 0 to 1, and the spans of the path.

    The score is that language's share of the letters times its mean
    probability, against the other languages, over the words that it holds.
    """
    found = [_words(t) if t and model.langs else [] for t in texts]
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    together: list[int] = []
    held = 0
    for k, words in enumerate(found):
        if not words:
            continue
        if together and (held + len(words)) * len(model.langs) > _TOGETHER:
            _label(model, texts, found, together, out)
            together, held = [], 0
        together.append(k)
        held += len(words)
    if together:
        _label(model, texts, found, together, out)
    return out


def _label(model: Model, texts: list[str | None], found: list[list[str]], own: list[int], out: list) -> None:
    """Set out for the texts whose numbers are in ``own``, each of which has words."""
    every = model.index([w for k in own for w in found[k]])
    counts = np.array([len(found[k]) for k in own])
    starts = np.cumsum(counts) - counts
    scores = model.table[every]
    totals = np.add.reduceat(scores, starts, axis=0)
    best = totals.argmax(axis=1)
    odds = np.exp(np.clip((totals - totals[np.arange(len(own)), best][:, None]) / np.sqrt(counts)[:, None], -60, 60))
    sure = (1 / odds.sum(axis=1)).tolist()
    for n, stays in enumerate(_stay(scores, starts, counts, best, model.penalty).tolist()):
        k, at = own[n], slice(starts[n], starts[n] + counts[n])
        if stays:
            lang = model.langs[best[n]]
            out[k] = lang, sure[n], [(*_ends(texts[k]), lang)]
        else:
            out[k] = _mixed(model, texts[k], scores[at], model.sizes[every[at]])


def _mixed(model: Model, text: str, scores: np.ndarray, letters: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
    """What ``labelled`` gives for a text whose words' scores and letters these are."""
    path = viterbi(scores, model.penalty)
    by = np.bincount(path, weights=letters, minlength=len(model.langs))
    lang = int(by.argmax())
    held = path == lang
    total = scores[held].sum(axis=0)
    odds = np.exp(np.clip((total - total[lang]) / math.sqrt(held.sum()), -60, 60))
    parts = [(start, end, model.langs[k]) for start, end, k in _stretches(text, path)]
    return model.langs[lang], float(by[lang] / by.sum() / odds.sum()), parts


def labels(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text; see ``labelled``."""
    return [(lang, score) for lang, score, _ in labelled(model, texts)]


def shares(counts: dict[str, int], train_docs: int, least: int) -> dict[str, float]:
    """Of languages with more rows than the sample takes of one, the share that it takes; of all others it takes every row.

    All languages have the same limit, which is as high as ``train_docs`` rows
    in all allow, but not below ``least``.
    """
    left, limit = train_docs, math.inf
    for k, n in enumerate(sorted(counts.values())):
        limit = left / (len(counts) - k)
        if n > limit:
            break
        left -= n
        limit = math.inf
    limit = max(limit, least)
    return {lang: limit / n for lang, n in counts.items() if n > limit}


def train(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
    train_docs: int = 20_000, penalty: float = 12.0, least: int = 20, most_langs: int = 256,
) -> Model:
    """A model of the rows with text and language; with more than ``train_docs`` of them, about that many by hash of their texts and numbers.

    They are chosen by language: rare languages keep all their rows, the
    others about as many as each other and ``least`` or more, so that the
    sample has at most about ``train_docs`` rows and ``least`` a language.
    Rows without text or language teach nothing. Without any usable row the
    model knows no language and labels everything ``und``. More than
    ``most_langs`` languages, which would make the model too large to send to
    all workers, are an error.
    """
    rows = docs.select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        # With the row's number, so that copies of a text aren't all learned from.
        F.pmod(F.xxhash64(text_col, F.monotonically_increasing_id()), F.lit(_HASHES)).alias("h"),
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"labels name more than {most_langs} languages; map them to fewer, or raise most_langs")
    if taken := shares(counts, train_docs, least):
        limits = F.create_map(*(F.lit(x) for lang, share in taken.items() for x in (lang, int(share * _HASHES))))
        rows = rows.where(F.col("h") < F.coalesce(limits[F.col("lang")], F.lit(_HASHES)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        known: dict[str, list[int]] = {}
        parts = (batch.slice(at, _GROUP) for batch in batches for at in range(0, batch.num_rows, _GROUP))
        for part in parts:
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                if lang not in counts:
                    counts[lang] = np.zeros(FEATURES + len(_SCRIPTS) + 1, np.int64)
                at: list[int] = []
                for word in set(_words(text)):  # once a document, so that no repetitive one outweighs the rest
                    if (c := known.get(word)) is None:
                        name = script(word[0])
                        c = known[word] = [*cells(word), FEATURES + (_SCRIPTS.index(name) if name in _SCRIPTS else len(_SCRIPTS))]
                    at += c
                counts[lang] += np.bincount(at, minlength=len(counts[lang])) if at else 0
                if len(known) > _CAPACITY:
                    known.clear()
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())],
                ["lang", "cell", "n"],
            )

    # At most ``most_langs`` x cells rows reach the driver.
    found = rows.select("text", "lang").mapInArrow(gather, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(langs), FEATURES + len(_SCRIPTS) + 1))
    table[[langs.index(x) for x in found["lang"]], found["cell"].astype(int)] = found["n"]
    grams, written = table[:, :FEATURES] + 0.1, table[:, FEATURES:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)) if langs else grams
    names = [*_SCRIPTS, "OTHER"]
    scripts = [{names[k] for k in np.flatnonzero(w >= _SCRIPT_SHARE * max(w.sum(), 1))} for w in written]
    return Model(langs, logp, scripts, penalty)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """One row per input row: id, the columns ``keep`` (but those called as the next three), lang_pred, score and spans.

    Spans are the stretches of one language, from first to last letter, as
    start, end (exclusive, both in code points) and lang, in order; a text of
    one language has one. ``und`` with score 0 and no spans where the text is
    null or has no letter. Null and repeated ids are kept; other columns are
    ignored; an empty table gives an empty result; texts of any length are
    read whole.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), ("language", uuid.uuid4().hex)
    kept = [c for c in dict.fromkeys([id_col, *keep]) if c not in ("lang_pred", "score", "spans")]
    stretch = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared(key, lambda: replace(sent.value, _ids={}, _cells={}))
        for batch in batches:
            for at in range(0, batch.num_rows, _GROUP):
                part = batch.slice(at, _GROUP)
                got = labelled(own, part.column("_text_").to_pylist())
                own.forget()
                langs, scores, found = zip(*got)
                found = [[dict(zip(("start", "end", "lang"), x)) for x in parts] for parts in found]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(found, pa.list_(stretch))],
                    [*kept, "lang_pred", "score", "spans"],
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    made = "lang_pred string, score double, spans array<struct<start: bigint, end: bigint, lang: string>>"
    return docs.select(*kept, F.col(text_col).alias("_text_")).mapInArrow(run, f"{kinds}, {made}")
