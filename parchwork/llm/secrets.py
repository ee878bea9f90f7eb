"""Secrets in whole texts: fixed patterns, and formats learned from labelled credentials.

Every labelled format gets a probabilistic automaton (see ``grammars``). In
any run of credential characters, candidates begin at the run's start, behind
punctuation and wherever a format's leading characters occur, and end at
punctuation or with the run. A candidate that no fixed pattern has found is
scored under all formats; it is added as a span of the likeliest one if its
likelihood is as high as that of nearly all held-out credentials of the format.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.llm.grammars import FLOOR, Automaton, infer
from parchwork.llm.workers import shared

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KINDS = ("assign", "access", "hex")
#: The fewest characters of a credential of a learned format.
_SHORTEST = 16
#: Runs that may hold credentials of learned formats.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % _SHORTEST)
#: What a text must hold for any of the four to find something.
_ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_.=-]{16}"
_GROUP = 256
#: A leading place of a format is fixed while its credentials have no more different characters there.
_FIXED = 6


#: The symbol of a character as it is usual in its part.
_USUAL = "x"


def _class(c: str) -> str:
    return c if not c.isalnum() else "9" if c.isdigit() else "A" if c.isupper() else "a"


@dataclass(frozen=True)
class Reader:
    """How an automaton reads runs: ``literal`` leading characters as they are, the others by part.

    ``marks`` part a credential; other characters are read as usual where their class occurs in labelled
    credentials' same part (``usual``), else as their class. How long parts are is thereby left to the automaton.
    """

    literal: int
    marks: frozenset[str]
    usual: tuple[frozenset[str], ...]

    def symbols(self, run: str, start: int = 0) -> Iterator[tuple[str, int]]:
        """Symbols of a run from ``start`` on, each with the number of its part."""
        part = 0
        for k in range(start, len(run)):
            c = run[k]
            if k < start + self.literal:
                yield c, -1
            elif c in self.marks:
                part += 1
                yield c, part
            else:
                own = _class(c)
                yield _USUAL if part < len(self.usual) and own in self.usual[part] else own, part

    def whole(self, run: str) -> list[str]:
        return [s for s, _ in self.symbols(run)]


def reader(credentials: list[str]) -> Reader:
    """Marks are the punctuation that all credentials hold equally often behind the leading places."""
    literal = leading(credentials)
    rest = [c[literal:] for c in credentials]
    seen = {c for r in rest for c in r if not c.isalnum()}
    marks = frozenset(c for c in seen if len({r.count(c) for r in rest}) == 1)
    usual: list[set[str]] = []
    for r in rest:
        for k, part in enumerate(re.split(f"[{re.escape(''.join(sorted(marks)))}]", r) if marks else [r]):
            if k == len(usual):
                usual.append(set())
            usual[k].update(map(_class, part))
    return Reader(literal, marks, tuple(map(frozenset, usual)))


def leading(credentials: list[str]) -> int:
    """How many leading places a format fixes."""
    k = 0
    while k < min(map(len, credentials)) and len({c[k] for c in credentials}) <= _FIXED:
        k += 1
    return k


def labelled_credentials(each: int = 400, seed: int = 17) -> list[tuple[str, str]]:
    """(format, credential) pairs drawn from publicly documented formats.

    Parts without a fixed length, those of a jwt and the numbers of a slack token, vary so
    much that the automata learn no limit of them.
    """
    rng = random.Random(seed)
    alnum, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    web64 = lambda text: base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    make = {
        "access": lambda: "AKIA" + some(upper, 16),
        "github": lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + some(alnum, 36),
        "gitlab": lambda: "glpat-" + some(alnum + "_-", 20),
        "google": lambda: "AIza" + some(alnum + "_-", 35),
        "jwt": lambda: "eyJhbGci" + some(alnum + "_-", rng.randrange(8, 80)) + "." + web64(f'{{"sub":"{some(alnum + "?>~", rng.randrange(1, 120))}"}}') + "." + some(alnum + "_-", rng.randrange(32, 128)),
        "npm": lambda: "npm_" + some(alnum, 36),
        "slack": lambda: rng.choice(["xoxb-", "xoxp-"]) + some(string.digits, rng.randrange(1, 24)) + "-" + some(string.digits, rng.randrange(1, 24)) + "-" + some(alnum, 24),
        "stripe": lambda: rng.choice(["sk_live_", "rk_live_"]) + some(alnum, 24),
    }
    return [(kind, f()) for kind, f in make.items() for _ in range(each)]


@dataclass(frozen=True)
class Format:
    """One format: how runs are read, how they begin, their automaton, and the least accepted likelihood."""

    kind: str
    reader: Reader
    heads: tuple[str, ...]
    automaton: Automaton
    least: float = -math.inf

    def score(self, run: str) -> float:
        """Mean log-probability of a run's symbols and its end."""
        return self.automaton.score(self.reader.whole(run))

    def longest(self, run: str, start: int, dead: set) -> tuple[float, int] | None:
        """(score, end) of the longest credential of this format that begins at ``start`` and ends with the run or at punctuation.

        ``dead`` are the places, with state and part, from which earlier calls for the run reached no
        end; walks that come there stop, so that many beginnings in a long run cost no square of it.
        """
        at, total, found, ended, passed = 0, 0.0, None, False, []
        for n, (s, part) in enumerate(self.reader.symbols(run, start), start + 1):
            step = self.automaton.steps[at].get(s)
            if step is None or (n, step[0], part) in dead:
                break
            at, p = step
            total += p
            if part >= 0:
                passed.append((n, at, part))
            if self.automaton.ends[at] > FLOOR and (n == len(run) or not run[n].isalnum()):
                ended = True
                if (score := (total + self.automaton.ends[at]) / (n - start + 1)) >= self.least:
                    found = score, n
        if not ended:
            dead.update(passed)
        return found


@dataclass(frozen=True)
class Formats:
    """All learned formats, and where in a run a credential may begin."""

    formats: tuple[Format, ...]
    begin: re.Pattern

    def best(self, run: str) -> str | None:
        """The likeliest format of those that accept the run."""
        found = [(s, f.kind) for f in self.formats if (s := f.score(run)) >= f.least]
        return max(found)[1] if found else None

    def within(self, run: str, free: Callable[[int, int], bool]) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the credentials in a run that are ``free``, from left to right and apart from each other."""
        out, at = [], 0
        dead: list[set] = [set() for _ in self.formats]
        for m in self.begin.finditer(run):
            start = m.start()
            if start < at or len(run) - start < _SHORTEST or not free(start, start + 1):
                continue
            longest = [(x, f.kind) for f, d in zip(self.formats, dead) if (x := f.longest(run, start, d))]
            found = [(score, end, kind) for (score, end), kind in longest if end - start >= _SHORTEST and free(start, end)]
            if found:
                _, at, kind = max(found)
                out.append((start, at, kind))
        return out


def learn(credentials: list[tuple[str, str]], *, alpha: float = 0.05, hold_out: int = 4, accept: float = 0.98) -> Formats:
    """Automata of the labelled formats; every ``hold_out``-th credential of a format calibrates the likelihood that ``accept`` of them reach."""
    out = []
    for kind in sorted({k for k, _ in credentials}):
        own = [c for k, c in credentials if k == kind]
        taught = [c for k, c in enumerate(own) if k % hold_out]
        how = reader(taught)
        heads = tuple(sorted({c[: how.literal] for c in own}))
        form = Format(kind, how, heads, infer([how.whole(c) for c in taught], alpha))
        scores = sorted(map(form.score, own[::hold_out]))
        out.append(replace(form, least=scores[int((1 - accept) * len(scores))] - 0.3))
    heads = "|".join(re.escape(h) for f in out for h in f.heads if h)
    return Formats(tuple(out), re.compile("^|(?<=[^A-Za-z0-9])" + (f"|(?={heads})" if heads else "")))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, index of kind, end, kind) of the fixed patterns, sorted by start, then kind."""
    out = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def scan(text: str, formats: Formats) -> tuple[list, list]:
    """Base spans, and all spans: those and credentials of learned formats that overlap none of them."""
    base, added = base_spans(text), []
    starts: list[int] = []  # of the stretches that base spans cover, and their ends
    ends: list[int] = []
    for start, _, end, _ in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or ends[before - 1] <= start

    for m in _RUN.finditer(text):
        at = m.start()
        found = formats.within(m[0], lambda start, end: free(at + start, at + end))
        added += [(at + start, len(_KINDS), at + end, kind) for start, end, kind in found]
    return base, sorted(base + added) if added else base


def _written(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


_NONE = hashlib.sha256(b"").hexdigest()


def _scanned(texts: pa.Array, formats: Formats) -> Iterator[tuple[str | None, list, list]]:
    """Text, base spans and all spans; texts without a trace of a pattern aren't searched further."""
    may = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_pylist()
    for k, hit in enumerate(may):
        if hit:
            text = texts[k].as_py()
            yield (text, *scan(text, formats))
        else:
            yield None, [], []


def find_secrets(docs: DataFrame, formats: Formats, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_learned.

    Positions are code points, ends exclusive; spans are written
    ``kind:start:end``. A null text counts as empty (no spans, the hash of the
    empty string). Null and repeated ids are kept; other columns are ignored;
    an empty table gives an empty result. Texts of any length are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared(("secrets",), tuple)
        for batch in batches:
            for at in range(0, batch.num_rows, _GROUP):
                part = batch.slice(at, _GROUP)
                rows = []
                for _, base, spans in _scanned(part.column("text"), sent.value):
                    kinds = [k for _, k, _, _ in base]
                    wrote = _written(base)
                    digest = hashlib.sha256(wrote.encode()).hexdigest() if base else _NONE
                    rows.append((*(kinds.count(k) for k in range(3)), digest, _written(spans), len(spans) - len(base)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:5]), pa.array(columns[5], pa.int64())],
                    [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long"
    )


def redacted(text: str, spans: list) -> str:
    """The text with each stretch of overlapping spans replaced by ``[kind]`` of its first."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, _, end, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, formats: Formats, *, text_col: str = "text") -> DataFrame:
    """docs, its columns unchanged, with every secret in ``text_col`` replaced; null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(formats)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared(("secrets",), tuple)
        for batch in batches:
            for at in range(0, batch.num_rows, _GROUP):
                part = batch.slice(at, _GROUP)
                texts = part.column(text_col)
                new = {
                    k: redacted(text, spans)
                    for k, (text, _, spans) in enumerate(_scanned(texts, sent.value))
                    if spans
                }
                if new:
                    texts = pa.array([new.get(k, x) for k, x in enumerate(texts.to_pylist())], texts.type)
                yield pa.RecordBatch.from_arrays([texts if c == text_col else part.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)
