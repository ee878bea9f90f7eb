"""Probabilistic automata inferred from samples.

A prefix tree of the samples is folded up: states are visited in order, and a
state merges into an earlier one if the shares of their endings and of each
next symbol, and those of all states behind them, differ by no more than the
Hoeffding bound at ``alpha`` allows. What remains is a deterministic
probabilistic automaton whose loops generalise the samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

#: Log-probability of a step that the automaton doesn't have.
FLOOR = -18.0


class _Tree:
    """States with arrivals, endings and counted steps."""

    def __init__(self):
        self.arrived, self.ended, self.steps = [0], [0], [{}]

    def add(self, symbols: Sequence[str]) -> None:
        at = 0
        self.arrived[0] += 1
        for s in symbols:
            if s not in self.steps[at]:
                self.steps[at][s] = [len(self.arrived), 0]
                self.arrived.append(0)
                self.ended.append(0)
                self.steps.append({})
            step = self.steps[at][s]
            step[1] += 1
            at = step[0]
            self.arrived[at] += 1
        self.ended[at] += 1

    def alike(self, a: int, b: int, bound: float) -> bool:
        """Whether two states, and all behind them, are statistically compatible."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.arrived[a], self.arrived[b]
            if not n or not m:
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) > most:
                return False
            sa, sb = self.steps[a], self.steps[b]
            for s in sa.keys() | sb.keys():
                x, y = sa.get(s), sb.get(s)
                if abs((x[1] / n if x else 0) - (y[1] / m if y else 0)) > most:
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, into: int, state: int) -> None:
        """Add a subtree's counts to another state's."""
        todo = [(into, state)]
        while todo:
            a, b = todo.pop()
            self.arrived[a] += self.arrived[b]
            self.ended[a] += self.ended[b]
            for s, (target, n) in self.steps[b].items():
                if s in self.steps[a]:
                    self.steps[a][s][1] += n
                    todo.append((self.steps[a][s][0], target))
                else:
                    self.steps[a][s] = [target, n]


@dataclass(frozen=True)
class Automaton:
    """Log-probabilities of ending in each state, and of each step with its target."""

    ends: tuple[float, ...]
    steps: tuple[dict[str, tuple[int, float]], ...]

    def score(self, symbols: Sequence[str]) -> float:
        """Mean log-probability of the symbols and the end; at most ``FLOOR`` a symbol once a step is missing."""
        at, total = 0, 0.0
        for k, s in enumerate(symbols):
            step = self.steps[at].get(s)
            if step is None:
                return (total + FLOOR * (len(symbols) - k + 1)) / (len(symbols) + 1)
            at, p = step
            total += p
        return (total + self.ends[at]) / (len(symbols) + 1)


def infer(samples: Iterable[Sequence[str]], alpha: float = 0.05) -> Automaton:
    """The automaton of the samples by state merging; without samples, one that accepts nothing."""
    tree = _Tree()
    for s in samples:
        tree.add(s)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    kept: list[int] = [0]
    parent = {t: (0, s) for s, (t, _) in tree.steps[0].items()}
    while parent:
        state = min(parent)  # states are numbered as the samples reach them
        at, symbol = parent.pop(state)
        home = next((k for k in kept if tree.alike(k, state, bound)), None)
        if home is None:
            kept.append(state)
        else:
            tree.steps[at][symbol][0] = home
            tree.fold(home, state)
        mine = set(kept)
        parent = {t: (k, s) for k in kept for s, (t, _) in tree.steps[k].items() if t not in mine}
    where = {state: k for k, state in enumerate(kept)}
    ends, steps = [], []
    for state in kept:
        total = tree.ended[state] + sum(n for _, n in tree.steps[state].values())
        ends.append(math.log(tree.ended[state] / total) if tree.ended[state] else FLOOR)
        steps.append({s: (where[t], math.log(n / total)) for s, (t, n) in tree.steps[state].items()})
    return Automaton(tuple(ends), tuple(steps))
