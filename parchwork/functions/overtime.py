"""Time limits for single documents within a Python worker."""

from __future__ import annotations

import contextlib
import signal
import threading
from collections.abc import Callable, Iterator


class Overtime(Exception):
    """A document took longer than it may."""


@contextlib.contextmanager
def time_limit(seconds: float | None) -> Iterator[Callable]:
    """Gives a context in which one document's work raises ``Overtime`` after ``seconds``.

    An alarm interrupts Python's patterns as well. It needs the process's main
    thread, which is where workers run; elsewhere, and without ``seconds``,
    nothing is limited.
    """
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield contextlib.nullcontext
        return

    def ring(*_) -> None:
        raise Overtime(f"excedio {seconds:g}s")

    @contextlib.contextmanager
    def limited() -> Iterator[None]:
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            yield
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)

    before = signal.signal(signal.SIGALRM, ring)
    try:
        yield limited
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
