"""Bounded logs of events and queries, with slow queries marked. A Catalog with a trace logs its queries, a Registry its rounds."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

EVENTS, QUERIES, SLOW_S = 512, 64, 0.01


@dataclass
class Trace:
    events: deque = field(default_factory=lambda: deque(maxlen=EVENTS))
    queries: deque = field(default_factory=lambda: deque(maxlen=QUERIES))

    def event(self, kind: str, **what) -> None:
        self.events.append((time.time(), kind, what))

    @contextmanager
    def query(self, sql: str, **what) -> Iterator[dict]:
        """Logs what runs inside; more facts can be put into the entry."""
        entry, began = {"sql": sql, **what}, time.perf_counter()
        try:
            yield entry
        finally:
            took = time.perf_counter() - began
            self.queries.append(entry | {"s": took, "slow": took > SLOW_S})
