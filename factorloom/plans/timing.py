"""Where a plan's time goes: totals by nested section."""

from __future__ import annotations

import time
from collections import defaultdict
from contextlib import contextmanager


class Sections:
    """Time and count of named sections; a section within another is counted below it."""

    def __init__(self) -> None:
        self.path: tuple[str, ...] = ()
        self.seconds: dict[tuple[str, ...], float] = defaultdict(float)
        self.counts: dict[tuple[str, ...], int] = defaultdict(int)

    @contextmanager
    def section(self, name: str):
        outer, self.path = self.path, (*self.path, name)
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[self.path] += time.perf_counter() - began
            self.counts[self.path] += 1
            self.path = outer

    def rows(self) -> list[dict]:
        """path, seconds, count and percent (of the section around it), outer sections first."""
        out = []
        for path in sorted(self.seconds):
            whole = self.seconds.get(path[:-1]) or sum(s for p, s in self.seconds.items() if len(p) == 1)
            out.append({"path": "/".join(path), "seconds": self.seconds[path], "count": self.counts[path], "percent": 100 * self.seconds[path] / whole if whole else 0.0})
        return out
