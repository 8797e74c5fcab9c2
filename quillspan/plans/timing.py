"""Times of named stages: those of the same name add up, also where a stage ends in an error."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Stages:
    def __init__(self) -> None:
        self.ms: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.ms[name] = self.ms.get(name, 0.0) + 1000 * (time.perf_counter() - began)

    @property
    def total_ms(self) -> float:
        return sum(self.ms.values())
