"""Hybrid logical clocks: (physical milliseconds, logical counter, node), ordered by component."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DRIFT_MS = 60_000


class ClockDrift(ValueError):
    """A remote time lies too far ahead."""


@dataclass(frozen=True, order=True)
class Hlc:
    physical: int
    logical: int = 0
    node: int = 0


class Clock:
    """A driver-side clock; reads never go back."""

    def __init__(self, node: int, now=lambda: int(time.time() * 1000), last: Hlc | None = None):
        self.node, self.now, self.last = node, now, last or Hlc(0, 0, node)

    def tick(self) -> Hlc:
        at = self.now()
        self.last = Hlc(at, 0, self.node) if at > self.last.physical else Hlc(self.last.physical, self.last.logical + 1, self.node)
        return self.last

    def receive(self, remote: Hlc) -> Hlc:
        """Move past both the local and the remote time; refuse a remote time more than a minute ahead."""
        at = self.now()
        if remote.physical > at + MAX_DRIFT_MS:
            raise ClockDrift(f"{remote.physical - at} ms ahead")
        top = max(at, self.last.physical, remote.physical)
        same = [x.logical for x in (self.last, remote) if x.physical == top]
        self.last = Hlc(top, max(same) + 1 if same else 0, self.node)
        return self.last

    def restore(self, seen: Hlc) -> None:
        self.last = max(self.last, Hlc(seen.physical, seen.logical, self.node))


def stamp(p: str = "hlc_p", logical: str = "hlc_l", node: str = "hlc_n") -> Column:
    """A struct whose order is the clocks' order."""
    return F.struct(F.col(p).alias("p"), F.col(logical).alias("l"), F.col(node).alias("n"))


def happens_before(left: Column, right: Column) -> Column:
    return left < right
