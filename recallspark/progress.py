"""Counters and callbacks of runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass
class Timings:
    """Seconds and times of each named part of a run."""

    seconds: dict[str, float] = field(default_factory=dict)
    times: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def measure(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            self.times[name] = self.times.get(name, 0) + 1


def counted(df: DataFrame, name: str, **conditions: str) -> tuple[DataFrame, Observation]:
    """df, and its number of rows and of those that meet each condition, counted while some action runs over it and no second time."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()]), seen


class Listener(StreamingQueryListener):
    """Calls back after each micro-batch with its number and rows, and once if the stream fails."""

    def __init__(self, done: Callable[[int, int], None], failed: Callable[[str], None] | None = None) -> None:
        self.done, self.failed = done, failed

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        self.done(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        if event.exception and self.failed is not None:
            self.failed(event.exception)
