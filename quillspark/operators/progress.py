"""Progress of a run, measured by the run itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Watch:
    """Numbers that a job collects while it runs: rows, rows that failed, letters of text; and their rates."""

    def __init__(self, name: str, clock: Callable[[], float] = time.monotonic):
        self.name, self.clock, self.observation = name, clock, Observation(name)
        self.began = self.ended = clock()

    def watched(self, rows: DataFrame, failed: Column | None = None, text: str | None = None) -> DataFrame:
        """``rows``, counted as they pass; nothing is scanned again."""
        letters = F.sum(F.length(text)) if text else F.lit(None).cast("long")
        bad = F.count_if(failed) if failed is not None else F.lit(0).cast("long")
        return rows.observe(self.observation, F.count(F.lit(1)).alias("rows"), bad.alias("failed"), F.coalesce(letters if text else F.max(letters), F.lit(0)).alias("letters"))

    @contextmanager
    def running(self) -> Iterator[None]:
        self.began = self.clock()
        try:
            yield
        finally:
            self.ended = self.clock()

    def told(self, total: int | None = None) -> dict:
        """Counts, seconds, rows and letters a second, and what is left of ``total`` rows at that rate.  Waits for the job."""
        counts = self.observation.get
        seconds = max(self.ended - self.began, 1e-9)
        rate = counts["rows"] / seconds
        left = None if total is None or not rate else max(total - counts["rows"], 0) / rate
        return {"run": self.name, **counts, "seconds": seconds, "rows_a_second": rate, "letters_a_second": counts["letters"] / seconds, "seconds_left": left}
