"""The engine's clock.

Plans never read the time themselves: a run takes one ``as_of`` and passes it
as a column, so results can be repeated. Elapsed times are measured on the
driver and stay out of result rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of(moment: datetime | None = None) -> Column:
    """A literal timestamp: the given moment, or now, read once."""
    return F.lit(moment or datetime.now(UTC)).cast("timestamp")


@contextmanager
def timed(timings: dict[str, int], name: str) -> Iterator[None]:
    """Put the milliseconds of a block under ``name``, never below zero."""
    began = time.perf_counter()
    try:
        yield
    finally:
        timings[name] = max(0, round((time.perf_counter() - began) * 1000))
