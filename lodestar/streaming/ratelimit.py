"""Fixed-window rate limits by key: a window opens with a key's first event and closes when one comes more than its
length later; rejected events change nothing. Which window an event is in depends on those accepted before it, so both
forms walk a key's events in order in Python: the batch form over sorted partitions, with the state of one key at a time;
the streaming form with (window start, count) by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

# The limiter's length in seconds and its most requests.
WINDOW, MOST = 60, 30


def step(start: int | None, count: int, now: int, window: int = WINDOW, most: int = MOST) -> tuple[int, int, bool]:
    """State and verdict after an event."""
    if start is None or now - start > window:
        return now, 1, True
    if count < most:
        return start, count + 1, True
    return start, count, False


def batch_limit(events: DataFrame, key: str, seconds: str, order: str, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """events (key, order, seconds) with allowed. Partitions hold whole keys in order; only the state is in memory."""
    kinds = dict(events.dtypes)
    rows = events.select(key, order, F.col(seconds).cast("long").alias("__s")).repartition(key).sortWithinPartitions(key, "__s", order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, start, count = object(), None, 0
        for frame in frames:
            verdicts = []
            for k, s in zip(frame[key].tolist(), frame["__s"].tolist()):
                if k != now_key:
                    now_key, start, count = k, None, 0
                start, count, fine = step(start, count, s, window, most)
                verdicts.append(fine)
            yield frame[[key, order]].assign(allowed=verdicts)

    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, allowed boolean")


def stream_limit(events: DataFrame, key: str, seconds: str, order: str, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """The same for a stream; events of a key are taken in order within each micro-batch."""
    kinds = dict(events.dtypes)

    def run(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        frame = pd.concat(list(frames)).sort_values([seconds, order])
        verdicts = []
        for s in frame[seconds].tolist():
            start, count, fine = step(start, count, int(s), window, most)
            verdicts.append(fine)
        if start is not None:
            state.update((start, count))
        yield frame[[key, order]].assign(allowed=verdicts)

    return events.select(key, order, F.col(seconds).cast("long").alias(seconds)).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, allowed boolean", "start long, n int", "append", "NoTimeout")
