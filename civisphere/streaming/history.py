"""Presence history as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "first_no long, last_no long, seen long"


def presence_stream(seen: DataFrame, key: str, edition_no: str) -> DataFrame:
    """First and last edition of each key and in how many it was seen, updated
    with each edition. An edition at or before the last one of a key changes
    nothing, so a replayed or late edition does no harm.
    """
    kind = seen.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        numbers: set[int] = set()
        for b in batches:
            numbers.update(int(x) for x in b[edition_no].dropna())
        for no in sorted(numbers):
            if last is None or no > last:
                first, last, n = no if first is None else first, no, n + 1
        if last is not None:
            state.update((first, last, n))
            yield pd.DataFrame({key: [k[0]], "first_no": [first], "last_no": [last], "seen": [n]})

    return seen.select(key, edition_no).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
