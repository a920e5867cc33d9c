"""Cooldowns: of a key's events in order, which fire. Batch form here, streaming form in ``streaming.events``.

An event fires when the last one that fired lies at least the cooldown back; whether it did depends on all before it,
which no window function expresses. A key's events are cut where the pause before them is at least the cooldown: what
follows such a pause fires whatever came before. So the stretches between pauses are independent groups, and a key with
a third of all rows is as many groups as it has pauses; pauses are found by days (``timeline``). Stretches are dealt out
whole, many to a task, and each task reads its stretches in order as one stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import previous, running


def with_cooldown(events: DataFrame, key: str, ts: str, tiebreak: str, cooldown: int) -> DataFrame:
    """``events`` with ``fired``. Equal times are in order of ``tiebreak``; an event exactly the cooldown later fires."""
    rows = previous(events, [key], [ts, tiebreak], [ts], "_before")
    cut = F.when(F.col(ts) - F.col("_before")[ts] < cooldown, 0).otherwise(1)
    rows = running(rows, [key], [ts, tiebreak], cut, "_stretch").drop("_before")

    def fire(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for part in parts:
            fired = []
            for k, stretch, t in zip(part[key].tolist(), part["_stretch"].tolist(), part[ts].tolist(), strict=True):
                if (k, stretch) != at:
                    at, last = (k, stretch), None
                now = last is None or t - last >= cooldown
                fired.append(now)
                if now:
                    last = t
            yield part.drop(columns="_stretch").assign(fired=fired)

    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes) + ", fired boolean"
    return rows.repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", ts, tiebreak).mapInPandas(fire, schema)
