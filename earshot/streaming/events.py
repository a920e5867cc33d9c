"""Structured Streaming: report windows, frame dedupe, cooldown triggers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def report_windows(stream: DataFrame, ts: str = "ts", late: str = "2 minutes", width: str = "30 seconds") -> DataFrame:
    """The best report per node, label and tumbling window: localized before omni, then the latest, then the largest id.
    A window comes out when the watermark has passed its end."""
    best = F.max(F.struct((F.col("reporting_modality") == "localized").alias("located"), F.col(ts).alias("at"), "id", "label", "reporting_modality"))
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "node_id", F.lower("label").alias("key")).agg(best.alias("m"))
    return rows.select("m.id", "node_id", "m.label", F.col("w.start").alias("window_start"), "m.reporting_modality")


def distinct_frames(stream: DataFrame, ts: str = "ts", late: str = "2 minutes", keys: tuple[str, ...] = ("node_id", "boot_session", "sequence")) -> DataFrame:
    """The first of each frame; repeats within the watermark's delay are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def triggers(stream: DataFrame, key: str, ts_ns: str, cooldown_ns: int, schema: str) -> DataFrame:
    """Events that fire: at least the cooldown after the key's last that fired, in order of time within a micro-batch.

    State is one number per key, kept until the query ends; events older than the key's last trigger don't fire.
    """

    def step(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for part in parts:
            part = part.sort_values([ts_ns, "id"])
            keep = []
            for t in part[ts_ns].tolist():
                now = last is None or t - last >= cooldown_ns
                keep.append(now)
                last = t if now else last
            yield part[keep]
        if last is not None:
            state.update((int(last),))

    return stream.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)
