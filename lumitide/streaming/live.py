"""Trims, waveforms and held regions of live samples.

Rows have ``ts timestamp`` besides their keys.  State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trim(stream: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open, by event time; stateless."""
    return stream.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))


def waveform(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """Extremes of each key in each window, once the watermark has passed it."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("start"), "lo", "hi", "n")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def held(stream: DataFrame, key: str = "user_id", value: str = "value", late: str = "10 minutes", forget_ms: int = 86_400_000) -> DataFrame:
    """Each row with the value held of its key before it, as a mask is held over a gap.

    Rows that come in one batch are taken in event-time order.  A key is forgotten once the watermark
    is ``forget_ms`` past its last row, which bounds the state.
    """
    key_type = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        before = [last, *rows[value].tolist()[:-1]]
        state.update((float(rows[value].iloc[-1]),))
        newest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest + forget_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], "ts": rows["ts"].to_numpy(), value: rows[value].to_numpy(), "held": pd.array(before, "Float64").to_numpy(float, na_value=float("nan"))})

    schema = f"{key} {key_type}, ts timestamp, {value} double, held double"
    return stream.select(key, "ts", value).withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, schema, "last double", "append", "EventTimeTimeout")
