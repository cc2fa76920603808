"""Scenes replaced by newer processing, as keyed state on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def replaced_scenes(found: DataFrame, *, late: str = "30 days") -> DataFrame:
    """A stream of scenes (day, tile, id, baseline and flat columns) as a stream in update mode: a row replaces the earlier one of its day and tile.

    A scene is given out where its (baseline, id) is above all that were seen of its day and tile, so the last row of each is what a
    batch would choose (``sources.catalog.newest_per_tile``). Scenes may come up to ``late`` behind the newest day; a day further
    behind is closed, its state goes with the watermark, and what comes for it is left out. Null baselines and ids count as empty.
    State is one pair of strings for each open day and tile. Rows without a day or a tile are left out.
    """
    names = found.columns
    rows = found.filter(F.col("day").isNotNull() & F.col("tile").isNotNull()).withColumn("__at", F.col("day").cast("timestamp")).withWatermark("__at", late)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = tuple(state.get) if state.exists else None
        top, row, at = before, None, 0
        for frame in frames:
            own = pd.DataFrame({c: frame[c].map(lambda v: "" if pd.isna(v) else str(v)) for c in ("baseline", "id")}, index=frame.index)
            k = own.sort_values(["baseline", "id"], kind="stable").index[-1]
            at = int(frame["__at"].max().timestamp() * 1000)
            if top is None or (own.at[k, "baseline"], own.at[k, "id"]) > top:
                top, row = (own.at[k, "baseline"], own.at[k, "id"]), frame.loc[[k], names]
        if row is not None:
            state.update(top)
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + 1)
        if row is not None:
            yield row

    schema = StructType(found.schema.fields)
    return rows.groupBy("day", "tile").applyInPandasWithState(keep, schema, "baseline string, id string", "update", GroupStateTimeout.EventTimeTimeout)
