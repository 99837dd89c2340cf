"""View messages as a stream: which camera moves call for a new walk of the tree.

State per session is the last accepted view. A view is accepted if the pixel threshold changed, the eye moved by more
than a fiftieth of the cube's half side, or the zoom changed by more than a twentieth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The share of the half side that a move must pass, and the ratio of zooms.
MOVE, ZOOM = 0.02, 1.05
VIEW = "session long, seq long, ex double, ey double, ez double, zoom double, pixels double"
STATE = "ex double, ey double, ez double, zoom double, pixels double"


def view_events(events: DataFrame, *more: str) -> DataFrame:
    """Views (VIEW) from user events: where each event's value and kind put the camera. more: columns to keep beside them."""
    k = F.coalesce(F.length("event_type"), F.lit(0)) % 7
    value = F.coalesce("value", F.lit(0.0))
    return events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (value * 20).alias("ex"), (value * (k - 3)).alias("ey"), F.lit(0.0).alias("ez"),
        (F.lit(900.0) + (k * 10)).alias("zoom"), F.when(k == 0, 8.0).otherwise(16.0).alias("pixels"), *more,
    )


def moved(last: tuple | None, now: tuple, half: float) -> bool:
    if last is None or last[3] == 0 or last[4] != now[4]:
        return True
    if sum((a - b) ** 2 for a, b in zip(now[:3], last[:3])) > (half * MOVE) ** 2:
        return True
    ratio = now[3] / last[3]
    return ratio > ZOOM or ratio < 1 / ZOOM


def _walk(rows: pd.DataFrame, last: tuple | None, half: float) -> tuple[pd.DataFrame, tuple | None]:
    keep = []
    for v in rows.itertuples(index=False):
        now = (v.ex, v.ey, v.ez, v.zoom, v.pixels)
        ok = moved(last, now, half)
        keep.append(ok)
        last = now if ok else last
    return rows[keep], last


def accepted_views(views: DataFrame, half: float) -> DataFrame:
    """Batch form: the accepted views of each session in the order of seq.

    Rows come sorted by session and seq, so a task holds one state at a time and no session is gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, last = None, None
        for b in batches:
            for s, rows in b.groupby("session", sort=False):
                if s != session:
                    session, last = s, None
                kept, last = _walk(rows, last, half)
                yield kept

    return views.where("session is not null").repartition("session").sortWithinPartitions("session", "seq").mapInPandas(run, VIEW)


def accepted_view_stream(views: DataFrame, half: float) -> DataFrame:
    """Streaming form, for views that arrive in order: keyed state survives between micro-batches.

    A session's rows of a micro-batch come in Arrow batches, which are walked one by one.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        for rows in batches:
            kept, last = _walk(rows.sort_values("seq"), last, half)
            yield kept
        if last is not None:
            state.update(last)

    return views.groupBy("session").applyInPandasWithState(run, VIEW, STATE, "append", "NoTimeout")
