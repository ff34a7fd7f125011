"""Streams: points located against a table of zones, and the newest viewport of each session."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geometry as G
from ..operators import cells


def locate_stream(points: DataFrame, zones: DataFrame, covers: bool = True) -> DataFrame:
    """A stream of points (x, y, ...) with zone_id for each zone of the static table that holds them.

    An inner stream-static join on grid cells; rows outside all zones are dropped.
    """
    boxes = zones.select(F.col("id").alias("zone_id"), F.col("level").alias("zone_level"), "polys", "bbox_w", "bbox_s", "bbox_e", "bbox_n")
    keyed, own = cells.point_cells(points, cells.occurring_grids(boxes)).alias("p"), cells.own_cells(boxes).alias("z")
    inside = F.expr("p.x BETWEEN z.bbox_w AND z.bbox_e AND p.y BETWEEN z.bbox_s AND z.bbox_n")
    hit = keyed.join(own, cells.same_cell("p", "z") & inside).where(G.pip_query(F.col("p.x"), F.col("p.y"), F.col("z.polys"), covers))
    return hit.select(*[F.col(f"p.{c}").alias(c) for c in points.columns], "z.zone_id", "z.zone_level")


def zone_counts(located: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Points by window of ts and zone, rows later than the watermark dropped."""
    return located.withWatermark("ts", late).groupBy(F.window("ts", width), "zone_id").agg(F.count("*").alias("n"))


#: Milliseconds of event time for which a silent session is remembered.
KEEP_MS = 3_600_000


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    best: tuple[Any, ...] | None = state.get if state.exists else None
    changed = False
    for pdf in batches:
        for row in pdf[["revision", "request"]].itertuples(index=False):
            if best is None or row.revision > best[0]:
                best, changed = (int(row.revision), str(row.request)), True
    if best is not None:
        state.update(best)
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + KEEP_MS)
    if changed and best is not None:
        yield pd.DataFrame({"session": [key[0]], "revision": [best[0]], "request": [best[1]]})


def newest_requests(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of requests(session, revision, request, ts): the newest revision of each session, older ones dropped.

    A session's state goes when the watermark has passed it by an hour.
    """
    kept = requests.withWatermark("ts", late).groupBy("session")
    return kept.applyInPandasWithState(_newest, "session string, revision long, request string", "revision long, request string", "append", GroupStateTimeout.EventTimeTimeout)


def newest_in_table(requests: DataFrame) -> DataFrame:
    """The same for a finished table."""
    return requests.groupBy("session").agg(F.max(F.struct("revision", "request")).alias("m")).select("session", "m.revision", "m.request")
