"""What the stateful operators of running streams did: rows they dropped as late, rows of state they hold."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

OPERATORS = "query string, batch_id long, operator_no int, operator string, late_rows long, state_rows long, updated_rows long, watermark string"


def operator_rows(progress: dict) -> list[tuple]:
    """A row per stateful operator of one micro-batch, from the progress it reports."""
    mark = (progress.get("eventTime") or {}).get("watermark")
    return [
        (progress.get("name") or progress["runId"], progress["batchId"], i, op["operatorName"], op["numRowsDroppedByWatermark"],
         op["numRowsTotal"], op["numRowsUpdated"], mark)
        for i, op in enumerate(progress.get("stateOperators") or [])
    ]


class LateRows(StreamingQueryListener):
    """Counts, for every query of a session it is added to, the rows that each stateful operator drops as too late.

    ``spark.streams.addListener(LateRows())``. ``totals`` has one entry per query and operator, so it does not grow with
    the micro-batches.
    """

    def __init__(self) -> None:
        self.totals: dict[tuple[str, int, str], int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            for query, _, no, operator, late, *_ in operator_rows(json.loads(event.progress.json)):
                self.totals[query, no, operator] = self.totals.get((query, no, operator), 0) + late

    def onQueryTerminated(self, event) -> None:
        pass


def operator_progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The micro-batches that ``query`` still remembers (``spark.sql.streaming.numRecentProgressUpdates``), a row per operator."""
    rows = [row for p in query.recentProgress for row in operator_rows(json.loads(p.json if hasattr(p, "json") else json.dumps(p)))]
    return spark.createDataFrame(rows, OPERATORS)
