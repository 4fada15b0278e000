"""When a sweep is due, how far one has come, and stopping one between batches."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: How often a game may be asked about, in seconds; fixed values.
EVERY = {"hourly": 3600, "six hours": 6 * 3600, "daily": 86_400, "weekly": 7 * 86_400}


def due(asked: DataFrame, now: int, every: str = "daily") -> DataFrame:
    """The games (game, asked: Unix seconds or null) to ask about now, longest unasked first."""
    wait = F.lit(now) - F.coalesce("asked", F.lit(0))
    return asked.where(wait >= EVERY[every]).orderBy(F.coalesce("asked", F.lit(0)), "game")


class Progress(StreamingQueryListener):
    """Rows and batches of every query since it began; read by ``seen``."""

    def __init__(self):
        self._lock, self._seen = threading.Lock(), {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self._seen.setdefault(str(event.id), {"batches": 0, "rows": 0, "done": False})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self._lock:
            at = self._seen.setdefault(str(event.progress.id), {"batches": 0, "rows": 0, "done": False})
            at["batches"] += 1
            at["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        return

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            self._seen.setdefault(str(event.id), {"batches": 0, "rows": 0, "done": False})["done"] = True

    def seen(self, query_id: str) -> dict:
        with self._lock:
            return dict(self._seen.get(str(query_id), {}))


def run_until(query: StreamingQuery, stop: threading.Event, look_every: float = 0.5) -> bool:
    """Waits for a query, and stops it once ``stop`` is set; batches are whole or not there. Whether it ended by itself."""
    while not query.awaitTermination(look_every):
        if stop.is_set():
            query.stop()
            return False
    return True
