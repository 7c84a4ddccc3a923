"""Progress of streaming queries, gathered as they report it."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Per query: batches, rows taken in, and the last batch's duration. Add it by ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.queries: dict[str, dict] = {}

    def _of(self, event: object) -> dict:
        return self.queries.setdefault(str(event.id), {"batches": 0, "rows": 0, "last_ms": None, "running": True, "error": None})  # type: ignore[attr-defined]

    def onQueryStarted(self, event) -> None:  # type: ignore[no-untyped-def]
        self._of(event)["running"] = True

    def onQueryProgress(self, event) -> None:  # type: ignore[no-untyped-def]
        own = self._of(event.progress)
        own["batches"] += 1
        own["rows"] += event.progress.numInputRows
        own["last_ms"] = event.progress.batchDuration

    def onQueryIdle(self, event) -> None:  # type: ignore[no-untyped-def]
        pass

    def onQueryTerminated(self, event) -> None:  # type: ignore[no-untyped-def]
        self._of(event).update(running=False, error=event.exception)
