"""How far a stream has come: a counter that only rises, against a total that is known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Counts the rows that queries of a name have taken in, and tells each step: done, total, percent and whether it is the last."""

    def __init__(self, name: str, total: int, tell: Callable[[dict], None]):
        self.name, self.total, self.tell = name, total, tell
        self.ids: set[str] = set()
        self.done = 0

    def _say(self, last: bool) -> None:
        percent = min(100, max(0, round(100 * self.done / self.total))) if self.total > 0 else 0
        self.tell({"done": self.done, "total": self.total, "percent": percent, "is_complete": last})

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.ids.add(str(event.id))

    def onQueryProgress(self, event):
        if event.progress.name == self.name and event.progress.numInputRows:
            self.done += event.progress.numInputRows
            self._say(False)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if str(event.id) in self.ids:
            self._say(True)
