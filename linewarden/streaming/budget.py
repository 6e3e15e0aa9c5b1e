"""Limits of a stream run, and a stop that never cuts a batch in two.

A batch passes a gate while its callback runs. A stop closes the gate, waits for the batch
that is inside and for its commit, and only then ends the query. A batch that comes to a
closed gate is refused; it stays uncommitted, so a later start runs it.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Seconds that a stop waits for the commit of the last batch.
COMMIT_S = 30.0


class StopRequested(Exception):
    """A batch came while its run was being stopped."""


class Gate:
    """Lets batches in, one at a time, until it is closed."""

    def __init__(self) -> None:
        self._inside = threading.Lock()
        self.closed = False
        self.entered = -1

    def admit(self, batch_id: int) -> Gate:
        self._inside.acquire()
        if self.closed:
            self._inside.release()
            raise StopRequested(f"batch {batch_id} waits for the next start")
        self.entered = batch_id
        return self

    def __enter__(self) -> Gate:
        return self

    def __exit__(self, *_) -> None:
        self._inside.release()

    def close(self) -> None:
        """Returns when no batch is inside."""
        self.closed = True
        with self._inside:
            pass


class RunBudget:
    """How many readings a run takes, and how long it lasts; None is no limit.

    ``watch`` puts a count into a stream of readings, which Spark reports per batch. The
    run ends at the first boundary of batches at which a limit is met, and ``last_seq`` says
    which reading was the last. ``clock`` gives seconds.
    """

    def __init__(
        self,
        readings: int | None = None,
        seconds: float | None = None,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        if readings is not None and readings < 0 or seconds is not None and seconds < 0:
            raise ValueError("a limit cannot be below zero")
        self.readings, self.seconds, self.clock = readings, seconds, clock
        self.name = f"budget_{uuid.uuid4().hex}"
        self.taken = 0
        self.last_seq: int | None = None
        self._begun: float | None = None

    def watch(self, readings: DataFrame) -> DataFrame:
        n, last = F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")
        return readings.observe(self.name, n, last)

    def begin(self) -> None:
        self._begun = self.clock()

    def note(self, taken: int, last_seq: int | None) -> None:
        self.taken = taken
        if last_seq is not None and (self.last_seq is None or last_seq > self.last_seq):
            self.last_seq = last_seq

    def spent(self) -> str | None:
        """The limit that is met, if any."""
        if self.readings is not None and self.taken >= self.readings:
            return "readings"
        if self.seconds is not None and self._begun is not None:
            if self.clock() - self._begun >= self.seconds:
                return "seconds"
        return None


class _Reports(StreamingQueryListener):
    """Counts of a budget out of the reports of its query, and its last committed batch."""

    def __init__(self, budget: RunBudget) -> None:
        self.budget, self.query_id, self.committed = budget, None, -1

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.budget.name)
        if found is not None and event.progress.batchId > self.committed:
            self.budget.note(self.budget.taken + found["n"], found["seq"])
        if str(event.progress.id) == self.query_id:
            self.committed = max(self.committed, event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class LimitedRun:
    """A streaming query under a budget, which stops between two batches.

    Anything else that a query offers is passed on to it.
    """

    def __init__(
        self, start: Callable[[], StreamingQuery], gate: Gate, budget: RunBudget, session
    ) -> None:
        self.gate, self.budget, self._session = gate, budget, session
        self._reports = _Reports(budget)
        session.streams.addListener(self._reports)
        self._ending = threading.Lock()
        budget.begin()
        self.query = start()
        self._reports.query_id = str(self.query.id)
        self.reason: str | None = None
        if budget.readings is not None or budget.seconds is not None:
            threading.Thread(target=self._watch, daemon=True).start()

    def __getattr__(self, name: str):
        return getattr(self.query, name)

    def _watch(self) -> None:
        while self.query.isActive:
            reason = self.budget.spent()
            if reason is not None:
                self.reason = reason
                self.stop()
                return
            time.sleep(0.05)

    def stop(self) -> None:
        """End the run after the batch that is under way."""
        with self._ending:
            self.gate.close()
            until = time.monotonic() + COMMIT_S
            while (
                self.query.isActive
                and self._reports.committed < self.gate.entered
                and time.monotonic() < until
            ):
                time.sleep(0.05)
            self.query.stop()
        self._forget()

    def awaitTermination(self, timeout: float | None = None) -> bool | None:
        """As of a query; a batch refused at the end is no failure."""
        try:
            ended = self.query.awaitTermination(timeout)
        except StreamingQueryException as e:
            if not (self.gate.closed and StopRequested.__name__ in str(e)):
                raise
            ended = True
        if not self.query.isActive:
            with self._ending:  # a stop that another thread began
                pass
            self._forget()
        return ended

    def _forget(self) -> None:
        self._session.streams.removeListener(self._reports)
