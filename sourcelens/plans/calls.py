"""Queries in flight: deadlines and cancellation of their Spark jobs."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession

#: Seconds between interruptions of a call that was ended: a job may have started since the last one.
AGAIN = 0.2


class Cancelled(RuntimeError):
    """The call was cancelled before it had an answer."""


class DeadlineExceeded(Cancelled):
    """The call had no answer in time."""


class Call:
    """One query in flight, as a context manager. Its jobs carry a tag; cancel() or the deadline interrupts
    them. A call is running until it is committed, cancelled or late, whichever comes first, and stays that.
    An interrupted job gives no rows, so a late call raises DeadlineExceeded and has no partial answer."""

    def __init__(self, spark: SparkSession, seconds: float | None = None):
        self.spark, self.seconds, self.tag = spark, seconds, f"sourcelens-{uuid.uuid4().hex}"
        self.state, self._lock = "running", threading.Lock()
        self._ended, self._left = threading.Event(), threading.Event()

    def _become(self, state: str) -> bool:
        with self._lock:
            if self.state != "running":
                return False
            self.state = state
            return True

    def commit(self) -> bool:
        """Takes the call as answered; False if it was cancelled or late before."""
        return self._become("committed")

    def cancel(self) -> bool:
        """Ends the call; False if it had ended or was answered before."""
        if done := self._become("cancelled"):
            self._ended.set()
        return done

    def check(self) -> None:
        if self.state == "late":
            raise DeadlineExceeded(f"no answer within {self.seconds} seconds")
        if self.state == "cancelled":
            raise Cancelled("the call was cancelled")

    def _watch(self) -> None:
        if not self._ended.wait(self.seconds):
            self._become("late")
        while self.state in ("cancelled", "late") and not self._left.is_set():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._left.wait(AGAIN)

    def __enter__(self) -> Call:
        self.check()
        self.spark.sparkContext.addJobTag(self.tag)
        self.spark.sparkContext.setInterruptOnCancel(True)
        threading.Thread(target=self._watch, daemon=True).start()
        return self

    def __exit__(self, kind, error, trace) -> None:  # noqa: ANN001
        self._left.set()
        self._ended.set()
        self.spark.sparkContext.removeJobTag(self.tag)
        self.spark.sparkContext.setInterruptOnCancel(False)
        try:
            self.check()
        except Cancelled as why:
            if error is not why and not isinstance(error, Cancelled):
                raise why from error


class Calls:
    """The calls in flight by the id of their request."""

    def __init__(self):
        self._held, self._lock = {}, threading.Lock()

    def begin(self, spark: SparkSession, request: str | None = None, seconds: float | None = None) -> Call:
        """A new call. Raises ValueError for a request id that is in flight."""
        call = Call(spark, seconds)
        with self._lock:
            if (request := request or call.tag) in self._held:
                raise ValueError(f"request {request} is in flight")
            self._held[request] = call
        return call

    def end(self, call: Call) -> None:
        with self._lock:
            self._held = {k: c for k, c in self._held.items() if c is not call}

    def cancel(self, request: str) -> bool:
        """Whether a call in flight was cancelled by this."""
        call = self._held.get(request)
        return call is not None and call.cancel()
