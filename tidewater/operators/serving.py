"""Serving queries: so many at once, each within a time that waiting counts towards."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

SECONDS, CONCURRENCY = 5.0, 16
T = TypeVar("T")


class Busy(RuntimeError):
    """No place became free in time."""


class TimedOut(RuntimeError):
    """The query did not end in time; its jobs have been cancelled."""


class Gate:
    """``run`` calls a function of the driver in a thread whose jobs are one group, and cancels the group when time is up."""

    def __init__(self, spark: SparkSession, most: int = CONCURRENCY, seconds: float = SECONDS):
        self.spark, self.seconds, self.places = spark, seconds, threading.BoundedSemaphore(most)

    def run(self, search: Callable[[], T]) -> T:
        until = time.monotonic() + self.seconds
        if not self.places.acquire(timeout=self.seconds):
            raise Busy(f"no place within {self.seconds} s")
        context, group, out = self.spark.sparkContext, f"search-{uuid.uuid4().hex}", {}

        def work() -> None:
            try:
                context.setJobGroup(group, "search", interruptOnCancel=True)
                out["value"] = search()
            except Exception as error:  # handed to the caller below
                out["error"] = error
            finally:
                self.places.release()

        thread = InheritableThread(target=work, daemon=True)
        thread.start()
        thread.join(max(until - time.monotonic(), 0))
        if thread.is_alive():
            context.cancelJobGroup(group)
            raise TimedOut(f"not done within {self.seconds} s")
        if "error" in out:
            raise out["error"]
        return out["value"]
