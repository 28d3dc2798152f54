"""Runs in stages that can be cancelled, and progress of streaming queries as rows.

A run's stages report to the log of a :class:`~siltwork.sources.manifest.Store`; between stages it looks whether it was cancelled,
and its Spark jobs carry its tag, so that a stage under way is interrupted too. What a cancelled run wrote is in no version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql.streaming import StreamingQueryListener

from siltwork.operators.indexing import STEPS
from siltwork.sources.manifest import Cancelled, Store, Transaction


class Run:
    """``with run.stage("chunking"): ...`` for each step; ``run.commit()`` ends it."""

    def __init__(self, store: Store, job: str, steps: dict[str, int] | None = None) -> None:
        self.store, self.job, self.steps = store, job, STEPS if steps is None else steps
        self.tag = f"siltwork-{job}"
        store.begin(job)
        self.writes: Transaction = store.transaction(job)

    @contextmanager
    def stage(self, step: str) -> Iterator[Transaction]:
        """Runs a step's jobs under the run's tag; its percentage is logged at the end. Raises Cancelled before or after it, and an
        error of the step ends the run as failed."""
        if not self.store.live(self.job):
            raise Cancelled(self.job)
        context = self.store.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            yield self.writes
        except Exception as e:
            if not self.store.live(self.job):
                raise Cancelled(self.job) from e
            self.store.fail(self.job, type(e).__name__)
            raise
        finally:
            context.removeJobTag(self.tag)
        self.store.progress(self.job, self.steps[step], step)

    def commit(self) -> int:
        return self.writes.commit()


def cancel(store: Store, job: str) -> None:
    """Ends a live job: its log says so first, then its running Spark jobs are interrupted."""
    store.cancel(job)
    store.spark.sparkContext.cancelJobsWithTag(f"siltwork-{job}")


class Progress(StreamingQueryListener):
    """Hands a row (event, query, batch, input_rows, state_rows, dropped_late, error) to ``observe``; an observer's error never reaches the query."""

    def __init__(self, observe: Callable[[dict], None]) -> None:
        self._observe = observe

    def _tell(self, **row) -> None:
        try:
            self._observe(row)
        except Exception:  # noqa: BLE001, S110  observers are fail-open
            pass

    def onQueryStarted(self, event) -> None:
        self._tell(event="started", query=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = p.stateOperators
        self._tell(event="progress", query=p.name, batch=p.batchId, input_rows=p.numInputRows, state_rows=sum(s.numRowsTotal for s in state), dropped_late=sum(s.numRowsDroppedByWatermark for s in state))

    def onQueryIdle(self, event) -> None:
        self._tell(event="idle", query=None)

    def onQueryTerminated(self, event) -> None:
        self._tell(event="ended", query=None, error=event.exception)
