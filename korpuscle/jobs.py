"""Long analyses as jobs: started in the background, watched, paged and cancelled by Spark job group."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

#: Rows that a finished job keeps for paging.
KEEP = 100_000


class Job:
    def __init__(self, name: str):
        self.id, self.name, self.state, self.error, self.rows, self.truncated = uuid.uuid4().hex, name, "queued", None, [], False


class Jobs:
    """States: queued, running, done, error, cancelled."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs, self.lock = spark, {}, threading.Lock()

    def create(self, name: str, make: Callable[[], DataFrame]) -> str:
        job = Job(name)
        self.jobs[job.id] = job

        def run() -> None:
            with self.lock:
                if job.state != "queued":
                    return
                job.state = "running"
            self.spark.sparkContext.setJobGroup(job.id, name, interruptOnCancel=True)
            try:
                rows = [r.asDict() for r in make().limit(KEEP + 1).collect()]
            except Exception as e:
                with self.lock:
                    if job.state == "running":
                        job.state, job.error = "error", str(e).splitlines()[0]
                return
            with self.lock:
                if job.state == "running":
                    job.rows, job.truncated, job.state = rows[:KEEP], len(rows) > KEEP, "done"

        job.thread = InheritableThread(target=run, daemon=True)
        job.thread.start()
        return job.id

    def status(self, job_id: str) -> dict:
        j = self.jobs[job_id]
        return {"id": j.id, "name": j.name, "state": j.state, "error": j.error, "rows": len(j.rows), "truncated": j.truncated}

    def page(self, job_id: str, offset: int = 0, limit: int = 100) -> list[dict]:
        return self.jobs[job_id].rows[offset : offset + limit]

    def wait(self, job_id: str, seconds: float | None = None) -> str:
        self.jobs[job_id].thread.join(seconds)
        return self.jobs[job_id].state

    def cancel(self, job_id: str) -> bool:
        with self.lock:
            j = self.jobs[job_id]
            if j.state not in ("queued", "running"):
                return False
            j.state = "cancelled"
        self.spark.sparkContext.cancelJobGroup(job_id)
        return True
