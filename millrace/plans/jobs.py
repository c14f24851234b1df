"""Actions in the background: wait, progress, close."""

from __future__ import annotations

import uuid
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Dataset:
    """A frame whose computation was started; ``frame`` stays lazy for further steps."""

    frame: DataFrame
    group: str
    future: Future = field(repr=False)

    def ready(self) -> bool:
        return self.future.done()

    def computing(self) -> bool:
        return self.future.running()

    def rows(self) -> int:
        """How many rows there are, when all are computed."""
        return self.future.result()

    def data(self):
        """All rows, a partition at a time."""
        self.rows()
        return self.frame.toLocalIterator()

    def fetchall(self) -> list:
        """All rows at once, for results that fit in the driver."""
        self.rows()
        return self.frame.collect()

    def splitdata(self, split: int):
        """Rows of one partition."""
        self.rows()
        return self.frame.where(F.spark_partition_id() == split).toLocalIterator()

    stream_data, stream_split = data, splitdata

    def sourcedata(self, source: int):
        """Rows of one source, for frames with a column ``source``, as grids of files have."""
        self.rows()
        return self.frame.where(F.col("source") == source).toLocalIterator()


class Jobs:
    def __init__(self, spark, in_flight: int = 10):
        self.spark, self.pool = spark, ThreadPoolExecutor(in_flight)

    def submit(self, df: DataFrame) -> Dataset:
        """Compute ``df`` in the background and keep it for what follows."""
        group, frame = f"millrace-{uuid.uuid4().hex}", df.persist()

        def run() -> int:
            out: list = []

            def act():
                try:
                    self.spark.sparkContext.setJobGroup(group, group)
                    out.append(frame.count())
                except BaseException as e:  # raised again by the future
                    out.append(e)

            thread = InheritableThread(target=act)
            thread.start()
            thread.join()
            if isinstance(out[0], BaseException):
                raise out[0]
            return out[0]

        return Dataset(frame, group, self.pool.submit(run))

    def wait(self, *sets: Dataset, timeout: float | None = None) -> list[Dataset]:
        """Those that are complete, as soon as one is or the time is over; errors are raised."""
        done, _ = wait([s.future for s in sets], timeout, FIRST_COMPLETED)
        for f in done:
            f.result()
        return [s for s in sets if s.future in done]

    def progress(self, one: Dataset) -> float:
        """Share of tasks that are done, 0 to 1; 1 for what is complete."""
        if one.ready():
            return 1.0
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(one.group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])]
        stages = [s for s in stages if s and s.numTasks]
        total = sum(s.numTasks for s in stages)
        return sum(s.numCompletedTasks for s in stages) / total if total else 0.0

    def close(self, one: Dataset) -> None:
        """No more readers: what was kept may go."""
        one.frame.unpersist()

    def shutdown(self) -> None:
        self.pool.shutdown(wait=True)
