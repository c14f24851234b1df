"""Session factory and the options of a job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Options:
    """Options of a job; those that Spark has of its own become configuration.

    ``splits``: partitions after a shuffle. ``max_failures``: failures of a task that are borne. ``local_dir``: scratch
    of one machine. ``checkpoint_dir``: scratch that all machines share. ``sequential``: jobs one after the other, else
    they share the cluster fairly. ``timeout``, ``heartbeat``: seconds until a silent executor is given up, and between
    its signs of life. ``profile``: times of Python functions. ``events_dir``: where Spark's event log goes, from which
    times of stages and tasks can be had. ``keep_scratch``: staged tables stay after the job.
    """

    seed: int = 0
    splits: int = 8
    max_failures: int = 3
    local_dir: str | None = None
    checkpoint_dir: str | None = None
    sequential: bool = True
    timeout: int = 120
    heartbeat: int = 10
    profile: bool = False
    events_dir: str | None = None
    keep_scratch: bool = False
    verbose: bool = False
    debug: bool = False

    def conf(self) -> dict[str, str]:
        out = {
            "spark.sql.shuffle.partitions": str(self.splits),
            "spark.task.maxFailures": str(self.max_failures + 1),
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.scheduler.mode": "FIFO" if self.sequential else "FAIR",
            "spark.network.timeout": f"{self.timeout}s",
            "spark.executor.heartbeatInterval": f"{self.heartbeat}s",
        }
        if self.local_dir:
            out["spark.local.dir"] = self.local_dir
        if self.checkpoint_dir:
            out["spark.checkpoint.dir"] = self.checkpoint_dir
        if self.profile:
            out["spark.sql.pyspark.udf.profiler"] = "perf"
        if self.events_dir:
            out |= {"spark.eventLog.enabled": "true", "spark.eventLog.dir": self.events_dir}
        return out


def session(options: Options | None = None, master: str | None = None, name: str = "millrace") -> SparkSession:
    options = options or Options()
    builder = SparkSession.builder.appName(name).config(map=options.conf())
    spark = (builder.master(master) if master else builder).getOrCreate()
    spark.sparkContext.setLogLevel("DEBUG" if options.debug else "INFO" if options.verbose else "WARN")
    return spark
