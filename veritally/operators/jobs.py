"""The job log: append-only events of which the current state, histories and counts are queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "job_id string, session_id string, job_type string, status string, progress int, at timestamp, settings string, files array<string>"
STATES = ("queued", "processing", "completed", "failed", "cancelled")
#: Jobs that a session keeps, and that a listing shows at most.
KEPT, LISTED = 20, 200


def event(spark: SparkSession, job: str, session: str, kind: str, status: str, progress: int, at: datetime, settings: str = "{}", files: tuple[str, ...] = ()) -> DataFrame:
    if status not in STATES:
        raise ValueError(f"no such state: {status}")
    return spark.createDataFrame([(job, session, kind, status, progress, at, settings, list(files))], EVENTS)


def latest(events: DataFrame) -> DataFrame:
    """The current row of each job; a final state stays, whatever was logged later."""
    final = F.col("status").isin("completed", "failed", "cancelled")
    order = F.struct(final.alias("f"), F.when(final, -F.unix_micros("at")).otherwise(F.unix_micros("at")), "progress")
    rest = [c for c in events.columns if c != "job_id"]
    last = events.groupBy("job_id").agg(F.max_by(F.struct(*rest), order).alias("r"), F.min("at").alias("created_at"))
    return last.select("job_id", "r.*", "created_at")


def of_session(jobs: DataFrame, session: str) -> DataFrame:
    return jobs.where(F.col("session_id") == session)


def recent(jobs: DataFrame, session: str, limit: int = LISTED) -> DataFrame:
    return of_session(jobs, session).orderBy(F.desc("created_at"), "job_id").limit(min(limit, LISTED))


def cancel(jobs: DataFrame, job: str, at: datetime) -> DataFrame:
    """The event that cancels a job, if it hasn't ended."""
    open_ = jobs.where((F.col("job_id") == job) & F.col("status").isin("queued", "processing"))
    return open_.select("job_id", "session_id", "job_type", F.lit("cancelled").alias("status"), "progress", F.lit(at).cast("timestamp").alias("at"), "settings", "files")


def newest(rows: DataFrame, group: str, order: str, tie: str, keep: int = KEPT) -> DataFrame:
    """The newest rows of each group. The rank filter becomes a limit inside each task before the exchange."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order), tie))
    return rows.withColumn("_k", rank).where(F.col("_k") <= keep).drop("_k")


def surplus(jobs: DataFrame, keep: int = KEPT) -> DataFrame:
    """Jobs beyond the newest of their session, to be deleted."""
    return jobs.join(newest(jobs, "session_id", "created_at", "job_id", keep).select("job_id"), "job_id", "left_anti")


def without(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """The log without some jobs."""
    return events.join(jobs.select("job_id"), "job_id", "left_anti")


def orphan_files(files: DataFrame, events: DataFrame) -> DataFrame:
    """Files (file_id) that no job refers to."""
    return files.join(events.select(F.explode("files").alias("file_id")).distinct(), "file_id", "left_anti")


def dashboard(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status").isin("queued", "processing")).alias("active"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


class Run:
    """A reconciliation whose Spark jobs carry a tag: they can be counted and cancelled from any thread while they run.

        with Run(spark, "job-1") as run:
            reconcile(one, two, spec, progress=run.progress, cancelled=run.cancelled)
    """

    def __init__(self, spark: SparkSession, job: str):
        self.context, self.job, self.steps, self.stopped = spark.sparkContext, job, [], False
        self.tag = f"veritally-{job}".replace(",", "_")

    def __enter__(self) -> Run:
        self.context.addJobTag(self.tag)
        return self

    def __exit__(self, *_: object) -> None:
        self.context.removeJobTag(self.tag)
        self.context.setLocalProperty("spark.job.description", None)

    def progress(self, percent: int, step: str) -> None:
        self.steps.append((percent, step))
        self.context.setJobDescription(f"{self.job}: {step} ({percent} %)")

    def tasks(self) -> tuple[int, int]:
        """Tasks of this run's jobs that are done, and all that are known so far, by the status tracker."""
        tracker = self.context._jsc.sc().statusTracker()
        done = every = 0
        for job in tracker.getJobIdsForTag(self.tag):
            found = tracker.getJobInfo(job)
            for stage in found.get().stageIds() if found.isDefined() else ():
                info = tracker.getStageInfo(stage)
                if info.isDefined():
                    done, every = done + info.get().numCompletedTasks(), every + info.get().numTasks()
        return done, every

    def cancel(self) -> None:
        """Ends the tasks that run, and the run at its next step."""
        self.stopped = True
        self.context.cancelJobsWithTag(self.tag)

    def cancelled(self) -> bool:
        return self.stopped
