"""Stage metrics of real runs, as rows that ``samples.stage_rollup`` and ``samples.phase_split`` take."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STAGES = """run_id string, stage_id bigint, attempt bigint, name string, tasks bigint, stage_duration_ms bigint,
  executor_run_time_ms bigint, executor_cpu_time_ms bigint, input_bytes_read bigint, input_rows bigint, shuffle_read_bytes bigint,
  shuffle_write_bytes bigint, result_size_bytes bigint"""
WALLS = "run_id string, wall_ms double"


class Run:
    """A named run whose jobs the application's own status store keeps."""

    def __init__(self, spark: SparkSession, run_id: str):
        self.spark, self.run_id = spark, run_id
        self.wall_ms: float | None = None

    def _jobs(self, store) -> set[int]:
        """Ids of all stages of the run's jobs."""
        jobs, ids = store.jobsList(None), set()
        for i in range(jobs.size()):
            job = jobs.apply(i)
            if job.jobGroup().isDefined() and job.jobGroup().get() == self.run_id:
                stages = job.stageIds()
                ids.update(int(stages.apply(j)) for j in range(stages.size()))
        return ids

    def stages(self) -> DataFrame:
        """One row per executed stage attempt of the run; skipped stages ran in no task and have none.

        Read from the status store of the running application (no port, no page); it holds the last
        ``spark.ui.retainedStages`` stages, which bounds the rows.
        """
        context = self.spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()  # metrics arrive behind the jobs
        store = context.statusStore()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        wanted = self._jobs(store)
        listed = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        rows = []
        for i in range(listed.size()):
            s = listed.apply(i)
            if s.stageId() not in wanted or not (s.submissionTime().isDefined() and s.completionTime().isDefined()):
                continue
            rows.append((
                self.run_id, s.stageId(), s.attemptId(), s.name(), s.numCompleteTasks(),
                s.completionTime().get().getTime() - s.submissionTime().get().getTime(),
                s.executorRunTime(), s.executorCpuTime() // 1_000_000, s.inputBytes(), s.inputRecords(),
                s.shuffleReadBytes(), s.shuffleWriteBytes(), s.resultSize(),
            ))
        return self.spark.createDataFrame(sorted(rows), STAGES)

    def walls(self) -> DataFrame:
        return self.spark.createDataFrame([(self.run_id, self.wall_ms)], WALLS)


@contextmanager
def recorded(spark: SparkSession, run_id: str) -> Iterator[Run]:
    """Run the jobs inside under one job group and measure the time around them.

    Ids of runs should differ, as jobs of an earlier run of this id in the same application count too.
    """
    context = spark.sparkContext
    before = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")
    run, begin = Run(spark, run_id), time.perf_counter()
    context.setJobGroup(run_id, run_id)
    try:
        yield run
    finally:
        run.wall_ms = (time.perf_counter() - begin) * 1000
        context.setLocalProperty("spark.jobGroup.id", before[0])
        context.setLocalProperty("spark.job.description", before[1])
