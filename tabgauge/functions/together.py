"""Independent jobs at the same time."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(spark: SparkSession, *tasks: Callable) -> list:
    """Results of tasks that each start Spark jobs; the cluster runs them side by
    side, so that one job's last stragglers do not leave it idle."""
    if len(tasks) == 1:
        return [tasks[0]()]
    with ThreadPool(len(tasks)) as pool:
        return pool.map(lambda task: inheritable_thread_target(spark)(task)(), tasks)
