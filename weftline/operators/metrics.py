"""Operation metrics: report per operation, comparison of threaded and sequential runs, recommendations."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def history(runs: DataFrame, operation: str | None = None) -> DataFrame:
    """The runs of one operation; all for none or ''."""
    return runs.filter(F.col("operation") == operation) if operation else runs


def report(runs: DataFrame, operation: str | None = None) -> DataFrame:
    """(operation, total_runs, successful_runs, avg_duration, threaded) per operation. ``runs``: operation, duration, threaded, success."""
    runs = history(runs, operation)
    ok = F.coalesce(F.col("success"), F.lit(False))
    return runs.groupBy("operation").agg(
        F.count("*").alias("total_runs"), F.count_if(ok).alias("successful_runs"), F.round(F.coalesce(F.avg(F.when(ok, F.coalesce("duration", F.lit(0.0)))), F.lit(0.0)), 6).alias("avg_duration"),
        F.coalesce(F.bool_or("threaded"), F.lit(False)).alias("threaded"))


def throughput(items: Column, duration: Column) -> Column:
    """Items a second; null where either is not above 0."""
    return F.when((items > 0) & (duration > 0), items / duration)


def comparison(runs: DataFrame) -> DataFrame:
    """Averages of threaded and sequential successful runs, improvement in percent and speedup; null where a side is missing or 0.

    ``runs``: operation, duration, items, threaded, success.
    """
    ok, per = F.col("success"), F.coalesce(throughput(F.col("items"), F.col("duration")), F.lit(0.0))
    side = lambda x, threaded: F.avg(F.when(ok & (F.col("threaded") == threaded), x))
    c = runs.groupBy("operation").agg(
        F.count_if(ok & F.col("threaded")).alias("threaded_runs"), F.count_if(ok & ~F.col("threaded")).alias("sequential_runs"),
        side(F.col("duration"), True).alias("td"), side(F.col("duration"), False).alias("sd"), side(per, True).alias("tt"), side(per, False).alias("st"))
    return c.select(
        "operation", "threaded_runs", "sequential_runs", F.round("td", 6).alias("avg_threaded_duration"), F.round("sd", 6).alias("avg_sequential_duration"),
        F.round("tt", 6).alias("avg_threaded_throughput"), F.round("st", 6).alias("avg_sequential_throughput"),
        F.round(F.try_divide(F.col("sd") - F.col("td"), F.col("sd")) * 100, 6).alias("time_improvement_percent"),
        F.round(F.try_divide(F.col("tt") - F.col("st"), F.col("st")) * 100, 6).alias("throughput_improvement_percent"),
        F.round(F.try_divide(F.col("sd"), F.col("td")), 6).alias("speedup_factor"))


#: Cores that suffice for threads, and the speedup of a core by the rule of thumb.
ENOUGH_CORES, PER_WORKER = 4, 0.7


def estimated_speedup(workers: Column) -> Column:
    """The rule of thumb, not a measurement."""
    return workers * PER_WORKER


def megabytes(n: Column) -> Column:
    return n / 1024 / 1024


def cores_advice(cores: Column) -> Column:
    return F.when(cores >= ENOUGH_CORES, "sufficient").otherwise("limited")


def system_info(spark) -> DataFrame:
    """One row on the driver's machine: cores, memory in GB, memory in use in percent."""
    import os

    memory = {}
    try:
        with open("/proc/meminfo") as f:
            memory = {k: int(v.split()[0]) for k, _, v in (line.partition(":") for line in f)}
    except OSError:
        pass
    total, free = memory.get("MemTotal"), memory.get("MemAvailable")
    used = 100.0 * (1 - free / total) if total and free is not None else None
    gb = lambda x: None if x is None else x / 1024**2
    return spark.createDataFrame([(os.cpu_count(), gb(total), gb(free), used)], "cpu_logical_cores int, memory_total_gb double, memory_available_gb double, memory_usage_percent double")


def recommendations(compared: DataFrame) -> DataFrame:
    """(operation, advice) of the operations with a speedup."""
    s = F.col("speedup_factor")
    return compared.filter(s.isNotNull()).select("operation", F.when(s > 1.5, "excellent").when(s > 1.2, "good").otherwise("minimal").alias("advice"))


@contextmanager
def monitored(sink: list[dict], operation: str, *, threaded: bool = False, items: int = 0):
    """Appends one metric record to ``sink`` whether the block succeeds or fails; create a DataFrame of them for ``report``."""
    start, error = time.time(), None
    try:
        yield
    except Exception as e:
        error = str(e)
        raise
    finally:
        sink.append({"operation": operation, "start_time": start, "duration": time.time() - start, "items": items, "threaded": threaded, "success": error is None, "error": error})
