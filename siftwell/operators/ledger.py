"""Rate limits, budgets, logs and spend, as windows over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_MINUTE, PER_DAY, BUDGET = 5, 20, 2.0


def utc_day(epoch: Column) -> Column:
    """The UTC day of epoch seconds as text, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(epoch / 86_400).cast("int")).cast("string")


def minute_counts(events: DataFrame, key: str, epoch: str, seconds: float = 60) -> DataFrame:
    """``recent``: earlier events of the key in the last ``seconds``, the lower bound excluded."""
    order = Window.partitionBy(key).orderBy(epoch)
    inside = F.count("*").over(order.rangeBetween(-seconds, 0))
    now = F.count("*").over(Window.partitionBy(key, epoch))
    edge = F.count("*").over(order.rangeBetween(-seconds, -seconds))
    return events.withColumn("recent", inside - now - edge)


def day_counts(events: DataFrame, key: str, epoch: str) -> DataFrame:
    """``today``: earlier events of the key on the same UTC day; ``day`` is that day."""
    rows = events.withColumn("day", utc_day(F.col(epoch)))
    before = Window.partitionBy(key, "day").orderBy(epoch).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    now = F.count("*").over(Window.partitionBy(key, epoch))
    return rows.withColumn("today", F.count("*").over(before) - now)


def verdict(recent: Column, today: Column, spent: Column, per_minute: int = PER_MINUTE, per_day: int = PER_DAY, budget: float = BUDGET) -> Column:
    return F.when(recent >= per_minute, "minute").when(today >= per_day, "day").when(spent >= budget, "budget").otherwise("ok")


def last_status(log: DataFrame, key: str = "job_id", at: str = "ts", status: str = "status") -> DataFrame:
    """The latest status of each job."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(at, status)).alias("status"), F.max(at).alias("updated_at"), F.count("*").alias("n_events"))


def interrupted(jobs: DataFrame) -> DataFrame:
    """After a restart: what ran has been interrupted; resumable are interrupted and failed jobs."""
    status = F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status"))
    return jobs.withColumn("status", status).withColumn("resumable", F.col("status").isin("interrupted", "failed"))


def numbered(log: DataFrame, key: str, by: list[str], first: int = 0) -> DataFrame:
    return log.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*by)) - 1 + first)


def resume(queries: DataFrame, results: DataFrame, keys: list[str], retry_failed: bool = False) -> DataFrame:
    """Queries without a recorded result; failed ones count as recorded unless they are to be retried."""
    done = results.where("status <> 'failed'") if retry_failed else results
    return queries.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def within_cap(costs: DataFrame, run: str, by: list[str], actual: str, estimate: str, cap: str) -> DataFrame:
    """Queries of each run that are reached before spent + estimate would pass the cap; the first that would ends the run."""
    order = Window.partitionBy(run).orderBy(*by)
    spent = F.coalesce(F.sum(actual).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = costs.withColumn("spent_before", spent)
    over = F.max((F.round(F.col("spent_before") + F.col(estimate), 9) > F.col(cap)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("admitted", over == 0)
