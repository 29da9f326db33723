"""Usage metrics of a query log ``(session_id, ts, agent_type, response_time)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Agents with a counter of their own.
AGENTS = ("conversational", "factual_agent", "analytical_agent", "complex_agent")
FAILED = "error"


def recorded(log: DataFrame) -> DataFrame:
    """Failed questions are not part of the metrics."""
    return log.filter(F.col("agent_type") != FAILED)


def response_seconds(started: Column, finished: Column) -> Column:
    return (F.unix_micros(finished) - F.unix_micros(started)) / F.lit(1_000_000.0)


def usage_counts(log: DataFrame, keys: Sequence[str] = ("session_id",), agents: Sequence[str] = AGENTS) -> DataFrame:
    """Total, per-agent counts and mean response time; unknown agents count in the total only.

    Counts and sums combine before the shuffle, so a busy session costs one
    partial row per task.
    """
    counters = [F.count_if(F.col("agent_type") == a).alias(a) for a in agents]
    return recorded(log).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"), *counters, F.avg("response_time").alias("avg_response_time")
    )


def usage_shares(counts: DataFrame, agents: Sequence[str] = AGENTS) -> DataFrame:
    """Each agent's share in percent, one decimal."""
    for agent in agents:
        share = F.when(
            F.col("total_queries") > 0,
            F.round(F.lit(100.0) * F.col(agent) / F.nullif(F.col("total_queries"), F.lit(0)), 1),
        )
        counts = counts.withColumn(f"{agent}_share", share)
    return counts
