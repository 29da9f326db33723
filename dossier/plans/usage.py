"""Usage metric queries: events as the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage
from .catalog import query, table

# Event kinds in the role of agents; purchases are an agent without a counter.
ROLES = {"click": "conversational", "view": "factual_agent", "signup": "analytical_agent", "error": "error"}
ROLE_SQL = """
    SELECT user_id AS session_id, ts, value AS response_time, CASE event_type WHEN 'click' THEN 'conversational'
        WHEN 'view' THEN 'factual_agent' WHEN 'signup' THEN 'analytical_agent' WHEN 'error' THEN 'error'
        ELSE 'unknown' END AS agent_type
    FROM events
"""


def query_log(events: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for pair in ROLES.items() for x in pair]
    agent = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("event_type")), F.lit("unknown"))
    return events.select(
        F.col("user_id").alias("session_id"), "ts", agent.alias("agent_type"), F.col("value").alias("response_time")
    )


_COUNTS_SQL = f"""
    log AS ({ROLE_SQL}),
    counted AS (
        SELECT session_id, count(*) AS total_queries,
            count(*) FILTER (agent_type = 'conversational') AS conversational,
            count(*) FILTER (agent_type = 'factual_agent') AS factual_agent,
            count(*) FILTER (agent_type = 'analytical_agent') AS analytical_agent,
            count(*) FILTER (agent_type = 'complex_agent') AS complex_agent,
            round(avg(response_time), 10) AS avg_response_time
        FROM log WHERE agent_type <> 'error' GROUP BY session_id)
"""


@query("A2", "A3", "C10", sql=f"WITH {_COUNTS_SQL} SELECT * FROM counted")
def usage_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = usage.usage_counts(query_log(table(spark, sf_dir, "events")))
    return counted.withColumn("avg_response_time", F.round("avg_response_time", 10))


@query(
    "A4",
    sql=f"""
    WITH {_COUNTS_SQL}
    SELECT session_id, round(100.0::DOUBLE * conversational / total_queries, 1) AS conversational_share,
        round(100.0::DOUBLE * factual_agent / total_queries, 1) AS factual_agent_share,
        round(100.0::DOUBLE * analytical_agent / total_queries, 1) AS analytical_agent_share,
        round(100.0::DOUBLE * complex_agent / total_queries, 1) AS complex_agent_share
    FROM counted
    """,
)
def usage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = usage.usage_shares(usage.usage_counts(query_log(table(spark, sf_dir, "events"))))
    return shares.select("session_id", *[f"{a}_share" for a in usage.AGENTS])


@query(
    "A3",
    sql="""
    SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1000000.0::DOUBLE AS seconds
    FROM events
    """,
)
def response_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    taken = usage.response_seconds(F.date_trunc("hour", "ts"), F.col("ts"))
    return events.select("event_id", taken.alias("seconds"))
