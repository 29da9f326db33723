"""Message history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversations
from .catalog import query, table


def chained(messages: DataFrame) -> DataFrame:
    """The given conversations strung together into two, of any number of messages."""
    turn = F.col("conv_id") * 1000 + F.col("turn")
    return messages.select((F.col("conv_id") % 2).alias("conv_id"), turn.alias("turn"), "role", "text")


_CHAINED_SQL = "chained AS (SELECT conv_id % 2 AS conv_id, conv_id * 1000 + turn AS turn, role, text FROM conversations)"
_PLACED_SQL = f"""
    {_CHAINED_SQL},
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM chained)
"""


@query(
    "W4",
    sql=f"""
    WITH {_CHAINED_SQL}
    SELECT conv_id, turn, coalesce(array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history
    FROM chained
    """,
)
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = conversations.recent_history(chained(table(spark, sf_dir, "conversations")))
    shown = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return told.select("conv_id", "turn", F.array_join(shown, "\n").alias("history"))


@query("C2", sql=f"WITH {_PLACED_SQL} SELECT conv_id, position, role, text AS content FROM placed")
def whole_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.whole_conversations(chained(table(spark, sf_dir, "conversations")))


@query(
    "R9",
    sql=f"""
    WITH {_PLACED_SQL},
    rendered AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS said FROM placed)
    SELECT conv_id, position, coalesce(sum(length(said)) OVER (PARTITION BY conv_id ORDER BY position
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, said
    FROM rendered
    """,
)
def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_texts(chained(table(spark, sf_dir, "conversations")))


@query(
    "C3",
    sql="""
    WITH said AS (SELECT conv_id, turn, role, CASE length(text) % 10 WHEN 0 THEN '/clear' WHEN 5 THEN ' /Clear' ELSE text END AS text
        FROM conversations),
    cleared AS (SELECT conv_id, max(turn) AS last FROM said WHERE lower(trim(text)) = '/clear' GROUP BY conv_id)
    SELECT s.conv_id, turn, role, text FROM said s LEFT JOIN cleared c USING (conv_id)
    WHERE last IS NULL OR turn > last
    """,
)
def messages_since_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").withColumn(
        "text",
        F.when(F.length("text") % 10 == 0, F.lit("/clear"))
        .when(F.length("text") % 10 == 5, F.lit(" /Clear"))
        .otherwise(F.col("text")),
    )
    return conversations.since_clear(said).select("conv_id", "turn", "role", "text")


@query(
    "C1", "O1",
    sql="""
    WITH asked AS (
        SELECT conv_id, 'Again: ' || text AS question, 'Re: ' || text AS response,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth
        FROM conversations WHERE role = 'user'),
    reached AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT conv_id, last + 2 * nth - 1, 'user', question FROM asked JOIN reached USING (conv_id)
    UNION ALL SELECT conv_id, last + 2 * nth, 'assistant', response FROM asked JOIN reached USING (conv_id)
    """,
)
def appended_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "conversations")
    asked = history.filter("role = 'user'").select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.concat(F.lit("Again: "), "text").alias("question"),
        F.concat(F.lit("Re: "), "text").alias("response"),
    )
    return conversations.append_exchanges(history, asked)
