"""Streaming jobs run over the given tables until their input is used up."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..session import work_folder
from ..streaming import jobs, seen
from .catalog import query, table
from .usage import ROLE_SQL, query_log


@query(
    "ST2", "A2", "A3",
    sql=f"""
    WITH log AS (SELECT *, date_trunc('hour', ts) AS hour FROM ({ROLE_SQL}) WHERE agent_type <> 'error'),
    newest AS (SELECT max(ts) AS ts FROM events)
    SELECT strftime(hour, '%Y-%m-%d %H:%M') AS hour, count(*) AS total_queries,
        count(*) FILTER (agent_type = 'conversational') AS conversational,
        count(*) FILTER (agent_type = 'factual_agent') AS factual_agent,
        round(avg(response_time), 10) AS avg_response_time
    FROM log
    WHERE hour + INTERVAL 1 HOUR <= (SELECT ts - INTERVAL 10 MINUTE FROM newest) GROUP BY hour
    """,
)
def streamed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly usage of the windows the watermark has closed."""
    folder = work_folder(spark, "usage")
    stream = query_log(jobs.table_stream(spark, f"{sf_dir}/events.parquet"))
    jobs.append_to_table(jobs.windowed_usage(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    closed = spark.read.parquet(f"{folder}/out")
    return closed.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"),
        "total_queries", "conversational", "factual_agent",
        F.round("avg_response_time", 10).alias("avg_response_time"),
    )


@query(
    "ST1", "K3", "W5",
    sql="""
    WITH uploads AS (
        SELECT user_id, ts, value, event_id FROM events
        UNION ALL SELECT user_id, ts + INTERVAL 1 DAY, value * 2, event_id FROM events WHERE user_id % 2 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM uploads)
    SELECT 'user ' || user_id AS doc_id, round(value / 7, 4) AS hybrid_score, event_id AS upload FROM ranked WHERE nth = 1
    """,
)
def streamed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uploads in several micro-batches, replayed by a second run, compacted, then added to by a third."""
    folder = work_folder(spark, "upserts")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    events.repartitionByRange(4, "event_id").write.parquet(f"{folder}/in")
    again = events.filter("user_id % 2 = 0").withColumn("value", F.col("value") * 2)
    again.withColumn("ts", F.expr("ts + INTERVAL 1 DAY")).write.parquet(f"{folder}/later")

    def rows(batch: DataFrame) -> DataFrame:
        return batch.select(
            F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("doc_id"),
            (F.col("value") / 7).alias("hybrid_score"),
            F.col("ts").alias("uploaded_at"),
            F.col("event_id").alias("batch_seq"),
        )

    for run, source in enumerate(("in", "in", "later")):
        stream = jobs.table_stream(spark, f"{folder}/{source}", files_per_trigger=2)
        jobs.stream_upserts(stream, rows, f"{folder}/store", f"{folder}/checkpoint-{run}").awaitTermination()
        if run == 1:
            store.compact(spark, f"{folder}/store")
    current = store.read_store(spark, f"{folder}/store")
    return current.select("doc_id", "hybrid_score", F.col("batch_seq").alias("upload"))


_BATCHES_SQL = """
    batches AS (
        SELECT *, (epoch(ts) - epoch(TIMESTAMP '2024-01-01'))::BIGINT // 691200 AS batch, '' AS note FROM events
        UNION ALL
        SELECT *, 9, 'late-' FROM events WHERE (epoch(ts) - epoch(TIMESTAMP '2024-01-01'))::BIGINT // 691200 = 0)
"""


def event_batches(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Events as a stream of files, one for every eight days and at last the first eight days again, marked as late."""
    events = table(spark, sf_dir, "events")
    number = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200)) / 691_200)
    marked = events.withColumn("note", F.lit("")).withColumn("_batch", number)
    count = marked.agg(F.max("_batch").alias("n")).first()["n"] + 1
    for batch in range(count):  # one job a file: files are streamed in the order they were written
        marked.filter(F.col("_batch") == batch).drop("_batch").coalesce(1).write.mode("append").parquet(folder)
    late = marked.filter("_batch = 0").withColumn("note", F.lit("late-"))
    late.drop("_batch").coalesce(1).write.mode("append").parquet(folder)
    return jobs.table_stream(spark, folder, files_per_trigger=1)


@query(
    "ST4", "F10",
    sql=f"""
    WITH {_BATCHES_SQL},
    named AS (
        SELECT note || event_type || '-' || user_id || '.docx' AS filename, ts, dense_rank() OVER (ORDER BY batch) - 1 AS batch,
            (epoch(ts)::BIGINT // 604800) * 604800 AS period FROM batches),
    newest AS (SELECT batch, max(ts) AS ts FROM named GROUP BY batch),
    closed AS (SELECT b.batch, max(e.ts) - INTERVAL 1 DAY AS ts FROM newest b LEFT JOIN newest e ON e.batch < b.batch GROUP BY b.batch)
    SELECT filename, period, min(n.batch)::INTEGER AS batch FROM named n JOIN closed c USING (batch)
    WHERE c.ts IS NULL OR period + 604800 > floor(epoch(c.ts)) GROUP BY filename, period
    """,
)
def streamed_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that are new in their week, over several micro-batches; the last one is too late."""
    folder = work_folder(spark, "files")
    stream = event_batches(spark, sf_dir, f"{folder}/in").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat("note", "event_type", F.lit("-"), F.col("user_id").cast("string"), F.lit(".docx")).alias("filename"),
    )
    seen.stream_new_files(stream, f"{folder}/memory", f"{folder}/checkpoint", timedelta(days=7), timedelta(days=1)).awaitTermination()
    return seen.new_files(spark, f"{folder}/memory").select("filename", "period", "batch")


@query(
    "ST2", "A2", "A3",
    sql=f"""
    WITH log AS (
        SELECT user_id AS session_id, ts, value AS response_time, CASE event_type WHEN 'click' THEN 'conversational'
            WHEN 'view' THEN 'factual_agent' ELSE 'other' END AS agent_type
        FROM events WHERE event_type <> 'error'),
    begun AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS first FROM log),
    numbered AS (SELECT *, sum(first) OVER (PARTITION BY session_id ORDER BY ts) AS nth FROM begun)
    SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS session_start, count(*) AS total_queries,
        count(*) FILTER (agent_type = 'conversational') AS conversational,
        count(*) FILTER (agent_type = 'factual_agent') AS factual_agent,
        round(avg(response_time), 10) AS avg_response_time
    FROM numbered GROUP BY session_id, nth HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
    """,
)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of every closed session; sessions cross micro-batches, and rows that come a month late change nothing."""
    folder = work_folder(spark, "sessions")
    stream = query_log(event_batches(spark, sf_dir, f"{folder}/in"))
    jobs.append_to_table(jobs.session_usage(stream, "8 hours"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "session_id", F.date_format("session_start", "yyyy-MM-dd HH:mm").alias("session_start"), "total_queries",
        "conversational", "factual_agent", F.round("avg_response_time", 10).alias("avg_response_time"),
    )


@query(
    "ST3", "W4",
    sql="""
    SELECT conv_id, turn, role, coalesce(array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id
        ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history
    FROM conversations
    """,
)
def streamed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with the ten before it, from keyed state."""
    folder = work_folder(spark, "history")
    stream = jobs.table_stream(spark, f"{sf_dir}/conversations.parquet")
    provider = "spark.sql.streaming.stateStore.providerClass"
    earlier = spark.conf.get(provider)
    spark.conf.set(provider, jobs.ROCKSDB_PROVIDER)
    try:
        told = jobs.live_history(stream, lifetime=None)
        jobs.append_to_table(told, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(provider, earlier)
    return spark.read.parquet(f"{folder}/out").select("conv_id", "turn", "role", "history")


@query(
    "ST3", "W4", "C1",
    sql="""
    WITH timed AS (SELECT *, turn * 600 + (turn // 4) * 7200 AS second FROM conversations),
    begun AS (SELECT *, CASE WHEN second - lag(second) OVER (PARTITION BY conv_id ORDER BY turn) < 3600 THEN 0 ELSE 1 END AS first FROM timed),
    numbered AS (SELECT *, sum(first) OVER (PARTITION BY conv_id ORDER BY turn) AS session FROM begun)
    SELECT conv_id, turn, role, coalesce(array_to_string(list(role || ': ' || text) OVER (PARTITION BY conv_id, session
        ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history
    FROM numbered
    """,
)
def streamed_chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in several micro-batches; after a pause of two hours a conversation starts anew, and a late file changes nothing."""
    folder = work_folder(spark, "chats")
    turn = F.col("turn")
    second = F.lit(1_704_067_200) + turn * 600 + F.floor(turn / 4) * 7200
    messages = table(spark, sf_dir, "conversations").withColumn("ts", F.timestamp_seconds(second))
    last = messages.agg(F.max("turn").alias("n")).first()["n"] or 0
    for start in range(0, last + 1, 3):  # files are streamed in the order they were written
        messages.filter(turn.between(start, start + 2)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    messages.filter(turn < 2).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.table_stream(spark, f"{folder}/in", files_per_trigger=1)
    provider = "spark.sql.streaming.stateStore.providerClass"
    earlier = spark.conf.get(provider)
    spark.conf.set(provider, jobs.ROCKSDB_PROVIDER)
    try:
        jobs.append_to_table(jobs.session_history(stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(provider, earlier)
    return spark.read.parquet(f"{folder}/out").select("conv_id", "turn", "role", "history")
