"""Cleaning, metadata and intent queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates, prompts, records, scores, text
from . import sqltext as q
from .catalog import query, table


@query(
    "P1", "P2",
    sql=f"SELECT doc_id, {q.name('text')} AS name, {q.email('text')} AS email FROM documents",
)
def contact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", text.leading_name(F.col("text")).alias("name"), text.first_email(F.col("text")).alias("email")
    )


_PRINTABLE = f"regexp_replace(text, '{q.UNPRINTABLE}', ' ', 'g')"
_COLLAPSED = f"regexp_replace(regexp_replace({_PRINTABLE}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
CLEANED_SQL = f"SELECT *, {q.strip(_COLLAPSED)} AS stripped FROM documents"


@query(
    "P3", "P4", "P5", "P6",
    sql=f"""
    WITH cleaned AS ({CLEANED_SQL}),
    cut AS (SELECT doc_id, nullif({q.first_words('stripped', text.EMBEDDING_WORD_LIMIT)}, '') AS cleaned FROM cleaned)
    SELECT doc_id, cleaned, length(cleaned) AS n_chars FROM cut
    """,
)
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").repartition("doc_id")
    cleaned = docs.select("doc_id", text.embeddable(F.col("text")).alias("cleaned"))
    return cleaned.select("doc_id", "cleaned", F.length("cleaned").cast("long").alias("n_chars"))


@query(
    "P5",
    sql=f"""
    WITH cleaned AS ({CLEANED_SQL})
    SELECT doc_id, md5({q.first_words('stripped', 200)}) AS digest FROM cleaned
    """,
)
def short_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").repartition("doc_id")
    return docs.select("doc_id", F.md5(text.clean_for_embedding(F.col("text"), 200)).alias("digest"))


_KEPT = f"[k for k in {q.lines('text')} if NOT regexp_full_match(k, '[\\-=_*.]{{3,}}')]"


@query(
    "P7",
    sql=f"""
    WITH body AS (SELECT *, array_to_string({_KEPT}, chr(10)) AS body FROM documents)
    SELECT doc_id, 'Candidate: ' || {q.name('text')} || chr(10) || 'Email: ' || {q.email('text')}
        || chr(10) || chr(10) || {q.first_words('body', text.SEARCH_WORD_LIMIT)} AS chunk
    FROM body
    """,
)
def searchable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").repartition("doc_id")
    name, email = text.leading_name(F.col("text")), text.first_email(F.col("text"))
    return docs.select("doc_id", text.searchable_text(F.col("text"), name, email).alias("chunk"))


@query(
    "P8",
    sql=f"""
    SELECT doc_id, regexp_replace({q.email('text')}, '[^a-zA-Z0-9._\\-]', '_', 'g') || '__'
        || regexp_replace(source || '/cv ' || lang || ' ' || doc_id || '.docx', '[^a-zA-Z0-9._\\-]', '_', 'g')
        AS record_key
    FROM documents
    """,
)
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filename = F.concat("source", F.lit("/cv "), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".docx"))
    return docs.select("doc_id", text.record_key(text.first_email(F.col("text")), filename).alias("record_key"))


@query(
    "P9",
    sql="""
    SELECT event_id, CASE WHEN (props::JSON ->> 'k')::BIGINT = 0 THEN ''
        ELSE 'k: ' || (props::JSON ->> 'k') END AS flat
    FROM events
    """,
)
def flattened_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", records.flatten_json(F.col("props")).alias("flat"))


@query(
    "P9",
    sql="""
    SELECT item, concat_ws(' ', 'p_name: ' || p_name, 'p_brand: ' || p_brand,
        CASE WHEN size <> 0 THEN 'size: ' || size END) AS flat
    FROM (SELECT p_partkey AS item, nullif(p_name, '') AS p_name, nullif(p_brand, '') AS p_brand,
        p_size - 10 AS size FROM part)
    """,
)
def flattened_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("size", F.col("p_size") - 10)
    flat = records.flatten_columns(["p_name", "p_brand", "size"], parts.schema)
    return parts.select(F.col("p_partkey").alias("item"), flat.alias("flat"))


@query(
    "P11",
    sql="""
    SELECT event_id, coalesce(strftime(CASE WHEN event_type <> 'error' THEN ts END, '%Y-%m-%d'), 'N/A') AS uploaded
    FROM events
    """,
)
def upload_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stamp = F.when(F.col("event_type") != "error", F.col("ts"))
    return events.select("event_id", text.upload_date(stamp).alias("uploaded"))


@query(
    "P12", "P13",
    sql="""
    SELECT event_id, upper(event_type[1]) || event_type[2:] || ' Agent' AS agent,
        printf('%.4f', round(value / 7, 4)) AS score
    FROM events
    """,
)
def agent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        text.agent_label(F.concat("event_type", F.lit("_agent"))).alias("agent"),
        text.score_text(F.round(F.col("value") / 7, 4)).alias("score"),
    )


_OUTPUT_SQL = """
    CASE event_type WHEN 'error' THEN 'Error: ' || props WHEN 'view' THEN 'see' || chr(10) || '  print(' || props || ')'
        WHEN 'signup' THEN '  import ' || props WHEN 'click' THEN 'Traceback ' || props ELSE props END
"""


def _outputs(events: DataFrame) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    shown = (
        F.when(kind == "error", F.concat(F.lit("Error: "), props))
        .when(kind == "view", F.concat(F.lit("see\n  print("), props, F.lit(")")))
        .when(kind == "signup", F.concat(F.lit("  import "), props))
        .when(kind == "click", F.concat(F.lit("Traceback "), props))
        .otherwise(props)
    )
    return events.select("event_id", shown.alias("output"))


@query(
    "P15", "P16",
    sql=f"""
    WITH outputs AS (SELECT event_id, {_OUTPUT_SQL} AS output FROM events)
    SELECT event_id,
        CASE WHEN starts_with({q.strip('output')}, 'Traceback') OR contains(output, 'Error') THEN 'error'
            WHEN len([l for l in {q.lines('output')} if regexp_matches(l, '^(def |class |import |print|#)')]) > 0
            THEN 'code' ELSE 'markdown' END AS kind,
        regexp_matches({q.strip('output')}, '^(def|print|import|#|for|while|if)') AS code_like
    FROM outputs
    """,
)
def output_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = _outputs(table(spark, sf_dir, "events"))
    return outputs.select(
        "event_id",
        text.output_kind(F.col("output")).alias("kind"),
        text.looks_like_code(F.col("output")).alias("code_like"),
    )


@query(
    "P15", "P16",
    sql=f"""
    SELECT conv_id, turn,
        CASE WHEN starts_with({q.strip('text')}, 'Traceback') OR contains(text, 'Error') THEN 'error'
            WHEN len([l for l in {q.lines('text')} if regexp_matches(l, '^(def |class |import |print|#)')]) > 0
            THEN 'code' ELSE 'markdown' END AS kind,
        regexp_matches({q.strip('lower(text)')}, '^(def|print|import|#|for|while|if)') AS code_like
    FROM conversations
    """,
)
def message_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return messages.select(
        "conv_id",
        "turn",
        text.output_kind(F.col("text")).alias("kind"),
        text.looks_like_code(F.lower("text")).alias("code_like"),
    )


_MESSAGE_SQL = """
    CASE event_type WHEN 'signup' THEN ' Upload MORE ' || props WHEN 'error' THEN 'please RESTART '
        WHEN 'purchase' THEN 'only matched, show table ' || props
        WHEN 'click' THEN 'Set results ' || (user_id - 10) WHEN 'view' THEN
        CASE WHEN user_id > 20 THEN 'db stats' ELSE 'set results many' END ELSE props END
"""


@query(
    "P17", "P18",
    sql=f"""
    WITH messages AS (SELECT event_id, lower({q.strip(_MESSAGE_SQL)}) AS m FROM events),
    lasts AS (SELECT *, ({q.words('m')})[-1] AS last FROM messages)
    SELECT event_id,
        CASE WHEN contains(m, 'more resumes') OR contains(m, 'upload more') OR contains(m, 'add resumes') THEN 'more'
            WHEN contains(m, 'restart') OR contains(m, 'reset') OR contains(m, 'new jd') OR contains(m, 'start over')
            THEN 'restart'
            WHEN contains(m, 'result') OR contains(m, 'rank') OR contains(m, 'show') OR contains(m, 'table')
            THEN 'results'
            WHEN contains(m, 'db stats') THEN 'stats' ELSE 'other' END AS matcher,
        CASE WHEN starts_with(m, 'set results') THEN 'set_results'
            WHEN contains(m, 'only shortlisted') OR contains(m, 'only matched') THEN 'only_matched'
            WHEN contains(m, 'show all') OR contains(m, 'remove filter') THEN 'show_all'
            WHEN contains(m, 'db stats') THEN 'stats' ELSE 'query' END AS search,
        CASE WHEN starts_with(m, 'set results') AND regexp_full_match(last, '[+-]?[0-9]+')
            THEN greatest(1, least(20, last::BIGINT))::INTEGER ELSE 0 END AS wanted
    FROM lasts
    """,
)
def message_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    message = (
        F.when(kind == "signup", F.concat(F.lit(" Upload MORE "), props))
        .when(kind == "error", F.lit("please RESTART "))
        .when(kind == "purchase", F.concat(F.lit("only matched, show table "), props))
        .when(kind == "click", F.concat(F.lit("Set results "), (F.col("user_id") - 10).cast("string")))
        .when(kind == "view", F.when(F.col("user_id") > 20, F.lit("db stats")).otherwise(F.lit("set results many")))
        .otherwise(props)
    )
    messages = table(spark, sf_dir, "events").select("event_id", message.alias("m"))
    return messages.select(
        "event_id",
        text.matcher_intent(F.col("m")).alias("matcher"),
        text.search_intent(F.col("m")).alias("search"),
        F.coalesce(text.requested_results(F.col("m")), F.lit(0)).alias("wanted"),
    )


@query(
    "P14",
    sql="""
    SELECT p_partkey, CASE WHEN p_size % 3 <> 0 AND p_size % 5 <> 0
        AND (CASE WHEN p_size % 2 = 0 THEN 0.1 WHEN p_size % 7 = 0 THEN 0.0 END) <> 0
        THEN 'lora' ELSE 'traditional' END AS method
    FROM part
    """,
)
def training_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    dropout = F.when(size % 2 == 0, F.lit(0.1)).when(size % 7 == 0, F.lit(0.0))
    method = scores.training_method(size % 3, size % 5, dropout)
    return table(spark, sf_dir, "part").select("p_partkey", method.alias("method"))


_BLOCKED_SQL = (
    r"(^|[^\p{L}\p{N}_])(java|javascript|typescript|go|ruby|rust|swift|kotlin|perl|php|haskell|scala|r|matlab|sql|bash"
    r"|shell|powershell|vb\.net|dart)([^\p{L}\p{N}_]|$)|(^|[^\p{L}\p{N}_])(c\+\+|c#)[\p{L}\p{N}_]"
)
_OPEN_SQL = " OR ".join(f"contains(p, {q.quoted(k)})" for k in dict.fromkeys(gates.TOPIC_KEYWORDS))


@query(
    "F7",
    sql=f"""
    WITH prompts AS (SELECT conv_id, turn, lower(text) AS p FROM conversations)
    SELECT conv_id, turn, NOT regexp_matches(p, '{_BLOCKED_SQL}') AND ({_OPEN_SQL}) AS accepted FROM prompts
    """,
)
def topic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return messages.select("conv_id", "turn", gates.topic_gate(F.col("text")).alias("accepted"))


DATA_BLOCKED = ("der", "von", "les ")
DATA_KEYWORDS = ("the", "Die", "que", "con")


@query(
    "F7",
    sql=r"""
    WITH prompts AS (SELECT doc_id, lower(text) AS p FROM documents)
    SELECT doc_id,
        NOT regexp_matches(p, '(^|[^\p{L}\p{N}_])(der|von|les)([^\p{L}\p{N}_]|$)')
            AND (contains(p, 'the') OR contains(p, 'Die') OR contains(p, 'que') OR contains(p, 'con')) AS by_substring,
        NOT regexp_matches(p, '(^|[^\p{L}\p{N}_])(der|von|les)([^\p{L}\p{N}_]|$)')
            AND regexp_matches(p, '(^|[^\p{L}\p{N}_])(the|die|que|con)([^\p{L}\p{N}_]|$)') AS by_word
    FROM prompts
    """,
)
def topic_gate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prompt = F.col("text")
    return docs.select(
        "doc_id",
        gates.topic_gate(prompt, DATA_BLOCKED, DATA_KEYWORDS).alias("by_substring"),
        gates.topic_gate(prompt, DATA_BLOCKED, DATA_KEYWORDS, mode="word").alias("by_word"),
    )


@query(
    "F12", "F13",
    sql=f"""
    WITH found AS (
        SELECT item_id, [w for w in regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')
            if length(w) > 2 AND w NOT IN ({q.listed(text.QUERY_STOP_WORDS)})] AS ws
        FROM benchmark WHERE {q.strip('text')} <> '')
    SELECT item_id, array_to_string(ws, ' ') AS keywords FROM found
    """,
)
def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import asked_queries

    items = asked_queries(table(spark, sf_dir, "benchmark"), "text")
    return items.select("item_id", F.array_join(text.query_keywords(F.col("text")), " ").alias("keywords"))


@query(
    "R6",
    sql="""
    SELECT doc_id, 'Process: ' || text[1:100] AS input, md5(text) AS target_digest FROM documents
    """,
)
def summary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", prompts.summary_input(F.col("text")).alias("input"), F.md5("text").alias("target_digest")
    )


@query(
    "R8",
    sql=f"""
    SELECT conv_id, turn, {q.quoted(prompts.JUDGE_HEAD)} || text || {q.quoted(prompts.JUDGE_TAIL)} AS prompt
    FROM conversations WHERE role = 'user'
    """,
)
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", prompts.judge_prompt(F.col("text")).alias("prompt"))
