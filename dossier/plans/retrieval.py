"""Nearest-neighbour, search, gate and answer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gates, prompts, scores, text
from ..operators import context, modelcalls, nearest, routing, search, store, vectorindex
from ..operators.chunking import window_chunks
from ..operators.conversations import recent_history
from ..operators.scaling import join_small
from ..session import checkpointed, work_folder
from . import sqltext as q
from .catalog import query, table
from .cleaning import CLEANED_SQL
from .matching import TFIDF_SQL
from .records import DOCX_SQL

_NEAREST_SQL = """
    WITH gaps AS (
        SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {gap} AS distance FROM embeddings a, embeddings b),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rk FROM gaps)
    SELECT query_id, vec_id, round(abs(distance), 6) AS distance, rk FROM ranked WHERE rk <= {k}
"""


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("V4", "W2", "J3", "L4", sql=_NEAREST_SQL.format(gap=q.distance("a.embedding", "b.embedding"), k=4))
def nearest_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest(
        _vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), 4, "l2", vector_id="vec_id"
    )
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rk")


@query("V5", "V1", "W2", "J3", sql=_NEAREST_SQL.format(gap="1 - " + q.cosine("a.embedding", "b.embedding"), k=5))
def nearest_by_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.nearest(
        _vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5, "cosine", vector_id="vec_id"
    )
    return found.select("query_id", "vec_id", F.round(F.abs("distance"), 6).alias("distance"), "rk")


@query(
    "V1",
    sql=f"""
    SELECT d.doc_id, round({q.cosine('a.embedding', 'list_reverse(a.embedding)')}, 6) AS similarity,
        round({q.distance('a.embedding', 'list_reverse(a.embedding)')}, 6) AS distance
    FROM documents d JOIN embeddings a ON a.vec_id = d.doc_id
    """,
)
def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    a, b = F.col("embedding"), F.reverse("embedding")
    return docs.join(vectors, "doc_id").select(
        "doc_id",
        F.round(scores.cosine(a, b), 6).alias("similarity"),
        F.round(scores.euclidean(a, b), 6).alias("distance"),
    )


@query("V6", "V4", "W2", "L4", sql=_NEAREST_SQL.format(gap=q.distance("a.embedding", "b.embedding"), k=4))
def nearest_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours from a saved index of codes, certified by the codes' error bounds."""
    root = work_folder(spark, "vector-index")
    vectorindex.build_index(table(spark, sf_dir, "embeddings"), root, sub_vectors=64)
    found = vectorindex.search_index(_vector_queries(spark, sf_dir), root, 4, certified=True)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rk")


@query("V6")
def approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours from 3 of 32 cells of a saved index; what is found depends on the training, so there is no SQL."""
    root = work_folder(spark, "vector-index")
    vectorindex.build_index(table(spark, sf_dir, "embeddings"), root, copies=8)
    return vectorindex.search_index(_vector_queries(spark, sf_dir), root, 4, probes=3)


@query("V6", "V4", sql=_NEAREST_SQL.format(gap=q.distance("a.embedding", "b.embedding"), k=4))
def nearest_in_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell search with every cell probed, which makes it exact."""
    vectors = table(spark, sf_dir, "embeddings")
    model = nearest.fit_cells(vectors, cells=8, rounds=3)
    celled = nearest.assign_cells(vectors, model)
    found = nearest.nearest_in_cells(_vector_queries(spark, sf_dir), celled, model, 4, 8, vector_id="vec_id")
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rk")


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a vector; those beyond the given vectors start over with the first."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    numbered = docs.withColumn("vec_id", F.col("doc_id") % vectors.count())
    return join_small(numbered, vectors.select("vec_id", "embedding"), ["vec_id"], spread=["doc_id"]).drop("vec_id")


def record_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored records; good quality counts as matching."""
    docs, labels = _with_vectors(spark, sf_dir), table(spark, sf_dir, "labels")
    score = F.round((F.col("n_chars") % 100) / 100.0, 4)
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("text").alias("document"),
        "embedding",
        F.lit(None).cast("string").alias("name"),
        text.first_email(F.col("text")).alias("email"),
        F.concat("source", F.lit(".docx")).alias("filename"),
        score.alias("tfidf_score"),
        score.alias("embedding_score"),
        score.alias("hybrid_score"),
        F.coalesce("quality", F.lit(0)).alias("matches_jd"),
        F.lit("2024-03-01 10:00:00").cast("timestamp_ntz").alias("uploaded_at"),
    )


def store_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as search queries, each with a vector of its own that is not stored."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.reverse("embedding").alias("query_vector")
    )
    return table(spark, sf_dir, "benchmark").join(vectors, "item_id").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "query_vector"
    )


_KEYWORDS_SQL = f"""[w for w in regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_]+')
    if length(w) > 2 AND w NOT IN ({q.listed(text.QUERY_STOP_WORDS)})]"""


def _search_sql(wanted: int, only_matched: bool) -> str:
    where = "WHERE matches_jd = 1" if only_matched else ""
    return f"""
    store AS (
        SELECT d.doc_id, text AS document, embedding, {q.email('text')} AS email, source || '.docx' AS filename,
            round((n_chars % 100) / 100.0::DOUBLE, 4) AS hybrid_score, coalesce(quality, 0) AS matches_jd
        FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) LEFT JOIN labels l ON l.doc_id = d.doc_id),
    asked AS (
        SELECT item_id AS query_id, text AS query_text, list_reverse(embedding) AS query_vector
        FROM benchmark JOIN embeddings ON vec_id = item_id),
    close AS (
        SELECT query_id, query_text, s.*, {q.cosine('query_vector', 'embedding')} AS similarity,
            row_number() OVER (PARTITION BY query_id
                ORDER BY 1 - {q.cosine('query_vector', 'embedding')}, s.doc_id) AS rk
        FROM asked, (SELECT * FROM store {where}) s),
    flagged AS (
        SELECT *, len({_KEYWORDS_SQL}) > 0
            AND len([w for w in {_KEYWORDS_SQL} if contains(lower(document), w)]) > 0 AS hit
        FROM close WHERE rk <= {2 * wanted}),
    results AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, rk) AS search_rank FROM flagged)
    """


def _result_columns(wanted: int) -> str:
    return f"""
    SELECT query_id, search_rank, doc_id, 'Unknown' AS name, email, filename,
        round(1 - (1 - similarity), 4) AS search_similarity, hybrid_score, matches_jd = 1 AS matches_jd,
        CASE WHEN hybrid_score >= 0.85 THEN 'Strong' WHEN hybrid_score >= 0.7 THEN 'Good' ELSE 'Weak' END AS fit,
        '2024-03-01' AS uploaded
    FROM results WHERE search_rank <= {wanted}
    """


_RESULT_NAMES = [
    "query_id", "search_rank", "doc_id", "name", "email", "filename", "search_similarity", "hybrid_score",
    "matches_jd", "fit", "uploaded",
]


@query(
    "V5", "V7", "L2", "L5", "J3", "J5", "F12", "F13", "O2", "W3", "V8", "P11",
    sql=f"WITH {_search_sql(5, False)} {_result_columns(5)}",
)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_store(store_queries(spark, sf_dir), record_store(spark, sf_dir))
    return found.select(*_RESULT_NAMES)


@query(
    "V5", "V7", "F5", "L2", "L5",
    sql=f"WITH {_search_sql(50, True)} {_result_columns(50)}",
)
def matched_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_store(store_queries(spark, sf_dir), record_store(spark, sf_dir), 50, only_matched=True)
    return found.select(*_RESULT_NAMES)


@query(
    "A13",
    sql=f"""
    WITH {_search_sql(5, False)},
    shown AS ({_result_columns(5)})
    SELECT query_id, count(*) AS returned, min_by(search_similarity, search_rank) AS top_similarity,
        min_by(hybrid_score, search_rank) AS top_hybrid
    FROM shown GROUP BY query_id
    """,
)
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_summary(search.search_store(store_queries(spark, sf_dir), record_store(spark, sf_dir)))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page passages; every seventh has no page number."""
    docs = _with_vectors(spark, sf_dir)
    page = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("int"))
    return docs.select(F.col("doc_id").alias("chunk_id"), page.alias("page"), "text", "embedding")


_PASSAGES_SQL = f"""
    asked AS (
        SELECT item_id AS query_id, text AS query_text, list_reverse(embedding) AS query_vector
        FROM benchmark JOIN embeddings ON vec_id = item_id),
    chunks AS (
        SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id::VARCHAR ELSE 'Unknown' END AS page, text,
            embedding FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
    close AS (
        SELECT query_id, query_vector, chunks.*, row_number() OVER (PARTITION BY query_id
            ORDER BY {q.distance('query_vector', 'embedding')}, chunk_id) AS rk
        FROM asked, chunks)
"""


@query(
    "F9", "V4", "V1",
    sql=f"""
    WITH {_PASSAGES_SQL}
    SELECT query_id, round({q.cosine('query_vector', 'embedding')}, 6) AS similarity,
        {q.cosine('query_vector', 'embedding')} >= 0.4 AS accepted
    FROM close WHERE rk = 1
    """,
)
def similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = context.similarity_gate(store_queries(spark, sf_dir), passages(spark, sf_dir))
    return judged.select("query_id", F.round("similarity", 6).alias("similarity"), "accepted")


@query(
    "A10", "L4", "V4",
    sql=f"""
    WITH {_PASSAGES_SQL}
    SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rk) AS context FROM close WHERE rk <= 4 GROUP BY query_id
    """,
)
def plain_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.plain_context(context.retrieve(store_queries(spark, sf_dir), passages(spark, sf_dir), 4))


CUES = (("complex", ("ouen", "reen")), ("analytical", ("ha ", "que ")), ("odd", ("zu ",)))
_CLASS_SQL = """
    CASE WHEN regexp_replace(lower(query_text), '^\\s+|\\s+$', '', 'g') IN ('hi', 'hello', 'hey', 'thanks', 'thank you',
            'bye', 'goodbye') THEN 'greeting'
        WHEN contains(lower(query_text), 'ouen') OR contains(lower(query_text), 'reen') THEN 'complex'
        WHEN contains(lower(query_text), 'ha ') OR contains(lower(query_text), 'que ') THEN 'analytical'
        WHEN contains(lower(query_text), 'zu ') THEN 'odd' ELSE 'factual' END
"""
_ROUTE_SQL = """
    CASE query_type WHEN 'greeting' THEN 'conversational' WHEN 'analytical' THEN 'analytical_agent'
        WHEN 'complex' THEN 'complex_agent' ELSE 'factual_agent' END
"""
_K_SQL = "CASE query_type WHEN 'factual' THEN 4 WHEN 'analytical' THEN 6 ELSE 8 END"
_ROUTER_STEP_SQL = """
    CASE WHEN query_type = 'greeting' THEN 'Router: Detected greeting'
        ELSE 'Router: Classified as ''' || query_type || ''', routing to ''' || route || '''' END
"""


@query(
    "C4", "C5", "C6", "J4", "A11", "L3",
    sql=f"""
    WITH asked AS (
        SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 9 = 0 THEN ' Thank YOU ' ELSE text END AS query_text
        FROM conversations),
    classed AS (SELECT *, {_CLASS_SQL} AS query_type FROM asked),
    routed AS (SELECT *, {_ROUTE_SQL} AS route FROM classed)
    SELECT conv_id, turn, query_type, route, query_type <> 'greeting' AS needs_retrieval, {_K_SQL} AS k,
        {_ROUTER_STEP_SQL} AS steps
    FROM routed
    """,
)
def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    greeted = (F.col("turn") == 0) & (F.col("conv_id") % 9 == 0)
    asked = table(spark, sf_dir, "conversations").withColumn(
        "query", F.when(greeted, F.lit(" Thank YOU ")).otherwise(F.col("text"))
    )
    routed = routing.route_questions(asked, gates.cue_class(F.col("query"), CUES))
    return routed.select(
        "conv_id", "turn", "query_type", "route", "needs_retrieval", "k", F.array_join("steps", "\n").alias("steps")
    )


def _stand_in_router(items: list[str]) -> list[str]:
    """Names the class by the cue phrases in the question."""
    asked = [item.rsplit("\nuser: ", 1)[1].lower() for item in items]
    return [next((f" {name.upper()}\n" for name, cues in CUES if any(c in a for c in cues)), "factual") for a in asked]


@query(
    "C5", "C4", "C6", "J4", "A11",
    sql=f"""
    WITH asked AS (
        SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 9 = 0 THEN ' Thank YOU ' ELSE text END AS query_text
        FROM conversations),
    classed AS (SELECT *, {_CLASS_SQL} AS query_type FROM asked)
    SELECT conv_id, turn, query_type, {_ROUTE_SQL} AS route, {_K_SQL} AS k FROM classed
    """,
)
def model_routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions classed by a model through the router prompt."""
    greeted = (F.col("turn") == 0) & (F.col("conv_id") % 9 == 0)
    asked = table(spark, sf_dir, "conversations").withColumn("query", F.when(greeted, F.lit(" Thank YOU ")).otherwise(F.col("text")))
    named = routing.classed_by_model(asked, _stand_in_router)
    cleaned = text.strip(F.col("question_class"))
    return routing.route_questions(named, cleaned).select("conv_id", "turn", "query_type", "route", "k")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries as questions; every ninth is a greeting."""
    query_text = F.when(F.col("query_id") % 9 == 0, F.lit(" Hello")).otherwise(F.col("query_text"))
    return store_queries(spark, sf_dir).select("query_id", query_text.alias("query"), "query_vector")


def _stand_in_model(items: list[str]) -> list[str]:
    return [f"{len(item)} characters read" for item in items]


_SECTION_SQL = "'[Section ' || rk || ' - Page ' || page || ']' || chr(10) || text"
_SYSTEM_SQL = "CASE route " + " ".join(
    f"WHEN {q.quoted(route)} THEN {q.quoted(body)}" for route, body in prompts.AGENT_PROMPTS.items()
) + " END"


@query(
    "C7", "C4", "C5", "C6", "L3", "A10", "A11", "R7", "U1", "J3", "J4",
    sql=f"""
    WITH {_PASSAGES_SQL},
    asked2 AS (SELECT query_id, CASE WHEN query_id % 9 = 0 THEN ' Hello' ELSE query_text END AS query_text
        FROM asked),
    classed AS (SELECT *, {_CLASS_SQL} AS query_type FROM asked2),
    routed AS (SELECT *, {_ROUTE_SQL} AS route, {_K_SQL} AS k FROM classed),
    found AS (
        SELECT r.query_id, string_agg({_SECTION_SQL}, {q.quoted(context.SECTION_BREAK)} ORDER BY rk) AS context,
            count(*) AS sections
        FROM routed r JOIN close c ON c.query_id = r.query_id AND c.rk <= r.k WHERE query_type <> 'greeting'
        GROUP BY r.query_id),
    prompted AS (
        SELECT r.*, sections, 'system: ' || replace({_SYSTEM_SQL}, '{{context}}', coalesce(context, '')) || chr(10)
            || 'user: ' || query_text AS prompt
        FROM routed r LEFT JOIN found f ON f.query_id = r.query_id)
    SELECT query_id, query_type, route AS agent_type, md5(prompt) AS prompt_digest,
        length(prompt) || ' characters read' AS response,
        {_ROUTER_STEP_SQL}
            || CASE WHEN query_type = 'greeting' THEN '' ELSE chr(10) || 'Retrieval: Found ' || sections
                || ' relevant sections' END || chr(10)
            || CASE route WHEN 'conversational' THEN 'Conversational' WHEN 'factual_agent' THEN 'Factual'
                WHEN 'analytical_agent' THEN 'Analytical' ELSE 'Complex' END || ' Agent: Generated response' AS steps
    FROM prompted
    """,
)
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = routing.answer_questions(
        _questions(spark, sf_dir),
        passages(spark, sf_dir),
        _stand_in_model,
        gates.cue_class(F.col("query"), CUES),
    )
    return told.select(
        "query_id", "query_type", "agent_type", F.md5("prompt").alias("prompt_digest"), "response",
        F.array_join("steps", "\n").alias("steps"),
    )


@query(
    "R7", "W4",
    sql=f"""
    WITH told AS (
        SELECT *, list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
            AS history FROM conversations)
    SELECT conv_id, turn, md5(array_to_string(list_concat(list_concat(
        [{q.quoted('system: ' + prompts.AGENT_PROMPTS['conversational'])}], coalesce(history, [])),
        ['user: ' || text]), chr(10))) AS prompt_digest
    FROM told
    """,
)
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = recent_history(table(spark, sf_dir, "conversations"))
    prompt = prompts.agent_prompt(F.lit("conversational"), F.lit(""), F.col("history"), F.col("text"))
    return told.select("conv_id", "turn", F.md5(prompt).alias("prompt_digest"))


@query(
    "R7", "W4", "L3", "C7",
    sql=f"""
    WITH {_PASSAGES_SQL.replace("asked AS (", "given AS (", 1).replace("FROM asked, chunks", "FROM vectored, chunks")
        .replace("close AS (", """vectored AS (
        SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, text AS query_text, list_reverse(embedding) AS query_vector,
            list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS history
        FROM conversations JOIN embeddings ON vec_id = (conv_id * 31 + turn) % (SELECT count(*) FROM embeddings)),
    close AS (""", 1)},
    classed AS (SELECT *, {_CLASS_SQL} AS query_type FROM vectored),
    routed AS (SELECT *, {_ROUTE_SQL} AS route, {_K_SQL} AS k FROM classed),
    found AS (
        SELECT r.query_id, string_agg({_SECTION_SQL}, {q.quoted(context.SECTION_BREAK)} ORDER BY rk) AS context
        FROM routed r JOIN close c ON c.query_id = r.query_id AND c.rk <= r.k WHERE query_type <> 'greeting' GROUP BY r.query_id)
    SELECT conv_id, turn, route, len(coalesce(history, []))::INTEGER AS told,
        md5(array_to_string(list_concat(list_concat(['system: ' || replace({_SYSTEM_SQL}, '{{context}}', coalesce(context, ''))],
            coalesce(history, [])), ['user: ' || query_text]), chr(10))) AS prompt_digest
    FROM routed LEFT JOIN found USING (query_id)
    """,
)
def grounded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a question: its prompt holds the retrieved sections and the ten messages before it."""
    vectors = table(spark, sf_dir, "embeddings")
    told = recent_history(table(spark, sf_dir, "conversations"))
    asked = told.withColumn("vec_id", (F.col("conv_id") * 31 + F.col("turn")) % vectors.count()).withColumn("query", F.col("text"))
    vectored = vectors.select("vec_id", F.reverse("embedding").alias("query_vector"))
    asked = join_small(asked, vectored, ["vec_id"], spread=["conv_id", "turn"]).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    routed = checkpointed(routing.route_questions(asked, gates.cue_class(F.col("query"), CUES)))
    prompted = routing.with_prompt(routing.with_context(routed, passages(spark, sf_dir)))
    return prompted.select("conv_id", "turn", "route", F.size("history").alias("told"), F.md5("prompt").alias("prompt_digest"))


@query(
    "C8", "F7", "U1",
    sql=f"""
    WITH judged AS (
        SELECT conv_id, turn, text, contains(lower(text), 'the')
            AND NOT regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(ha)([^\\p{{L}}\\p{{N}}_]|$)') AS accepted
        FROM conversations)
    SELECT conv_id, turn, accepted,
        CASE WHEN accepted THEN length(text) || ' characters read' ELSE {q.quoted(prompts.REFUSAL)} END AS output
    FROM judged
    """,
)
def gated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    gate = gates.topic_gate(F.col("text"), ("ha",), ("the",))
    told = routing.gate_then_answer(messages, gate, _stand_in_model, "text")
    return told.select("conv_id", "turn", "accepted", "output")


def _stand_in_judge(items: list[str]) -> list[str]:
    return [" Yes." if " the " in item.rsplit('Question: "', 1)[1] else "no" for item in items]


@query(
    "F8", "R8", "U1",
    sql="SELECT conv_id, turn, contains(text, ' the ') AS accepted FROM conversations",
)
def judged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return routing.judged_by_model(asked, _stand_in_judge, "text").select("conv_id", "turn", "accepted")


@query(
    "F8", "C8", "R8", "U1",
    sql=f"""
    SELECT conv_id, turn, contains(text, ' the ') AS accepted,
        CASE WHEN contains(text, ' the ') THEN length(text) || ' characters read' ELSE {q.quoted(prompts.JUDGED_REFUSAL)} END AS output
    FROM conversations
    """,
)
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model judges, the accepted questions are answered, the others refused."""
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    told = routing.judge_then_answer(asked, _stand_in_judge, _stand_in_model, "text")
    return told.select("conv_id", "turn", "accepted", "output")


@query(
    "C9",
    sql="""
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'in: ' || text WHEN 1 THEN 'last: ' || text ELSE text END AS prompt
    FROM conversations
    """,
)
def request_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, said = F.col("turn") % 3, F.col("text")

    def message(role: str, content) -> object:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    listed = F.array(message("system", F.lit("first")), message("user", F.concat(F.lit("last: "), said)))
    payload = F.struct(
        F.when(kind == 0, F.concat(F.lit("in: "), said)).alias("input"),
        F.when(kind == 1, listed).alias("messages"),
        F.when(kind == 2, said).alias("text"),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.prompt_text(payload).alias("prompt"))


def _stand_in_answer(items: list[str]) -> list[str]:
    """Refuses texts of an uneven number of characters."""
    if any(len(item) % 2 for item in items):
        raise ValueError("refused")
    return [f"{len(item)} characters read" for item in items]


@query(
    "C10", "U1",
    sql="""
    SELECT conv_id, turn, CASE WHEN length(text) % 2 = 1 THEN 'error' ELSE 'factual_agent' END AS agent_type,
        CASE WHEN length(text) % 2 = 1 THEN 'Error processing query: refused'
            ELSE length(text) || ' characters read' END AS response,
        CASE WHEN length(text) % 2 = 1 THEN 'Error: refused' ELSE 'Factual Agent: Generated response' END AS steps
    FROM conversations
    """,
)
def failed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("prompt"), F.lit("factual_agent").alias("route"),
        F.array().cast("array<string>").alias("steps"),
    )
    told = routing.answered(asked, _stand_in_answer)
    return told.select("conv_id", "turn", "agent_type", "response", F.array_join("steps", "\n").alias("steps"))


def _stand_in_embedder(items: list[str]) -> dict:
    return {"data": [{"embedding": [float(len(t)), float(t.count(" ")), float(t.count("e"))]} for t in items]}


@query(
    "V10", "U1",
    sql=f"""
    WITH cleaned AS (SELECT doc_id, text FROM documents),
    counted AS (SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, ' ', '')) AS n_spaces,
        length(text) - length(replace(text, 'e', '')) AS n_e FROM cleaned)
    SELECT doc_id, n_chars::DOUBLE AS a, n_spaces::DOUBLE AS b, n_e::DOUBLE AS c, TRUE AS embedded FROM counted
    """,
)
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = modelcalls.embed_texts(docs, _stand_in_embedder, clean=False)
    parts = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")]
    return done.select("doc_id", *parts, F.col("error").isNull().alias("embedded"))


@query(
    "V11", "V10", "P6",
    sql=f"""
    WITH cleaned AS ({CLEANED_SQL}),
    cut AS (SELECT doc_id, {q.first_words('stripped', text.EMBEDDING_WORD_LIMIT)} AS text FROM cleaned),
    buckets AS (
        SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n
        FROM (SELECT doc_id, unnest({q.tokens('text')}) AS term FROM cut) GROUP BY ALL),
    sums AS (
        SELECT doc_id, sqrt(sum(n * n)) AS length, string_agg(bucket::VARCHAR, ' ' ORDER BY bucket) AS places,
            round(max(n) / sqrt(sum(n * n)), 3) AS largest, round(min(n) / sqrt(sum(n * n)), 3) AS smallest
        FROM buckets GROUP BY doc_id)
    SELECT doc_id, CASE WHEN length > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length, coalesce(places, '') AS places, largest, smallest
    FROM cut LEFT JOIN sums USING (doc_id) WHERE text <> ''
    """,
)
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline embedder over all documents: length, non-zero places, largest and smallest value there."""
    done = modelcalls.hashed_embedding(table(spark, sf_dir, "documents").select("doc_id", "text"))
    used = F.filter("embedding", lambda x: x != 0)
    places = F.filter(F.transform("embedding", lambda x, i: F.when(x != 0, i.cast("string"))), lambda p: p.isNotNull())
    return done.filter("embedding is not null").select(
        "doc_id",
        F.round(scores.norm(F.col("embedding")), 4).alias("length"),
        F.array_join(places, " ").alias("places"),
        F.round(F.array_max(used).cast("double"), 3).alias("largest"),
        F.round(F.array_min(used).cast("double"), 3).alias("smallest"),
    )


_INGEST_SQL = f"""
    WITH read AS (
        SELECT r.doc_id, r.text, d.source FROM ({DOCX_SQL}) r JOIN documents d USING (doc_id)),
    items AS (SELECT -1 - item_id AS doc_id, text, 'source' || item_id AS source FROM benchmark),
    documents AS (SELECT * FROM read UNION ALL SELECT * FROM items),
    cleaned AS ({CLEANED_SQL}),
    cut AS (SELECT doc_id, {q.first_words('stripped', text.EMBEDDING_WORD_LIMIT)} AS text FROM cleaned),
    buckets AS (
        SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n
        FROM (SELECT doc_id, unnest({q.tokens('text')}) AS term FROM cut WHERE text <> '') GROUP BY ALL),
    lengths AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS length FROM buckets GROUP BY doc_id),
    sessions AS (SELECT doc_id, regexp_extract(source, '\\d+')::BIGINT AS session_id, text FROM documents WHERE doc_id >= 0),
    dots AS (
        SELECT s.doc_id, sum(a.n * b.n)::DOUBLE AS dot FROM sessions s JOIN buckets a ON a.doc_id = s.doc_id
        JOIN buckets b ON b.doc_id = -1 - s.session_id AND b.bucket = a.bucket GROUP BY s.doc_id),
    {TFIDF_SQL},
    scored AS (
        SELECT s.doc_id, s.session_id::VARCHAR AS session_id, {q.name('s.text')} AS name, {q.email('s.text')} AS email,
            'cv ' || s.doc_id || '.docx' AS filename, coalesce(t.tfidf_score, 0) AS tfidf,
            coalesce(dot / (la.length * lb.length), 0) AS embedding
        FROM sessions s JOIN benchmark i ON i.item_id = s.session_id JOIN cut c ON c.doc_id = s.doc_id AND c.text <> ''
        LEFT JOIN dots ON dots.doc_id = s.doc_id LEFT JOIN lengths la ON la.doc_id = s.doc_id LEFT JOIN lengths lb ON lb.doc_id = -1 - s.session_id
        LEFT JOIN tfidf t ON t.jd_id = s.session_id AND t.doc_id = s.doc_id),
    hybrids AS (SELECT *, round(0.4 * tfidf + 0.6 * embedding, 4) AS hybrid_score FROM scored)
    SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY hybrid_score DESC, doc_id) AS rank, name, email,
        filename, round(tfidf, 4) AS tfidf_score, round(embedding, 4) AS embedding_score, hybrid_score,
        hybrid_score >= 0.7 AS matches_jd
    FROM hybrids
"""


@query("ST1", "V12", "V2", "V3", "V9", "S7", "P1", "P2", "P8", "F4", "A9", "K3", "W1", sql=_INGEST_SQL)
def ingested_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCX files that arrive in several micro-batches, scored against their session's description, stored, ranked from the store.

    Beside every document there is a broken file for every description; all files are read
    again by a second run.
    """
    from ..operators import matching
    from ..sources.writers import write_files
    from ..streaming import jobs
    from .records import as_docx

    folder = work_folder(spark, "ingest")
    session = F.regexp_extract("source", r"(\d+)", 1)
    docs = table(spark, sf_dir, "documents")
    placed = docs.select(F.concat(session, F.lit("/cv "), F.col("doc_id").cast("string"), F.lit(".docx")).alias("filename"), "text")
    items = table(spark, sf_dir, "benchmark")
    broken = items.select(F.concat(F.col("item_id").cast("string"), F.lit("/broken.docx")).alias("filename"), "text")
    files = as_docx(placed).unionByName(as_docx(broken, first_bytes=40))
    count = write_files(files, f"{folder}/in")
    described = items.select(F.col("item_id").cast("string").alias("session_id"), "text")
    described = checkpointed(modelcalls.hashed_counts(described))
    for run in range(2):
        arriving = jobs.resume_files(spark, f"{folder}/in", files_per_trigger=-(-count // 3))
        done = jobs.stream_resumes(arriving, described, modelcalls.hashed_counts, f"{folder}/store", f"{folder}/checkpoint-{run}")
        done.awaitTermination()
    stored = store.read_store(spark, f"{folder}/store")
    stored = stored.withColumn("seq", F.regexp_extract("filename", r"(\d+)", 1).cast("long"))
    ranked = matching.rank_resumes(stored.drop("document", "embedding"))
    return ranked.select(
        "session_id", "rank", F.coalesce("name", F.lit("Unknown")).alias("name"), "email", "filename",
        "tfidf_score", "embedding_score", "hybrid_score", (F.col("matches_jd") == 1).alias("matches_jd"),
    )


@query(
    "J6", "S8", "T3",
    sql="""
    SELECT source, count(*) AS chunks, count(DISTINCT page) AS pages, 500 AS chunk_size, 50 AS chunk_overlap
    FROM (SELECT source, doc_id AS page, unnest(range(0, greatest(length(text) - 50 - 1, 0) + 1, 450)) AS start
        FROM documents WHERE length(text) > 0)
    GROUP BY source
    """,
)
def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index the labelled documents, then all; only missing chunks are embedded the second time."""
    from ..sources.readers import document_pages

    root = work_folder(spark, "index")
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")

    def chunks(source: DataFrame) -> DataFrame:
        pages = document_pages(source, "source", "doc_id")
        cut = window_chunks(pages, size=500, overlap=50).drop("start")
        return cut.withColumn("chunk_id", F.concat_ws("-", "page", "chunk_no"))

    def embed(missing: DataFrame) -> DataFrame:
        return modelcalls.hashed_embedding(missing, size=32)

    identity = ("page",)
    store.update_index(chunks(labelled), root, embed, 500, 50, identity=identity)
    rows = store.update_index(chunks(docs), root, embed, 500, 50, identity=identity)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.countDistinct("page").alias("pages"),
        F.max("chunk_size").alias("chunk_size"),
        F.max("chunk_overlap").alias("chunk_overlap"),
    )


@query(
    "K4", "S12", "J6", "S8", "T3",
    sql="""
    WITH before AS (SELECT doc_id, 'file ' || source AS source, text FROM documents),
    after AS (
        SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN text || ' revised' ELSE text END AS text
        FROM before WHERE doc_id % 5 <> 1 AND source <> (SELECT min(source) FROM before)),
    old AS (SELECT doc_id, start, text[start + 1:start + 500] AS chunk
        FROM (SELECT *, unnest(range(0, greatest(length(text) - 50 - 1, 0) + 1, 450)) AS start FROM before WHERE length(text) > 0)),
    new AS (SELECT doc_id, source, start, text[start + 1:start + 500] AS chunk
        FROM (SELECT *, unnest(range(0, greatest(length(text) - 50 - 1, 0) + 1, 450)) AS start FROM after WHERE length(text) > 0)),
    live AS (
        SELECT new.*, CASE WHEN source = (SELECT max(source) FROM after) THEN 2 WHEN old.chunk IS NULL THEN 1 ELSE 0 END AS born
        FROM new LEFT JOIN old ON old.doc_id = new.doc_id AND old.start = new.start AND old.chunk = new.chunk)
    SELECT source, born, count(*) AS chunks, count(DISTINCT doc_id) AS pages, sum(length(chunk))::BIGINT AS n_chars
    FROM live GROUP BY source, born
    """,
)
def refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that forgets: all documents; then revised and deleted pages and a deleted source; then one source reloaded.

    Live chunks by source and the generation that embedded them.
    """
    from ..sources.readers import document_pages

    root = work_folder(spark, "index")
    path = F.concat(F.lit("/in/file "), "source", F.lit(".pdf"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.file_stem(path).alias("source"))
    ends = docs.agg(F.min("source").alias("first"), F.max("source").alias("last")).first()
    left = docs.filter((F.col("doc_id") % 5 != 1) & (F.col("source") != ends["first"]))
    revised = left.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))

    def update(pages: DataFrame, **options) -> None:
        cut = window_chunks(document_pages(pages, "source", "doc_id"), size=500, overlap=50).drop("start")
        embed = lambda missing: modelcalls.hashed_embedding(missing, size=32)
        store.update_index(cut, root, embed, 500, 50, identity=("page",), **options)

    update(docs)
    update(revised, sources=docs.select("source"))
    update(revised.filter(F.col("source") == ends["last"]), force_reload=True)
    return store.read_index(spark, root).groupBy("source", "born").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("page").alias("pages"), F.sum(F.length("text")).alias("n_chars")
    )


_PAID_CALLS = """
    WITH asked AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'Say more: ' || role ELSE text END AS prompt FROM conversations),
    earlier AS (SELECT DISTINCT prompt FROM asked WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN length(prompt) % 7 = 0 THEN NULL ELSE length(prompt) || ' characters read, run '
            || CASE WHEN prompt IN (SELECT prompt FROM earlier) THEN 1 ELSE 2 END END AS response,
        CASE WHEN length(prompt) % 7 = 0 THEN 'refused' END AS error
    FROM asked
"""


@query("U1", sql=_PAID_CALLS)
def paid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that repeat, the users' in a first run and all in a second: an answer names the run that paid for it."""
    root = work_folder(spark, "paid")
    prompt = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Say more: "), "role")).otherwise(F.col("text"))
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", prompt.alias("prompt"))

    def model(run: int):
        def call(items: list[str]) -> list[str]:
            if any(len(item) % 7 == 0 for item in items):
                raise ValueError("refused")
            return [f"{len(item)} characters read, run {run}" for item in items]

        return modelcalls.in_time(call, 60.0, at_once=2)

    modelcalls.ask_once(asked.filter("role = 'user'"), model(1), root)
    return modelcalls.ask_once(asked, model(2), root).select("conv_id", "turn", "response", "error")
