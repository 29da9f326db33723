"""Chunk, vocabulary, padding and packing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators import chunking, tokens
from ..operators.scaling import spread
from ..session import work_folder
from . import sqltext as q
from .catalog import query, table

def _chunk_report(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _recursive_chunks_sql(size: int, overlap: int) -> str:
    """Chunks from running lengths: pieces by line, long ones by word, long words by character.

    Pieces of one level between two long ones form a run; a chunk of a run takes
    pieces while they fit, the next one starts at the first piece that leaves at
    most ``overlap`` old characters and room for one new piece.
    """

    def pieces(text: str, mark: str) -> str:
        split = f"string_split({text}, {mark})"
        return f"list_transform({split}, lambda p, i: CASE WHEN i = 1 THEN p ELSE {mark} || p END)"

    return f"""
    WITH RECURSIVE marked AS (
        SELECT doc_id, text, CASE WHEN contains(text, chr(10) || chr(10)) THEN chr(10) || chr(10)
            WHEN contains(text, chr(10)) THEN chr(10) WHEN contains(text, ' ') THEN ' ' ELSE '' END AS mark
        FROM documents),
    first AS (
        SELECT doc_id, mark, unnest(ps) AS piece, unnest(range(len(ps))) AS a, 0::BIGINT AS b, 0::BIGINT AS c
        FROM (SELECT doc_id, mark, {pieces('text', 'mark')} AS ps FROM marked)),
    second AS (
        SELECT doc_id, mark, unnest(ps) AS piece, a, unnest(range(len(ps))) AS b, c
        FROM (SELECT doc_id, a, c, mark2 AS mark, {pieces('piece', 'mark2')} AS ps
            FROM (SELECT *, CASE WHEN mark = chr(10) AND contains(piece, ' ') THEN ' ' ELSE '' END AS mark2
                FROM first WHERE length(piece) >= {size} AND mark <> ''))),
    third AS (
        SELECT doc_id, mark, unnest(ps) AS piece, a, b, unnest(range(len(ps))) AS c
        FROM (SELECT doc_id, a, b, '' AS mark, string_split(piece, '') AS ps
            FROM second WHERE length(piece) >= {size} AND mark <> '')),
    leveled AS (
        SELECT *, 'a' AS level, sum((length(piece) >= {size})::INTEGER) OVER (PARTITION BY doc_id ORDER BY a) AS broken
        FROM first
        UNION ALL SELECT *, 'b' || a, sum((length(piece) >= {size})::INTEGER) OVER (PARTITION BY doc_id, a ORDER BY b)
        FROM second
        UNION ALL SELECT *, 'c' || a || '-' || b, 0 FROM third),
    small AS (SELECT *, doc_id || level || '/' || broken AS run FROM leveled WHERE length(piece) BETWEEN 1 AND {size - 1}),
    summed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY run ORDER BY a, b, c)::BIGINT AS upto FROM small),
    runs AS (
        SELECT run, any_value(doc_id) AS doc_id, min((a * 100000 + b) * 100000 + c) AS spot,
            list(upto ORDER BY upto) AS ends, string_agg(piece, '' ORDER BY a, b, c) AS body
        FROM summed GROUP BY run),
    cut AS (
        SELECT run, 0::BIGINT AS n, 0::BIGINT AS s,
            greatest(1, len([x for x in ends if x <= {size}]))::BIGINT AS e FROM runs
        UNION ALL
        SELECT run, n, s, greatest(s + 1, len([x for x in ends if x <= coalesce(ends[s], 0) + {size}]))::BIGINT AS e
        FROM (
            SELECT c.run, n + 1 AS n, ends, least(e, greatest(s + 1,
                len([x for x in list_concat([0], ends) if x < greatest(ends[e] - {overlap}, ends[e + 1] - {size})])
                ))::BIGINT AS s
            FROM cut c JOIN runs r ON r.run = c.run WHERE e < len(ends))),
    chunks AS (
        SELECT doc_id, spot, n, {q.strip('body[coalesce(ends[s], 0) + 1:ends[e]]')} AS chunk
        FROM cut c JOIN runs r ON r.run = c.run)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY spot, n) - 1)::INTEGER AS chunk_no,
        length(chunk)::INTEGER AS n_chars, md5(chunk) AS digest
    FROM chunks WHERE chunk <> ''
    """


@query("T1", sql=_recursive_chunks_sql(chunking.CHUNK_SIZE, chunking.CHUNK_OVERLAP))
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return _chunk_report(chunking.recursive_chunks(docs))


@query("T2", sql=_recursive_chunks_sql(chunking.GATE_CHUNK_SIZE, chunking.GATE_CHUNK_OVERLAP))
def gate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    size, overlap = chunking.GATE_CHUNK_SIZE, chunking.GATE_CHUNK_OVERLAP
    return _chunk_report(chunking.recursive_chunks(docs, size=size, overlap=overlap))


@query(
    "T3", "S8",
    sql="""
    SELECT doc_id, (start / 800)::INTEGER AS chunk_no, length(text[start + 1:start + 1000])::INTEGER AS n_chars,
        md5(text[start + 1:start + 1000]) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200 - 1, 0) + 1, 800)) AS start
        FROM documents WHERE length(text) > 0)
    """,
)
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _chunk_report(chunking.window_chunks(docs))


_VOCABULARY_SQL = f"""
    counts AS (SELECT term, count(*) AS n FROM (SELECT unnest({q.tokens('text')}) AS term FROM documents) GROUP BY term),
    vocabulary AS (SELECT term, (row_number() OVER (ORDER BY n DESC, term) + 1)::INTEGER AS id FROM counts)
"""


@query("T4", sql=f"WITH {_VOCABULARY_SQL} SELECT term, id FROM vocabulary")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.build_vocabulary(table(spark, sf_dir, "documents"))


_ENCODED_SQL = f"""
    {_VOCABULARY_SQL},
    places AS (
        SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS term
        FROM (SELECT doc_id, {q.tokens('text')} AS ts FROM documents)),
    coded AS (SELECT doc_id, pos, coalesce(id, 1) AS id FROM places LEFT JOIN vocabulary USING (term)),
    encoded AS (
        SELECT d.doc_id, coalesce(ids, []) AS ids FROM documents d
        LEFT JOIN (SELECT doc_id, list(id ORDER BY pos) AS ids FROM coded GROUP BY doc_id) USING (doc_id))
"""


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.encode(docs, tokens.build_vocabulary(docs))


@query(
    "T4", "T6", "T7",
    sql=f"""
    WITH {_ENCODED_SQL},
    cut AS (SELECT doc_id, ids[1:128] AS ids FROM encoded),
    padded AS (SELECT doc_id, ids, [0 for i in range(128 - len(ids))] AS zeros FROM cut)
    SELECT doc_id, array_to_string(list_concat(ids, zeros), ' ') AS input_ids,
        array_to_string(list_concat([1 for i in ids], zeros), ' ') AS attention_mask,
        array_to_string(list_concat(ids, [-100 for i in zeros]), ' ') AS labels
    FROM padded
    """,
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.training_rows(encoded_documents(spark, sf_dir))
    shown = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "attention_mask", "labels")]
    return rows.select("doc_id", *shown)


@query(
    "A5", "T8",
    sql=f"""
    SELECT max(least(len({q.tokens('text')}), 128))::INTEGER AS max_tokens,
        round(avg(least(len({q.tokens('text')}), 128)), 6) AS avg_tokens
    FROM documents
    """,
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(word_tokens(F.col("text")).alias("ids"))
    return tokens.token_stats(docs).select("max_tokens", F.round("avg_tokens", 6).alias("avg_tokens"))


@query(
    "T5", "W8",
    sql=f"""
    WITH {_ENCODED_SQL},
    run AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM coded),
    blocks AS (SELECT floor(place / 128.0)::BIGINT AS block, list(id ORDER BY place) AS ids FROM run GROUP BY 1)
    SELECT block, array_to_string(ids, ' ') AS input_ids FROM blocks WHERE len(ids) = 128
    """,
)
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "encoded")
    encoded_documents(spark, sf_dir).write.parquet(folder)  # encoded once; offsets are taken from what was written
    blocks = tokens.packed_blocks(spark.read.parquet(folder))
    return blocks.select("block", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


def _letters(items: list[str]) -> list[list[int]]:
    """Stand-in for a caller's tokenizer: one id per word, its length."""
    return [[len(word) for word in item.split()] for item in items]


@query(
    "T4", "U2",
    sql=f"""
    SELECT doc_id, array_to_string(([length(w) for w in {q.words('text')}])[1:128], ' ') AS ids FROM documents
    """,
)
def caller_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = tokens.encode_with(docs, _letters)
    cut = tokens.truncated(F.col("ids")).cast("array<string>")
    return coded.select("doc_id", F.array_join(cut, " ").alias("ids"))
