"""Search of the record store: nearest records, keyword re-rank, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import fit_label
from ..functions.text import QUERY_STOP_WORDS, mentions_any, query_keywords, strip, upload_date
from ..session import checkpointed
from .nearest import nearest
from .scaling import join_small

DEFAULT_RESULTS = 5


def result_count(wanted: int | None) -> int:
    """Requested number of results, 5 when nothing is asked; less than one is an error."""
    if wanted is None:
        return DEFAULT_RESULTS
    if wanted < 1:
        raise ValueError("the number of results must be at least 1")
    return wanted


def asked_queries(queries: DataFrame, query_text: str = "query_text") -> DataFrame:
    """Queries that hold more than white space."""
    return queries.filter(strip(F.col(query_text)) != "")


def keyword_first(
    candidates: DataFrame,
    query_id: str = "query_id",
    query_text: str = "query_text",
    document: str = "document",
    rank: str = "rk",
    new_rank: str = "search_rank",
    stop_words: Sequence[str] = QUERY_STOP_WORDS,
) -> DataFrame:
    """Move candidates that mention a query keyword to the front, order kept inside both groups.

    A query without keywords keeps its order. Candidate lists are short (twice
    the result count), so one window per query suffices.
    """
    hit: Column = mentions_any(F.col(document), query_keywords(F.col(query_text), stop_words))
    flagged = candidates.withColumn("hit", hit)
    window = Window.partitionBy(query_id).orderBy(F.col("hit").desc(), F.col(rank))
    return flagged.withColumn(new_rank, F.row_number().over(window))


def search_store(
    queries: DataFrame,
    store: DataFrame,
    n_results: int | None = None,
    only_matched: bool = False,
    stop_words: Sequence[str] = QUERY_STOP_WORDS,
) -> DataFrame:
    """Top records of every query ``(query_id, query_text, query_vector)``.

    Twice the wanted number is fetched by cosine from the vector column alone;
    documents and metadata are read for those survivors only, re-ranked by
    keyword, and cut. The match filter applies before the fetch.
    """
    wanted = result_count(n_results)
    asked = asked_queries(queries)
    stored = store.filter(F.col("matches_jd") == 1) if only_matched else store
    close = nearest(asked, stored, 2 * wanted, "cosine", vector_id="doc_id", vector="embedding")
    texts = asked.select("query_id", "query_text")
    hits = checkpointed(close.select("query_id", "doc_id", "rk", "distance"))
    records = store.select(
        "doc_id", "document", "name", "email", "filename", "tfidf_score", "embedding_score",
        "hybrid_score", "matches_jd", "uploaded_at",
    )
    # Ids and numbers meet the records first; query texts join the survivors last, each side measured.
    found = join_small(records, hits, ["doc_id"], "inner", spread=["doc_id"])
    found = join_small(found, texts, ["query_id"], "inner", spread=["doc_id"])
    ranked = keyword_first(found, stop_words=stop_words).filter(F.col("search_rank") <= wanted)
    return ranked.select(
        "query_id",
        "search_rank",
        "doc_id",
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("email", F.lit("N/A")).alias("email"),
        F.coalesce("filename", F.lit("")).alias("filename"),
        F.round(1 - F.col("distance"), 4).alias("search_similarity"),
        F.coalesce("tfidf_score", F.lit(0.0)).alias("tfidf_score"),
        F.coalesce("embedding_score", F.lit(0.0)).alias("embedding_score"),
        F.coalesce("hybrid_score", F.lit(0.0)).alias("hybrid_score"),
        (F.coalesce("matches_jd", F.lit(0)) == 1).alias("matches_jd"),
        fit_label(F.coalesce("hybrid_score", F.lit(0.0))).alias("fit"),
        upload_date(F.col("uploaded_at")).alias("uploaded"),
    )


def search_summary(results: DataFrame) -> DataFrame:
    """Per query: results returned, similarity and hybrid score of the first one."""
    return results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.min_by("search_similarity", "search_rank").alias("top_similarity"),
        F.min_by("hybrid_score", "search_rank").alias("top_hybrid"),
    )
