"""The training-corpus pipeline: five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.llm import decontamination, jaccardjoin, linededup, packing, toxicity
from dossier.llm.queries import word_tokenizer
from dossier.session import bounded_batches, work_folder


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier, fitted on the labelled ones among them, does not reject.

    Null and empty texts are scored like any other, rows without an id or with a shared one each by
    its own text; an empty table stays empty and other columns pass through.
    """
    bounded_batches(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark, docs, sf_dir):
    """Documents without the lines that repeat one that stays; ``n_chars`` counts what is left.

    A null text stays null, one without any line left becomes empty, a row without an id is left
    alone, rows that share an id are compared line by line, an empty table stays empty.
    """
    bounded_batches(spark)
    kept = linededup.dedup_lines(docs)
    _, removed = linededup.count_columns(docs)
    chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    """One document, the one with the smallest id, of each group of linked documents.

    Null and empty texts and rows without an id link with nothing and stay; rows that share an id
    are one document and stay or go together; an empty table stays empty.
    """
    bounded_batches(spark)
    return jaccardjoin.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that the contamination rule does not catch, unchanged.

    Null and wordless texts and rows without an id are judged like any other, by their own text;
    without benchmark items, or without documents, nothing changes.
    """
    bounded_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs, sf_dir):
    """Pieces of the documents left, packed into token windows.

    A null or empty text is its closing id alone; every row is a document of its own, whatever its id;
    an empty table gives no pieces.
    """
    bounded_batches(spark)
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

# The classifier and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to the documents table, each over what the one before kept.

    Every stage but the last is written to the shared folder and read again, so
    that no stage is computed twice.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = work_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
