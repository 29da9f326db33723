"""Quality rules of documents, judged by host with an empirical beta prior. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scaling import join_small
from ..session import checkpointed

LEAST_WORDS = 10
REPEAT_PERCENT = 20
HOST_LIMIT = 0.5
WINDOW = 5

# White space that parts words, and the symbols that are counted.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_failures() -> dict[str, Column]:
    """Whether a document breaks each rule, from its base columns."""
    n = F.col("n_words")
    return {
        "short": n < LEAST_WORDS,
        "repetitive": F.col("n_repeat_words") * 100 > n * REPEAT_PERCENT,
        "symbols": F.col("n_symbols") * 2 > F.col("word_chars"),
        "lines": F.col("n_dup_lines") * 2 > F.col("_n_lines"),
        "lengths": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 30),
    }


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Id, ``_host`` and the base counts of every whole text, in one pass without a shuffle.

    Repeated words are found by hashing each five-word window of a text; texts
    whose hashes are all different, nearly all of them, are done then. In the
    others equal hashes meet by sorting, and each repeated window adds the words
    that the one before it has not covered.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blanked = F.translate(text, BLANKS, " " * len(BLANKS))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.translate(x, BLANKS, " " * len(BLANKS))) != "")
    step = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("_host"),
        F.array_remove(F.split(blanked, " ", -1), "").alias("_words"),
        F.length(F.replace(blanked, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    words = F.col("_words")
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)])),
    )
    step = step.select(
        "_id",
        "_host",
        F.size(words).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("_hashes"),
    )
    pairs = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs)).drop("_hashes")
    found = F.col("_pairs")
    twice = F.filter(
        found,
        lambda x, k: F.when(k > 0, F.get(found, k - 1)["h"] == x["h"]).otherwise(False)
        | F.coalesce(F.get(found, k + 1)["h"] == x["h"], F.lit(False)),
    )
    step = step.withColumn("_starts", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_pairs")
    starts = F.col("_starts")
    gained = F.transform(starts, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, k - 1))))
    repeated = F.aggregate(gained, F.lit(0).cast("long"), lambda n, x: n + x)
    return step.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long"))).drop("_starts")


def host_verdicts(failures: DataFrame, rules: tuple[str, ...], limit: float = HOST_LIMIT) -> DataFrame:
    """One row per ``_host``: documents, failures, shrunk rate per rule, and whether the host is kept.

    Per rule the prior is the beta distribution with the mean and the variance
    of the hosts' rates, weighted by their documents (moments over all hosts). A
    host's rate is shrunk towards it; without any spread between hosts every
    host gets the mean. A host goes if a shrunk rate is above ``limit``.
    """
    hosts = failures.groupBy("_host").agg(
        F.count(F.lit(1)).alias("_docs"), *[F.sum(F.col(r).cast("long")).alias(f"_{r}") for r in rules]
    )
    n = F.col("_docs")
    total = F.sum(n).cast("double")
    moments = hosts.agg(
        *[(F.sum(f"_{r}") / total).alias(f"_mean_{r}") for r in rules],
        *[(F.sum(F.col(f"_{r}").cast("double") * F.col(f"_{r}") / n) / total).alias(f"_square_{r}") for r in rules],
    )
    prior = moments.first()  # one row
    judged, bad = hosts, F.lit(False)
    for r in rules:
        mean = prior[f"_mean_{r}"] or 0.0
        spread = (prior[f"_square_{r}"] or 0.0) - mean * mean
        if spread > 1e-12:
            strength = max(0.0, mean * (1 - mean) / spread - 1)
            rate = (F.col(f"_{r}") + mean * strength) / (n + strength)
        else:
            rate = F.lit(mean)
        judged = judged.withColumn(f"rate_{r}", rate)
        bad = bad | (F.col(f"rate_{r}") > limit)
    return judged.select("_host", "_docs", *[f"_{r}" for r in rules], *[f"rate_{r}" for r in rules], (~bad).alias("_host_kept"))


def judge_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT
) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every document.

    A document fails by itself with fewer than 10 words or with more than 20 %
    of them in repeated five-word windows. Failures of each rule are added up by
    host, shrunk, and the host's verdict joined back: ``kept`` is false for a
    failed document or a rejected host. The counts are checkpointed, so texts
    are read once. Null text has no words; a null host is the host with an empty
    name; null and repeated ids are judged row by row; an empty table gives no
    rows; other columns are not read.
    """
    rules = rule_failures()
    base = checkpointed(base_columns(docs, id_col, text_col, host_col))
    failures = base.select("_host", *[c.alias(r) for r, c in rules.items()])
    hosts = host_verdicts(failures, tuple(rules), limit).select("_host", "_host_kept")
    joined = join_small(base, hosts, ["_host"], "inner", spread=["_id"])
    failed = rules["short"] | rules["repetitive"]
    return joined.select(
        F.col("_id").alias(id_col), *BASE, failed.alias("base_failed"), (~failed & F.col("_host_kept")).alias("kept")
    )
