"""Language identification: word frequencies first, character n-grams for unseen words."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .samples import held_out, sampled

PER_LANGUAGE = 1500
LONGEST_GRAM = 5
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks of its start and end."""
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies per language of words and of character n-grams of each length."""

    def __init__(self, languages: list[str], words: dict[str, list[int]]):
        self.languages = languages
        counts: list[dict[str, list[int]]] = [words]
        for n in range(1, LONGEST_GRAM + 1):
            table: dict[str, list[int]] = {}
            for word, seen in words.items():
                for g in grams(word, n):
                    row = table.setdefault(g, [0] * len(languages))
                    for i, c in enumerate(seen):
                        row[i] += c
            counts.append(table)
        # A word or n-gram met only once says little; the shorter n-grams speak for it.
        self.tables = [self._logs({k: v for k, v in t.items() if sum(v) > 1}) for t in counts]
        self.name = uuid.uuid4().hex

    def _logs(self, table: dict[str, list[int]]) -> dict[str, tuple[float, ...]]:
        totals = [sum(v[i] for v in table.values()) + len(table) + 1 for i in range(len(self.languages))]
        return {k: tuple(math.log((c + 0.5) / t) for c, t in zip(v, totals, strict=True)) for k, v in table.items()}

    def word(self, word: str) -> tuple[float, ...]:
        """Log probability of a word in each language, by the longest unit that is known."""
        found = self.tables[0].get(word)
        if found is not None:
            return found
        for n in range(LONGEST_GRAM, 0, -1):
            known = [g for g in map(self.tables[n].get, grams(word, n)) if g is not None]
            if known:
                return tuple(sum(c) / len(known) for c in zip(*known, strict=True))
        return (0.0,) * len(self.languages)

    def chunk(self, chunk: str) -> tuple[float, ...] | None:
        """Sum over the words of a chunk; None without a letter."""
        words = [w for w in WORD.findall(chunk.lower()) if any(map(str.isalpha, w))]
        if not words:
            return None
        return tuple(sum(c) for c in zip(*map(self.word, words), strict=True))

    def predict(self, text: str | None, memo) -> tuple[str, float]:
        counted = [(s, n) for s, n in ((memo[c], n) for c, n in Counter((text or "").split()).items()) if s is not None]
        if not counted or not self.languages:
            return UNKNOWN, 0.0
        sums = [0.0] * len(self.languages)
        for scores, n in counted:
            for i, s in enumerate(scores):
                sums[i] += n * s
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        return self.languages[best], 1.0 / sum(math.exp(max(-700.0, s - sums[best])) for s in sums)


def _word_rows(batches):
    import pyarrow as pa

    from dossier.llm.langid import WORD

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counted = Counter(w for w in WORD.findall((text.as_py() or "").lower()) if any(map(str.isalpha, w)))
            if counted:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(counted)), pa.array(list(counted)), pa.array(list(counted.values()), pa.int64())],
                    ["lang", "word", "n"],
                )


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` documents of each language, whole texts.

    Documents of fold 0 and without a language are never learned from. Words are
    counted on the cluster; what reaches the driver is bounded by the sample.
    """
    rows = docs.withColumn("_lang", F.col(f"`{lang_col}`").cast("string"))
    sample = checkpointed(sampled(rows, id_col, "_lang", per_language))
    # At most ``per_language`` ids of each language.
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(
        F.broadcast(sample), "_id"
    )
    counted = texts.select("_label", "_text").mapInArrow(_word_rows, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    languages = sorted(r["_label"] for r in sample.select("_label").distinct().collect())
    place = {name: i for i, name in enumerate(languages)}
    words: dict[str, list[int]] = {}
    for lang, word, n in zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True):
        words.setdefault(word, [0] * len(languages))[place[lang]] += n
    return Model(languages, words)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``held_out``, ``lang_pred`` and ``score`` of every whole text.

    A known word scores by its log frequency in each language; any other by the
    mean over its known character n-grams of the greatest length that has one,
    from five down to one. ``score`` is the posterior of the best language under
    equal priors; ties go to the language that sorts first. A text that is null
    or has no letter is ``und`` with score 0, and so is everything if nothing
    could be learned. One output row per input row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        from dossier.llm.memo import Memo, kept

        model = shared.value
        memo = kept(f"lang:{model.name}", lambda: Memo(model.chunk))
        for batch in batches:
            found = []
            for text in batch.column(2):
                found.append(model.predict(text.as_py(), memo))
                memo.trim()
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [id_col, "held_out", "lang_pred", "score"],
            )

    chosen = docs.select(F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
