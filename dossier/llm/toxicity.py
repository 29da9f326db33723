"""Toxicity classifier that is told not to react to which group a text mentions."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .samples import held_out, sampled

PER_LABEL = 6000
FEATURES = 4000
LEAST_DOCS = 4
STRENGTH = 10.0
RIDGE = 1.0
STEPS = 300
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s*")

# Identity terms that may stand for each other, by kind and language.
IDENTITY = [
    "women men girls boys", "woman man girl boy", "female male", "gay straight lesbian bisexual transgender",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
    "black white asian latino", "immigrants refugees natives foreigners", "old young", "deaf blind disabled",
    "femmes hommes filles garçons", "femme homme fille garçon", "musulman chrétien juif hindou bouddhiste",
    "musulmans chrétiens juifs hindous bouddhistes", "immigrés réfugiés étrangers",
    "frauen männer mädchen jungen", "frau mann", "muslime christen juden hindus buddhisten", "einwanderer flüchtlinge ausländer",
    "mujeres hombres niñas niños", "mujer hombre", "musulmanes cristianos judíos hindúes budistas", "inmigrantes refugiados extranjeros",
]


def swaps() -> dict[str, list[str]]:
    """Every identity term with the terms it may be swapped for."""
    out: dict[str, list[str]] = {}
    for line in IDENTITY:
        terms = line.split()
        for t in terms:
            out.setdefault(t, []).extend(x for x in terms if x != t)
    return out


def word_features(word: str) -> list[str]:
    """A word, and its beginnings of four to six letters."""
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]


def text_words(text: str | None) -> set[str]:
    return {w for chunk in set((text or "").lower().split()) for w in WORD.findall(chunk)}


def text_features(text: str | None) -> set[str]:
    return {f for w in text_words(text) for f in word_features(w)}


def counterfactuals(text: str | None) -> list[tuple[str, str]]:
    """Sentences that name a group, each with the sentence after one swap of its terms."""
    table = swaps()
    out = []
    if not table.keys().isdisjoint(text_words(text)):
        for sentence in SENTENCE.split((text or "").lower()):
            terms = [w for w in WORD.findall(sentence) if w in table]
            if terms:
                swap = {t: table[t][len(sentence) % len(table[t])] for t in terms}
                out.append((sentence, WORD.sub(lambda m: swap.get(m.group(), m.group()), sentence)))
    return out


class Model:
    """Weights of words and word beginnings that occur in a text, and a constant."""

    def __init__(self, weights: dict[str, float], constant: float):
        self.weights = {k: v for k, v in weights.items() if v}
        self.constant = constant
        self.name = uuid.uuid4().hex

    def chunk(self, chunk: str) -> tuple[str, ...]:
        """The weighted features of a chunk of text."""
        return tuple(f for w in WORD.findall(chunk) for f in word_features(w) if f in self.weights)

    def score(self, text: str | None, memo) -> float:
        found: set[str] = set()
        for chunk in set((text or "").lower().split()):
            found.update(memo[chunk])
        z = self.constant + sum(map(self.weights.__getitem__, sorted(found)))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def fit(rows: list[list[int]], labels: list[int], pairs: list[tuple[list[int], list[int]]], size: int, strength: float = STRENGTH, ridge: float = RIDGE):
    """Weights and constant of a logistic regression over sets of features.

    The loss is the mean log loss with both labels weighing the same, a ridge,
    and ``strength`` times the mean squared change of the raw score over the
    counterfactual pairs.
    """
    import numpy as np

    def flat(sets):
        lengths = [len(s) for s in sets]
        return np.repeat(np.arange(len(sets)), lengths), np.array([f for s in sets for f in s], dtype=np.int64)

    y = np.asarray(labels, dtype=float)
    weight, constant = np.zeros(size), 0.0
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        return weight, math.log(share / (1 - share))
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    row, col = flat(rows)
    gone = [sorted(set(a) - set(b)) for a, b in pairs]
    come = [sorted(set(b) - set(a)) for a, b in pairs]
    (out_row, out_col), (in_row, in_col) = flat(gone), flat(come)
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weight[col], len(y)) + constant
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * share
        grad = np.bincount(col, error[row], size) + ridge * weight / len(y)
        if pairs:
            change = np.bincount(in_row, weight[in_col], len(pairs)) - np.bincount(out_row, weight[out_col], len(pairs))
            change = change * (2 * strength / len(pairs))
            grad += np.bincount(in_col, change[in_row], size) - np.bincount(out_col, change[out_row], size)
        full = np.append(grad, error.sum())
        mean = 0.9 * mean + 0.1 * full
        square = 0.99 * square + 0.01 * full * full
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weight, constant = weight - move[:-1], constant - move[-1]
    return weight, float(constant)


def _feature_rows(batches):
    import pyarrow as pa

    from dossier.llm.toxicity import text_features

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = sorted(text_features(text.as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([label] * len(found), pa.int32())], ["feature", "label"])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = PER_LABEL,
    features: int = FEATURES,
    strength: float = STRENGTH,
) -> Model:
    """Fit on at most ``per_label`` documents of each label, whole texts.

    Documents of fold 0, null labels and other labels than 0 and 1 are never
    used; a document labelled both ways is toxic. Features are counted on the
    cluster and the ``features`` with the clearest difference between the labels
    are kept. In the sentences of the sample that name a group its term is
    swapped for another of its kind, and score changes are penalised. Only sets
    of kept features reach the driver, bounded by the sample.
    """
    label = F.col(f"`{label_col}`").cast("int")
    rows = labels.select(F.col(f"`{id_col}`").alias("_id"), label.alias("_toxic")).filter(F.col("_toxic").isin(0, 1))
    rows = rows.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    # At most ``per_label`` ids of two labels.
    sample = F.broadcast(checkpointed(sampled(rows, "_id", "_toxic", per_label)))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(sample, "_id")
    texts = checkpointed(texts.select("_label", "_text"))
    totals = {r["_label"]: r["n"] for r in texts.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        weight, constant = fit([], [1] * toxic + [0] * clean, [], 0)
        return Model({}, constant)
    counted = texts.mapInArrow(_feature_rows, "feature string, label int").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")
    )
    a, b = F.col("bad") / toxic, (F.col("n") - F.col("bad")) / clean
    clear = F.pow(a - b, F.lit(2.0)) / (a + b + F.lit(2.0 / (toxic + clean)))
    chosen = counted.filter(F.col("n") >= LEAST_DOCS).orderBy(clear.desc(), "feature").limit(features)
    names = sorted(r["feature"] for r in chosen.select("feature").collect())
    place = {f: i for i, f in enumerate(names)}

    def sets(batches):
        import pyarrow as pa

        from dossier.llm.toxicity import counterfactuals, text_features

        def numbers(text):
            return sorted(place[f] for f in text_features(text) if f in place)

        for batch in batches:
            found = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                pairs = [(numbers(x), numbers(y)) for x, y in counterfactuals(text)]
                found.append((label, numbers(text), [p[0] for p in pairs], [p[1] for p in pairs]))
            many = pa.list_(pa.list_(pa.int32()))
            kinds = [pa.int32(), pa.list_(pa.int32()), many, many]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)],
                    ["label", "here", "before", "after"],
                )

    got = texts.mapInArrow(sets, "label int, here array<int>, before array<array<int>>, after array<array<int>>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["here"]))
    pairs = [p for r in got for p in zip(r["before"], r["after"], strict=True)]
    weight, constant = fit([r["here"] for r in got], [r["label"] for r in got], pairs, len(names), strength)
    return Model(dict(zip(names, weight.tolist(), strict=True)), constant)


def _scorer(shared, text_at: int):
    def run(batches):
        from dossier.llm.memo import Memo, kept

        model = shared.value
        memo = kept(f"toxic:{model.name}", lambda: Memo(model.chunk))
        for batch in batches:
            scores = []
            for text in batch.column(text_at):
                scores.append(model.score(text.as_py(), memo))
                memo.trim()
            yield batch, scores

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of every whole text.

    Only the text is scored. Null and empty texts get the score of a text without
    any feature. One output row per input row, null and repeated ids included.
    """
    scored = _scorer(docs.sparkSession.sparkContext.broadcast(model), 2)

    def run(batches):
        import pyarrow as pa

        for batch, scores in scored(batches):
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), predicted],
                [id_col, "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text is scored below 0.5, unchanged."""
    scored = _scorer(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col))

    def run(batches):
        import pyarrow as pa

        for batch, scores in scored(batches):
            yield batch.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
