"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .htmlblocks import Block, blocks

PAGES = 600
STEPS = 120
RIDGE = 2e-4


def path_features(path: tuple) -> list[str]:
    """Ancestor tags, the words of their names, and the innermost tag."""
    found = {f"t={tag}" for tag, _ in path} | {f"n={name}" for _, names in path for name in names}
    found.add(f"leaf={path[-1][0] if path else ''}")
    return sorted(found)


def text_features(text: str, linked: int) -> tuple[str, ...]:
    """Size, links, sentence end and odd signs of a block."""
    n, words = len(text), text.count(" ") + 1
    size = "1" if words < 2 else "4" if words < 5 else "10" if words < 11 else "30" if words < 31 else "more"
    link = "all" if linked * 10 >= n * 9 else "some" if linked * 4 >= n else "few"
    end = "stop" if text[-1] in ".!?…:;\"”»" else "open"
    return (f"size={size}", f"link={link}", f"end={end}", f"sign={'©' in text or '|' in text}")


class Model:
    """Log-linear scores: weights of features for label 1, and of label pairs."""

    def __init__(self, weights: dict[str, float], first, moves, last):
        self.weights = weights
        self.first, self.moves, self.last = tuple(first), tuple(map(tuple, moves)), tuple(last)
        self.name = uuid.uuid4().hex

    def path(self, path: tuple) -> float:
        return sum(self.weights.get(f, 0.0) for f in path_features(path))

    def text(self, key: tuple[str, ...]) -> float:
        return sum(self.weights.get(f, 0.0) for f in key)

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the labels of the best path; of equal ones label 0."""
        (a, b), back = self.first, []
        (stay0, to1), (to0, stay1) = self.moves
        for i, s in enumerate(scores):
            if i:
                from0, from1 = int(b + to0 > a + stay0), int(b + stay1 > a + to1)
                a, b = (b + to0 if from0 else a + stay0), (b + stay1 if from1 else a + to1)
                back.append((from0, from1))
            b += s
        label = int(b + self.last[1] > a + self.last[0])
        labels = [label]
        for choice in reversed(back):
            label = choice[label]
            labels.append(label)
        return labels[::-1] if scores else []


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Maximum likelihood with a ridge: exact gradients by forward-backward sums over all pages at once."""
    import numpy as np

    pages = [p for p in pages if p[0]]
    place: dict[str, int] = {}
    rows, features = [], []
    lengths = np.array([len(b) for b, _ in pages])
    n, width = len(pages), int(lengths.max())
    gold = np.zeros((n, width), dtype=int)
    for i, (found, labels) in enumerate(pages):
        gold[i, : len(labels)] = labels
        for j, block in enumerate(found):
            for f in (*path_features(block.path), *text_features(block.text, block.linked)):
                rows.append(i * width + j)
                features.append(place.setdefault(f, len(place)))
    rows, features = np.array(rows), np.array(features)
    inside = np.arange(width)[None, :] < lengths[:, None]
    weight = np.zeros(len(place) + 8)
    m1, m2 = np.zeros_like(weight), np.zeros_like(weight)
    every = np.arange(n)

    def logsum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        first, moves, last = weight[-8:-6], weight[-6:-2].reshape(2, 2), weight[-2:]
        unary = np.zeros((n, width, 2))
        unary[:, :, 1] = np.bincount(rows, weight[features], n * width).reshape(n, width)
        ahead, behind = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        ahead[:, 0] = first + unary[:, 0]
        for t in range(1, width):
            ahead[:, t] = logsum(ahead[:, t - 1, :, None] + moves, 1) + unary[:, t]
        ends = lengths - 1
        total = logsum(ahead[every, ends] + last, 1)
        for t in range(width - 1, -1, -1):
            behind[:, t] = last
            if t + 1 < width:
                on = (t < ends)[:, None]
                behind[:, t] = np.where(on, logsum(moves + (unary[:, t + 1] + behind[:, t + 1])[:, None, :], 2), last)
        chance = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
        grad = np.zeros_like(weight)
        error = (chance[:, :, 1] - gold * inside).ravel()
        grad[: len(place)] = np.bincount(features, error[rows], len(place))
        grad[-8:-6] = chance[:, 0].sum(0) - np.bincount(gold[:, 0], minlength=2)
        joint = np.zeros((2, 2))
        for t in range(width - 1):
            on = inside[:, t + 1]
            pair = ahead[on, t, :, None] + moves + (unary[on, t + 1] + behind[on, t + 1])[:, None, :]
            joint += np.exp(pair - total[on, None, None]).sum(0)
            joint -= np.bincount(gold[on, t] * 2 + gold[on, t + 1], minlength=4).reshape(2, 2)
        grad[-6:-2] = joint.ravel()
        grad[-2:] = chance[every, ends].sum(0) - np.bincount(gold[every, ends], minlength=2)
        grad = grad / n + ridge * weight
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        weight = weight - 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    names = {f: float(weight[i]) for f, i in place.items()}
    return Model(names, weight[-8:-6].tolist(), weight[-6:-2].reshape(2, 2).tolist(), weight[-2:].tolist())


def trained(pages: int = PAGES) -> Model:
    """A model fitted on that many labelled pages."""
    from .labelledpages import labelled_pages

    rows = [(blocks(page), labels) for page, labels in labelled_pages(pages)]
    wrong = [i for i, (found, labels) in enumerate(rows) if len(found) != len(labels)]
    if wrong:
        raise ValueError(f"labels and blocks of training page {wrong[0]} differ in number")
    return train(rows)


def main_text(model: Model, page: str | None, paths, texts) -> str:
    """The article's blocks, joined by an empty line."""
    found = blocks(page)
    scores = [paths[b.path] + texts[text_features(b.text, b.linked)] for b in found]
    return "\n\n".join(b.text for b, label in zip(found, model.decode(scores), strict=True) if label)


def extract_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, ``text`` and ``n_chars`` of every page, from the whole html.

    Pages are cut into leaf blocks; ancestor tags, their names and the look of
    the text score each block, and Viterbi finds the best labels for the page.
    Null or empty html, and a page without an article, give an empty text. Ids
    and urls pass through, nulls and repeats included; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        from dossier.llm.extraction import main_text
        from dossier.llm.memo import Memo, kept

        model = shared.value
        paths = kept(f"paths:{model.name}", lambda: Memo(model.path))
        looks = kept(f"looks:{model.name}", lambda: Memo(model.text))
        for batch in batches:
            found = []
            for page in batch.column(2):
                found.append(main_text(model, page.as_py(), paths, looks))
                paths.trim()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    chosen = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`"))
    kind = pages.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
