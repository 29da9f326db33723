"""Benchmark passages in documents, found by a generalised suffix automaton of the items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .naming import unused

WINDOW = 13
COVERAGE_PERCENT = 5
SHARD_WORDS = 400_000

# Words are runs of lower-case letters, digits and anything beyond ASCII.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over the words of some items.

    ``feed`` takes the matched state and length through one more word, the
    longest suffix of the text that occurs in an item, cut to ``window`` words.
    ``found`` holds, for the state of a window, the items that contain it; of an
    item with fewer words the whole item is the window.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.found: dict[int, set[str]] = {}
        self.short: dict[int, int] = {}
        items = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for name, words in items if words]
        self.least = min((min(len(ids), window) for _, ids in items), default=window)
        for _, ids in items:
            last = 0
            for word in ids:
                last = self._extend(last, word)
        for name, ids in items:
            self._mark(name, ids)
        self._inherit()

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, word, known)
        new = self._state(length[last] + 1, {})
        at = last
        while at != -1 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at == -1:
            link[new] = 0
        else:
            target = nxt[at][word]
            link[new] = target if length[target] == length[at] + 1 else self._clone(at, word, target)
        return new

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, at: int, word: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[target]))
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def feed(self, state: int, matched: int, word: int) -> tuple[int, int]:
        nxt, link, length = self.next, self.link, self.length
        while state and word not in nxt[state]:
            state = link[state]
            matched = length[state]
        if word not in nxt[state]:
            return 0, 0
        state, matched = nxt[state][word], matched + 1
        if matched > self.window:
            matched = self.window
        while length[link[state]] >= matched:  # the state that holds the cut match
            state = link[state]
        return state, matched

    def _mark(self, name: str, ids: list[int]) -> None:
        state = matched = 0
        whole = min(len(ids), self.window)
        for word in ids:
            state, matched = self.feed(state, matched, word)
            if matched == whole and (whole == self.window or len(ids) == whole):
                self.found.setdefault(state, set()).add(name)
                if whole < self.window:
                    self.short[state] = whole

    def _inherit(self) -> None:
        """Point each state to the nearest short item on its chain of suffixes, itself included."""
        self.shorter = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.shorter[state] = state if state in self.short else self.shorter[self.link[state]]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs [start, end) of hit words, and the items whose windows occur."""
        import numpy as np

        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * n), dtype=np.int32, count=n)
        # A window consists of known words only, so shorter runs of them hold none.
        breaks = np.concatenate(([-1], np.flatnonzero(ids == 0), [n]))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for b in np.flatnonzero(np.diff(breaks) > self.least):
            start, end = int(breaks[b]) + 1, int(breaks[b + 1])
            state = matched = 0
            for at, word in enumerate(ids[start:end].tolist(), start):
                state, matched = self.feed(state, matched, word)
                hit = 0
                if matched == self.window:
                    hit = matched
                    items |= self.found.get(state, set())
                short = self.short.get(state, 0)
                marked = state if 0 < short <= matched else self.shorter[self.link[state]] if state else -1
                while marked > 0:
                    hit = max(hit, self.short[marked])
                    items |= self.found[marked]
                    marked = self.shorter[self.link[marked]]
                if hit:
                    first = at + 1 - hit
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, at + 1))
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [start, end) runs, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _shards(items: DataFrame, item_id: str, item_text: str, window: int, shard_words: int) -> Iterator[Automaton]:
    """Automata of at most ``shard_words`` words each (one longer item is cut into overlapping parts).

    Items come to the driver one by one; what is broadcast at a time is bounded.
    """
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("name"), F.col(f"`{item_text}`").alias("text"))
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        for at in range(0, max(1, len(words) - window + 1), shard_words):
            part = words[at : at + shard_words + window - 1] if len(words) > shard_words else words
            if held and size + len(part) > shard_words:
                yield Automaton(held, window)
                held, size = [], 0
            if part:
                held.append((row["name"] or "", part))
                size += len(part)
            if part is words:
                break
    if held:
        yield Automaton(held, window)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    out: str = "_found",
) -> DataFrame:
    """``docs`` with a struct column ``out``: ``n_words``, ``spans`` and ``items``.

    ``spans`` are the runs of words inside an occurrence of a window of an item
    (``window`` words, or a whole shorter item), ``items`` the ids as text of the
    items found. The items are cut into automata of bounded size, each broadcast
    and streamed over in turn; the documents are not shuffled and texts are read
    whole. Null and empty texts have no words; null and wordless items match
    nothing; items with equal ids are one item, a null id counts as an empty
    one. Empty tables give no rows or no hits; other columns pass through.
    """
    context = docs.sparkSession.sparkContext
    found = docs.withColumn(
        out, F.lit(None).cast("struct<n_words: bigint, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>")
    )
    schema = found.schema
    empty = True
    for automaton in _shards(items, item_id, item_text, window, shard_words):
        empty = False
        found = found.mapInArrow(_matcher(context.broadcast(automaton), text_col, out), schema)
    if empty:
        found = found.mapInArrow(_matcher(context.broadcast(Automaton([], window)), text_col, out), schema)
    return found


def _matcher(automaton, text_col: str, out: str):
    def run(batches):
        import pyarrow as pa

        from dossier.llm.decontamination import merged, words_of

        match = automaton.value.match
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            place = batch.schema.get_field_index(out)
            rows = []
            for text, before in zip(texts, batch.column(place).to_pylist(), strict=True):
                words = words_of(text.as_py())
                spans, items = match(words)
                if before:
                    spans = merged([*spans, *((s["start"], s["end"]) for s in before["spans"])])
                    items |= set(before["items"])
                rows.append(
                    {"n_words": len(words), "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(items)}
                )
            yield batch.set_column(place, batch.schema.field(place), pa.array(rows, batch.schema.field(place).type))

    return run


def hit_words(found: str = "_found"):
    """Number of words inside spans."""
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(found: str = "_found", coverage_percent: int = COVERAGE_PERCENT):
    hits = hit_words(found)
    return (hits > 0) & (hits * 100 >= F.col(f"{found}.n_words") * coverage_percent)


def drop_contaminated(docs: DataFrame, items: DataFrame, coverage_percent: int = COVERAGE_PERCENT, **options) -> DataFrame:
    """The documents whose words are hit to less than ``coverage_percent``, unchanged.

    Null and wordless texts stay, rows that share an id are judged one by one, an empty
    table stays empty, and columns of any name pass through.
    """
    (out,) = unused(docs.columns, "_found")
    found = find_items(docs, items, out=out, **options)
    return found.filter(~is_contaminated(out, coverage_percent)).drop(out)


def remove_spans(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    least_words: int = WINDOW,
    coverage_percent: int = 100,
    **options,
) -> DataFrame:
    """Documents without the spans of at least ``least_words`` words, dropped where hits reach ``coverage_percent``.

    A removed span takes the characters from its first to its last word; the
    rest of the text stays as it is. Null texts stay null.
    """
    (out,) = unused(docs.columns, "_found")
    found = find_items(docs, items, text_col=text_col, out=out, **options)
    found = found.filter(~is_contaminated(out, coverage_percent))
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        from dossier.llm.decontamination import without_spans

        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts, spans = batch.column(place).to_pylist(), batch.column(len(columns)).to_pylist()
            cut = [
                t if t is None else without_spans(t, [(s["start"], s["end"]) for s in f["spans"] if s["end"] - s["start"] >= least_words])
                for t, f in zip(texts, spans, strict=True)
            ]
            batch = batch.set_column(place, batch.schema.field(place), pa.array(cut, batch.schema.field(place).type))
            yield batch.select(range(len(columns)))

    return found.mapInArrow(run, docs.schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the characters of some runs of its words."""
    if not spans:
        return text
    import re

    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")
