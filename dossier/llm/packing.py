"""Online packing of documents into token windows by the sum of squares."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
EPOCH_TOKENS = 4_000_000
BATCH_BYTES = 8 << 20
SCHEMA = "{id} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces one by one; ``levels[h]`` counts the open windows filled up to ``h``.

    Each piece goes where the sum of squared counts over the levels 1 to
    ``window - 1`` grows least, a new window included; of equal places the
    fullest wins. A piece is (key, start, ids, document tokens).
    """

    def __init__(self, window: int, first_id: int):
        import numpy as np

        self.np = np
        self.window = window
        self.next_id = first_id
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.held = 0

    def _new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _level_for(self, size: int) -> int:
        """Fill level of the window to use, 0 for a new one."""
        n, w = self.levels, self.window
        best, growth = 0, 2 * int(n[size]) + 1
        if size < w:
            have = n[1 : w - size + 1]
            # n[w] stays 0: full windows do not count, so filling one up saves its square.
            change = 2 * (n[size + 1 : w + 1] - have) + 2
            change[-1] = 1 - 2 * have[-1]
            change = self.np.where(have > 0, change, self.np.iinfo(self.np.int64).max)
            least = int(change.min())
            if least <= growth:
                best = w - size - int(self.np.argmin(change[::-1]))
        return best

    def add(self, piece: tuple) -> list[tuple]:
        """Place a piece of 1 to ``window`` tokens; returns rows of windows that became full."""
        size = len(piece[2]) // 4
        if size == self.window:
            return [(*piece, self._new_id(), 0)]
        level = self._level_for(size)
        if level:
            self.levels[level] -= 1
            stack = self.open[level]
            pieces = stack.pop()
            if not stack:
                del self.open[level]
        else:
            pieces = []
        pieces.append(piece)
        self.held += size
        if level + size == self.window:
            return self._close(pieces)
        self.levels[level + size] += 1
        self.open.setdefault(level + size, []).append(pieces)
        return []

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset, number = [], 0, self._new_id()
        for piece in pieces:
            rows.append((*piece, number, offset))
            offset += len(piece[2]) // 4
        self.held -= offset
        return rows

    def flush(self) -> list[tuple]:
        """Close all open windows: the fullest are topped up with cut pieces of the emptiest."""
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open.clear()
        self.levels[:] = 0
        rows: list[tuple] = []
        first, last = 0, len(windows) - 1
        while first <= last:
            room = 4 * self.window - sum(len(p[2]) for p in windows[first])
            while room and first < last:
                key, start, ids, total = windows[last].pop()
                taken, rest = ids[:room], ids[room:]
                windows[first].append((key, start, taken, total))
                room -= len(taken)
                if rest:
                    windows[last].append((key, start + len(taken) // 4, rest, total))
                if not windows[last]:
                    last -= 1
            rows += self._close(windows[first])
            first += 1
        return rows


def packed_rows(documents: Iterator[tuple], window: int, epoch_tokens: int, first_id: int) -> Iterator[tuple]:
    """Pieces with their places for (key, ids) documents of one task."""
    packer = Packer(window, first_id)
    for key, ids in documents:
        total, step = len(ids) // 4, 4 * window
        for at in range(0, len(ids), step):
            yield from packer.add((key, at // 4, ids[at : at + step], total))
        if packer.held >= epoch_tokens:
            yield from packer.flush()
    yield from packer.flush()


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    epoch_tokens: int = EPOCH_TOKENS,
) -> DataFrame:
    """Cut documents into pieces and pack them into sequences of ``window`` tokens.

    One row per piece: the id, ``start`` (tokens of its document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit numbers), ``doc_tokens``
    (with the end id), ``sequence_id`` and ``offset`` (its place there; places
    are gapless from 0). Documents longer than a window fill whole windows
    first; the rest is placed online by the sum of squares. Whenever the open
    windows of a task hold ``epoch_tokens`` tokens, and at the end, the open
    windows are closed: the emptiest are cut up to fill the fullest, so at most
    one window per epoch needs padding, and none if it ends at a power of two.

    No shuffle: each task packs the documents it reads, in bounded memory, and
    numbers its sequences from its partition number, so a lost task is simply
    run again. Null and empty texts hold the end id only. Null or repeated ids
    pack like others, one document per row. An empty table gives no rows; other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from dossier.llm.encoding import encoder

        encode = encoder(tokenizer_path).ids
        end = int(end_id).to_bytes(4, "little")

        def documents():
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield key, encode(text.as_py() or "") + end

        types = [batch_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def table(rows):
            keys, starts, ids, totals, numbers, offsets = zip(*rows, strict=True)
            columns = [keys, starts, [len(i) // 4 for i in ids], ids, totals, numbers, offsets]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        first_id = TaskContext.get().partitionId() << 40
        rows, size = [], 0
        for row in packed_rows(documents(), window, epoch_tokens, first_id):
            rows.append(row)
            size += len(row[2]) + 64
            if size >= BATCH_BYTES:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(docs.schema[id_col].dataType)
    chosen = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return chosen.mapInArrow(run, SCHEMA.format(id=f"`{id_col}`", kind=kind))
