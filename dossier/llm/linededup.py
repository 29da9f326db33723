"""Near-duplicate lines across documents: one occurrence of each group stays."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scaling import small_rows
from .components import connected
from .naming import unused
from .sketches import turned_bits
from .tables import Tables

LEAST_WORDS = 5
LEAST_LETTERS = 20
SIMILARITY = 0.9
BITS = 64
# SimHash bits in which alike lines may differ: all of them, so that the edit similarity alone decides.
DISTANCE = BITS
# Up to so many bits, blocks of the SimHash find all pairs.
NEAR = 3
BUCKET_LINES = 64
GRAM_WORDS = 5
MOST_WINDOW = 16
HUB_ROUNDS = 3
# Buckets of at most so many lines give all their pairs after the first turn of hubs.
FEW_LINES = 16
# The numbers of 64 bits that sketch the words of a line.
SKETCH = ("s0", "s1", "s2", "s3")
# Lines of more words than this have a wider sketch as well, about a bit a word, of at most so many numbers.
WIDE_WORDS, WIDE_MOST = 384, 64
# Pairs whose words become Python objects at a time.
PAIRS_AT_ONCE = 64

NOT_WORD = re.compile(r"[\W_]+")
DIGIT = re.compile(r"\d")
# Thai, Lao, Tibetan, Burmese, Khmer, Japanese and Chinese: written without spaces, so that each letter is a word.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def _plain(text: str) -> str:
    """Lower case, every digit a 0, without anything that is neither letter, number nor white space."""
    return " ".join(DIGIT.sub("0", NOT_WORD.sub("", chunk)) for chunk in text.lower().split())


# The same for the Western letters of one byte each, as a table.
_WESTERN = [bytes([b]).decode("latin-1") for b in range(256)]
TABLE = bytes(ord(" " if c.isspace() else _plain(c) or "-") for c in _WESTERN)
DROPPED = bytes(b for b, c in enumerate(_WESTERN) if not c.isspace() and not _plain(c))


def normalised(line: str) -> list[bytes]:
    """Words of a line as UTF-8, in scripts without spaces its letters: lower case, every digit a 0, without punctuation."""
    try:
        plain = line.encode("latin-1").translate(TABLE, DROPPED)
    except UnicodeEncodeError:
        return UNSPACED.sub(r" \g<0> ", _plain(line)).encode("utf-8", "surrogatepass").split()
    return plain.split() if line.isascii() else plain.decode("latin-1").encode().split()


def long_enough(words: list[bytes], least_words: int) -> bool:
    """Whether a line has so many words parted by spaces, or ``LEAST_LETTERS`` letters and digits in all."""
    if len(words) >= least_words and all(map(bytes.isascii, words)):
        return True
    text = b" ".join(words).decode("utf-8", "surrogatepass")
    return len(text) - text.count(" ") >= LEAST_LETTERS or len(UNSPACED.sub(" ", text).split()) >= least_words


def digest(words: list[bytes]) -> bytes:
    """128 bits that name a normalised line; the first 60 are its id in the similarity step."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def simhashes(lines: list[list[bytes]]):
    """Signed 64-bit SimHash of the distinct words of each line: a bit is set where most words have it.

    Bits are counted eight at a time, in the bytes of a 64-bit number, over runs
    of at most 255 words.
    """
    import numpy as np
    from xxhash import xxh3_64_intdigest

    flat: list[int] = []
    sizes = np.empty(len(lines), dtype=np.int64)
    for i, words in enumerate(lines):
        distinct = set(words)
        sizes[i] = len(distinct)
        flat.extend(map(xxh3_64_intdigest, distinct))
    hashes = np.array(flat, dtype=np.uint64)
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    line_start = np.cumsum(sizes) - sizes
    starts = np.repeat(line_start - 255 * first, runs) + 255 * np.arange(int(runs.sum()))
    most = np.empty((len(lines), 8, 8), dtype=np.uint8)
    for bit in range(8):
        ones = (hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        counts = np.add.reduceat(ones, starts).view(np.uint8).reshape(-1, 8)
        most[:, :, bit] = np.add.reduceat(counts, first, axis=0, dtype=np.int32) * 2 > sizes[:, None]
    return np.packbits(most.reshape(len(lines), 64), axis=1, bitorder="little").view("<i8").ravel()


def edits(words: int, similarity: float) -> int:
    """Edits that a line and one of at most as many words may be apart."""
    return int((1 - similarity) * words + 1e-9)


@functools.lru_cache(1 << 16)
def common_run(words: int, similarity: float) -> int:
    """Words in a row that a line of that length shares with every line alike; 0 if only equal ones are.

    Of m words of the longer line all but d edits stay, in at most d + 1 runs.
    """
    least = 0
    longer = words
    while longer - edits(longer, similarity) <= words:
        d = edits(longer, similarity)
        if d:
            run = -(-(longer - d) // (d + 1))
            least = min(least or run, run)
        longer += 1
    return least


@functools.lru_cache(16)
def gram_words(similarity: float) -> int:
    """Words of a gram: no more than the shortest run that lines alike share."""
    return min([GRAM_WORDS, *(run for n in range(1, 500) if (run := common_run(n, similarity)))])


def occurrences(hashes, sizes):
    """How often the word at each place has come before in its line."""
    import numpy as np

    line = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    own = (hashes ^ (line * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(own, kind="stable")
    sorted_own = own[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_own[1:] != sorted_own[:-1])))
    before = np.empty(len(hashes), dtype=np.uint64)
    before[order] = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    return before


def counted_words(lines: list[list[bytes]]):
    """Hash of every word, a hash of it with the number of its occurrence in its line, and the sizes of lines."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    hashes = np.fromiter(map(xxh3_64_intdigest, itertools.chain.from_iterable(lines)), np.uint64, int(sizes.sum()))
    return hashes, (hashes + occurrences(hashes, sizes) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9), sizes


def wide_sketches(lines: list[list[bytes]]) -> list:
    """The sketch of each line of more than ``WIDE_WORDS`` words in as many numbers as keep it from filling up, else None.

    Their count is a power of two; folded in halves it is the sketch of fewer numbers.
    """
    import numpy as np

    wide = [None] * len(lines)
    for i, words in enumerate(lines):
        if len(words) > WIDE_WORDS:
            counted = counted_words([words])[1]
            numbers = min(WIDE_MOST, 1 << (-(-len(words) // 64) - 1).bit_length())
            found = np.zeros(numbers, np.uint64)
            np.bitwise_xor.at(found, ((counted >> np.uint64(40)) % np.uint64(numbers)).astype(np.int64), np.uint64(1) << (counted >> np.uint64(58)))
            wide[i] = found.view(np.int64)
    return wide


def run_keys(lines: list[list[bytes]], similarity: float, numbers: int = 2):
    """Keys of each line, of which lines alike but not equal share one, and ``numbers`` (a power of two) that sketch its words.

    A key is the smallest gram hash in a window of grams no longer than the run
    of words that the line shares with any line alike; a window inside that run
    gives both lines a key of the one with the wider windows. The sketch turns a
    bit for every word with the number of its occurrence, so that an edit turns
    at most two and words said over and over do not cancel out.
    """
    import numpy as np

    hashes, counted, sizes = counted_words(lines)
    starts = np.cumsum(sizes) - sizes
    bits = np.uint64(1) << (counted >> np.uint64(58))
    place = (counted >> np.uint64(40)) % np.uint64(numbers)
    sketch = [np.bitwise_xor.reduceat(np.where(place == i, bits, np.uint64(0)), starts).view(np.int64) for i in range(numbers)]

    gram = gram_words(similarity)
    windows = np.array([min(max(common_run(n, similarity) - gram + 1, 0), MOST_WINDOW) for n in sizes.tolist()], dtype=np.int64)
    keys = [()] * len(lines)
    if not windows.any():
        return keys, sketch
    least = np.zeros(max(0, len(hashes) - gram + 1), dtype=np.uint64)
    for i in range(gram):
        least = (least + hashes[i : i + len(least)]) * np.uint64(0x9E3779B97F4A7C15)
        least ^= least >> np.uint64(29)
    grams = least * np.uint64(0xBF58476D1CE4E5B9)
    least = grams
    for window in range(1, int(windows.max()) + 1):
        if window > 1:
            least = np.minimum(least[:-1], grams[window - 1 :])
        chosen = np.flatnonzero(windows == window)
        if not len(chosen):
            continue
        # Windows of all lines of that width one after the other; one minimum stays the least of several in a row.
        first, many = starts[chosen], sizes[chosen] - gram - window + 2
        ends = np.cumsum(many)
        found = least[np.repeat(first - ends + many, many) + np.arange(ends[-1])]
        new = np.concatenate(([True], found[1:] != found[:-1]))
        new[ends[:-1]] = True
        kept = np.concatenate(([0], np.cumsum(new)))
        found = found[new].view(np.int64)
        for i, begin, end in zip(chosen.tolist(), kept[ends - many].tolist(), kept[ends].tolist(), strict=True):
            own = found[begin:end]
            keys[i] = own if end - begin < 2 * len(set(own.tolist())) else np.unique(own)
    return keys, sketch


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and exchanges of words between two lines, bit-parallel."""
    if not a or not b:
        return max(len(a), len(b))
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for w in b:
        match = places.get(w, 0)
        vertical = match | minus
        diagonal = (((match & plus) + plus) ^ plus) | match
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        plus = (down << 1 & full) | ~(vertical | up) & full
        minus = up & vertical
    return score


def alike(a: list, b: list, similarity: float) -> bool:
    """Whether two lines are alike; words that one has more often than the other are edits, so most others are told without a distance."""
    longest = max(len(a), len(b))
    most = (1 - similarity) * longest + 1e-9
    if abs(len(a) - len(b)) > most or longest - (Counter(a) & Counter(b)).total() > most:
        return False
    return edit_distance(a, b) <= most


def line_rows(docs: DataFrame, id_col: str, text_col: str, least_words: int, similarity: float, distance: int) -> DataFrame:
    """``doc``, ``line`` (from 0), whether it is the ``first`` such line of its text, ``node`` (digest) and what finds lines alike.

    That is ``simhash``, if ``distance`` bounds it, and, unless blocks of it do,
    the number of words ``n``, the numbers of its ``SKETCH`` and, once a task,
    its ``wide`` one and the ``keys``. Only lines that are ``long_enough``. Rows without an id are
    left out.
    """

    def run(batches):
        import pyarrow as pa

        from dossier.llm.linededup import SKETCH, digest, long_enough, normalised, run_keys, simhashes, wide_sketches
        from dossier.llm.memo import forget

        forget()
        names = ["doc", "line", "first", "node", "simhash", "n", *SKETCH, "wide", "keys"]
        kinds = [id_type, pa.int32(), pa.bool_(), pa.binary(), *[pa.int64()] * (2 + len(SKETCH)), *[pa.list_(pa.int64())] * 2]
        held, words, size, given = [], [], 0, set()
        shortest = min(2 * least_words - 1, LEAST_LETTERS)

        def table():
            columns = list(zip(*held, strict=True))
            nothing = [None] * len(held)
            columns.append(simhashes(words) if distance < BITS else nothing)
            if distance <= NEAR:
                columns += [nothing] * (3 + len(SKETCH))
            else:
                # A line that this task has given before goes by its name alone.
                if len(given) > 1_000_000:
                    given.clear()
                own, slots = [], []
                for line, name in zip(words, columns[3], strict=True):
                    slots.append(None if name in given else len(own))
                    if name not in given:
                        given.add(name)
                        own.append(line)
                keys, sketch = run_keys(own, similarity, len(SKETCH)) if own else ((), [()] * len(SKETCH))
                slots = pa.array(slots, pa.int64())
                found = ([len(w) for w in own], *sketch, wide_sketches(own), keys)
                columns += [pa.array(c, k).take(slots) for c, k in zip(found, kinds[5:], strict=True)]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, seen = doc.as_py(), set()
                for number, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= shortest:
                        found = normalised(line)
                        if found and long_enough(found, least_words):
                            name = digest(found)
                            held.append((doc, number, name not in seen, name))
                            seen.add(name)
                            words.append(found)
                            size += len(found)
                if size >= 100_000:
                    yield table()
                    held.clear()
                    words.clear()
                    size = 0
        if held:
            yield table()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).filter("doc is not null")
    columns = f"line int, first boolean, node binary, simhash long, n long, {' long, '.join(SKETCH)} long, wide array<long>, keys array<long>"
    return chosen.mapInArrow(run, f"doc {kind}, {columns}")


def blocks_for(lines: int, distance: int = NEAR) -> int:
    """Number of blocks whose keys keep buckets near ``BUCKET_LINES`` lines at that many lines.

    With b blocks, lines within ``distance`` agree in some b - distance of them.
    More blocks mean longer keys and more of them; the pairs found are the same.
    """
    blocks = distance + 1
    while blocks < distance + 4 and lines > BUCKET_LINES << BITS * (blocks - distance) // blocks:
        blocks += 1
    return blocks


def block_keys(simhash: Column, blocks: int, equal: int) -> Column:
    """Keys of all choices of ``equal`` out of ``blocks`` pieces of the SimHash, as an array.

    A key is a hash of the choice and its pieces; what meets by chance is told apart by the distance.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), equal)):
        mask = sum(masks[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), simhash.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def hub_pairs(lines: DataFrame, distance: int) -> DataFrame:
    """Pairs of each line with the smallest id of its bucket, in buckets that differ in one block only.

    A linear number of pairs that ties dense groups of variants together.
    """
    keyed = lines.select("id", "simhash", F.explode(block_keys(F.col("simhash"), distance + 1, distance)).alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("_last"), F.min_by("simhash", "id").alias("_sim"))
    hubs = hubs.filter("hub <> _last").drop("_last")
    pairs = keyed.join(hubs, "key").filter((F.col("id") != F.col("hub")) & _near(F.col("simhash"), F.col("_sim"), distance))
    return pairs.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def far_pairs(lines: DataFrame, groups: DataFrame, distance: int, blocks: int) -> DataFrame:
    """All pairs within ``distance`` whose lines are not yet in one group."""
    tied = lines.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keyed = tied.select("id", "simhash", "component", F.explode(block_keys(F.col("simhash"), blocks, blocks - distance)).alias("key"))
    a, b = keyed.alias("x"), keyed.alias("y")
    meet = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.id") < F.col("y.id"))
        & (F.col("x.component") != F.col("y.component"))
        & _near(F.col("x.simhash"), F.col("y.simhash"), distance)
    )
    return a.join(b, meet).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def crowded_keys(keyed: DataFrame, signatures: DataFrame, narrowed: Callable[[DataFrame], DataFrame] = lambda keys: keys) -> DataFrame:
    """The lines (``id``, ``n``, the ``SKETCH`` and ``wide`` one, ``simhash``) of every ``key`` that several share.

    Keys are dealt out once: the window sees the smallest and largest id of a key where its lines lie.
    ``narrowed`` gets the shared keys and may write them before their lines are joined.
    """
    of_key = Window.partitionBy("key")
    several = keyed.withColumn("_a", F.min("id").over(of_key)).withColumn("_z", F.max("id").over(of_key)).filter("_a <> _z")
    return narrowed(several.select("id", "key")).distinct().join(signatures, "id")


def _turned(x: str, y: str) -> Column:
    """Bits in which the sketches of two lines differ."""
    return functools.reduce(Column.__add__, [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH])


def _may_be_alike(x: str, y: str, distance: int, similarity: float) -> Column:
    """Whether lengths and sketches leave it possible that two lines are alike."""
    a, b = ({c: F.col(f"{side}.{c}") for c in ("n", "simhash", "wide")} for side in (x, y))
    most = F.floor(F.greatest(a["n"], b["n"]) * F.lit(1 - similarity) + F.lit(1e-9))
    # Each edit turns two bits, one that adds or takes a word only one.
    gap = F.abs(a["n"] - b["n"])
    may = (gap <= most) & (_turned(x, y) <= most * 2 - gap)
    may = may & F.coalesce(turned_bits(a["wide"], b["wide"]) <= most * 2 - gap, F.lit(True))
    return may if distance >= BITS else may & _near(a["simhash"], b["simhash"], distance)


def placed_lines(crowds: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the keys that bring lines of several groups together, with the ``component`` of each line and the number of lines of its key, ``crowd``."""
    of_key = Window.partitionBy("key")
    rows = crowds.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.withColumn("_a", F.min("component").over(of_key)).withColumn("_z", F.max("component").over(of_key))
    return mixed.withColumn("crowd", F.count(F.lit(1)).over(of_key)).filter("_a <> _z").drop("_a", "_z")


def hub_run_pairs(rows: DataFrame, turn: int, distance: int, similarity: float) -> DataFrame:
    """Each line with the nearest of its buckets' hubs that it may be alike and is in no group with.

    A linear number of pairs. A bucket's hub is drawn by a hash, anew at every turn.
    """
    line = F.struct("id", "component", "n", *SKETCH, "wide", "simhash")
    hubs = rows.groupBy("key").agg(F.min_by(line, F.xxhash64("id", "key", F.lit(turn))).alias("hub"))
    met = rows.select("key", line.alias("line")).join(hubs, "key").filter("line.component <> hub.component")
    met = met.filter(_may_be_alike("line", "hub", distance, similarity))
    best = met.groupBy(F.col("line.id").alias("id")).agg(F.min(F.struct(_turned("line", "hub").alias("turned"), "hub.id")).alias("best"))
    pair = F.col("id"), F.col("best.id")
    return best.select(F.least(*pair).alias("a"), F.greatest(*pair).alias("b")).distinct()


def length_class(n: Column, similarity: float) -> Column:
    """The class of a line of ``n`` words; lines alike are in the same or in neighbouring ones."""
    return F.floor(F.ln(n) / F.lit(1e-6 - math.log(max(similarity, 1e-9))))


def far_run_pairs(rows: DataFrame, distance: int, similarity: float) -> DataFrame:
    """All pairs of lines that share a key, may be alike and are not yet in one group.

    Lines meet only those of their key that are about as long.
    """
    sized = rows.withColumn("size", length_class(F.col("n"), similarity))
    meeting = sized.withColumn("meets", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    meet = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.size") == F.col("y.meets"))
        & ((F.col("x.size") != F.col("y.size")) | (F.col("x.id") < F.col("y.id")))
        & (F.col("x.component") != F.col("y.component"))
        & _may_be_alike("x", "y", distance, similarity)
    )
    pair = F.col("x.id"), F.col("y.id")
    return sized.alias("x").join(meeting.alias("y"), meet).select(F.least(*pair).alias("a"), F.greatest(*pair).alias("b")).distinct()


def texts_of(ids: DataFrame, lines: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and the ``words`` of the line's first occurrence, parted by spaces."""
    places = lines.join(ids, "id").select("id", "doc", "line")
    chosen = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    if small_rows(places) is not None:
        places = F.broadcast(places)
    found = chosen.join(places, "doc").select("id", F.element_at(F.split("text", "\n", -1), F.col("line") + 1).alias("text"))

    def run(batches):
        import pyarrow as pa

        from dossier.llm.linededup import normalised

        for batch in batches:
            words = [b" ".join(normalised(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["id", "words"])

    return found.mapInArrow(run, "id long, words binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float, tables: Tables) -> DataFrame:
    """The pairs whose lines are alike, written."""
    pairs = tables.write(pairs)
    if pairs.isEmpty():
        return pairs
    words = tables.write(texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    both = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    both = both.join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b").select("a", "b", "wa", "wb")

    def run(batches):
        import pyarrow as pa

        from dossier.llm.linededup import PAIRS_AT_ONCE, alike

        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                some = batch.slice(at, PAIRS_AT_ONCE)
                both = zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True)
                keep += [alike(x.split(b" "), y.split(b" "), similarity) for x, y in both]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = tables.write(both.mapInArrow(run, "a long, b long"))
    tables.drop(pairs, words)
    return found


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    distance: int = DISTANCE,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``doc`` and ``lines``: number (from 0, split at line feeds) and digest of its lines that go.

    Lines are alike when their word edit similarity (1 - distance / longer line)
    is ``similarity`` or more and, if ``distance`` is given, their SimHashes
    differ in at most so many bits; equal normalised lines always are. Of each connected group the
    occurrence with the smallest (id, line) stays. Lines of fewer than
    ``least_words`` words parted by spaces and of fewer than ``LEAST_LETTERS``
    letters and digits always stay; scripts without spaces have letters for words. First every line is compared with hubs of
    its buckets, which ties dense groups with a linear number of pairs; then all
    pairs that lie in different groups and share a run of words that lines alike
    must share or, for few SimHash bits, that pigeonhole blocks bring together;
    small buckets give theirs at once, only crowded ones are compared with more hubs before.
    Only narrow rows meet; texts are fetched for candidates alone.
    """
    by_blocks = distance <= NEAR
    tables = Tables(docs.sparkSession, "lines")
    full = tables.write(line_rows(docs, id_col, text_col, least_words, similarity, distance))
    lines = tables.write(full.select("doc", "line", "node"))
    doc = F.when(F.col("first"), F.col("doc"))
    distinct = full.groupBy("node").agg(
        F.min(doc).alias("doc"), F.min_by("line", doc).alias("line"), *[F.max(c).alias(c) for c in ("simhash", "n", *SKETCH)], F.count(F.lit(1)).alias("_times")
    )
    name = F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long")
    distinct = tables.write(distinct.withColumn("id", name))
    signatures = distinct.select("id", "simhash", "n", *SKETCH)

    def texts(ids):
        return texts_of(ids, distinct, docs, id_col, text_col)

    if by_blocks:
        tables.drop(full)
        links = verified(hub_pairs(signatures, distance), texts, similarity, tables)
        groups = connected(links).withColumnRenamed("node", "id")
        second = far_pairs(signatures, groups, distance, blocks_for(distinct.count(), distance))
    else:
        keyed = full.select(name.alias("id"), F.explode("keys").alias("key"))
        wide = tables.write(full.filter("wide is not null").select(name.alias("id"), "wide").dropDuplicates(["id"]))
        shared = []

        def narrowed(keys):
            # Lone keys, most of them, are gone from the disk before the lines of the others are joined.
            shared.append(tables.write(keys))
            tables.drop(full)
            return shared[0]

        crowds = tables.write(crowded_keys(keyed, signatures.join(wide, "id", "left"), narrowed))
        tables.drop(wide, *shared)
        links = signatures.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
        groups = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
        rows, few, placed = crowds.withColumn("component", F.col("id")), None, crowds
        for turn in range(HUB_ROUNDS):
            pairs = hub_run_pairs(rows, turn, distance, similarity)
            if few is not None:
                pairs = pairs.union(far_run_pairs(few, distance, similarity)).distinct()
            found = verified(pairs, texts, similarity, tables)
            if turn and found.isEmpty():
                break
            links, before = tables.write(links.union(found)), links
            groups = connected(links).withColumnRenamed("node", "id")
            placed, earlier = tables.write(placed_lines(rows.drop("component", "crowd"), groups)), placed
            tables.drop(found, before, earlier)
            # Small buckets give their pairs in the second turn and are done with then.
            few = placed.filter(F.col("crowd") <= FEW_LINES) if not turn else None
            rows = placed.filter(F.col("crowd") > FEW_LINES) if not turn else placed
        second = far_run_pairs(rows, distance, similarity) if few is None else far_run_pairs(placed, distance, similarity)
    more = verified(second, texts, similarity, tables)
    if not more.isEmpty():
        groups = connected(links.union(more)).withColumnRenamed("node", "id")
    tables.keep(lines, distinct)
    # A line that occurs once and has no group stays; any other may have something to remove.
    placed = distinct.join(groups, "id", "left").filter("_times > 1 or component is not null")
    placed = placed.withColumn("component", F.coalesce("component", "id")).select("node", "component", "doc", "line")
    first = placed.groupBy("component").agg(F.min(F.struct("doc", "line")).alias("kept"))
    kept = placed.select("node", "component").join(first, "component").select("node", "kept")
    gone = lines.join(kept, "node").filter((F.col("doc") != F.col("kept.doc")) | (F.col("line") != F.col("kept.line")))
    return gone.groupBy("doc").agg(F.collect_set(F.struct("line", "node")).alias("lines"))


def count_columns(docs: DataFrame) -> list[str]:
    """Names of the columns that :func:`dedup_lines` adds: lines before, and lines removed.

    ``_n_lines`` and ``_n_removed``, with further underscores where ``docs`` has such columns itself.
    """
    return unused(docs.columns, "_n_lines", "_n_removed")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the lines that repeat one that stays, with the columns named by :func:`count_columns`.

    Null texts stay null and count no line; a text all of whose lines go becomes
    empty. Rows without an id keep their lines and are not compared; equal lines
    of the same number in rows that share an id stay or go together. An empty
    table stays empty; other columns, whatever their names, pass through.
    """
    counted = count_columns(docs)
    doc_of, lines_of = unused([*docs.columns, *counted], "_doc", "_lines")
    gone = repeated_lines(docs, id_col, text_col, **options).select(F.col("doc").alias(doc_of), F.col("lines").alias(lines_of))
    joined = docs.join(gone.hint("shuffle_hash"), F.col(f"`{id_col}`") == F.col(doc_of), "left").drop(doc_of)
    joined = joined.withColumn(counted[0], F.lit(0)).withColumn(counted[1], F.lit(0))
    schema = joined.drop(lines_of).schema
    text_at, lines_at = joined.columns.index(text_col), joined.columns.index(lines_of)

    def run(batches):
        import pyarrow as pa

        from dossier.llm.linededup import digest, normalised

        for batch in batches:
            texts, before, after = [], [], []
            for text, numbers in zip(batch.column(text_at).to_pylist(), batch.column(lines_at).to_pylist(), strict=True):
                if text is None:
                    counts = 0, 0
                elif numbers:
                    parts = text.split("\n")
                    gone = {(x["line"], x["node"]) for x in numbers}
                    places = {x["line"] for x in numbers}
                    left = [p for i, p in enumerate(parts) if i not in places or (i, digest(normalised(p))) not in gone]
                    counts = len(parts), len(parts) - len(left)
                    text = "\n".join(left)
                else:
                    counts = text.count("\n") + 1, 0
                texts.append(text)
                before.append(counts[0])
                after.append(counts[1])
            arrays = list(batch.columns)
            arrays[text_at] = pa.array(texts, pa.string())
            del arrays[lines_at]
            arrays[-2:] = [pa.array(before, pa.int32()), pa.array(after, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return joined.mapInArrow(run, schema)
