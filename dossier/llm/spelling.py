"""Spelling variants: words one edit apart, found through a trie of letter-group counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_folder, work_folder

LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_FACTOR = 10
# One run in so many, by its hash, loses a letter.
DAMAGED = 31

# Levels of the trie: words' length, the counts of so many groups of letters, and of so many single letters.
GROUPS, SINGLES = 12, 16
# A subtree of more words than this is parted at its next level; at most PARTED of each level are.
SUBTREE_WORDS, PARTED = 50_000, 20_000
# Words that search one subtree in one task; more are dealt to several tasks.
SEARCHERS = 200_000
# A node of so few words is verified without going on to its children.
LEAF_WORDS = 24
# Distinct words of a task that are counted before they are passed on, and pairs compared at once.
COUNTED, PAIRS = 300_000, 1_000_000
# Words of more letters are compared one pair at a time.
WIDE = 64

# The letters of a run, after A-Z have been lower-cased.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def runs(text: str | None) -> list[str]:
    """Lower-cased maximal runs of at least ``LEAST_LETTERS`` letters; a null text has none."""
    return _RUN.findall(text.encode().translate(_LOWER).decode()) if text else []


def damaged(run: str, prefix: int) -> str:
    """The run, without one letter where the crc32 of ``<id>:<run>`` says so; ``prefix`` is that of ``<id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``word`` and ``n`` of all words with enough letters and occurrences; a null id is written as nothing."""

    def count(batches):
        seen: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                prefix = zlib.crc32(f"{name.as_py()}:".encode())
                for run, n in Counter(runs(text.as_py())).items():
                    word = damaged(run, prefix)
                    if len(word) >= LEAST_LETTERS:
                        seen[word] += n
                if len(seen) > COUNTED:
                    yield rows()
                    seen.clear()
        yield rows()

    ids = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    found = docs.select(ids.alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Levels:
    """The successive counts of a word: its length, letters by group, then some letters alone.

    An edit that turns a word into a near one adds at most one letter and takes at most one, so
    along the groups, and again along the single letters, at most one count is
    larger by one and at most one smaller. Letters, the commonest first, go to the
    group with the fewest occurrences so far, which keeps the branches even.
    """

    def __init__(self, letters: dict[str, int]):
        order = sorted(letters, key=lambda c: (-letters[c], c))
        self.group = np.zeros(256, np.int64)
        sizes = [0] * GROUPS
        for c in order:
            g = min(range(GROUPS), key=lambda g: (sizes[g], g))
            self.group[ord(c)] = g
            sizes[g] += letters[c]
        self.single = np.full(256, SINGLES, np.int64)
        for i, c in enumerate(order[:SINGLES]):
            self.single[ord(c)] = i
        self.depth = 1 + GROUPS + SINGLES

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts by level and a mask of the letters held, for words in Latin-1."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        letters = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        counts = np.empty((n, self.depth), np.int32)
        counts[:, 0] = sizes
        counts[:, 1 : 1 + GROUPS] = np.bincount(row * GROUPS + self.group[letters], minlength=n * GROUPS).reshape(n, GROUPS)
        singles = np.bincount(row * (SINGLES + 1) + self.single[letters], minlength=n * (SINGLES + 1))
        counts[:, 1 + GROUPS :] = singles.reshape(n, SINGLES + 1)[:, :SINGLES]
        held = np.zeros((n, 64), bool)
        held[row, letters & 63] = True
        mask = np.packbits(held, axis=1, bitorder="little").view("<u8").ravel()
        return counts, mask


class Budget:
    """Searching words still on their way down the trie, with what each may yet spend.

    They look for near words of the same length or one letter longer: of the same
    length, one surplus and one deficit; longer, one surplus and no deficit.
    """

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        self.rows, self.counts = rows, counts
        self.longer = np.zeros(len(rows), bool)
        self.surplus = self.deficit = np.ones(len(rows), bool)

    def after(self, level: int, value: int) -> "Budget":
        """Those that may enter the child with this count at this level."""
        change = value - self.counts[self.rows, level]
        if level == 0:
            fits = (change == 0) | (change == 1)
            longer = change == 1
        else:
            fits = (change == 0) | ((change == 1) & self.surplus) | ((change == -1) & self.deficit)
            longer = self.longer
        found = Budget.__new__(Budget)
        found.rows, found.counts, found.longer = self.rows[fits], self.counts, longer[fits]
        if level in (0, GROUPS):
            # The groups are spent anew by each word, and so are the single letters after them.
            found.surplus, found.deficit = np.ones(len(found.rows), bool), ~found.longer
        else:
            found.surplus, found.deficit = (self.surplus & (change != 1))[fits], (self.deficit & (change != -1))[fits]
        return found


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether ``b``, of the same length or one letter longer, is ``a`` with one letter replaced or inserted."""
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and a[same + (len(a) == len(b)) :] == b[same + 1 :]


class Words:
    """Words side by side, for comparing many pairs at once."""

    def __init__(self, words: list[bytes], counts: np.ndarray, mask: np.ndarray):
        self.words, self.counts, self.mask = words, counts, mask
        self.sizes = counts[:, 0]
        self.width = int(min(max(self.sizes, default=0), WIDE))
        self.letters = np.zeros((len(words), self.width + 1), np.uint8)
        rows = np.flatnonzero(self.sizes <= self.width)
        if len(rows):
            flat = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
            sizes = self.sizes[rows]
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.letters[np.repeat(rows, sizes), inside] = flat

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs (``b`` as long as ``a`` or a letter longer) are one edit apart."""
        fits = np.bitwise_count(self.mask[a] ^ self.mask[b]) <= 2
        a, b = a[fits], b[fits]
        found = np.zeros(len(a), bool)
        wide = self.sizes[b] > self.width
        same = (self.sizes[a] == self.sizes[b]) & ~wide
        x, y = self.letters[a[same]], self.letters[b[same]]
        found[same] = (x != y).sum(1) == 1
        more = (self.sizes[a] != self.sizes[b]) & ~wide
        x, y = self.letters[a[more]][:, :-1], self.letters[b[more]]
        # The first letter that differs comes after the last one that differs when shifted.
        first = np.argmax(np.c_[x != y[:, :-1], np.ones(len(x), bool)], 1)
        late = (x != y[:, 1:])[:, ::-1]
        last = np.where(late.any(1), x.shape[1] - 1 - np.argmax(late, 1), -1)
        found[more] = last < first
        for i in np.flatnonzero(wide):
            found[i] = one_edit(self.words[a[i]], self.words[b[i]])
        fits[np.flatnonzero(fits)] = found
        return fits


def search(words: Words, homes: np.ndarray, searchers: np.ndarray, depth: int):
    """Yield (searcher, home) arrays of all near pairs, by depth-first search of the homes' trie.

    A node is a run of homes, sorted by their counts; the searchers that have not
    overspent go down with it. Leaf words are verified letter by letter.
    """
    counts = words.counts
    homes = homes[np.lexsort(counts[homes][:, ::-1].T)]
    stack = [(0, 0, len(homes), Budget(searchers, counts))]
    while stack:
        level, start, end, budget = stack.pop()
        if not len(budget.rows):
            continue
        if end - start <= LEAF_WORDS or level == depth:
            leaf = homes[start:end]
            lines = max(1, PAIRS // max(1, len(leaf)))
            for at in range(0, len(budget.rows), lines):
                rows = budget.rows[at : at + lines]
                for low in range(0, len(leaf), PAIRS):
                    some = leaf[low : low + PAIRS]
                    a, b = np.repeat(rows, len(some)), np.tile(some, len(rows))
                    change = words.sizes[b] - words.sizes[a]
                    fits = (change == 0) | (change == 1)
                    a, b = a[fits], b[fits]
                    near = words.near(a, b)
                    if near.any():
                        yield a[near], b[near]
            continue
        values = counts[homes[start:end], level]
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        edges = np.r_[0, cuts, len(values)]
        for low, high in zip(edges[:-1], edges[1:]):
            stack.append((level + 1, start + int(low), start + int(high), budget.after(level, int(values[low]))))


def letter_counts(words: DataFrame) -> dict[str, int]:
    """How many words hold each letter how often, over all words; at most 90 letters exist."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter(F.col("letter") != "")
    return {r["letter"]: r["count"] for r in letters.groupBy("letter").count().collect()}


def with_counts(words: DataFrame, levels: Levels) -> DataFrame:
    """Add ``counts``, the word's counts by level."""

    def add(batches):
        for batch in batches:
            if batch.num_rows:
                counts, _ = levels.of([w.encode("latin-1") for w in batch.column("word").to_pylist()])
                flat = pa.array(counts.ravel(), pa.int32())
                offsets = pa.array(np.arange(batch.num_rows + 1) * levels.depth, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], [*batch.schema.names, "counts"])

    return words.mapInArrow(add, "word string, n long, counts array<int>")


def crowded_nodes(words: DataFrame, depth: int, subtree_words: int) -> dict[tuple, tuple[int, int]]:
    """Upper nodes of the trie with more words than a task should take, with their least and largest child.

    Level by level, the children of such nodes are counted on Spark. A node is
    crowded above ``subtree_words`` or one ``PARTED``-th of all words, so at most
    ``PARTED`` nodes of a level come to the driver.
    """
    least = max(subtree_words, words.count() // PARTED)
    crowded: dict[tuple, tuple[int, int]] = {}
    level = [()]
    for at in range(depth):
        parents = words.sparkSession.createDataFrame([(list(p),) for p in level], "parent array<int>")
        inside = words.select(F.slice("counts", 1, at).alias("parent"), F.col("counts")[at].alias("child"))
        children = inside.join(F.broadcast(parents), "parent").groupBy("parent", "child").count()
        ends = children.groupBy("parent").agg(F.min("child").alias("low"), F.max("child").alias("high"))
        crowded |= {tuple(r["parent"]): (r["low"], r["high"]) for r in ends.collect()}
        level = [(*r["parent"], r["child"]) for r in children.filter(F.col("count") > least).collect()]
        if not level:
            break
    return crowded


def subtrees(crowded: dict[tuple, tuple[int, int]], counts: np.ndarray):
    """Yield (node, rows, is home) for every node below the crowded ones that words live in or may search."""
    rows = np.arange(len(counts))
    stack = [((), rows, Budget(rows, counts))]
    while stack:
        node, homes, budget = stack.pop()
        if not len(budget.rows):
            continue
        if node not in crowded:
            yield node, homes, budget.rows
            continue
        level = len(node)
        low, high = crowded[node]
        near = counts[budget.rows, level]
        for value in np.unique(np.r_[near - 1, near, near + 1]):
            if low <= value <= high:
                stack.append(((*node, int(value)), homes[counts[homes, level] == value], budget.after(level, int(value))))


def near_words(words: DataFrame, levels: Levels, subtree_words: int = SUBTREE_WORDS, searchers: int = SEARCHERS) -> DataFrame:
    """``word``, ``near`` and ``near_n`` for all pairs of words one edit apart, both ways round.

    Subtrees of the trie with few enough words are the units of work. Each word goes to the
    subtree it lives in and to those that its budget lets it enter; a subtree that more
    than ``searchers`` words enter is repeated, with a part of them each.
    """
    crowded = crowded_nodes(words, levels.depth, subtree_words)
    narrow = words.select("word", "n")

    def entries(batch: pa.RecordBatch):
        names = batch.column("word").to_pylist()
        counts, _ = levels.of([w.encode("latin-1") for w in names])
        for node, homes, rows in subtrees(crowded, counts):
            yield ",".join(map(str, node)), homes, rows

    def tally(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for node, _, rows in entries(batch):
                seen[node] += len(rows)
            if len(seen) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["node", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["node", "n"])

    busy = narrow.mapInArrow(tally, "node string, n long").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > searchers)
    # At most one row for each ``searchers`` entries.
    parts = {r["node"]: -(-r["n"] // searchers) for r in busy.collect()}

    def deal(batches):
        for batch in batches:
            names, sizes = batch.column("word"), batch.column("n")
            deal_by = np.fromiter((zlib.crc32(w.encode()) for w in names.to_pylist()), np.int64, batch.num_rows)
            for node, homes, rows in entries(batch):
                shares = parts.get(node, 1)
                for part in range(shares):
                    for picked, home in ((homes, True), (rows[deal_by[rows] % shares == part], False)):
                        if len(picked):
                            at = pa.array(picked)
                            columns = [pa.array([f"{node}/{part}"] * len(picked)), names.take(at), sizes.take(at), pa.array([home] * len(picked))]
                            yield pa.RecordBatch.from_arrays(columns, ["node", "word", "n", "home"])

    def match(group: pa.Table) -> pa.Table:
        names = group.column("word").to_pylist()
        n = group.column("n").to_numpy()
        home = group.column("home").to_numpy()
        found: list[pa.Table] = []
        if home.any() and len(names):
            counts, mask = levels.of([w.encode("latin-1") for w in names])
            words = Words([w.encode("latin-1") for w in names], counts, mask)
            for a, b in search(words, np.flatnonzero(home), np.flatnonzero(~home), levels.depth):
                # Words of one length find each other; of two lengths only the shorter one searches.
                back = counts[a, 0] != counts[b, 0]
                left, right = np.r_[a, b[back]], np.r_[b, a[back]]
                column = group.column("word")
                found.append(pa.table([column.take(pa.array(left)), column.take(pa.array(right)), pa.array(n[right])], ["word", "near", "near_n"]))
        return pa.concat_tables(found) if found else pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int64())], ["word", "near", "near_n"])

    dealt = narrow.mapInArrow(deal, "node string, word string, n long, home boolean")
    return dealt.groupBy("node").applyInArrow(match, "word string, near string, near_n long")


def follow(forms: DataFrame, folder: str) -> DataFrame:
    """``word`` and ``root`` for rows (``word``, ``form``): the last word that forms lead to.

    Each round joins a word to where its form has got to, which doubles the steps
    taken. A form is at least ``FORM_FACTOR`` times as frequent as its word, so
    there is no circle and few rounds.
    """
    spark = forms.sparkSession
    at = forms.select("word", F.col("form").alias("root"))
    number = 0
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved.write.parquet(f"{folder}/roots-{number}")
        moved = spark.read.parquet(f"{folder}/roots-{number}")
        if number:
            remove_folder(spark, f"{folder}/roots-{number - 1}")
        at, number = moved.select("word", "root"), number + 1
        if moved.filter("moved").isEmpty():
            return at


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    subtree_words: int = SUBTREE_WORDS,
    searchers: int = SEARCHERS,
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of the texts.

    Words are the runs of at least seven letters, some damaged by the rule of
    :func:`damaged`, that occur at least twice. Near words differ by one letter inserted,
    deleted or replaced. A word's form is its most frequent near word (equal counts: the
    smallest in code-point order) if that is at least ten times as frequent; its root
    is the last word that forms lead to, itself without a form.

    All words are compared, without caps: they are counted with partial sums, the trie of
    their letter-group counts is parted into subtrees of bounded size, and each word
    searches those that its budget reaches. Near words of a word are few however
    many words there are (its letters bound them), and are counted with partial sums.

    Null and empty texts have no words; a null id stands as nothing before the
    colon; repeated rows count each by itself; very long runs are words like others; an
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "spelling")
    count_words(docs, id_col, text_col).write.parquet(f"{folder}/words")
    counted = spark.read.parquet(f"{folder}/words")
    levels = Levels(letter_counts(counted))
    with_counts(counted, levels).write.parquet(f"{folder}/counts")
    words = spark.read.parquet(f"{folder}/counts")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = near_words(words, levels, subtree_words, searchers).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = counted.join(near, "word", "left")
    has_form = -F.col("best.n") >= FORM_FACTOR * F.col("n")
    joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, -F.col("best.n")).alias("form_n"),
    ).write.parquet(f"{folder}/forms")
    remove_folder(spark, f"{folder}/counts")
    remove_folder(spark, f"{folder}/words")
    forms = spark.read.parquet(f"{folder}/forms")
    roots = follow(forms.filter(F.col("form").isNotNull()), folder)
    return forms.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
