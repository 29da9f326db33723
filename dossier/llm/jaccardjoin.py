"""Exact similarity join of shingle sets by partitioning the universe of shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scaling import join_small
from .components import connected
from .shingles import BAND_BITS
from .sketches import turned_bits
from .tables import Tables


def set_rows(docs: DataFrame) -> DataFrame:
    """``doc``, ``key`` (digest of its words), ``node`` (number of its text), ``n`` (set size) and the segments it may ask for (``x``)."""

    def run(batches):
        import pyarrow as pa

        from dossier.llm.shingles import content_key, own_segments, plain_words, shingle_set, text_node

        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = plain_words(text.as_py())
                found = shingle_set(words)
                key = content_key(words)
                rows.append((key, text_node(key), len(found), own_segments(found)))
            keys, *numbers = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), *[pa.array(c, pa.int64()) for c in numbers]], ["doc", "key", "node", "n", "x"]
            )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, key binary, node long, n long, x long")


def signature_rows(docs: DataFrame) -> DataFrame:
    """``sig``, ``node`` (number of the text) and ``asks`` (whether it may) of the indexed segments of every text.

    Of equal texts in one task only the first is indexed, under the number they
    share; each task that reads such a text gives its rows again.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from dossier.llm.shingles import content_key, plain_words, shingle_set, signatures, text_node

        seen = set()
        for batch in batches:
            found, asking, rows, size = [], [], [], 0
            for row, text in enumerate(batch.column(0)):
                words = plain_words(text.as_py())
                key = content_key(words)
                if words and key not in seen:
                    seen.add(key)
                    sigs, asks = signatures(shingle_set(words))
                    found.append(sigs)
                    asking.append(asks)
                    rows.append(np.full(len(sigs), text_node(key)))
                    size += len(sigs)
                if found and (size > 200_000 or row + 1 == batch.num_rows):
                    columns = [np.concatenate(found).view(np.int64), np.concatenate(rows), np.concatenate(asking)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "node", "asks"])
                    found, asking, rows, size = [], [], [], 0

    return docs.filter("doc is not null").select("text").mapInArrow(run, "sig long, node long, asks boolean")


def needed(n: Column) -> Column:
    return F.floor(n / 7) + 1


def allocated(shared: DataFrame) -> DataFrame:
    """Adds ``probe``, ``alone`` and ``weight`` to the rows of buckets with several sets.

    A set asks in so many of its segments that a linked set at least as large
    must have one. Segments that no other set has cost nothing and find nothing,
    so they are asked for first; of the shared ones those with the smallest
    buckets make up the number. ``alone`` counts a set's segments that no other
    set has, ``weight`` adds up the sizes of its buckets.
    """
    of_node = Window.partitionBy("node")
    asked = F.col("asks").cast("long")
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("node", "asks").orderBy("k", "sig")))
    ranked = ranked.withColumn("count", F.sum(asked).over(of_node)).withColumn("weight", F.sum(F.col("k")).over(of_node))
    spare = F.col("x") - needed(F.col("n"))
    probe = F.col("asks") & ((spare < 0) | (F.col("rank") <= F.col("count") - spare))
    return ranked.withColumn("probe", probe).withColumn("alone", F.col("x") - F.col("count"))


def _band(n: Column) -> Column:
    return F.floor((F.length(F.bin(n)) - 1) / BAND_BITS)


def _may_link(small: dict[str, Column], large: dict[str, Column]) -> Column:
    """Whether sizes and shingles that no other set has leave a link possible.

    The smaller set must ask. Of n and m >= n shingles at most (4 n - 3 m) / 7
    and (4 m - 3 n) / 7 are missing on the other side; a segment found nowhere
    else holds one that is. The larger set's segments are known to the smaller
    one within a band only.
    """
    n, m = small["n"], large["n"]
    return (
        small["probe"]
        & (n <= m)
        & (small["alone"] * 7 <= n * 4 - m * 3)
        & ((_band(n) != _band(m)) | (large["alone"] * 7 <= m * 4 - n * 3))
    )


def _columns(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in ("n", "probe", "alone")}


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """Each set with the hub of its bucket, where a link is possible: a linear number of pairs."""
    own, hub = _columns(""), _columns("hub.")
    met = buckets.filter((F.col("node") != F.col("hub.node")) & (_may_link(own, hub) | _may_link(hub, own)))
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _overlap_left(x: str, y: str) -> Column:
    """Whether two sets compared with the same hub can still be linked.

    They share at most the smaller of their overlaps with the hub and, outside
    it, the smaller of what is left there without the shingles nobody else has.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    known = F.when(_band(n) == _band(m), F.col(f"{y}.alone")).otherwise(F.lit(0))
    outside = F.least(n - F.col(f"{x}.same") - F.col(f"{x}.alone"), m - F.col(f"{y}.same") - known)
    most = F.least(F.col(f"{x}.same"), F.col(f"{y}.same")) + outside
    return F.coalesce((F.col(f"{x}.ref") != F.col(f"{y}.ref")) | (most * 7 >= (n + m) * 3), F.lit(True))


def _sketches_allow(x: str, y: str) -> Column:
    """Whether the sketches of two sets leave a link possible.

    Every shingle that only one of them has turns one bit, and linked sets of n
    and m shingles have at most (n + m) / 7 of those.
    """
    turned = turned_bits(F.col(f"{x}.sketch"), F.col(f"{y}.sketch"))
    return F.coalesce(turned * 7 <= F.col(f"{x}.n") + F.col(f"{y}.n"), F.lit(True))


def far_pairs(buckets: DataFrame, groups: DataFrame, checked: DataFrame, tables: Tables, sketches: DataFrame) -> DataFrame:
    """All pairs that a bucket brings together, that may be linked, and that lie in different groups.

    ``groups`` holds the component of every node; ``checked`` holds the overlaps
    of sets with their hubs; each set goes by the hub it overlaps most. Its sketch
    tells most unlike sets apart where they meet, so that a pair is not named
    again in each of the many segments that such sets may share.
    """
    best = checked.groupBy("b").agg(F.max(F.struct("same", "a")).alias("best"))
    best = best.select(F.col("b").alias("node"), F.col("best.a").alias("ref"), F.col("best.same").alias("same"))
    rows = buckets.drop("hub").join(groups, "node").join(best, "node", "left").repartition("sig")
    mixed = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    # Only rows of buckets that bring several groups together are kept, dealt out once.
    rows = tables.write(rows.join(mixed.select("sig"), "sig", "left_semi"))
    tables.drop(buckets)
    rows = rows.join(sketches, "node", "left")
    x, y = rows.filter("probe").alias("x"), rows.alias("y")
    meet = (
        (F.col("x.sig") == F.col("y.sig"))
        & (F.col("x.component") != F.col("y.component"))
        & _may_link(_columns("x."), _columns("y."))
        & _overlap_left("x", "y")
        & _sketches_allow("x", "y")
    )
    return x.join(y, meet).select(*_pair(F.col("x.node"), F.col("y.node"))).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the size of their overlap (``same``) and whether they are ``linked``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from dossier.llm.shingles import linked, overlap

        def numbers(cell):
            return np.frombuffer(cell.as_buffer(), dtype=np.uint64)

        for batch in batches:
            both = [(numbers(x), numbers(y)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            same = [overlap(x, y) for x, y in both]
            links = [linked(len(x), len(y), n) for (x, y), n in zip(both, same, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(same, pa.int64()), pa.array(links, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "same", "linked"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long, same long, linked boolean")


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and its sorted shingle hashes as bytes, for texts given by ``node`` and the id of a row that has it (``rep``).

    The sketch of the set comes with it. A row of that id with another text does not count.
    """

    def run(batches):
        import pyarrow as pa

        from dossier.llm.shingles import content_key, parity_sketch, plain_words, shingle_set, text_node

        seen = set()
        for batch in batches:
            rows = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = plain_words(text.as_py())
                if node not in seen and text_node(content_key(words)) == node:
                    seen.add(node)
                    found = shingle_set(words)
                    rows.append((node, found.tobytes(), parity_sketch(found)))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            kinds = pa.int64(), pa.binary(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "shingles", "sketch"])

    chosen = docs.join(nodes.select(F.col("rep").alias("doc"), "node").hint("shuffle_hash"), "doc")
    return chosen.select("node", "text").mapInArrow(run, "node long, shingles binary, sketch array<long>")


def unindexed_pairs(reps: DataFrame) -> DataFrame:
    """Sets with too few segments to ask in, with every set they could be linked to by size.

    A matter of hash luck so rare that the table is all but always empty.
    """
    odd = reps.filter(F.col("x") < needed(F.col("n"))).select(F.col("node").alias("x"), F.col("n").alias("m"))
    sizes = odd.select("x", F.explode(F.sequence(F.col("m"), F.floor(F.col("m") * 4 / 3))).alias("n"))
    met = sizes.join(reps.select(F.col("node").alias("y"), "n"), "n").filter("x <> y")
    return met.select(*_pair(F.col("x"), F.col("y")))


def document_links(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Linked pairs of texts as pairs of the smallest ids that have them."""
    both = pairs.select("a", "b").join(reps.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a")
    both = both.join(reps.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
    return both.select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def shared_ids(infos: DataFrame) -> DataFrame:
    """Links between the texts of rows that share an id."""
    rows = infos.filter("n > 0 and doc is not null").select("doc", "rep")
    several = rows.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("doc", "a")
    return rows.join(several, "doc").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``n_shingles`` and ``component`` (smallest linked id, itself included) per row.

    Two documents link when their sets of distinct five-word shingles overlap in
    75 % of the union. Every distinct text indexes part of its segments of the
    hashed universe, by the size band; of its segments there a linked set at
    least as large must have most. Buckets of one set are dropped where they
    arise; the others tell each set how dear its segments are, and each asks in
    the cheapest it may. Candidates are verified on whole sets: first each set
    with one hub per bucket, the set with the largest buckets, then all pairs
    that still lie in different groups. So groups of near copies do not emit all
    their pairs, and no link between groups is lost.

    Shingles are compared by 64-bit hashes. A null or empty text has no shingles
    and links with nothing. Equal texts are one set, whatever their number. A
    null id links with nothing and has a null component; rows that share an id
    are one document, linked by any of its texts, each compared by its own size. An empty table gives no rows;
    other columns are not read.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    tables = Tables(docs.sparkSession, "jaccard")
    found = tables.write(set_rows(docs))
    copies = found.filter("n > 0 and doc is not null").groupBy("key").agg(F.min("doc").alias("_rep"), F.count(F.lit(1)).alias("_n"))
    copies = copies.filter("_n > 1").drop("_n")
    joined = join_small(found, copies, ["key"], "left", spread=["doc"])
    infos = tables.write(joined.withColumn("rep", F.coalesce("_rep", "doc")).drop("_rep", "key"))
    tables.drop(found)

    of_sig = Window.partitionBy("sig")
    shared = signature_rows(docs).withColumn("_low", F.min("node").over(of_sig)).withColumn("_high", F.max("node").over(of_sig))
    shared = shared.filter("_low <> _high").dropDuplicates(["sig", "node"]).select("sig", "node", "asks")
    shared = tables.write(shared.withColumn("k", F.count(F.lit(1)).over(of_sig)))
    # Lone signatures, most of all, are gone with the shuffle that brought them together.
    tables.drop()
    reps = tables.write(infos.filter("doc = rep and n > 0").select("node", "n", "x", "rep").dropDuplicates(["node"]))
    asked = allocated(shared.join(reps.drop("rep"), "node")).select("sig", "node", "n", "probe", "alone", "weight")
    buckets = asked.withColumn("asked", F.max("probe").over(of_sig)).withColumn("k", F.count(F.lit(1)).over(of_sig))
    buckets = buckets.withColumn("hub", F.max(F.struct("weight", "node", "n", "probe", "alone")).over(of_sig))
    buckets = tables.write(buckets.filter("asked and k > 1").drop("asked", "k", "weight"))
    tables.drop(shared)

    first = tables.write(hub_pairs(buckets).union(unindexed_pairs(reps)).distinct())
    nodes = buckets.select("node").union(first.select("a")).union(first.select("b")).distinct()
    sets = tables.write(sets_of(docs, reps.join(nodes, "node", "left_semi")))
    checked = tables.write(verified(first, sets))
    links = tables.write(document_links(checked.filter("linked"), reps).union(shared_ids(infos)))
    groups = connected(links)
    tied = reps.select("node", "rep").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    tied = tied.select("node", F.coalesce("component", "rep").alias("component"))
    done = first.select(*_pair(F.col("a"), F.col("b")))
    second = tables.write(far_pairs(buckets, tied, checked, tables, sets.select("node", "sketch")).join(done, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        groups = connected(links.union(document_links(verified(second, sets).filter("linked"), reps)))
    tables.keep(infos)
    placed = infos.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc"))
    return placed.select("doc", F.col("n").alias("n_shingles"), component.alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are linked to one with a smaller id through any chain of links.

    Null and empty texts and null ids link with nothing and stay; rows that share an id stay or go
    together; an empty table stays empty; other columns, whatever their names, pass through.
    """
    gone = link_documents(docs, id_col, text_col).filter("component <> doc").select(F.col("doc").alias(id_col)).distinct()
    return docs.join(gone.hint("shuffle_hash"), id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
