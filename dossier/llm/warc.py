"""WARC archives written index first, and read back by coalesced byte ranges."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scaling import join_small

RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
ARCHIVE_BYTES = 256 << 20
LEVEL = 2

# The format's version, line end, base32 letters, and a fixed capture date.
VERSION = "WARC/1.1"
LINE = b"\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, record_type string, digest string, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a text's UTF-8: eight groups of four letters."""
    digest = F.sha1(text.cast("binary"))
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``refers_to`` (null for responses).

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with
    the largest id is the response the others refer to.
    """
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    pages = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload")
    ).withColumn("digest", base32_sha1(F.col("payload")))
    same = F.when(F.octet_length("payload") >= least_bytes, F.col("digest"))
    groups = (
        pages.select(same.alias("digest"), "page_id")
        .filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("_kept"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )
    joined = join_small(pages, groups, ["digest"], "left", spread=["page_id"])
    revisit = (F.octet_length("payload") >= least_bytes) & (F.col("_kept") != F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("_kept")).alias("refers_to"))


def _head(lines: list[tuple[str, object]]) -> bytes:
    return b"".join(f"{k}: {v}".encode() + LINE for k, v in lines)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the headers of its response, without the payload."""
    http = b"HTTP/1.1 200 OK" + LINE + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + LINE
    block = http if refers_to is not None else http + payload
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id))]
    lines += [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        lines.append(("WARC-Target-URI", " ".join(url.split()) or " "))
    if refers_to is not None:
        lines.append(("WARC-Refers-To", record_id(refers_to)))
        lines.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return VERSION.encode() + LINE + _head([*lines, ("Content-Length", len(block))]) + LINE + block + LINE + LINE


def _headers(raw: bytes) -> dict[str, str]:
    found = {}
    for line in raw.split(LINE)[1:]:
        key, _, value = line.decode().partition(": ")
        found[key.lower()] = value
    return found


def parse_record(raw: bytes) -> tuple:
    """(page id, url, type, digest, payload bytes, refers to, payload) of one record.

    Length and digest of a response are those of the bytes that were read; the
    digest must equal the header's. A revisit has them from its headers.
    """
    import base64
    import hashlib

    head, _, rest = raw.partition(LINE + LINE)
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(LINE + LINE)
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    page, url, kind = _page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"]
    if kind == "revisit":
        return page, url, kind, digest, int(_headers(http)["content-length"]), _page_of(warc["warc-refers-to"]), None
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"page {page}: payload and digest differ")
    return page, url, kind, digest, len(payload), None, payload


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write every page as a record into archives below ``folder`` and return the index.

    Each task writes archives of its own (``.warc.gz``, one gzip member per
    record) under a name of its attempt and lists them in the index, which is a
    table written by Spark: of a task that ran twice only the committed rows
    name archives. The folder is any address that Arrow's file systems know and
    all executors reach. Null html is an empty payload, a null url leaves the
    header out, a null id stays null; equal rows are records of their own, and
    an empty table gives an empty index.
    """
    spark = pages.sparkSession

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as arrow_fs

        from dossier.llm.warc import gzip_member, record_bytes

        system, root = arrow_fs.FileSystem.from_uri(f"{folder}/archives")
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip_member(record_bytes(page, url, (payload or "").encode("utf-8", "surrogatepass"), digest, refers))
                out.write(member)
                rows.append((page, url, "response" if refers is None else "revisit", digest, name, at, len(member)))
                at += len(member)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                names = ["page_id", "url", "record_type", "digest", "archive", "offset", "length"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
                )
        if out is not None:
            out.close()

    with_types(pages, **columns).mapInArrow(run, INDEX).write.mode("error").parquet(f"{folder}/index")
    return read_index(spark, folder)


def gzip_member(record: bytes) -> bytes:
    return gzip.compress(record, LEVEL, mtime=0)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(rows: Iterator[tuple[str, int, int]], range_bytes: int, gap_bytes: int) -> Iterator[tuple[str, int, int, list]]:
    """Join sorted (archive, offset, length) reads into ranges, with the members inside each.

    A range stops at a gap above ``gap_bytes`` or once it holds ``range_bytes``.
    """
    archive, start, end, members = "", 0, 0, []
    for name, offset, length in rows:
        if members and (name != archive or offset - end > gap_bytes or offset + length - start > range_bytes):
            yield archive, start, end - start, members
            members = []
        if not members:
            archive, start = name, offset
        members.append((offset - start, length))
        end = offset + length
    if members:
        yield archive, start, end - start, members


def read_records(index: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """Records that the rows of ``index`` select, with payloads (null for revisits).

    The selected rows are spread by archive and stretch of ``range_bytes``, over one task for
    each such stretch of all they read, sorted by offset, and each run of near
    neighbours is one read.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as arrow_fs

        from dossier.llm.warc import coalesced, parse_record

        system, root = arrow_fs.FileSystem.from_uri(f"{folder}/archives")

        def places():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        for name, start, size, members in coalesced(places(), range_bytes, gap_bytes):
            with system.open_input_file(f"{root}/{name}") as archive:
                raw = archive.read_at(size, start)
            rows = [parse_record(gzip.decompress(raw[at : at + length])) for at, length in members]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    stretch = F.floor(F.col("offset") / F.lit(range_bytes))
    # The rows dealt out are tiny, what they read is not: tasks are numbered by the bytes behind them.
    size = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(1, -(-size // range_bytes))
    ordered = index.select("archive", "offset", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, RECORD)
