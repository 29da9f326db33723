"""Source, sink, rule and DOCX queries: tables are written, read back and rendered."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import versions
from ..session import rename_suffix, work_folder
from ..sources import readers, splitting, writers
from . import sqltext as q
from .catalog import query, table

_EOS = prompts.END_OF_TEXT


@query(
    "S1", "K1", "F1",
    sql=f"""
    WITH written AS (SELECT unnest(string_split(text || '{_EOS}', chr(10))) AS line FROM documents),
    kept AS (SELECT {q.strip('line')} AS text FROM written)
    SELECT text, count(*) AS copies FROM kept WHERE text <> '' GROUP BY text
    """,
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "lines")
    writers.write_with_end_of_text(table(spark, sf_dir, "documents"), folder)
    return readers.text_lines(spark, folder).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))


def _json_documents(parts: DataFrame) -> DataFrame:
    """One JSON document per part; the shape depends on its type."""
    record = F.struct(F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("size"), F.lit("").alias("note"))
    other = F.struct(F.col("p_brand").alias("brand"), (F.col("p_size") > 25).alias("large"))
    kind = F.pmod(F.col("p_partkey"), F.lit(6))
    raw = (
        F.when(kind == 0, F.to_json(F.array(record, record)))
        .when(kind == 1, F.to_json(F.array(F.col("p_name"), F.col("p_brand"))))
        .when(kind == 2, F.to_json(F.struct(record.alias("first"), other.alias("second"))))
        .when(kind == 3, F.to_json(F.struct(record.alias("first"), F.col("p_size").alias("size"))))
        .when(kind == 4, F.to_json(other))
        .otherwise(F.col("p_size").cast("string"))
    )
    return parts.select("p_partkey", raw.alias("raw"))


_RECORD_SQL = "'name: ' || p_name || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' size: ' || (p_size % 5) END"
_OTHER_SQL = "'brand: ' || p_brand || CASE WHEN p_size > 25 THEN ' large: True' ELSE '' END"
_NESTED_SQL = """'first: {"name":"' || p_name || '","size":' || (p_size % 5) || ',"note":""} size: ' || p_size"""


@query(
    "S2", "P9",
    sql=f"""
    WITH shaped AS (
        SELECT p_partkey, CASE p_partkey % 6
            WHEN 0 THEN [{_RECORD_SQL}, {_RECORD_SQL}]
            WHEN 1 THEN [p_name, p_brand]
            WHEN 2 THEN [{_RECORD_SQL}, {_OTHER_SQL}]
            WHEN 3 THEN [{_NESTED_SQL}]
            WHEN 4 THEN [{_OTHER_SQL}]
            ELSE [p_size::VARCHAR] END AS texts
        FROM part)
    SELECT p_partkey, unnest(range(len(texts)))::INTEGER AS record_no, unnest(texts) AS text FROM shaped
    """,
)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.json_records(_json_documents(table(spark, sf_dir, "part")))


@query(
    "S2", "P9",
    sql=f"""
    SELECT text FROM (SELECT {_RECORD_SQL} AS text FROM part UNION ALL SELECT p_name FROM part
        UNION ALL SELECT {_OTHER_SQL} FROM part UNION ALL SELECT p_size::VARCHAR FROM part)
    """,
)
def one_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in one JSON array, read by many tasks through byte ranges."""
    folder = work_folder(spark, "onefile")
    parts = table(spark, sf_dir, "part")
    record = F.struct(F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("size"), F.lit("").alias("note"))
    other = F.struct(F.col("p_brand").alias("brand"), (F.col("p_size") > 25).alias("large"))
    items = F.array(F.to_json(record), F.to_json(F.array("p_name")), F.to_json(other), F.col("p_size").cast("string"))
    # A name alone is a string item: the brackets of its own array go.
    items = F.transform(items, lambda x, i: F.when(i == 1, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    lines = parts.select(F.lit(1).alias("_order"), F.concat(F.lit(","), F.array_join(items, " ,\t")).alias("value"))
    ends = spark.createDataFrame([(0, '["first"'), (2, "]")], "_order int, value string")
    lines.unionByName(ends).orderBy("_order").select("value").coalesce(1).write.text(folder)
    return splitting.split_json_records(spark, folder, 50_000, "*.txt").filter("text <> 'first'")


@query(
    "S3", "P10",
    sql="""
    SELECT unnest(['splitting', 'whole']) AS reader,
        'p_partkey: ' || p_partkey || ' p_name: ' || p_name || ' p_brand: ' || p_brand || ' p_type: ' || p_type AS text FROM part
    """,
)
def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "xml")
    columns = ["p_partkey", "p_name", "p_brand", "p_type"]
    parts = table(spark, sf_dir, "part").select(*columns)
    parts.write.format("xml").option("rootTag", "parts").option("rowTag", "part").save(folder)
    split = readers.xml_corpus(spark, folder, "part", columns).withColumn("reader", F.lit("splitting"))
    return split.unionByName(readers.xml_texts(spark, folder).withColumn("reader", F.lit("whole")))


def _markup(value):
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


@query(
    "S4", "S3",
    sql=f"""
    SELECT 'item: ' || item_id || ' text: ' || text AS text FROM benchmark
    UNION ALL SELECT 'item: ' || item_id || ' text: ' || text || ' none:' FROM benchmark
    UNION ALL SELECT 'own ' || item_id || ' note: n' FROM benchmark
    UNION ALL SELECT text FROM (SELECT {q.strip('line')} AS text FROM
        (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)) WHERE text <> ''
    """,
)
def mixed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of JSON, XML of several record tags, text and unknown suffixes, in any case."""
    root = work_folder(spark, "mixed")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item"), "text")
    xml = F.concat(
        F.lit("<r><rec><item>"), "item", F.lit("</item><text>"), _markup(F.col("text")),
        F.lit("</text><none/></rec><other>own "), "item", F.lit("<note>n</note></other></r>"),
    )
    items.select(xml).write.option("maxRecordsPerFile", 1).text(root)
    rename_suffix(spark, root, ".txt", ".XML")
    odd = F.col("item").cast("long") % 2 == 1
    items.filter(odd).select("text").write.mode("append").text(root)
    rename_suffix(spark, root, ".txt", ".log")
    items.filter(~odd).select("text").write.mode("append").text(root)
    items.write.mode("append").option("maxRecordsPerFile", 1).json(root)
    return readers.read_corpus(spark, root)


@query(
    "S9",
    sql="SELECT item_id, text || chr(10) AS text FROM benchmark",
)
def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "whole")
    items = table(spark, sf_dir, "benchmark")
    items.write.partitionBy("item_id").text(folder)
    item = F.regexp_extract("source", r"item_id=(\d+)", 1).cast("long").alias("item_id")
    return readers.whole_texts(spark, f"{folder}/*").select(item, "text")


_RULE_SQL = """
    SELECT p_partkey::VARCHAR AS rule_id, p_name AS title,
        CASE WHEN p_size % 4 = 0 THEN 'N/A' ELSE p_type END AS description FROM part
"""


def _rules(parts: DataFrame) -> DataFrame:
    return parts.select(
        F.col("p_partkey").cast("string").alias("rule_id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("description"),
    )


@query(
    "S5", "R1", "R5",
    sql=f"""
    WITH rules AS ({_RULE_SQL})
    SELECT rule_id, 'Rule ID: ' || rule_id || chr(10) || 'Title: ' || title || chr(10) || 'Description: '
        || description || chr(10) || '{_EOS}' || chr(10) AS record,
        'Title: ' || title || chr(10) || 'Description:' AS prompt
    FROM rules
    """,
)
def rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "rules")
    _rules(table(spark, sf_dir, "part")).write.json(folder)
    rules = readers.rules(spark, folder, multi_line=False)
    record = prompts.rule_record(F.col("rule_id"), F.col("title"), F.col("description"))
    return rules.select("rule_id", record.alias("record"), prompts.title_prompt(F.col("title")).alias("prompt"))


@query(
    "K2",
    sql=f"""
    WITH rules AS ({_RULE_SQL}),
    written AS (SELECT unnest(['Rule ID: ' || rule_id, 'Title: ' || title, 'Description: ' || description, '{_EOS}'])
        AS line FROM rules)
    SELECT line, count(*) AS copies FROM written GROUP BY line
    """,
)
def rule_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "rulefile")
    writers.write_rule_records(readers.with_rule_defaults(_rules(table(spark, sf_dir, "part"))), folder)
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("copies"))


_CHAT_HEAD = f"{prompts.SYSTEM_TAG}{prompts.RULE_EXPERT}{prompts.END_TAG}{prompts.USER_TAG}How do I solve the Java rule: "
_CHAT_MID = f"?{prompts.END_TAG}{prompts.ASSISTANT_TAG}"


@query(
    "S6", "F2", "F3", "R2", "R3", "R4",
    sql=f"""
    WITH rules AS (
        SELECT p_partkey, p_brand AS category, p_name AS title, p_type AS description,
            CASE WHEN p_size % 2 = 0 THEN 'use ' || p_type ELSE '' END AS examples
        FROM part WHERE p_size % 3 <> 0 AND p_name <> '' AND p_type <> ''),
    rendered AS (SELECT *, description || chr(10) || chr(10) || 'Examples:' || chr(10) || examples
        || {q.quoted(prompts.END_TAG)} AS body, {q.quoted(_CHAT_HEAD)} || title || {q.quoted(_CHAT_MID)} AS prompt
        FROM rules)
    SELECT p_partkey, category, prompt || body AS text, prompt, body AS answer FROM rendered
    """,
)
def ruleset_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    size = F.col("p_size")
    listed = F.to_json(
        F.array(
            F.struct(
                F.col("p_name").alias("title"),
                F.when(size % 3 != 0, F.col("p_type")).alias("description"),
                F.when(size % 2 == 0, F.concat(F.lit("use "), F.col("p_type"))).alias("examples"),
            )
        )
    )
    raw = F.concat(
        F.lit('{"language":"java","rulesets":{"'), F.col("p_brand"), F.lit('":'), listed, F.lit(',"about":"none"}}')
    )
    rules = readers.ruleset_rules(parts.select("p_partkey", raw.alias("raw")))
    chat = prompts.rule_chat(F.col("title"), F.col("description"), F.col("examples"))
    rendered = rules.select("p_partkey", "category", chat.alias("text"), prompts.rule_prompt(F.col("title")).alias("prompt"))
    return rendered.withColumn("answer", prompts.assistant_answer(F.col("text")))


def as_docx(documents: DataFrame, text: str = "text", first_bytes: int | None = None) -> DataFrame:
    """Give every document the bytes of a DOCX file with one paragraph per line.

    Paragraphs have tab stops, every third is a hyperlink. With ``first_bytes`` the
    files are broken off there.
    """
    head = (
        '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w='
        '"http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    )

    def pack(value: str) -> bytes:
        stops = '<w:pPr><w:tabs><w:tab w:val="left" w:pos="720"/><w:tab w:val="left" w:pos="1440"/></w:tabs></w:pPr>'
        runs = [f'<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r>' for line in value.split("\n")]
        runs = [f"<w:hyperlink>{r}</w:hyperlink>" if i % 3 == 2 else r for i, r in enumerate(runs)]
        body = "".join(f"<w:p>{stops}{r}</w:p>" for r in runs)
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("word/document.xml", f"{head}{body}</w:body></w:document>")
        return buffer.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[pack(v)[:first_bytes] for v in batch[text]]).drop(columns=[text])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in documents.schema.fields if f.name != text]
    return documents.mapInPandas(run, ", ".join([*kept, "content binary"]))


DOCX_SQL = f"""
    SELECT doc_id, array_to_string([l for l in string_split(text, chr(10)) if {q.strip('l')} <> ''], chr(10)) AS text
    FROM documents
"""


@query(
    "S7", "F1", "A9",
    sql=f"""
    SELECT doc_id, text, TRUE AS readable FROM ({DOCX_SQL})
    UNION ALL SELECT -1 - item_id, NULL, FALSE FROM benchmark
    """,
)
def docx_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a DOCX file, and the benchmark items as files that are broken off."""
    whole = as_docx(table(spark, sf_dir, "documents").select("doc_id", "text"))
    items = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    read = readers.docx_texts(whole.unionByName(as_docx(items, first_bytes=40)))
    return read.select("doc_id", "text", F.col("error").isNull().alias("readable"))


_RUN_SQL = """
    SELECT 'gpt2' AS model_type, CASE WHEN p_size % 2 = 0 THEN 'lora' ELSE 'traditional' END AS training_method,
        p_size % 7 AS epochs, (p_size * 1.5)::DOUBLE AS total_time, p_size AS version,
        CASE WHEN p_size % 2 = 0 THEN 8 END AS lora_r FROM part
"""


@query(
    "S13", "K5",
    sql=f"""
    WITH runs AS ({_RUN_SQL}), written AS (SELECT * FROM runs UNION ALL SELECT * FROM runs WHERE training_method = 'lora')
    SELECT training_method, version, count(*) AS runs, sum(epochs)::BIGINT AS epochs, max(total_time) AS longest,
        coalesce(max(lora_r), 0) AS lora_r FROM written GROUP BY training_method, version
    """,
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "runs")
    size = F.col("p_size")
    runs = table(spark, sf_dir, "part").select(
        F.lit("gpt2").alias("model_type"),
        F.when(size % 2 == 0, F.lit("lora")).otherwise(F.lit("traditional")).alias("training_method"),
        (size % 7).alias("epochs"),
        (size * 1.5).alias("total_time"),
        size.alias("version"),
        F.when(size % 2 == 0, F.lit(8)).alias("lora_r"),
    )
    writers.write_run_metrics(runs, f"{folder}/models", f"{folder}/adapters")
    read = readers.run_metrics(spark, [f"{folder}/models", f"{folder}/adapters"], multi_line=False)
    return read.groupBy("training_method", "version").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("epochs").alias("epochs"),
        F.max("total_time").alias("longest"),
        F.coalesce(F.max("lora_r"), F.lit(0)).alias("lora_r"),
    )


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version folders derived from parts: family is the brand, number the size, every fifth name has none."""
    number = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("gpt2-v"), F.col("p_size").cast("string")))
    name = F.coalesce(number, F.concat(F.lit("gpt2-x"), F.col("p_size").cast("string")))
    named = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), name.alias("name"))
    return named.withColumn("version", versions.any_version(F.col("name"))).withColumn(
        "path", F.concat("family", F.lit("/"), "name")
    )


_REGISTRY_SQL = """
    SELECT p_brand AS family, CASE WHEN p_size % 5 <> 0 THEN p_size END AS version,
        CASE WHEN p_size % 5 <> 0 THEN 'gpt2-v' ELSE 'gpt2-x' END || p_size AS name FROM part
"""


@query(
    "A7", "W6",
    sql=f"""
    WITH registry AS ({_REGISTRY_SQL})
    SELECT family, max(version) AS highest, coalesce(max(version), 0) + 1 AS next FROM registry GROUP BY family
    """,
)
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _registry(spark, sf_dir)
    return versions.highest_version(registry).join(versions.next_version(registry), "family")


@query(
    "W6",
    sql=f"""
    WITH registry AS ({_REGISTRY_SQL}),
    taken AS (SELECT DISTINCT family, version FROM registry WHERE version IS NOT NULL),
    families AS (SELECT DISTINCT family FROM registry)
    SELECT f.family, min(n.version)::INTEGER AS next
    FROM families f CROSS JOIN (SELECT unnest(range(1, 1000)) AS version) n
    LEFT JOIN taken t ON t.family = f.family AND t.version = n.version
    WHERE t.version IS NULL GROUP BY f.family
    """,
)
def first_free_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.next_version(_registry(spark, sf_dir), "first_free")


@query(
    "L6",
    sql=f"""
    WITH registry AS ({_REGISTRY_SQL})
    SELECT family, max(version) AS version, family || '/gpt2-v' || max(version) AS path
    FROM registry WHERE version IS NOT NULL GROUP BY family
    """,
)
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest_path(_registry(spark, sf_dir))


@query(
    "W6",
    sql=f"""
    WITH registry AS ({_REGISTRY_SQL}),
    taken AS (SELECT DISTINCT family, version FROM registry WHERE version IS NOT NULL),
    free AS (
        SELECT f.family, n.version, row_number() OVER (PARTITION BY f.family ORDER BY n.version) AS place
        FROM (SELECT DISTINCT family FROM registry) f CROSS JOIN (SELECT unnest(range(1, 1000))::INTEGER AS version) n
        LEFT JOIN taken t ON t.family = f.family AND t.version = n.version WHERE t.version IS NULL)
    SELECT family, version, place AS claim FROM free WHERE place <= 2
    """,
)
def claimed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two claims in a row for every family: each gets the lowest number that is neither used nor claimed."""
    root = work_folder(spark, "claims")
    registry = _registry(spark, sf_dir)
    first = versions.claim_next(registry, root).withColumn("claim", F.lit(1).cast("long"))
    return first.unionByName(versions.claim_next(registry, root).withColumn("claim", F.lit(2).cast("long")))


@query(
    "W7", "L6",
    sql="""
    WITH named AS (
        SELECT p_brand AS family, CASE p_partkey % 3 WHEN 0 THEN 'v' || p_size WHEN 1 THEN 'v' || p_size || '_epochs_1'
            ELSE 'gpt2-v' || p_size END AS name FROM part)
    SELECT family, max(CASE WHEN regexp_full_match(name, 'v\\d+') THEN name[2:]::INTEGER END) AS exact,
        max(CASE WHEN regexp_matches(name, '^v\\d+') THEN regexp_extract(name, '^v(\\d+)', 1)::INTEGER END) AS leading,
        max(regexp_extract(name, 'v(\\d+)', 1)::INTEGER) AS any_place,
        family || '/v' || max(CASE WHEN regexp_full_match(name, 'v\\d+') THEN name[2:]::INTEGER END) AS path
    FROM named GROUP BY family
    """,
)
def exact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest folder that is named ``v<digits>``, beside names that only start so or hold a version."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    name = F.when(kind == 0, F.concat(F.lit("v"), size)).when(kind == 1, F.concat(F.lit("v"), size, F.lit("_epochs_1")))
    named = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.coalesce(name, F.concat(F.lit("gpt2-v"), size)).alias("name"))
    found = named.withColumn("version", versions.exact_version(F.col("name"))).withColumn("path", F.concat("family", F.lit("/"), "name"))
    latest = versions.latest_path(found).withColumnRenamed("version", "exact")
    others = named.groupBy("family").agg(
        F.max(versions.leading_version(F.col("name"))).alias("leading"), F.max(versions.any_version(F.col("name"))).alias("any_place")
    )
    return others.join(latest, "family", "left").select("family", "exact", "leading", "any_place", "path")


@query(
    "A12", "K1", "K2",
    sql="""
    SELECT 'rules' AS kind, count(*) AS records FROM part WHERE p_size % 4 <> 0
    UNION ALL SELECT 'texts', count(*) FROM documents
    """,
)
def written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records two corpora hold, as told by the writes that made them."""
    folder = work_folder(spark, "counted")
    rules = _rules(table(spark, sf_dir, "part")).filter("description is not null")
    told = [
        ("rules", writers.write_rule_records(rules, f"{folder}/rules")),
        ("texts", writers.write_with_end_of_text(table(spark, sf_dir, "documents"), f"{folder}/texts")),
    ]
    return spark.createDataFrame(told, "kind string, records long")
