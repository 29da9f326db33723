"""One query per operator over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..session import checkpointed, remove_folder, work_folder
from . import chatformat, decontamination, exactdedup, extraction, hostrules, jaccardjoin, langid, lexicalsearch, linededup
from . import packing, spelling, toxicity, warc
from .catalog import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]


def word_tokenizer() -> str:
    """Path of the public word tokenizer, ``DOSSIER_TOKENIZER`` if that is set."""
    named = os.environ.get("DOSSIER_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query()
def op1_packing(spark, sf_dir):
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


DECONTAMINATION_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), iw AS (
    SELECT DISTINCT item, k, len(k) AS n FROM (
        SELECT item, list_slice(ws, p, p + least(len(ws), 13) - 1) AS k
        FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS p FROM b WHERE len(ws) > 0)
    )
), sizes AS (SELECT DISTINCT n FROM iw
), dw AS (
    SELECT doc_id, p, n, list_slice(ws, p, p + n - 1) AS k
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)
), hits AS (SELECT doc_id, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k
), covered AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * 20 >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query(sql=DECONTAMINATION_SQL)
def op7_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.find_items(docs.select("doc_id", "text"), items)
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        decontamination.hit_words().alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


HOST_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), l AS (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
    SELECT doc_id, unnest(range(1, greatest(len(ws) - 3, 1))) AS p, ws FROM d
), keyed AS (
    SELECT doc_id, p, list_slice(ws, p, p + 4) AS k FROM win
), counted AS (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed
), gaps AS (
    SELECT doc_id, least(5, p - lag(p, 1, p - 5) OVER (PARTITION BY doc_id ORDER BY p)) AS g FROM counted WHERE n > 1
), rep AS (
    SELECT doc_id, sum(g) AS n FROM gaps GROUP BY doc_id
), base AS (
    SELECT d.doc_id, d.host, len(ws) AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
           coalesce(rep.n, 0) AS n_repeat_words
    FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)
), ruled AS (
    SELECT *, n_words < 10 AS r1, n_repeat_words * 100 > n_words * 20 AS r2, n_symbols * 2 > word_chars AS r3,
           n_dup_lines * 2 > n_lines AS r4, word_chars < n_words * 2 OR word_chars > n_words * 30 AS r5
    FROM base
), long AS (
    SELECT host, unnest([1, 2, 3, 4, 5]) AS rule, unnest([r1, r2, r3, r4, r5])::BIGINT AS failed FROM ruled
), hosts AS (
    SELECT host, rule, count(*) AS n, sum(failed)::DOUBLE AS f FROM long GROUP BY host, rule
), moments AS (
    SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS v
    FROM hosts GROUP BY rule
), shrunk AS (
    SELECT host, CASE WHEN v > 1e-12 THEN (f + m * greatest(0, m * (1 - m) / v - 1)) / (n + greatest(0, m * (1 - m) / v - 1)) ELSE m END AS rate
    FROM hosts JOIN moments USING (rule)
), verdicts AS (
    SELECT host, max(rate) <= 0.5 AS ok FROM shrunk GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       r1 OR r2 AS base_failed, NOT (r1 OR r2) AND ok AS kept
FROM ruled JOIN verdicts USING (host)
"""


@query(sql=HOST_SQL)
def op9_host_rules(spark, sf_dir):
    return hostrules.judge_documents(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|SYS\]|/SYS\]|INST\]|/INST\]|REPLY\]|ROLE\]|AS\]|/AS\])', '\1\\\2\3', 'g'))
           + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 11 ELSE 15 + length(role) END AS chars
    FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query(sql=CHAT_SQL)
def op2_chat_formatting(spark, sf_dir):
    conflict = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", conflict), (-7, 1, "assistant", conflict)], given.schema)
    return chatformat.conversation_digests(chatformat.format_turns(given.unionByName(extra)))


WARC_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1), 1)), '') AS payload_digest
    FROM p
), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM r
"""


@query(sql=WARC_SQL)
def op8_warc(spark, sf_dir):
    folder = work_folder(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = warc.read_records(index, folder)
    read = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    found = checkpointed(read)
    remove_folder(spark, folder)
    return found


@query()
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


@query()
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


@query()
def op6_html_extraction(spark, sf_dir):
    return extraction.extract_text(table(spark, sf_dir, "pages"), extraction.trained())


@query()
def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = linededup.dedup_lines(docs)
    return cleaned.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 4), ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM d WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2
    ) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * i >= 75 * (na.n + nb.n - i)
), reach AS (
    SELECT doc_id, doc_id AS r FROM d
    UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT reach.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""


@query(sql=JACCARD_SQL)
def op3_jaccard_join(spark, sf_dir):
    found = jaccardjoin.link_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
WINDOW copies AS (PARTITION BY h)
"""


@query(sql=EXACT_SQL)
def op11_exact_dedup(spark, sf_dir):
    return exactdedup.label_copies(table(spark, sf_dir, "documents"))


LEXICAL_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), corpus AS (
    SELECT count(*) AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0
), tf AS MATERIALIZED (
    SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS t FROM d) GROUP BY ALL
), wanted AS (
    SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(ws) AS t FROM i) GROUP BY ALL
), weights AS (
    SELECT t, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY t
), shares AS (
    SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ws) * n) // l)) AS s
    FROM tf JOIN d USING (doc_id), corpus
), scored AS (
    SELECT item_id, doc_id, sum(q * w * s)::BIGINT AS score
    FROM wanted JOIN weights USING (t) JOIN shares USING (t) GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""


@query(sql=LEXICAL_SQL)
def op12_lexical_search(spark, sf_dir):
    return lexicalsearch.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SPELLING_SQL = r"""
WITH RECURSIVE bits AS (
    SELECT list(list_reduce([v, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS steps
    FROM (SELECT unnest(range(256)) AS v)
), found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run
    FROM documents
), hexed AS (
    SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM found GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
    FROM hexed, bits
), words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
    ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS MATERIALIZED (
    SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS MATERIALIZED (
    SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, w.word, w.n FROM cut a JOIN words w ON a.rest = w.word
    UNION SELECT w.word, a.word, a.n FROM cut a JOIN words w ON a.rest = w.word
), best AS (
    SELECT word, count(*) AS n_near, min((-n, encode(other), other)) AS top FROM near GROUP BY word
), formed AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 10 * n THEN top[3] END AS form,
           CASE WHEN -top[1] >= 10 * n THEN -top[1] END AS form_n
    FROM words LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL
)
SELECT formed.word, formed.n, formed.n_near, formed.form, formed.form_n, chain.at AS root
FROM formed JOIN chain ON chain.word = formed.word JOIN formed f ON f.word = chain.at AND f.form IS NULL
"""


@query(sql=SPELLING_SQL)
def op13_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))
