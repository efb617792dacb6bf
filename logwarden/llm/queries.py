"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import curve_packing, divergence, embedding_dedup, exact_dedup, fixity, infill, jaccard_join, language, mixing, packing, pii, sharding, token_counts
from logwarden.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def damaged(pages: DataFrame, file_pages: int = fixity.FILE_PAGES) -> DataFrame:
    """A replica's pages with damage by rule, for audits of derived data.

    Of every 97 pages one has its first character of html overwritten; every seventh file has lost
    its last pages, and every fifth one page inside, which shifts the records after it.
    """
    inside = F.pmod("page_id", F.lit(file_pages))
    tail = (F.floor(F.col("page_id") / file_pages) % 7 == 3) & (inside >= file_pages - 6)
    lost = tail | (F.floor(F.col("page_id") / file_pages) % 5 == 0) & (inside == 10)
    html = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    return pages.filter(~F.coalesce(lost, F.lit(False))).select("page_id", "url", html.alias("html"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.fixity_audit(fixity.warc_index(pages), fixity.warc_index(damaged(pages)))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(table(spark, sf_dir, "documents"), key=b"example key, to be replaced")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_with_edits(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.infill(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack_along_curve(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_exact_dedup, op3_embedding_dedup, op4_sharding, op5_warc_fixity, op6_pii, op7_packing, op8_token_counts, op9_language, op10_jaccard_join, op11_divergence, op12_infill, op13_curve_packing, pipeline)
}

_FOLDED = f"translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"

#: Bytes of the fixed parts of a record: the HTTP head of its block, and the WARC head.
_HTTP = len("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
_HEAD = len("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Target-URI: \r\nContent-Length: \r\n\r\n")

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op5_warc_fixity": f"""
        WITH b AS (SELECT page_id, page_id // 256 AS file_id, coalesce(strlen(url), 0) AS url_bytes, coalesce(strlen(html), 0) + {_HTTP} AS block FROM pages),
             r AS (SELECT *, {_HEAD} + strlen(CAST(page_id AS VARCHAR)) + url_bytes + strlen(CAST(block AS VARCHAR)) + block + 4 AS length FROM b),
             o AS (SELECT *, row_number() OVER w - 1 AS record_no, sum(length) OVER w - length AS "offset", page_id % 97 = 5 AS hit,
                     file_id % 7 = 3 AND page_id % 256 >= 250 OR file_id % 5 = 0 AND page_id % 256 = 10 AS lost FROM r WINDOW w AS (PARTITION BY file_id ORDER BY page_id)),
             q AS (SELECT *, "offset" - coalesce(sum(CASE WHEN lost THEN length ELSE 0 END) OVER (PARTITION BY file_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept_at FROM o)
        SELECT file_id, record_no, CASE WHEN lost THEN 'missing' WHEN hit THEN 'altered' ELSE 'moved' END AS fault, "offset", length,
               CASE WHEN NOT lost THEN kept_at END AS replica_offset, CASE WHEN NOT lost THEN length END AS replica_length
        FROM q WHERE lost OR hit OR kept_at <> "offset"
    """,
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
             g AS (SELECT DISTINCT lang, source FROM d),
             t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
             c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
             v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
             x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p FROM x JOIN v USING (lang)),
             y AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
             q AS (SELECT lang, term, CAST(1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q FROM y JOIN v USING (lang)),
             s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                     LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                   UNION ALL SELECT p.lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
        WHERE part = 'pair' OR rank <= 50
    """,
    "op12_infill": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
             e AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM d),
             c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
             o AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM o
    """,
}
