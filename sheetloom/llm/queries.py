"""The queries opN_<name> of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .main_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hexadecimal, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal("print").alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeated_passages import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .avi_jpeg import media_column, media_digests

    return media_digests(media_column(table(spark, sf_dir, "documents")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER)))


def op8_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary(BYTE_TOKENIZER))


def op9_bloom_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bloom_sketch import edit_fingerprints

    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op10_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fixity import archive, audit, damaged_replica, leaves

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(leaves(archive(pages)), leaves(archive(damaged_replica(pages))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_main_text": op2_main_text,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality": op5_quality,
    "op6_media": op6_media,
    "op7_token_files": op7_token_files,
    "op8_chunk_bpe": op8_chunk_bpe,
    "op9_bloom_sketch": op9_bloom_sketch,
    "op10_fixity": op10_fixity,
}
ORACLE_SQL: dict[str, str] = {
    "op10_fixity": """
        WITH pages_ AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL
        ), replicas AS (
            SELECT 0 AS replica, page_id, url, html FROM pages_
            UNION ALL
            SELECT 1, page_id, url, CASE WHEN page_id % 97 = 13 THEN '?' || substr(html, 2) ELSE html END
            FROM pages_ WHERE page_id % 389 <> 7
        ), records AS (
            SELECT replica, page_id, CAST(floor(page_id / 1024.0) AS BIGINT) AS segment,
                   'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                   || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                   || 'Content-Type: text/html' || chr(13) || chr(10)
                   || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10)
                   || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM replicas
        ), hashed AS (
            SELECT replica, page_id, segment, CAST(octet_length(encode(record)) AS BIGINT) AS length, sha256(record) AS digest
            FROM records
        ), placed AS (
            SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS position,
                   CAST(coalesce(sum(length) OVER (PARTITION BY segment ORDER BY page_id, digest
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM hashed WHERE replica = 0 WINDOW w AS (PARTITION BY segment ORDER BY page_id, digest)
        )
        SELECT a.page_id, a.segment, a.position, a.start, a.length, a.digest,
               CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'damaged' ELSE 'ok' END AS status
        FROM placed a LEFT JOIN hashed b ON b.replica = 1 AND b.page_id = a.page_id
    """,
}
