"""The registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.embeddings import embedding_dedup
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.langid import language_id
from tessella.llm.licenses import license_scan
from tessella.llm.lines import line_dedup
from tessella.llm.mixing import mix
from tessella.llm.packing import packed
from tessella.llm.secrets import find_secrets
from tessella.llm.simhash import simhash_dedup
from tessella.llm.tokens import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).drop("component")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("pieces")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_simhash_dedup, op3_token_counts, op4_mixing, op5_secrets, op6_line_dedup, op7_packing, op8_language_id, op9_embedding_dedup, op10_exact_dedup)}

ORACLE_SQL = {
    "op6_line_dedup": r"""
        WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, i - 1 AS line_no, regexp_replace(trim(ls[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)), '[\x20\x09-\x0D]+', ' ', 'g') AS line
              FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
        w AS (SELECT *, CASE WHEN line = '' THEN [] WHEN strlen(line) > 2 * length(line) THEN list_transform(range(1, length(replace(line, ' ', '')) + 1), lambda i: substring(replace(line, ' ', ''), i::INT, 1))
                             ELSE string_split(line, ' ') END AS words, row_number() OVER (ORDER BY doc_id, line_no) AS pos FROM l),
        d AS (SELECT line, words, min(pos) AS first FROM w WHERE line <> '' GROUP BY ALL),
        v AS (SELECT * FROM (SELECT line, words, first, i, CASE WHEN i = 0 THEN words ELSE list_concat(words[1:i - 1], words[i + 1:]) END AS rest
              FROM (SELECT *, unnest(range(0, len(words) + 1)) AS i FROM d))
              WHERE len(rest) > 0 AND length(array_to_string(rest, ' ')) * 5 >= length(array_to_string(words, ' ')) * 4),
        sub AS (SELECT line, first > min(first) OVER (PARTITION BY rest, i) AS gone FROM v),
        ins AS (SELECT line, first > coalesce(CASE WHEN i = 0 THEN min(first) FILTER (i > 0) OVER g ELSE min(first) FILTER (i = 0) OVER g END, first) AS gone
                FROM v WINDOW g AS (PARTITION BY rest)),
        near AS (SELECT DISTINCT line FROM (SELECT * FROM sub UNION ALL SELECT * FROM ins) WHERE gone),
        j AS (SELECT w.doc_id, w.line_no, coalesce(w.pos > d.first, false) AS exact, coalesce(w.pos = d.first AND near.line IS NOT NULL, false) AS near
              FROM w LEFT JOIN d ON w.line = d.line LEFT JOIN near ON w.line = near.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
               coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (exact OR near), '') AS dropped
        FROM j GROUP BY doc_id""",
    "op9_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links,
               (SELECT min(y) FROM reach r WHERE r.x = v.vec_id) AS component_id,
               v.vec_id = (SELECT min(y) FROM reach r WHERE r.x = v.vec_id) AS kept
        FROM v""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
}
