"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, embed, exact, kneser_ney, langid, packing, phrases, simhash, tokenbin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op3_bpe_codec(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_token_store(spark, sf_dir):
    return tokenbin.store_and_index(table(spark, sf_dir, "documents"), end_id=0)


def op2_chat_format(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seed=42)


def op6_embedding_graph(spark, sf_dir):
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"), reach=0.93)


def op7_substring_dedup(spark, sf_dir):
    return phrases.dedup(table(spark, sf_dir, "documents"), window=50)


def op8_quality(spark, sf_dir):
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_format": op2_chat_format,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_token_store": op4_token_store,
    "op5_simhash": op5_simhash,
    "op6_embedding_graph": op6_embedding_graph,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest
  FROM conversations),
convs AS (SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS ds FROM rows GROUP BY conv_id),
firsts AS (SELECT array_to_string(ds, '') AS whole, min(conv_id) AS conv_id FROM convs GROUP BY 1),
steps AS (SELECT ds, unnest(range(1, len(ds))) AS k FROM convs),
proper AS (SELECT DISTINCT array_to_string(ds[1:k], '') AS whole FROM steps),
kept AS (SELECT conv_id FROM firsts WHERE whole NOT IN (SELECT whole FROM proper))
SELECT r.conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), ''
                  ORDER BY turn NULLS FIRST, digest) AS rendered
FROM rows r JOIN kept k ON r.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY r.conv_id
""",
    "op7_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts),
owners AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN owners USING (h) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
marked AS (SELECT a.doc_id, a.p, a.word, g.p IS NOT NULL AS out FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p),
counted AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE out) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT out), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counted USING (doc_id)
""",
    "op10_exact_dedup": """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
""",
}
