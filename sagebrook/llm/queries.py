"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language_id, language_model, packing, prefix_trie, quality_model, quality_rules, secret_scan, sharding, simhash, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(_table(spark, sf_dir, "documents"))


def _op6_sql() -> str:
    """The rules, sketches and fences in SQL; logarithmic bins count rows, so merged sketches are sums."""
    base = repr(math.log((1 + quality_rules.ACCURACY) / (1 - quality_rules.ACCURACY)))
    share = "coalesce({scale}::DOUBLE * {part} / nullif({whole}, 0), 0.0::DOUBLE)"
    measures = {
        "symbols": share.format(scale=1000, part="n_symbols", whole="word_chars"), "dup_lines": share.format(scale=1000, part="n_dup_lines", whole="n_lines"),
        "repeats": share.format(scale=1000, part="n_repeat_words", whole="n_words"), "capitals": share.format(scale=1000, part="n_capitals", whole="word_chars"),
        "mean_word": share.format(scale=10, part="word_chars", whole="n_words"),
    }
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {x} AS x FROM b WHERE n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words" for m, x in measures.items())

    def level(name: str, *by: str) -> str:
        keys = ", ".join((*by, "measure"))
        return f"""{name} AS (SELECT {keys}, max(total) AS rows, min(value) FILTER (upto * 4 >= total) AS q1, min(value) FILTER (upto * 4 >= total * 3) AS q3 FROM
 (SELECT {keys}, CASE WHEN bin = 0 THEN 0.0::DOUBLE ELSE exp((bin - 1.5::DOUBLE) * {base}::DOUBLE) END AS value, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total
  FROM (SELECT {keys}, bin, sum(n) AS n FROM sk WHERE bin > 0 OR measure = 'symbols' GROUP BY ALL)) GROUP BY ALL)"""

    least = quality_rules.LEAST_ROWS
    pick = lambda q: f"CASE WHEN l0.rows >= {least} THEN l0.{q} WHEN l1.rows >= {least} THEN l1.{q} ELSE l2.{q} END"
    beyond = repr(1 + 2 * quality_rules.ACCURACY)
    windows = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER p" for k in range(1, 5))])
    within = " AND ".join(f"{x} <= {m}_most" for m, x in measures.items())
    return f"""WITH m AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
 w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM m),
 g AS (SELECT doc_id, i, {windows} AS win FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g WHERE win IS NOT NULL),
 n AS (SELECT doc_id, count(DISTINCT j) AS k FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r WHERE c > 1) GROUP BY 1),
 b AS (SELECT m.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, len(ls)::BIGINT AS n_lines FROM m LEFT JOIN n USING (doc_id)),
 sk AS (SELECT lang, source, measure, CASE WHEN x < 1 THEN 0 ELSE ceil(ln(x) / {base}::DOUBLE) + 1 END AS bin, count(*) AS n FROM ({long}) GROUP BY ALL),
 {level('l0', 'lang', 'source')}, {level('l1', 'lang')}, {level('l2')},
 f AS (SELECT o.lang, o.source, o.measure, coalesce(({pick('q3')} + {quality_rules.REACH}::DOUBLE * ({pick('q3')} - {pick('q1')})) * {beyond}::DOUBLE + CASE WHEN o.measure = 'symbols' THEN {quality_rules.SLACK['symbols']}::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE) AS most
  FROM (SELECT DISTINCT lang, source, measure FROM sk) o LEFT JOIN l0 ON l0.lang IS NOT DISTINCT FROM o.lang AND l0.source IS NOT DISTINCT FROM o.source AND l0.measure = o.measure
  LEFT JOIN l1 ON l1.lang IS NOT DISTINCT FROM o.lang AND l1.measure = o.measure LEFT JOIN l2 ON l2.measure = o.measure),
 h AS (SELECT lang AS fl, source AS fs, {', '.join(f"max(most) FILTER (measure = '{m}') AS {m}_most" for m in measures)} FROM f GROUP BY ALL)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad AS base_failed, NOT bad AND ok AS kept, {', '.join(f"round({m}_most, 6) AS {m}_most" for m in measures)} FROM
 (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS bad, {within} AS ok FROM b LEFT JOIN h ON fl IS NOT DISTINCT FROM lang AND fs IS NOT DISTINCT FROM source)"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.document_languages(_table(spark, sf_dir, "documents"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.page_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_quality_classifier, op3_sharding, op4_toxicity, op5_simhash, op6_quality_rules, op7_language_model, op8_byte_bpe, op9_packing, op10_language_id, op11_secret_scan, op12_embedding_whitening, op13_prefix_trie, page_languages)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_quality_rules": _op6_sql()}
