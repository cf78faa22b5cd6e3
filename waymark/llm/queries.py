"""The thin ``opN_`` queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as dedup
from . import jaccard, language, media, mixing, packing, preference, quality, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.format_pairs(preference.reply_pairs(read(spark, sf_dir, "conversations")))

    def shown(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")

    return out.select(
        F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", "chosen", "rejected", shown("chosen_spans").alias("chosen_spans"), shown("rejected_spans").alias("rejected_spans")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.media_column(read(spark, sf_dir, "documents")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_packing": op2_packing,
        "op3_mixing": op3_mixing,
        "op4_language": op4_language,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_preference": op6_preference,
        "op7_quality": op7_quality,
        "op8_media_columns": op8_media_columns,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_warc": op10_warc,
    }


LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH t AS (SELECT doc_id, sha256({LOWER_AZ}) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, CAST([3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS place,
         CAST(source_size * 2 AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget
  FROM s),
b AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + cap / w * sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget AS capped
  FROM r),
g AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE
           (budget - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN w END) OVER () * w END AS target
  FROM b),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN CAST(floor(floor(g.target) / g.source_size) AS BIGINT) ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - start)) AS BIGINT) AS taken
FROM p
"""


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
g AS (
  SELECT conv_id, min(i) FILTER (role = 'assistant') AS f, coalesce(max(i) FILTER (role = 'assistant'), max(i)) AS l FROM t GROUP BY conv_id),
c AS (SELECT t.* FROM t JOIN g USING (conv_id) WHERE i <= l),
r AS (
  SELECT c.conv_id, c.role, i,
         CASE WHEN i = l AND f = l THEN '' WHEN i = l AND f < l THEN (SELECT any_value(x.text) FROM t x WHERE x.conv_id = c.conv_id AND x.i = g.f) ELSE c.text END AS text
  FROM c JOIN g USING (conv_id)),
p AS (
  SELECT g.conv_id, coalesce(min(c.i) FILTER (c.role <> r.role OR c.text <> r.text) - 1, max(g.l)) AS prompt_turns
  FROM g JOIN c USING (conv_id) JOIN r ON r.conv_id = c.conv_id AND r.i = c.i GROUP BY g.conv_id),
b AS (SELECT *, 'c' AS side FROM c UNION ALL SELECT conv_id, role, text, i, 'r' FROM r),
m AS (
  SELECT b.*, prompt_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, i > prompt_turns AS rest
  FROM b JOIN p USING (conv_id)),
o AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, side, rest ORDER BY i) - length(shown) + length(role) + 5 AS start FROM m)
SELECT conv_id, CAST(any_value(prompt_turns) AS INTEGER) AS prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'c' AND NOT rest), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'c' AND rest), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'r' AND rest), '') AS rejected,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(text) + 7 AS BIGINT), ',' ORDER BY i) FILTER (side = 'c' AND rest AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(text) + 7 AS BIGINT), ',' ORDER BY i) FILTER (side = 'r' AND rest AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_preference": OP6_SQL, "op3_mixing": OP3_SQL, "op5_exact_dedup": OP5_SQL}
