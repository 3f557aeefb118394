"""Query op6: base statistics and verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.common import table
from strandline.llm.quality import judge


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


QUERIES = {"op6_quality": op6_quality}
SQL = {
    "op6_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT r, i, array_to_string(words[i:i+7], ' ') AS win FROM w, unnest(range(1, len(words) - 6)) AS t(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 8)) AS t(k) GROUP BY r),
lines AS (SELECT r, doc_id, source, text, x AS raw, trim(lower(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'))) AS line
          FROM d, unnest(string_split(text, chr(10))) AS t(x)),
dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n FROM lines WHERE line <> '' GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
freq AS (SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT text) AS n FROM lines WHERE line <> '' GROUP BY source, line) l
         JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source WHERE l.n > 20 AND l.n > 0.1 * h.texts),
gone AS (SELECT r, sum(len(string_split(l.line, ' '))) AS n FROM lines l JOIN freq f ON f.source IS NOT DISTINCT FROM l.source AND f.line = l.line GROUP BY r),
b AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM w LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - gone >= 0.25 * n_words AS kept, CAST(gone AS BIGINT) AS removed_words FROM f"""
}
