"""Query op6_quality_rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality_rules import ERROR, POINTS, PRICE, RISK, RULES, TUNING_DIGIT, quality_rules


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every document."""
    rows = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_GRID = " UNION ALL ".join(f"SELECT doc_id, stratum, {list(RULES).index(rule)} AS r, '{rule}' AS rule, CAST({cut} AS DOUBLE) AS cutoff, good, tune, {rule} > {cut} AS hit FROM lab" for rule, cut in POINTS)
_HITS = " OR ".join(f"coalesce({rule} > (SELECT min(cutoff) FROM best WHERE best.stratum = f.stratum AND best.rule = '{rule}'), false)" for rule in RULES)

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE = {
    "op6_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g),
v AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d, (SELECT unnest(range(0, 8)) AS j) WHERE c > 1 GROUP BY doc_id),
b AS (SELECT doc_id, stratum, len(w) AS n_words, length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
  len(regexp_extract_all(t, '\p{{Lu}}')) AS upper, len(regexp_extract_all(t, '[!?.,;:]')) AS marks, coalesce(v.n, 0) AS n_repeat_words FROM w LEFT JOIN v USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share,
  word_chars / greatest(n_words, 1) AS chars_per_word, upper / greatest(word_chars, 1) AS capital_share, marks / greatest(n_words, 1) AS marks_per_word FROM b),
lab AS (SELECT f.*, good, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '{TUNING_DIGIT}' AS tune FROM f JOIN (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
grid AS ({_GRID}),
points AS (SELECT stratum, r, rule, cutoff, count(*) FILTER (hit AND NOT good) - {PRICE} * count(*) FILTER (hit AND good AND tune) AS gain FROM grid GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, r, cutoff DESC) AS place FROM points WHERE gain > 0),
hold AS (SELECT g.doc_id, g.stratum, g.good, min(k.place) FILTER (g.hit) AS first FROM grid g LEFT JOIN ranked k ON g.stratum = k.stratum AND g.rule = k.rule AND g.cutoff = k.cutoff WHERE NOT (g.good AND g.tune) GROUP BY ALL),
tested AS (SELECT k.stratum, k.place AS step, count(*) FILTER (h.good) AS n, count(*) FILTER (h.good AND h.first <= k.place) AS k, count(*) FILTER (NOT h.good AND h.first <= k.place) AS t FROM ranked k JOIN hold h ON h.stratum = k.stratum GROUP BY ALL),
alone AS (SELECT *, n > 0 AND k <= n * {RISK} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {ERROR} / (SELECT count(DISTINCT stratum) FROM lab) AS ok FROM tested),
holds AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS holds FROM alone),
taken AS (SELECT stratum, step FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY t - {PRICE} * k DESC, step) AS o FROM holds WHERE holds AND t - {PRICE} * k > 0) WHERE o = 1),
best AS (SELECT k.stratum, k.rule, k.cutoff FROM ranked k JOIN taken USING (stratum) WHERE k.place <= taken.step)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR {_HITS}) AS kept FROM f
"""
}
