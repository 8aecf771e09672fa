"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bytebpe, importance, ngram_join, packing, pii, quality_rules, sharding, spotsigs, toxicity, wordbpe


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_spotsigs": spotsigs.op1_spotsigs,
        "op2_token_counts": wordbpe.op2_token_counts,
        "op3_feistel_pii": pii.op3_feistel_pii,
        "op4_size_tiered_sharding": sharding.op4_size_tiered_sharding,
        "op5_byte_bpe": bytebpe.op5_byte_bpe,
        "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_toxicity_crf": toxicity.op9_toxicity_crf,
        "op10_importance_resampling": importance.op10_importance_resampling,
        "pipeline": corpus_pipeline.run,
    }


def _rules_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in (*quality_rules.STOP_WORDS, *(x.title() for x in quality_rules.STOP_WORDS)))
    bounds = " AND ".join(f"{m} >= {low}" for m, low, _ in quality_rules.RULES if low is not None) + " AND " + " AND ".join(f"{m} <= {high}" for m, _, high in quality_rules.RULES if high is not None)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
x AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
marked AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM x) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM marked) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
  length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper, len(list_filter(ws, lambda y: y IN ({stop}))) AS n_stop,
  len(list_filter(ls, lambda y: rtrim(y, ' ') LIKE '%...')) AS n_ellipsis,
  len(list_filter(ls, lambda y: ltrim(y, ' ') LIKE '- %' OR ltrim(y, ' ') LIKE '* %' OR ltrim(y, ' ') LIKE '•%')) AS n_bullet
  FROM w LEFT JOIN rep USING (r)),
q AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
  coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_ratio, coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
  coalesce(n_ellipsis / nullif(n_lines, 0), 0) AS ellipsis_line_ratio, coalesce(n_bullet / nullif(n_lines, 0), 0) AS bullet_line_ratio,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND {bounds} AS kept FROM q"""


def _join_sql() -> str:
    """Exact: every pair that shares a shingle is compared. A class is the closure of the links."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, min(reach.b) AS class_id, coalesce(any_value(k.n_links), 0)::BIGINT AS n_links FROM w JOIN reach ON reach.a = doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = doc_id GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_jaccard_join": _join_sql(), "op7_quality_rules": _rules_sql()}
