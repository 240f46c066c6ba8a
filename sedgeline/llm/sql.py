"""DuckDB statements for the queries that SQL can express on whole tables.

p2_*, p7_* and p9_* need a comparison of all texts, p8_* and p10_* a tokenizer or a trained
model, p1_sample an order of md5 within quotas of a flow, p6_splits the components of a
graph and Spark's hash: they are tested against brute force in tests/llm.
"""

from __future__ import annotations

B = "chr(32)||chr(9)||chr(10)||chr(13)||chr(160)"
CATEGORIES = f"""
base AS (
  SELECT nullif(trim(niche_id, {B}), '') AS niche_id, nullif(trim(review_id, {B}), '') AS review_id,
    coalesce(nullif(regexp_replace(lower(rating_group), '\\s+', '', 'g'), ''), CASE WHEN rating IN (1, 2) THEN 'low_1_2' WHEN rating = 3 THEN 'mid_3' WHEN rating IN (4, 5) THEN 'high_4_5' END) AS rating_group,
    coalesce(CAST(review_year AS VARCHAR), CAST(year(CAST(review_timestamp AS TIMESTAMPTZ) AT TIME ZONE 'UTC') AS VARCHAR)) AS review_year,
    nullif(regexp_replace(lower(stratum_id), '\\s+', '', 'g'), '') AS s, nullif(regexp_replace(lower(length_bucket), '\\s+', '', 'g'), '') AS l
  FROM aspect_sampling),
r AS (SELECT niche_id, review_id, rating_group, review_year, coalesce(s, rating_group || '|' || review_year || '|' || l) AS stratum_id FROM base WHERE niche_id IS NOT NULL AND review_id IS NOT NULL),
c AS (
  SELECT niche_id, 'stratum_id' AS f, stratum_id AS c, review_id FROM r UNION ALL
  SELECT niche_id, 'rating_group', rating_group, review_id FROM r UNION ALL
  SELECT niche_id, 'review_year', review_year, review_id FROM r),
n AS (SELECT niche_id, f, c, count(DISTINCT review_id) AS n FROM c WHERE c IS NOT NULL GROUP BY ALL),
t AS (SELECT *, greatest(min_rows, (CAST(sample_size AS BIGINT) * target_permille) // 1000) AS demand FROM sampling_targets),
j AS (SELECT t.*, coalesce(n.n, 0) AS available FROM t LEFT JOIN n ON n.niche_id = t.niche_id AND n.f = t.target_field AND n.c = regexp_replace(lower(t.category), '\\s+', '', 'g'))
"""

SQL = {
    "p1_found": f"WITH {CATEGORIES} SELECT niche_id, target_field, category FROM j WHERE available < demand",
    "p1_report": f"""WITH {CATEGORIES} SELECT niche_id, target_field, category, CAST(demand AS BIGINT) AS demand, CAST(available AS BIGINT) AS available,
      CAST(greatest(0, least(min_rows, demand) - available) AS BIGINT) AS floor_short,
      CAST(greatest(0, demand - available) - greatest(0, least(min_rows, demand) - available) AS BIGINT) AS margin_short,
      CAST(least(demand, available) AS BIGINT) AS allotted FROM j""",
    "p3_found": f"""SELECT DISTINCT review_id FROM aspect_sampling WHERE trim(review_id, {B}) <> '' AND deterministic_key IS NOT NULL
      AND lower(trim(deterministic_key, {B})) IS DISTINCT FROM md5(review_id || ':' || CAST(sampling_seed AS VARCHAR))""",
    "p3_sample": f"""WITH k AS (SELECT review_id, CAST(min(load_batch) AS BIGINT) AS load_batch FROM aspect_sampling WHERE trim(review_id, {B}) <> '' GROUP BY 1),
      o AS (SELECT *, row_number() OVER (PARTITION BY load_batch ORDER BY md5(review_id || ':42'), review_id) AS rn, count(*) OVER (PARTITION BY load_batch) AS n FROM k)
      SELECT review_id, load_batch FROM o WHERE rn <= (n * 100 + 999) // 1000""",
    "p4_found": f"""WITH m AS (SELECT upper(trim(review_id, {B})) AS r, trim(review_id, {B}) AS review_id, lower(trim(aspect_id, {B})) AS aspect_id, upper(trim(parent_asin, {B})) AS parent_asin,
        scored_at, aspect_sentiment_score AS score, coalesce(helpful_vote, 0) AS votes FROM aspect_marts),
      l AS (SELECT *, row_number() OVER (PARTITION BY r, aspect_id ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST, votes DESC) AS k FROM m WHERE r <> '' AND aspect_id <> ''),
      v AS (SELECT *, row_number() OVER (PARTITION BY parent_asin, aspect_id ORDER BY score DESC, votes DESC, review_id) AS rn FROM l
        WHERE k = 1 AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 AND parent_asin <> '')
      SELECT parent_asin, aspect_id, review_id FROM v WHERE rn <= 3""",
    "p6_found": f"""WITH s AS (SELECT upper(trim(parent_asin, {B})) AS p, upper(trim(user_id, {B})) AS u, replace(lower(trim(split_name, {B})), '-', '_') AS split FROM sentiment),
      e AS (SELECT 'parent_asin' AS entity_kind, p AS entity_id, split FROM s UNION ALL SELECT 'user_id', u, split FROM s)
      SELECT entity_kind, entity_id FROM e WHERE entity_id <> '' AND split <> '' GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""",
}
