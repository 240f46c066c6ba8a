"""Driver queries of the core: name -> (spark, folder) -> DataFrame, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline.functions import spans
from sedgeline.functions.text import bucket100, clean_text, fingerprint, spreadsheet_safe, title_key, word_count
from sedgeline.operators import aspects, catalog, compare, evaluation, ingest, models, profile, sampling, search, skew, splits, taxonomy
from sedgeline.plans import views
from sedgeline.plans.views import COUNTERS, MANIFEST, MENTIONS, PREDICTIONS, PRODUCTS, REVIEWS
from sedgeline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COUNTS = """WITH n AS (SELECT upper(trim(parent_asin)) AS p, count(DISTINCT review_id) AS n FROM reviews WHERE trim(review_id) <> '' GROUP BY 1),
c AS (SELECT DISTINCT upper(trim(parent_asin)) AS parent_asin, review_count FROM product_catalog WHERE trim(parent_asin) <> ''),
j AS (SELECT parent_asin, review_count, coalesce(n, 0) AS found_count FROM c LEFT JOIN n ON n.p = parent_asin)
"""


@query(COUNTS + "SELECT DISTINCT parent_asin FROM j WHERE review_count <> found_count")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.wrong_counts(table(spark, d, "product_catalog"), table(spark, d, "reviews"))


@query(COUNTS + "SELECT parent_asin, CAST(review_count AS BIGINT) AS review_count, CAST(found_count AS BIGINT) AS found_count FROM j")
def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return skew.review_counts(table(spark, d, "product_catalog"), table(spark, d, "reviews"))


# ------------------------------------------------------------------ profiles


@query(f"""WITH {REVIEWS}, a AS (SELECT count(*) AS reviews, count(DISTINCT asin) AS asins, count(DISTINCT parent_asin) AS parents, count(DISTINCT user_id) AS users, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms,
count(*) FILTER (WHERE verified) AS verified, CAST(sum(helpful) AS BIGINT) AS helpful, count(*) FILTER (WHERE user_id IS NULL) AS null_users, CAST(sum(length(text)) AS BIGINT) AS characters, quantile_cont(length(text), [0.5, 0.9, 0.99]) AS q FROM rev)
SELECT * EXCLUDE (q), CAST(floor(q[1] * 1000 + 0.5) AS BIGINT) AS length_p50, CAST(floor(q[2] * 1000 + 0.5) AS BIGINT) AS length_p90, CAST(floor(q[3] * 1000 + 0.5) AS BIGINT) AS length_p99 FROM a""")
def dataset_profile(spark, d):
    return profile.dataset_profile(views.reviews(spark, d))


@query(f"WITH {REVIEWS} SELECT CAST(rating AS BIGINT) AS rating, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM rev GROUP BY 1")
def rating_distribution(spark, d):
    return profile.distribution(views.reviews(spark, d), F.col("rating").cast("long"), "rating")


@query(f"WITH {REVIEWS} SELECT CAST(year AS BIGINT) AS year, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM rev GROUP BY 1")
def year_distribution(spark, d):
    return profile.distribution(views.reviews(spark, d), F.col("year").cast("long"), "year")


BUCKET = "CASE WHEN w < 5 THEN 'too_short_1_4' WHEN w <= 40 THEN 'short_5_40' WHEN w <= 120 THEN 'medium_41_120' ELSE 'long_121_plus' END"


@query(f"WITH {REVIEWS}, b AS (SELECT len(regexp_split_to_array(trim(text), '[ \\t\\n\\f\\r]+')) AS w FROM rev) SELECT {BUCKET} AS length_bucket, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM b GROUP BY 1")
def length_buckets(spark, d):
    return profile.length_buckets(views.reviews(spark, d))


@query(f"WITH {REVIEWS} SELECT CAST(year AS BIGINT) AS year, " + ", ".join(f"count(*) FILTER (WHERE rating = {i}) / count(*)::DOUBLE AS share_{i}" for i in range(1, 6)) + " FROM rev GROUP BY year")
def rating_by_year(spark, d):
    return profile.rating_by_year(views.reviews(spark, d))


@query(f"WITH {REVIEWS} SELECT rating, count(*) AS reviews, count(*) FILTER (WHERE verified) AS verified, CAST(sum(helpful) AS BIGINT) AS helpful, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(max(helpful) AS BIGINT) AS most_helpful FROM rev GROUP BY 1")
def helpful_by_rating(spark, d):
    return profile.helpful_by_rating(views.reviews(spark, d))


@query(f"WITH {REVIEWS} SELECT CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS label, CASE WHEN rating <= 3 THEN 'needs_attention' ELSE 'satisfied' END AS attention, count(*) AS n FROM rev GROUP BY ALL")
def sentiment_label_shares(spark, d):
    return views.reviews(spark, d).groupBy(profile.sentiment_label(F.col("rating")).alias("label"), profile.attention_label(F.col("rating")).alias("attention")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ ingest

FIRST, LAST = "2021-03-01", "2023-09-30"
REASON = f"""CASE WHEN rating IS NULL OR rating NOT IN (1, 2, 3, 4, 5) THEN 'invalid_rating' WHEN review_timestamp IS NULL THEN 'invalid_timestamp'
WHEN review_timestamp AT TIME ZONE 'UTC' < TIMESTAMP '{FIRST}' OR review_timestamp AT TIME ZONE 'UTC' >= TIMESTAMP '{LAST}' + INTERVAL 1 DAY THEN 'outside_window' WHEN coalesce(trim(asin), '') = '' THEN 'missing_asin'
WHEN coalesce(trim(parent_asin), '') = '' THEN 'missing_parent_asin' WHEN coalesce(review_text, '') = '' THEN 'empty_review_text' ELSE 'kept' END"""


@query(f"SELECT {REASON} AS reason, count(*) AS n FROM reviews GROUP BY 1")
def drop_reason_counts(spark, d):
    r = table(spark, d, "reviews")
    why = ingest.drop_reason(r["rating"], r["review_timestamp"], r["asin"], r["parent_asin"], r["review_text"], FIRST, LAST)
    return r.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE k BETWEEN 10 AND 90) AS valid, CAST(sum(CASE WHEN k BETWEEN 10 AND 90 THEN k ELSE 0 END) AS BIGINT) AS total FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def bounded_integers(spark, d):
    k = ingest.bounded_integer(F.get_json_object("props", "$.k"), 10, 90)
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("valid"), F.sum(F.coalesce("k", F.lit(0))).alias("total"))


@query(f"WITH {REVIEWS} SELECT review_id, CAST(rating AS BIGINT) AS rating, epoch_ms(ts) AS ms, length(text) AS characters FROM rev")
def canonical_dedup(spark, d):
    return views.reviews(spark, d).select("review_id", F.col("rating").cast("long").alias("rating"), F.unix_millis("ts").alias("ms"), F.length("text").cast("long").alias("characters"))


@query(f"WITH {REVIEWS} SELECT (SELECT count(*) FROM reviews) AS input, (SELECT count(*) FROM rev) AS output, (SELECT count(*) FROM reviews) - (SELECT count(*) FROM rev) AS duplicates")
def canonical_dedup_counts(spark, d):
    r = table(spark, d, "reviews")
    by = r.groupBy(*ingest.DEDUP_KEY[:-1], F.md5("review_text")).agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("input"), F.count("*").alias("output"), (F.sum("n") - F.count("*")).alias("duplicates"))


NULLABLE = ["review_id", "asin", "parent_asin", "rating", "review_text", "review_timestamp", "user_id", "verified_purchase", "helpful_vote"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM reviews" for c in NULLABLE))
def required_null_counts(spark, d):
    return ingest.null_counts(table(spark, d, "reviews"), NULLABLE)


# ------------------------------------------------------------------ text

SPACES = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(f"SELECT source, count(*) AS n, CAST(sum(length(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '{SPACES}', ' ', 'g')))) AS BIGINT) AS characters FROM documents GROUP BY 1")
def clean_text_lengths(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length(clean_text("text"))).alias("characters"))


@query(f"WITH {REVIEWS} SELECT md5(lower(trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g')))) AS print, count(*) AS n, count(DISTINCT parent_asin) AS products FROM rev GROUP BY 1 HAVING count(*) > 1")
def text_fingerprint_duplicates(spark, d):
    return views.reviews(spark, d).groupBy(fingerprint("text").alias("print")).agg(F.count("*").alias("n"), F.count_distinct("parent_asin").alias("products")).where("n > 1")


@query(f"WITH {PRODUCTS} SELECT CAST(md5_number_lower(parent_asin) % 100 AS BIGINT) AS bucket, count(*) AS products FROM prod GROUP BY 1")
def product_bucket_histogram(spark, d):
    return views.products(spark, d).groupBy(bucket100("parent_asin").cast("long").alias("bucket")).agg(F.count("*").alias("products"))


@query(f"WITH {PRODUCTS} SELECT parent_asin, trim(regexp_replace(lower(coalesce(product_title, '')), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM prod")
def title_keys(spark, d):
    return views.products(spark, d).select("parent_asin", title_key("product_title").alias("title_key"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^[ \\t\\r\\n\\f\\x0b]*[=+\\-@]') OR regexp_matches(text, '^[\\t\\r]') THEN '''' || text ELSE text END AS safe FROM documents WHERE text IS NOT NULL")
def spreadsheet_safe_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", spreadsheet_safe("text").alias("safe"))


# ------------------------------------------------------------------ catalog and scope

#: The namespace of the ids in the given tables.
NAMESPACE = "hair-category"
PATH_KEY = "array_to_string(list_filter(list_transform(category_path, lambda x: replace(lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))), 'ß', 'ss')), lambda x: x <> ''), ' > ')"


@query(f"""WITH k AS (SELECT *, {PATH_KEY} AS path_key FROM product_catalog WHERE len(category_path) > 0)
SELECT 'hair-category:' || substr(sha256(dataset_category || '|' || path_key), 1, 24) AS category_path_id, path_key, array_to_string(min(category_path), ' > ') AS path_text, CAST(len(min(category_path)) AS BIGINT) AS depth, min(category_path)[-1] AS leaf, count(*) AS records, count(DISTINCT upper(trim(parent_asin))) AS parents,
count(DISTINCT trim(main_category)) AS main_categories, count(*)::DOUBLE / sum(count(*)) OVER () AS record_share FROM k GROUP BY dataset_category, path_key""")
def category_registry(spark, d):
    return catalog.registry(table(spark, d, "product_catalog"), NAMESPACE)


@query(f"""WITH k AS (SELECT DISTINCT string_split({PATH_KEY}, ' > ') AS k FROM product_catalog WHERE len(category_path) > 0), n AS (SELECT k, unnest(range(1, len(k) + 1)) AS depth FROM k)
SELECT CAST(depth AS BIGINT) AS depth, count(DISTINCT k[1:depth]) AS nodes FROM n GROUP BY 1""")
def category_nodes(spark, d):
    return catalog.category_nodes(table(spark, d, "product_catalog"))


@query(f"WITH {REVIEWS} SELECT parent_asin, count(*) AS reviews, count(DISTINCT asin) AS asins, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms FROM rev GROUP BY 1")
def review_coverage(spark, d):
    return catalog.coverage(views.reviews(spark, d))


@query(f"""WITH {REVIEWS}, {PRODUCTS}, o AS (SELECT parent_asin, count(*) AS n FROM rev GROUP BY 1), b AS (SELECT o.n, p.parent_asin AS known FROM o FULL JOIN prod p USING (parent_asin))
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS reviews, CAST(coalesce(sum(n) FILTER (WHERE known IS NOT NULL), 0) AS BIGINT) AS matched, count(known) AS products, count(*) FILTER (WHERE known IS NOT NULL AND n IS NOT NULL) AS reviewed_products, count(*) FILTER (WHERE known IS NULL) AS unknown_products FROM b""")
def catalog_join_coverage(spark, d):
    return catalog.join_coverage(views.reviews(spark, d), table(spark, d, "product_catalog"))


def _lacks(c, name, text=True):
    return f"CASE WHEN coalesce(trim({c}), '') = '' THEN '{name}' END" if text else f"CASE WHEN {c} IS NULL THEN '{name}' END"


@query(f"WITH {PRODUCTS} SELECT concat_ws(',', {_lacks('main_category', 'missing_main_category')}, {_lacks('price_at_collection', 'missing_price', False)}, {_lacks('rating_number', 'missing_rating_number', False)}, {_lacks('store', 'missing_store')}, {_lacks('product_title', 'missing_title')}) AS flags, count(*) AS products FROM prod GROUP BY 1")
def catalog_quality_flags(spark, d):
    return catalog.quality_flags(table(spark, d, "product_catalog"))


@query(f"WITH {PRODUCTS} SELECT parent_asin, trim(regexp_replace(concat_ws(' ', product_title, store, array_to_string(category_path, ' '), array_to_string(features, ' ')), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS search_text FROM prod")
def product_search_texts(spark, d):
    return catalog.search_text(table(spark, d, "product_catalog"))


@query(f"""WITH {REVIEWS}, {PRODUCTS}, o AS (SELECT parent_asin, count(*) AS reviews, count(DISTINCT asin) AS asins, count(*) FILTER (WHERE verified) AS verified, sum(helpful) AS helpful FROM rev GROUP BY 1)
SELECT trim(leaf_category) AS leaf, count(*) AS products, count(reviews) AS reviewed_products, CAST(coalesce(sum(reviews), 0) AS BIGINT) AS reviews, CAST(coalesce(sum(asins), 0) AS BIGINT) AS asins, CAST(coalesce(sum(verified), 0) AS BIGINT) AS verified, CAST(coalesce(sum(helpful), 0) AS BIGINT) AS helpful FROM prod LEFT JOIN o USING (parent_asin) GROUP BY 1""")
def niche_population(spark, d):
    return catalog.niche_population(views.reviews(spark, d), table(spark, d, "product_catalog"))


LEAVES = ["Conditioners", "Hair Masks"]


@query(f"WITH {REVIEWS}, {PRODUCTS} SELECT rev.review_id, rev.parent_asin, trim(leaf_category) AS leaf, product_title, CAST(rev.rating AS BIGINT) AS rating FROM rev JOIN prod ON prod.parent_asin = rev.parent_asin WHERE trim(leaf_category) IN ('Conditioners', 'Hair Masks')")
def niche_reviews(spark, d):
    return catalog.niche_reviews(views.reviews(spark, d), table(spark, d, "product_catalog"), LEAVES).select("review_id", "parent_asin", "leaf", "product_title", F.col("rating").cast("long").alias("rating"))


# ------------------------------------------------------------------ samples and splits

STRATUM = f"""b AS (SELECT *, len(regexp_split_to_array(trim(text), '[ \\t\\n\\f\\r]+')) AS w FROM rev), s AS (SELECT review_id, CASE WHEN rating <= 2 THEN 'low_1_2' WHEN rating = 3 THEN 'mid_3' ELSE 'high_4_5' END AS rating_group, year, {BUCKET} AS length_bucket FROM b WHERE w >= 5)"""
SAMPLED = f"""WITH {REVIEWS}, {STRATUM}, o AS (SELECT *, row_number() OVER (PARTITION BY rating_group, year, length_bucket ORDER BY md5(review_id || ':42'), review_id) AS rn, count(*) OVER (PARTITION BY rating_group, year, length_bucket) AS population FROM s),
t AS (SELECT review_id, rating_group, CAST(year AS BIGINT) AS year, length_bucket, population, population::DOUBLE / least(population, 20) AS sampling_weight FROM o WHERE rn <= 20)"""


def _strata(spark, d):
    r = views.reviews(spark, d)
    w = word_count("text")
    return r.select("review_id", profile.rating_group(F.col("rating")).alias("rating_group"), F.col("year").cast("long").alias("year"), profile.length_bucket(w).alias("length_bucket"), w.alias("w")).where("w >= 5").drop("w")


@query(SAMPLED + " SELECT * FROM t")
def stratified_sample(spark, d):
    return sampling.per_stratum(_strata(spark, d), ["rating_group", "year", "length_bucket"], "review_id", 20).drop("rn")


@query(SAMPLED + " SELECT rating_group, year, length_bucket, count(*) AS sampled, any_value(population) AS population, CAST(floor(sum(sampling_weight) + 0.5) AS BIGINT) AS weight_total FROM t GROUP BY ALL")
def stratum_weights(spark, d):
    s = stratified_sample(spark, d)
    return s.groupBy("rating_group", "year", "length_bucket").agg(F.count("*").alias("sampled"), F.max("population").alias("population"), F.floor(F.sum("sampling_weight") + 0.5).cast("long").alias("weight_total"))


@query(f"""WITH {REVIEWS}, {STRATUM}, g AS (SELECT *, rating_group || '|' || year || '|' || length_bucket AS stratum FROM s), h AS (SELECT stratum, count(*) AS n FROM g GROUP BY 1),
fl AS (SELECT *, least(n, 2) AS q FROM h), op AS (SELECT *, (200 - (SELECT sum(q) FROM fl)) * n::DOUBLE / (SELECT sum(n) FROM fl WHERE n > q) AS ideal FROM fl WHERE n > q),
wh AS (SELECT *, least(n, q + CAST(floor(ideal) AS BIGINT)) AS w FROM op), r AS (SELECT *, row_number() OVER (PARTITION BY w < n ORDER BY ideal - floor(ideal) DESC, stratum) AS place FROM wh),
quo AS (SELECT fl.stratum, fl.n, coalesce(r.w + CASE WHEN r.w < r.n AND place <= 200 - (SELECT coalesce(sum(q), 0) FROM fl WHERE n <= q) - (SELECT sum(w) FROM wh) THEN 1 ELSE 0 END, fl.q) AS quota FROM fl LEFT JOIN r ON r.stratum = fl.stratum),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(review_id || ':42'), review_id) AS rn FROM g)
SELECT o.stratum, review_id, rating_group, CAST(year AS BIGINT) AS year, length_bucket, quo.n::DOUBLE / quota AS sampling_weight FROM o JOIN quo ON quo.stratum = o.stratum WHERE rn <= quota""")
def proportional_sample(spark, d):
    s = _strata(spark, d)
    return sampling.stratified(s.withColumn("stratum", F.concat_ws("|", "rating_group", "year", "length_bucket")), "stratum", "review_id", 200, 2)


@query(SAMPLED + " SELECT s.rating_group, count(*) AS held_out FROM s WHERE review_id NOT IN (SELECT review_id FROM t) GROUP BY 1")
def holdout_anti_join(spark, d):
    return sampling.holdout(_strata(spark, d), stratified_sample(spark, d), "review_id").groupBy("rating_group").agg(F.count("*").alias("held_out"))


@query("SELECT count(*) AS sampled, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM aspect_sampling a WHERE a.review_id = s.review_id)) AS missing FROM (SELECT DISTINCT review_id FROM sentiment) s")
def exclusion_membership(spark, d):
    return sampling.membership(table(spark, d, "sentiment"), table(spark, d, "aspect_sampling"), "review_id")


@query(f"""WITH {MANIFEST}, o AS (SELECT review_id, sentiment_label, row_number() OVER (PARTITION BY sentiment_label ORDER BY md5(review_id || ':42'), review_id) AS rn, count(*) OVER (PARTITION BY sentiment_label) AS n FROM man WHERE split_name = 'test_product')
SELECT review_id, sentiment_label FROM o WHERE rn <= (SELECT min(n) FROM o)""")
def balanced_view(spark, d):
    return sampling.balanced(views.manifest(spark, d).where("split_name = 'test_product'").select("review_id", "sentiment_label"), "sentiment_label", "review_id")


@query(f"WITH {MANIFEST} SELECT CAST(('0x' || substr(md5(parent_asin), 1, 8))::BIGINT % 5 AS BIGINT) AS fold, count(*) AS n, count(DISTINCT parent_asin) AS products FROM man WHERE parent_asin IS NOT NULL GROUP BY 1")
def group_folds(spark, d):
    return views.manifest(spark, d).where("parent_asin is not null").groupBy(sampling.fold("parent_asin", 5).alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("parent_asin").alias("products"))


CUTOFF, QUOTAS, TEMPORAL = "2023-01-01", {"train": 300, "validation": 60, "test_product": 60, "test_niche": 60}, 200
SPLIT = f"""WITH {REVIEWS}, {PRODUCTS},
lab AS (SELECT review_id, rev.parent_asin, user_id, rating, ts AT TIME ZONE 'UTC' AS t, coalesce(trim(leaf_category) = 'Conditioners', false) AS is_niche, CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS sentiment_label,
  md5(lower(trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g')))) AS print, CAST(md5_number_lower(rev.parent_asin) % 100 AS INTEGER) AS bucket FROM rev LEFT JOIN prod ON prod.parent_asin = rev.parent_asin),
seen AS (SELECT DISTINCT parent_asin FROM lab WHERE t < TIMESTAMP '{CUTOFF}' AND NOT is_niche AND bucket < 80),
cand AS (SELECT *, CASE WHEN is_niche THEN 'test_niche' WHEN t < TIMESTAMP '{CUTOFF}' AND bucket < 80 THEN 'train' WHEN t < TIMESTAMP '{CUTOFF}' AND bucket < 90 THEN 'validation' WHEN t < TIMESTAMP '{CUTOFF}' THEN 'test_product'
  WHEN parent_asin IN (SELECT parent_asin FROM seen) THEN 'test_temporal' END AS split_name FROM lab),
one AS (SELECT print FROM cand WHERE split_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split_name) = 1),
uni AS (SELECT c.*, row_number() OVER (PARTITION BY split_name, c.print ORDER BY md5(review_id || ':42'), review_id) AS k FROM cand c JOIN one ON one.print = c.print WHERE split_name IS NOT NULL),
ran AS (SELECT *, row_number() OVER (PARTITION BY split_name, sentiment_label ORDER BY md5(review_id || ':' || sentiment_label || ':42'), review_id) AS rn FROM uni WHERE k = 1),
his AS (SELECT * FROM ran WHERE (split_name = 'train' AND rn <= 300) OR (split_name IN ('validation', 'test_product', 'test_niche') AND rn <= 60)),
tem AS (SELECT * FROM ran WHERE split_name = 'test_temporal' AND parent_asin IN (SELECT parent_asin FROM his WHERE split_name = 'train') ORDER BY md5(review_id || ':temporal:42'), review_id LIMIT {TEMPORAL}),
sel AS (SELECT review_id, split_name, sentiment_label, parent_asin, user_id FROM his UNION ALL SELECT review_id, split_name, sentiment_label, parent_asin, user_id FROM tem)
"""


def _split(spark, d):
    return splits.sentiment_sample(views.reviews(spark, d), views.products(spark, d), "Conditioners", CUTOFF, QUOTAS, TEMPORAL)


@query(SPLIT + "SELECT review_id, split_name, sentiment_label, parent_asin FROM sel")
def sentiment_split(spark, d):
    return _split(spark, d).select("review_id", "split_name", "sentiment_label", "parent_asin")


@query(SPLIT + """, p AS (SELECT DISTINCT parent_asin FROM sel WHERE split_name = 'train'), u AS (SELECT DISTINCT user_id FROM sel WHERE split_name = 'train')
SELECT split_name, count(*) AS records, count(DISTINCT parent_asin) AS products, count(DISTINCT user_id) AS users, count(DISTINCT parent_asin) FILTER (WHERE parent_asin IN (SELECT parent_asin FROM p)) AS train_products, count(DISTINCT user_id) FILTER (WHERE user_id IN (SELECT user_id FROM u WHERE user_id IS NOT NULL)) AS train_users FROM sel GROUP BY 1""")
def split_audit(spark, d):
    return splits.audit(_split(spark, d))


# ------------------------------------------------------------------ aspects

ALIASES = {
    "scent": ["scent", "smell", "smells", "fragrance", "aftertaste of the fragrance"],
    "packaging": ["bottle", "pump", "cap", "lid", "dispenser", "packaging", "nozzle"],
    "texture": ["texture", "consistency", "finish", "foam"],
    "price_value": ["price", "dollars", "cents per wash"],
    "hold": ["hold", "hairline", "shine"],
}
_OWNERS = ", ".join(f"('{n}', '{a}')" for n, a in sorted(aspects.alias_owner(ALIASES).items()))
_PATTERN = "\\b(?:" + "|".join(n.replace(" ", "\\s+") for n in sorted(aspects.alias_owner(ALIASES), key=lambda n: (-len(n), n))) + ")\\b"
ALIASED = f"""WITH {REVIEWS}, own(alias, aspect_id) AS (VALUES {_OWNERS}),
hit AS (SELECT review_id, regexp_replace(unnest(regexp_extract_all(lower(text), '{_PATTERN}')), '\\s+', ' ', 'g') AS alias FROM rev),
am AS (SELECT review_id, aspect_id, least(count(*), 5) AS evidence_count FROM hit JOIN own USING (alias) GROUP BY 1, 2)"""


@query(ALIASED + " SELECT * FROM am")
def alias_mentions(spark, d):
    return aspects.alias_mentions(views.reviews(spark, d), ALIASES).withColumn("evidence_count", F.col("evidence_count").cast("long"))


@query(ALIASED + ", m AS (SELECT count(DISTINCT review_id) AS matched, count(*) AS mentions, CAST(sum(evidence_count) AS BIGINT) AS spans FROM am) SELECT reviews, matched, mentions, spans, reviews - matched AS unmatched FROM m, (SELECT count(*) AS reviews FROM rev)")
def alias_coverage(spark, d):
    return aspects.extraction_coverage(views.reviews(spark, d), aspects.alias_mentions(views.reviews(spark, d), ALIASES))


@query()
def alias_evidence(spark, d):
    return aspects.alias_evidence(views.reviews(spark, d), ALIASES)


def _shares(*kinds):
    return ", ".join(f"{k}::DOUBLE / nullif(mentions, 0) AS {k}_share" for k in kinds)


SHARES = _shares("needs_attention", "satisfied", "negative", "positive")


@query(f"WITH {MENTIONS}, s AS (SELECT aspect_id, {COUNTERS}, count(DISTINCT review_id) AS reviews, count(DISTINCT parent_asin) AS products FROM men GROUP BY 1) SELECT *, {SHARES} FROM s")
def aspect_statistics(spark, d):
    return aspects.statistics(views.mentions(spark, d))


@query(f"""WITH {MENTIONS}, o AS (SELECT aspect_id, sentiment, row_number() OVER (PARTITION BY aspect_id, sentiment ORDER BY score DESC, helpful DESC, review_id) AS place, review_id FROM men WHERE score IS NOT NULL AND NOT isnan(score)) SELECT * FROM o WHERE place <= 3""")
def aspect_top_examples(spark, d):
    return aspects.top_examples(views.mentions(spark, d))


MART = f"""{REVIEWS}, {PRODUCTS}, {MENTIONS},
tot AS (SELECT parent_asin, count(*) AS product_reviews, CAST(sum(rating) AS BIGINT) AS product_rating_sum FROM rev GROUP BY 1),
mar0 AS (SELECT parent_asin, aspect_id, {COUNTERS}, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms FROM men GROUP BY 1, 2),
mart AS (SELECT m.*, t.product_reviews, t.product_rating_sum, trim(p.leaf_category) AS niche, {SHARES}, mentions::DOUBLE / product_reviews AS review_share,
  dense_rank() OVER (PARTITION BY m.parent_asin ORDER BY mentions DESC) AS frequency_rank, dense_rank() OVER (PARTITION BY m.parent_asin ORDER BY negative DESC) AS complaint_rank, dense_rank() OVER (PARTITION BY m.parent_asin ORDER BY positive DESC) AS strength_rank
  FROM mar0 m LEFT JOIN tot t ON t.parent_asin = m.parent_asin LEFT JOIN prod p ON p.parent_asin = m.parent_asin)"""


def _mart(spark, d):
    return aspects.product_mart(views.mentions(spark, d), views.reviews(spark, d), views.products(spark, d))


@query(f"WITH {MART} SELECT * FROM mart")
def product_aspect_mart(spark, d):
    return _mart(spark, d)


@query(f"""WITH {MENTIONS}, o AS (SELECT parent_asin, aspect_id, sentiment, review_id, evidence, row_number() OVER (PARTITION BY parent_asin, aspect_id, sentiment ORDER BY score DESC, helpful DESC, review_id) AS k FROM men WHERE score IS NOT NULL AND NOT isnan(score) AND sentiment IN ('negative', 'positive')) SELECT * EXCLUDE (k) FROM o WHERE k = 1""")
def top_evidence(spark, d):
    return aspects.top_evidence(views.mentions(spark, d))


MONTH = f"""WITH {REVIEWS}, {MENTIONS}, c AS (SELECT month, aspect_id, {COUNTERS}, count(DISTINCT parent_asin) AS products FROM men GROUP BY 1, 2),
g AS (SELECT month, aspect_id, month_reviews, month_products FROM (SELECT month, count(*) AS month_reviews, count(DISTINCT parent_asin) AS month_products FROM rev GROUP BY 1), (SELECT DISTINCT aspect_id FROM men)),
f AS (SELECT g.*, coalesce(mentions, 0) AS mentions, rating_sum, coalesce(needs_attention, 0) AS needs_attention, coalesce(satisfied, 0) AS satisfied, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral, coalesce(positive, 0) AS positive, coalesce(alias_evidence, 0) AS alias_evidence, coalesce(products, 0) AS products
  FROM g LEFT JOIN c USING (month, aspect_id))
SELECT f.*, {SHARES}, mentions::DOUBLE / month_reviews AS review_share, lag(mentions) OVER w AS previous_mentions, mentions - lag(mentions) OVER w AS mentions_change, mentions::DOUBLE / month_reviews - lag(mentions::DOUBLE / month_reviews) OVER w AS share_change FROM f WINDOW w AS (PARTITION BY aspect_id ORDER BY month)"""


@query(MONTH)
def month_aspect_mart(spark, d):
    return aspects.month_mart(views.mentions(spark, d), views.reviews(spark, d))


RANKED = f"""WITH {MART}, pol AS (SELECT *, sum(positive) OVER g::DOUBLE / sum(mentions) OVER g AS pp, sum(negative) OVER g::DOUBLE / sum(mentions) OVER g AS np FROM mart WHERE product_reviews >= 10 AND mentions >= 3 AND niche IS NOT NULL WINDOW g AS (PARTITION BY niche, aspect_id)),
sm AS (SELECT * EXCLUDE (pp, np), (positive + 10.0::DOUBLE * pp) / (mentions + 10) AS positive_smoothed, (negative + 10.0::DOUBLE * np) / (mentions + 10) AS negative_smoothed FROM pol),
ranked AS (SELECT *, CASE WHEN positive >= 2 THEN rank() OVER (PARTITION BY niche, aspect_id, positive >= 2 ORDER BY positive_smoothed DESC) END AS positive_rank,
  CASE WHEN negative >= 2 THEN rank() OVER (PARTITION BY niche, aspect_id, negative >= 2 ORDER BY negative_smoothed DESC) END AS negative_rank,
  CASE WHEN positive >= 2 THEN rank() OVER (PARTITION BY niche, aspect_id, positive >= 2 ORDER BY positive DESC) END AS positive_frequency_rank, CASE WHEN negative >= 2 THEN rank() OVER (PARTITION BY niche, aspect_id, negative >= 2 ORDER BY negative DESC) END AS negative_frequency_rank,
  CASE WHEN positive >= 2 THEN rank() OVER (PARTITION BY parent_asin, positive >= 2 ORDER BY positive DESC) END AS positive_reason_rank, CASE WHEN negative >= 2 THEN rank() OVER (PARTITION BY parent_asin, negative >= 2 ORDER BY negative DESC) END AS negative_reason_rank, product_rating_sum::DOUBLE / product_reviews >= 4.0 AND negative >= 3 AS recurring_complaint FROM sm)"""


@query(RANKED + " SELECT parent_asin, niche, aspect_id, mentions, positive, negative, positive_smoothed, negative_smoothed, positive_rank, negative_rank, positive_frequency_rank, negative_frequency_rank, positive_reason_rank, negative_reason_rank, recurring_complaint FROM ranked")
def niche_rankings(spark, d):
    return aspects.rankings(_mart(spark, d)).select("parent_asin", "niche", "aspect_id", "mentions", "positive", "negative", "positive_smoothed", "negative_smoothed", "positive_rank", "negative_rank", "positive_frequency_rank", "negative_frequency_rank", "positive_reason_rank", "negative_reason_rank", "recurring_complaint")


@query(RANKED + ", o AS (SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY negative DESC, aspect_id) AS k FROM ranked WHERE recurring_complaint) SELECT parent_asin, niche, aspect_id, negative, mentions FROM o WHERE k = 1")
def recurring_complaints(spark, d):
    return aspects.recurring_complaints(aspects.rankings(_mart(spark, d)))


@query(RANKED + ", o AS (SELECT niche, aspect_id, row_number() OVER (PARTITION BY niche, aspect_id ORDER BY positive_rank, mentions DESC, parent_asin) AS place, parent_asin, positive_rank FROM ranked WHERE positive_rank IS NOT NULL) SELECT * FROM o WHERE place <= 3")
def aspect_leaders(spark, d):
    return aspects.leaders(aspects.rankings(_mart(spark, d)))


# ------------------------------------------------------------------ comparison

OWN = "(SELECT parent_asin FROM tot ORDER BY product_reviews DESC, parent_asin LIMIT 1)"
GROUP = "(SELECT parent_asin FROM tot ORDER BY product_reviews DESC, parent_asin LIMIT 5)"


def _workspace(spark, d):
    """The most reviewed product and the four after it (a workspace is five ids, chosen by an aggregate)."""
    r = views.reviews(spark, d).groupBy("parent_asin").agg(F.count("*").alias("n"))
    ids = [x["parent_asin"] for x in r.orderBy(F.col("n").desc(), "parent_asin").limit(5).collect()]
    return ids[0], ids[1:]


_SIDE = lambda side, cond: ", ".join(f"CAST(coalesce(sum({k}) FILTER (WHERE {cond}), 0) AS BIGINT) AS {side}_{k}" for k in compare.COUNTED) + f", count(DISTINCT parent_asin) FILTER (WHERE {cond}) AS {side}_products"
_GAP = lambda k, total: f"100 * (own_{k}::DOUBLE / nullif(own_{total}, 0) - other_{k}::DOUBLE / nullif(other_{total}, 0))"
COMPARED = f"""WITH {MART}, w AS (SELECT *, parent_asin = {OWN} AS is_own FROM mart WHERE parent_asin IN {GROUP}), s AS (SELECT aspect_id, {_SIDE('own', 'is_own')}, {_SIDE('other', 'NOT is_own')} FROM w GROUP BY 1),
t AS (SELECT count(*) FILTER (WHERE parent_asin = {OWN}) AS own_reviews, count(*) FILTER (WHERE parent_asin <> {OWN}) AS other_reviews FROM rev WHERE parent_asin IN {GROUP}),
g AS (SELECT s.*, t.*, {_GAP('mentions', 'reviews')} AS discussion_gap_pp, {_GAP('needs_attention', 'mentions')} AS attention_gap_pp, {_GAP('positive', 'mentions')} AS positive_gap_pp FROM s, t),
cmp AS (SELECT *, positive_gap_pp - attention_gap_pp AS advantage_pp, own_mentions >= 20 AND other_mentions >= 20 AS support_sufficient FROM g)"""


def _compared(spark, d):
    own, others = _workspace(spark, d)
    return compare.comparison(_mart(spark, d), views.reviews(spark, d), own, others)


@query(COMPARED + " SELECT * FROM cmp")
def seller_comparison(spark, d):
    return _compared(spark, d)


@query(COMPARED + " SELECT aspect_id, attention_gap_pp FROM cmp WHERE support_sufficient AND attention_gap_pp >= 1 ORDER BY attention_gap_pp DESC, aspect_id LIMIT 10")
def seller_weaknesses(spark, d):
    return compare.weaknesses(_compared(spark, d), 1.0).select("aspect_id", "attention_gap_pp")


@query(COMPARED + " SELECT aspect_id, advantage_pp FROM cmp WHERE support_sufficient AND own_positive::DOUBLE / own_mentions >= 0.3 AND attention_gap_pp <= -1 ORDER BY advantage_pp DESC, aspect_id LIMIT 10")
def seller_strengths(spark, d):
    return compare.strengths(_compared(spark, d), 1.0, 0.3).select("aspect_id", "advantage_pp")


@query(f"WITH {REVIEWS} SELECT parent_asin, count(*) AS reviews, CAST(sum(rating) AS BIGINT) AS rating_sum, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms, count(DISTINCT month) AS active_months, CAST(sum(helpful) AS BIGINT) AS helpful FROM rev GROUP BY 1")
def product_overview(spark, d):
    return compare.overview(views.reviews(spark, d))


@query(f"WITH {MART} SELECT aspect_id, month, count(*) AS mentions, count(*) FILTER (WHERE rating <= 3) AS needs_attention, count(*) FILTER (WHERE sentiment = 'positive') AS positive FROM men WHERE parent_asin = {OWN} GROUP BY 1, 2")
def aspect_trend(spark, d):
    return compare.aspect_trend(views.mentions(spark, d), _workspace(spark, d)[0])


@query(f"""WITH {PRODUCTS}, h AS (SELECT *, lower(concat_ws(' ', product_title, store, product_search_text)) AS body, coalesce(contains(lower(product_title), 'hair oil'), false) AS hit FROM prod)
SELECT parent_asin, product_title, review_count FROM h WHERE lower(parent_asin) = 'hair oil' OR (contains(body, 'hair') AND contains(body, 'oil')) ORDER BY hit DESC, review_count DESC NULLS LAST, parent_asin LIMIT 20""")
def product_search(spark, d):
    return compare.product_search(views.products(spark, d), "Hair oil")


_AGAIN, _NEVER = (x.replace("'", "''") for x in (compare.AGAIN, compare.NEVER))


@query(f"""WITH {REVIEWS}, f AS (SELECT review_id, parent_asin, regexp_matches(lower(text), '{_AGAIN}') AND NOT regexp_matches(lower(text), '{_NEVER}') AS again, regexp_matches(lower(text), '{_NEVER}') AS never FROM rev)
SELECT parent_asin, count(*) AS reviews, count(DISTINCT review_id) FILTER (WHERE again) AS again, count(DISTINCT review_id) FILTER (WHERE never) AS never, count(DISTINCT review_id) FILTER (WHERE again)::DOUBLE / count(*) AS again_share, count(DISTINCT review_id) FILTER (WHERE again) >= 3 AS supported FROM f GROUP BY 1""")
def repurchase_signal(spark, d):
    return compare.repurchase(views.reviews(spark, d))


#: Phrases of a title by what the product is for; a parameter of the ranking.
CONCEPTS = {"mask": ["hair mask", "hair butter"], "oil": ["hair oil", "oil"], "rinse": ["purple rinse", "rinse"], "shine": ["shine mist", "mist", "shine"], "styling": ["styling mousse", "mousse"], "wash": ["co wash", "shampoo", "conditioner"]}
_HAS = lambda t: ", ".join(f"CASE WHEN {' OR '.join(f"contains(' ' || {t} || ' ', ' {p} ')" for p in v)} THEN '{k}' END" for k, v in sorted(CONCEPTS.items()))
_NORMAL = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


# ------------------------------------------------------------------ search

_STOP = ", ".join(f"'{w}'" for w in search.STOP)
GRAMS = lambda source, key, text, extra="": f"""w AS (SELECT {key} AS id{extra}, list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM {source}),
gr AS (SELECT id{extra}, unnest(w) AS term FROM w UNION ALL SELECT id{extra}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2)"""  # noqa: E731


TFIDF = """tf AS (SELECT id, term, count(*) AS tf FROM gr GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM tf),
v AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS v FROM tf JOIN df USING (term), n), nor AS (SELECT id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1), x AS (SELECT id, term, v / norm AS weight FROM v JOIN nor USING (id))"""


@query(f"""WITH {REVIEWS}, {PRODUCTS}, own AS (SELECT parent_asin FROM rev GROUP BY 1 ORDER BY count(*) DESC, parent_asin LIMIT 1),
t AS (SELECT parent_asin, category_path_id, store, product_title, price_at_collection AS price, coalesce(review_count, 0) AS review_count, {_NORMAL('product_title')} AS title, {_NORMAL('store')} AS brand FROM prod),
me AS (SELECT category_path_id AS cat, brand AS brand0, price AS price0, list_filter([{_HAS('title')}], lambda x: x IS NOT NULL) AS concepts0 FROM t WHERE parent_asin IN (SELECT parent_asin FROM own)),
pool AS (SELECT *, parent_asin IN (SELECT parent_asin FROM own) AS is_own FROM t, me WHERE category_path_id = cat AND (parent_asin IN (SELECT parent_asin FROM own) OR review_count >= 1
  AND NOT ((brand = brand0 AND brand <> '') OR (least(length(brand), length(brand0)) >= 4 AND CASE WHEN length(brand) <= length(brand0) THEN starts_with(brand0, brand || ' ') ELSE starts_with(brand, brand0 || ' ') END)))),
{GRAMS('pool', 'parent_asin', 'title')}, {TFIDF},
txt AS (SELECT id, sum(weight * q) AS text_similarity FROM x JOIN (SELECT term, weight AS q FROM x WHERE id IN (SELECT parent_asin FROM own)) USING (term) GROUP BY 1),
sc0 AS (SELECT pool.*, coalesce(text_similarity, 0) AS text_similarity, list_filter([{_HAS('title')}], lambda x: x IS NOT NULL AND list_contains(concepts0, x)) AS matched_concepts, ln(1 + review_count) / (SELECT max(ln(1 + review_count)) FROM pool WHERE NOT is_own) AS support,
  CASE WHEN price0 IS NULL OR price IS NULL OR isnan(price0) OR isnan(price) THEN 0.5 ELSE greatest(0, 1 - abs(ln(greatest(price, 0.01) / greatest(price0, 0.01))) / ln(4)) END AS price_similarity FROM pool LEFT JOIN txt ON id = parent_asin WHERE NOT is_own),
sc AS (SELECT *, len(matched_concepts)::DOUBLE / greatest(1, len(concepts0)) AS concept_similarity FROM sc0), s2 AS (SELECT *, 0.45::DOUBLE * text_similarity + 0.30::DOUBLE * concept_similarity + 0.10::DOUBLE * price_similarity + 0.15::DOUBLE * support AS score FROM sc),
ra AS (SELECT *, row_number() OVER (ORDER BY score DESC, review_count DESC, parent_asin) AS rank FROM s2), fi AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN brand = '' THEN '=' || parent_asin ELSE brand END ORDER BY rank) = 1 AS first FROM ra),
ch AS (SELECT *, row_number() OVER (ORDER BY first DESC, rank) <= 4 AS selected FROM fi)
SELECT rank, selected, parent_asin, array_to_string(matched_concepts, ',') AS concepts, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_micro, CAST(floor(text_similarity * 1000000 + 0.5) AS BIGINT) AS text_micro, CAST(floor(price_similarity * 1000000 + 0.5) AS BIGINT) AS price_micro FROM ch""")
def competitor_ranking(spark, d):
    own = _workspace(spark, d)[0]
    found = compare.competitors(views.products(spark, d), own, CONCEPTS)
    micro = lambda c, n: F.floor(F.col(c) * 1000000 + 0.5).cast("long").alias(n)
    return found.select("rank", "selected", "parent_asin", F.array_join("matched_concepts", ",").alias("concepts"), micro("score", "score_micro"), micro("text_similarity", "text_micro"), micro("price_similarity", "price_micro"))


@query(f"""WITH {PRODUCTS}, {GRAMS('prod', 'parent_asin', 'product_search_text')}, tf AS (SELECT id, term, count(*) AS tf FROM gr GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM tf),
v AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS v FROM tf JOIN df USING (term), n), nor AS (SELECT id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1), x AS (SELECT id, term, v / norm AS weight FROM v JOIN nor USING (id)),
q AS (SELECT term, weight AS q FROM x WHERE id = (SELECT min(parent_asin) FROM prod)), s AS (SELECT id, sum(weight * q) AS score FROM x JOIN q USING (term) WHERE id <> (SELECT min(parent_asin) FROM prod) GROUP BY 1)
SELECT id AS parent_asin, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_micro FROM s""")
def tfidf_similarity(spark, d):
    p = views.products(spark, d)
    first = p.agg(F.min("parent_asin").alias("m")).first()["m"]
    s = search.cosine_to(search.tfidf_vectors(search.grams(p, "parent_asin", "product_search_text")), F.col("id") == F.lit(first))
    return s.select(F.col("id").alias("parent_asin"), F.floor(F.col("score") * 1000000 + 0.5).cast("long").alias("score_micro"))


@query(f"""WITH {PRODUCTS}, {GRAMS('prod', 'parent_asin', 'product_search_text')}, tf AS (SELECT id, term, count(*) AS tf FROM gr GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM tf),
v AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS v FROM tf JOIN df USING (term), n), nor AS (SELECT id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1), x AS (SELECT id, term, v / norm AS weight FROM v JOIN nor USING (id)),
q AS (SELECT id AS query_id, term, weight AS q FROM x WHERE md5_number_lower(id) % 100 = 0), s AS (SELECT query_id, id, sum(weight * q) AS score FROM x JOIN q USING (term) WHERE id <> query_id GROUP BY 1, 2)
SELECT query_id, id AS parent_asin, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_micro FROM s""")
def tfidf_similarity_set(spark, d):
    """The cosines of tfidf_similarity for every product whose hash is divisible by 100."""
    p = views.products(spark, d)
    s = search.cosines_of(search.tfidf_vectors(search.grams(p, "parent_asin", "product_search_text")), bucket100("id") == 0)
    return s.select("query_id", F.col("id").alias("parent_asin"), F.floor(F.col("score") * 1000000 + 0.5).cast("long").alias("score_micro"))


_FOREIGN = "[\\w]*[\\x{C0}-\\x{24F}\\x{370}-\\x{1FFF}\\x{3040}-\\x{9FFF}\\x{AC00}-\\x{D7A3}][\\w\\x{C0}-\\x{24F}\\x{370}-\\x{1FFF}\\x{3040}-\\x{9FFF}\\x{AC00}-\\x{D7A3}]*"


@query(f"""WITH {REVIEWS}, {PRODUCTS}, src AS (SELECT rev.review_id, trim(leaf_category) AS leaf, text FROM rev JOIN prod ON prod.parent_asin = rev.parent_asin WHERE leaf_category IS NOT NULL),
w AS (SELECT review_id, leaf, list_filter(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '{_FOREIGN}', '_', 'g'), '\\b[a-z][a-z'']+\\b'), lambda x: x NOT IN ({_STOP})) AS w FROM src),
gr AS (SELECT review_id, leaf, unnest(w) AS term FROM w UNION SELECT review_id, leaf, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2 UNION SELECT review_id, leaf, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) >= 3),
df AS (SELECT leaf, term, count(*) AS df FROM gr GROUP BY 1, 2), t AS (SELECT leaf, count(*) AS docs FROM src GROUP BY 1),
o AS (SELECT leaf, row_number() OVER (PARTITION BY leaf ORDER BY df DESC, term) AS place, term, df, df::DOUBLE / docs AS share FROM df JOIN t USING (leaf) WHERE df <= 0.95::DOUBLE * docs AND df >= greatest(5, CAST(floor(docs * 0.0005) AS BIGINT))) SELECT * FROM o WHERE place <= 150""")
def segment_vocabulary(spark, d):
    r = views.reviews(spark, d).join(views.products(spark, d).select("parent_asin", F.trim("leaf_category").alias("leaf")), "parent_asin")
    return search.vocabulary(r, "leaf", "text")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS q FROM v ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS score FROM v, q) SELECT vec_id, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_micro FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).first()["embedding"]
    return search.vector_topk(e, q).select("vec_id", F.floor(F.col("score") * 1000000 + 0.5).cast("long").alias("score_micro"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS q FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS score FROM v, q),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, place, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score_micro FROM o WHERE place <= 10""")
def vector_topk_set(spark, d):
    """The search of vector_topk with every hundredth vector as a query."""
    e = table(spark, d, "embeddings")
    return search.vectors_topk(e, e.where("vec_id % 100 = 0")).select("query_id", "vec_id", "place", F.floor(F.col("score") * 1000000 + 0.5).cast("long").alias("score_micro"))


EVIDENCE = f"""WITH {REVIEWS}, {MENTIONS}, own AS (SELECT m.review_id, m.parent_asin, probability, m.helpful, md5(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key, text FROM men m JOIN rev ON rev.review_id = m.review_id WHERE aspect_id = 'scent' AND m.rating <= 2 AND probability IS NOT NULL AND NOT isnan(probability)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY probability DESC, helpful DESC, review_id) AS a FROM own) WHERE a = 1),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY probability DESC, helpful DESC, review_id) AS b FROM one) WHERE b <= 2)"""


@query(EVIDENCE + " SELECT review_id, parent_asin, CAST(helpful AS BIGINT) AS helpful FROM few ORDER BY probability DESC, few.helpful DESC, review_id LIMIT 10")
def evidence_diverse_topk(spark, d):
    return search.evidence(views.mentions(spark, d), views.reviews(spark, d), "scent", True).withColumn("helpful", F.col("helpful").cast("long"))


@query()
def evidence_retrieval(spark, d):
    """ML13: what reviews say against the scent, ranked by a query over all of them, with product title and store."""
    found = search.retrieve(views.mentions(spark, d), views.reviews(spark, d), "the scent is too strong and smells bad", "scent", "negative", k=10)
    return found.join(views.products(spark, d).select("parent_asin", "product_title", "store"), "parent_asin", "left")


@query(f"""WITH {REVIEWS}, t AS (SELECT review_id, text, helpful FROM rev ORDER BY helpful DESC, review_id LIMIT 8), u AS (SELECT review_id, row_number() OVER w AS place, CAST(sum(length(text)) OVER w AS BIGINT) AS upto FROM t WINDOW w AS (ORDER BY helpful DESC, review_id))
SELECT review_id, place, upto, '[R' || place || ']' AS citation FROM u WHERE upto <= 2000""")
def context_budget(spark, d):
    return search.context_budget(views.reviews(spark, d).select("review_id", "text", "helpful"), [F.col("helpful").desc(), F.col("review_id")], "text", 2000).select("review_id", "place", "upto", "citation")


# ------------------------------------------------------------------ evaluation

PAIRS = f"""{REVIEWS}, {MENTIONS}, own(alias, aspect_id) AS (VALUES {_OWNERS}), hit AS (SELECT review_id, regexp_replace(unnest(regexp_extract_all(lower(text), '{_PATTERN}')), '\\s+', ' ', 'g') AS alias FROM rev),
p AS (SELECT DISTINCT review_id, aspect_id FROM hit JOIN own USING (alias)), t AS (SELECT DISTINCT m.review_id, aspect_id FROM men m WHERE aspect_id IN (SELECT aspect_id FROM own)), b AS (SELECT review_id, aspect_id, p.aspect_id IS NOT NULL AS p, t.aspect_id IS NOT NULL AS t FROM p FULL JOIN t USING (review_id, aspect_id))"""
PAIRS = PAIRS.replace("SELECT review_id, aspect_id, p.aspect_id IS NOT NULL AS p, t.aspect_id IS NOT NULL AS t FROM p FULL JOIN t USING (review_id, aspect_id)", "SELECT coalesce(p.review_id, t.review_id) AS review_id, coalesce(p.aspect_id, t.aspect_id) AS aspect_id, p.review_id IS NOT NULL AS p, t.review_id IS NOT NULL AS t FROM p FULL JOIN t ON p.review_id = t.review_id AND p.aspect_id = t.aspect_id")
SCORES = "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"


def _pairs(spark, d):
    found = aspects.alias_mentions(views.reviews(spark, d), ALIASES)
    return found, views.mentions(spark, d).where(F.col("aspect_id").isin(list(ALIASES)))


@query(f"WITH {PAIRS}, s AS (SELECT aspect_id, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM b GROUP BY 1) SELECT *, {SCORES} FROM s")
def pair_scores(spark, d):
    s = evaluation.pair_scores(*_pairs(spark, d), ["review_id", "aspect_id"], ["aspect_id"])
    return s.withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "fn")})


@query(f"WITH {PAIRS}, w AS (SELECT b.*, coalesce(1 + helpful, 1) AS weight FROM b LEFT JOIN (SELECT review_id, max(helpful) AS helpful FROM rev GROUP BY 1) r ON r.review_id = b.review_id), s AS (SELECT CAST(coalesce(sum(weight) FILTER (WHERE p AND t), 0) AS BIGINT) AS tp, CAST(coalesce(sum(weight) FILTER (WHERE p AND NOT t), 0) AS BIGINT) AS fp, CAST(coalesce(sum(weight) FILTER (WHERE t AND NOT p), 0) AS BIGINT) AS fn FROM w) SELECT *, {SCORES} FROM s")
def pair_scores_weighted(spark, d):
    weight = views.reviews(spark, d).groupBy("review_id").agg((1 + F.max("helpful")).alias("weight"))
    s = evaluation.pair_scores(*_pairs(spark, d), ["review_id", "aspect_id"], weight=weight)
    return s.withColumns({c: F.col(c).cast("long") for c in ("tp", "fp", "fn")})


@query(f"WITH {PAIRS}, s AS (SELECT aspect_id, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM b GROUP BY 1), f AS (SELECT aspect_id, tp + fn AS support, {SCORES} FROM s) SELECT aspect_id, support, f1, CASE WHEN support >= 20 AND f1 >= 0.7 THEN 'strong' WHEN support >= 10 AND f1 >= 0.55 THEN 'usable' WHEN support >= 5 AND f1 >= 0.35 THEN 'directional' ELSE 'experimental' END AS reliability_tier FROM f")
def reliability_tiers(spark, d):
    s = pair_scores(spark, d).withColumn("support", F.col("tp") + F.col("fn"))
    return aspects.reliability(s).select("aspect_id", "support", "f1", "reliability_tier")


@query(f"WITH {PREDICTIONS} SELECT sentiment_label, predicted_label, count(*) AS n FROM pred GROUP BY 1, 2")
def sentiment_confusion(spark, d):
    return evaluation.confusion(views.predictions(spark, d), "sentiment_label", "predicted_label")


METRICS = f"""WITH {PREDICTIONS}, c AS (SELECT DISTINCT sentiment_label AS class FROM pred UNION SELECT DISTINCT predicted_label FROM pred),
s AS (SELECT class, count(*) FILTER (WHERE sentiment_label = class AND predicted_label = class) AS tp, count(*) FILTER (WHERE sentiment_label <> class AND predicted_label = class) AS fp, count(*) FILTER (WHERE sentiment_label = class AND predicted_label <> class) AS fn, count(*) FILTER (WHERE sentiment_label = class) AS support FROM pred, c GROUP BY 1)"""


@query(METRICS + f" SELECT *, {SCORES} FROM s")
def class_metrics(spark, d):
    return evaluation.class_metrics(views.predictions(spark, d), "sentiment_label", "predicted_label")


@query(f"WITH {PREDICTIONS} SELECT greatest(1, CAST(ceil(model_score * 10) AS BIGINT)) AS bin, count(*) AS rows, count(*) FILTER (WHERE sentiment_label = predicted_label) AS hits, CAST(sum(floor(model_score * 1000000 + 0.5)) AS BIGINT) AS score_micro FROM pred WHERE model_score IS NOT NULL AND NOT isnan(model_score) AND model_score BETWEEN 0 AND 1 GROUP BY 1")
def calibration_bins(spark, d):
    return evaluation.calibration_bins(views.predictions(spark, d), "model_score", "sentiment_label", "predicted_label")


@query(f"WITH {PREDICTIONS} SELECT CASE WHEN token_count <= 16 THEN '0–16' WHEN token_count <= 32 THEN '17–32' WHEN token_count <= 64 THEN '33–64' WHEN token_count <= 128 THEN '65–128' WHEN token_count <= 255 THEN '129–255' WHEN token_count > 255 THEN '256+' END AS tokens, count(*) AS rows, count(*) FILTER (WHERE sentiment_label <> predicted_label) AS errors, count(*) FILTER (WHERE sentiment_label <> predicted_label)::DOUBLE / count(*) AS error_rate FROM pred GROUP BY 1")
def error_rates(spark, d):
    return evaluation.error_rates(views.predictions(spark, d), evaluation.token_bin(F.col("token_count")), "tokens", "sentiment_label", "predicted_label")


@query(f"""WITH {PREDICTIONS}, m AS (SELECT sentiment_label AS l, predicted_label AS a, CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS b FROM pred)
SELECT CASE WHEN a = l AND b = l THEN 'both_right' WHEN a = l THEN 'only_first_right' WHEN b = l THEN 'only_second_right' ELSE 'both_wrong' END AS outcome, count(*) AS n FROM m GROUP BY 1""")
def model_comparison(spark, d):
    p = views.predictions(spark, d)
    other = p.select("review_id", profile.sentiment_label(F.col("rating")).alias("predicted_label"))
    return evaluation.model_comparison(p, other, "review_id", "sentiment_label", "predicted_label")


_PATTERNS = {k: getattr(evaluation, k).replace("'", "''") for k in ("POSITIVE", "NEGATIVE", "NEGATED", "CONTRAST", "DELIVERY", "SHOUT")}
_ON = lambda k, t="lower(raw)": f"regexp_matches({t}, '{_PATTERNS[k]}')"
CLUED = f"""WITH {PREDICTIONS}, f0 AS (SELECT *, coalesce(review_text, '') AS raw FROM pred), f1 AS (SELECT *, {_ON('POSITIVE')} AND NOT {_ON('NEGATED')} AS good, {_ON('NEGATIVE')} AS bad FROM f0),
f2 AS (SELECT *, coalesce(rating <= 2 AND good AND NOT bad, false) AS low, coalesce(rating >= 4 AND bad AND NOT good, false) AS high FROM f1),
f3 AS (SELECT sentiment_label <> predicted_label AS wrong, unnest([CASE WHEN good THEN 'has_positive' END, CASE WHEN bad THEN 'has_negative' END, CASE WHEN (good AND bad) OR {_ON('CONTRAST')} THEN 'mixed_opinion' END, CASE WHEN {_ON('DELIVERY')} THEN 'delivery' END,
  CASE WHEN low THEN 'positive_text_low_rating' END, CASE WHEN high THEN 'negative_text_high_rating' END, CASE WHEN NOT (good OR bad) THEN 'no_clear_sentiment' END, CASE WHEN token_count <= 8 THEN 'very_short' END, CASE WHEN length(raw) - length(replace(raw, '!', '')) >= 2 OR {_ON('SHOUT', 'raw')} THEN 'strong_emotion' END, CASE WHEN low OR high THEN 'text_against_rating' END]) AS clue FROM f2)"""


@query(CLUED + " SELECT clue, count(*) AS rows, count(*) FILTER (WHERE wrong) AS errors FROM f3 WHERE clue IS NOT NULL GROUP BY 1")
def error_clues(spark, d):
    return evaluation.clue_errors(views.predictions(spark, d), "sentiment_label", "predicted_label")


@query()
def bootstrap_intervals(spark, d):
    return evaluation.bootstrap(views.predictions(spark, d), "parent_asin", "sentiment_label", "predicted_label")


# ------------------------------------------------------------------ observations, taxonomy, models


def _observations(spark, d):
    """Aspect mentions as labelled observations: the label is the aspect in the spelling of the row."""
    m = table(spark, d, "aspect_marts").where("review_id is not null")
    return m.select("review_id", F.upper(F.trim("parent_asin")).alias("parent_asin"), F.trim("aspect_id").alias("label"), F.lower(F.trim("aspect_sentiment")).alias("topic_type"), F.lit(1).alias("weight"), (F.year("review_timestamp") * 12 + F.month("review_timestamp")).cast("long").alias("batch"))


OBSERVED = """WITH o AS (SELECT review_id, upper(trim(parent_asin)) AS parent_asin, trim(aspect_id) AS label, nullif(trim(regexp_replace(lower(trim(aspect_id)), '[^a-z0-9]+', ' ', 'g')), '') AS candidate_key,
year(review_timestamp AT TIME ZONE 'UTC') * 12 + month(review_timestamp AT TIME ZONE 'UTC') AS batch FROM aspect_marts WHERE review_id IS NOT NULL)"""


@query(OBSERVED + """, one AS (SELECT candidate_key, review_id, min(parent_asin) AS parent_asin, count(*) AS mentions FROM o WHERE candidate_key IS NOT NULL GROUP BY 1, 2),
s AS (SELECT candidate_key, CAST(sum(mentions) AS BIGINT) AS mentions, count(*) AS reviews, count(DISTINCT parent_asin) AS products FROM one GROUP BY 1),
l AS (SELECT candidate_key, label, row_number() OVER (PARTITION BY candidate_key ORDER BY count(*) DESC, label) AS k FROM o WHERE candidate_key IS NOT NULL GROUP BY 1, 2)
SELECT s.*, label AS canonical_label, row_number() OVER (ORDER BY reviews DESC, s.candidate_key) AS support_rank, reviews >= 2 AND products >= 2 AS eligible FROM s JOIN l ON l.candidate_key = s.candidate_key AND k = 1""")
def candidate_support(spark, d):
    return taxonomy.candidates(_observations(spark, d)).select("candidate_key", "mentions", "reviews", "products", "canonical_label", "support_rank", "eligible")


@query(OBSERVED + """, f AS (SELECT candidate_key, min(batch) AS first FROM o WHERE candidate_key IS NOT NULL GROUP BY 1), n AS (SELECT first // 3 + 1 AS checkpoint, count(*) AS new_candidates FROM f GROUP BY 1),
p AS (SELECT unnest(range((SELECT min(batch) FROM o) // 3 + 1, (SELECT max(batch) FROM o) // 3 + 2)) AS checkpoint)
SELECT p.checkpoint, coalesce(new_candidates, 0) AS new_candidates, CAST(sum(coalesce(new_candidates, 0)) OVER (ORDER BY p.checkpoint) AS BIGINT) AS candidates, coalesce(new_candidates, 0) <= 5 AS low_growth FROM p LEFT JOIN n ON n.checkpoint = p.checkpoint""")
def saturation(spark, d):
    return taxonomy.saturation(_observations(spark, d), "batch", 3)


@query(f"""WITH {MANIFEST}, s AS (SELECT review_id, sentiment_label, row_number() OVER (PARTITION BY sentiment_label ORDER BY md5(review_id || ':42'), review_id) AS r FROM man WHERE split_name = 'validation')
SELECT review_id, (row_number() OVER (ORDER BY r, sentiment_label, review_id) - 1) // 10 AS batch FROM s""")
def request_batches(spark, d):
    rows = views.manifest(spark, d).where("split_name = 'validation'").select("review_id", "sentiment_label")
    return taxonomy.batches(rows, "sentiment_label", 10).select("review_id", "batch")


@query()
def sentiment_model(spark, d):
    """Train on the training reviews, score the others: class metrics by split."""
    p = views.predictions(spark, d).select("review_id", "review_text", "sentiment_label").join(views.manifest(spark, d).select("review_id", "split_name"), "review_id")
    model = models.train(p.where("split_name = 'train'"), "review_text", "sentiment_label", least_df=2)
    scored = models.predict(model, p.where("split_name <> 'train'"), "review_text", "sentiment_label")
    return evaluation.class_metrics(scored, "sentiment_label", "predicted_label")


@query()
def latent_vectors(spark, d):
    """ML10 over every review's text, with the reference's vocabulary bounds and size."""
    return models.lsa_vectors(views.reviews(spark, d), "review_id", "text", least_df=3, most_share=0.995)


@query()
def sentence_pieces(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.explode(spans.sentence_spans("text")).alias("s")).select("doc_id", "s.start", "s.end")


from sedgeline.plans import audits  # noqa: E402, F401  its queries join those above
