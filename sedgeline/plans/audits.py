"""Driver queries of checks, samples, scores and the catalog build; imported by ``queries``, whose tables they join."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedgeline.operators import aspects, catalog, checks, evaluation, ingest, profile, sampling, search, taxonomy
from sedgeline.plans import views
from sedgeline.plans.queries import FIRST, GRAMS, LAST, MENTIONS, NAMESPACE, OBSERVED, PAIRS, PATH_KEY, PREDICTIONS, PRODUCTS, RANKED, REASON, REVIEWS, SAMPLED, SPACES, _mart, _observations, _pairs, _strata, query, stratified_sample
from sedgeline.session import table

# ------------------------------------------------------------------ catalog build

_BLANK = lambda c: f"coalesce(trim({c}), '') = ''"
_LACKS = [("coalesce(len(category_path), 0) = 0", "missing_category"), (_BLANK("main_category"), "missing_main_category"), ("price_at_collection IS NULL", "missing_price"), ("price_at_collection <= 0 OR isnan(price_at_collection)", "invalid_price"), ("rating_number IS NULL", "missing_rating_number"), (_BLANK("store"), "missing_store"), (_BLANK("product_title"), "missing_title"), ("cov.reviews IS NULL", "no_reviews")]
BUILT = f"""WITH {REVIEWS}, {PRODUCTS}, k AS (SELECT dataset_category, category_path, {PATH_KEY} AS path_key FROM product_catalog WHERE len(category_path) > 0),
reg AS (SELECT path_key, '{NAMESPACE}:' || substr(sha256(dataset_category || '|' || path_key), 1, 24) AS known_id, array_to_string(min(category_path), ' > ') AS known_text FROM k GROUP BY dataset_category, path_key),
cov AS (SELECT parent_asin, count(*) AS reviews, count(DISTINCT asin) AS asins, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms FROM rev GROUP BY 1),
bui AS (SELECT p.parent_asin, nullif(trim(product_title), '') AS product_title, nullif(trim(store), '') AS store, coalesce(known_id, nullif(trim(category_path_id), '')) AS category_path_id, coalesce(known_text, nullif(array_to_string(category_path, ' > '), '')) AS category_path_text,
  CASE WHEN price_at_collection > 0 AND NOT isnan(price_at_collection) THEN price_at_collection END AS price, coalesce(cov.reviews, 0) AS review_count, coalesce(asins, 0) AS reviewed_asin_count, first_ms, last_ms, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _LACKS)}) AS flags
  FROM (SELECT *, {PATH_KEY} AS pk FROM prod) p LEFT JOIN reg ON reg.path_key = p.pk LEFT JOIN cov ON cov.parent_asin = p.parent_asin)"""


def _built(spark, d):
    t = table(spark, d, "product_catalog")
    return catalog.build(t, views.reviews(spark, d), catalog.registry(t, NAMESPACE))


@query(BUILT + " SELECT * FROM bui")
def catalog_build(spark, d):
    return _built(spark, d).withColumn("flags", F.array_join("flags", ","))


@query(BUILT + f" SELECT count(*) AS products, count(*) FILTER (WHERE review_count > 0) AS reviewed_products, CAST(sum(review_count) AS BIGINT) AS reviews, count(DISTINCT category_path_id) AS paths, {', '.join(f"count(*) FILTER (WHERE list_contains(string_split(flags, ','), '{n}')) AS {n}" for _, n in _LACKS)} FROM bui")
def catalog_build_summary(spark, d):
    return catalog.build_summary(_built(spark, d))


_CLEAN = lambda c: f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '{SPACES}', ' ', 'g'))"


@query(f"""WITH c AS (SELECT source_record_index AS i, rating, asin, parent_asin, source_timestamp_ms AS ms, to_timestamp(source_timestamp_ms / 1000.0::DOUBLE) AS review_timestamp, {_CLEAN('review_title')} AS t, {_CLEAN('review_body')} AS b, helpful_vote, verified_purchase FROM reviews),
f AS (SELECT *, trim(t || ' ' || b) AS review_text FROM c), r AS (SELECT *, {REASON} AS reason FROM f)
SELECT 'v1:review:' || lpad(CAST(i AS VARCHAR), CAST(greatest(9, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS review_id, trim(asin) AS asin, length(t) AS title_chars, md5(review_text) AS text_md5, ms, helpful_vote AS votes, verified_purchase AS verified, nullif(reason, 'kept') AS drop_reason FROM r""")
def canonical_transform(spark, d):
    """PRJ1, PRJ5, TX2, TX3, DT1 on the reviews as raw text records."""
    r = table(spark, d, "reviews")
    text = lambda c, n: F.col(c).cast("string").alias(n)
    raw = r.select("source_record_index", text("rating", "rating"), F.col("review_title").alias("title"), F.col("review_body").alias("text"), "asin", "parent_asin", "user_id", text("source_timestamp_ms", "timestamp"), text("helpful_vote", "helpful_vote"), text("verified_purchase", "verified_purchase"))
    t = ingest.transform(raw, "v1", "hair", FIRST, LAST)
    return t.select("review_id", "asin", F.length("review_title").cast("long").alias("title_chars"), F.md5("review_text").alias("text_md5"), F.col("source_timestamp_ms").alias("ms"), F.col("helpful_vote").alias("votes"), F.col("verified_purchase").alias("verified"), "drop_reason")


_NUMBER = lambda c, low, high: f"CASE WHEN NOT isnan(try_cast({c} AS DOUBLE)) AND try_cast({c} AS DOUBLE) BETWEEN {low} AND {high} THEN try_cast({c} AS DOUBLE) END"
_TEXTS = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')"


@query(f"""WITH r AS (SELECT parent_asin, product_title AS title, store, CAST(average_rating AS VARCHAR) AS average_rating, CASE WHEN source_record_index % 7 = 0 THEN 'unknown' ELSE CAST(rating_number AS VARCHAR) END AS rating_number, CASE WHEN source_record_index % 5 = 0 THEN '-3' ELSE CAST(price_at_collection AS VARCHAR) END AS price, category_path AS categories, features FROM product_catalog),
n AS (SELECT *, {_NUMBER('average_rating', 0, 5)} AS ar, {_NUMBER('rating_number', 0, 2**53)} AS rn, {_NUMBER('price', 0, 1e9)} AS pr FROM r)
SELECT trim(parent_asin) AS parent_asin, nullif(trim(title), '') AS product_title, nullif(trim(store), '') AS store, ar AS average_rating, CASE WHEN rn = floor(rn) THEN CAST(rn AS BIGINT) END AS rating_number, pr AS price, array_to_string({_TEXTS('categories')}, '|') AS path, array_to_string({_TEXTS('features')}, '|') AS features,
concat_ws(',', CASE WHEN coalesce(trim(title), '') = '' THEN 'missing_title' END, CASE WHEN price IS NULL THEN 'missing_price' WHEN pr IS NULL THEN 'invalid_price' END, CASE WHEN average_rating IS NOT NULL AND ar IS NULL THEN 'invalid_average_rating' END,
  CASE WHEN rating_number IS NOT NULL AND (rn IS NULL OR rn <> floor(rn)) THEN 'invalid_rating_number' END, CASE WHEN len({_TEXTS('categories')}) = 0 THEN 'missing_category' END) AS flags FROM n""")
def product_records(spark, d):
    """PRJ6, TC1 on the catalog as raw text, with numbers that are none and prices out of bounds among them."""
    text = lambda c: F.col(c).cast("string")
    odd = lambda k, other, c: F.when(F.col("source_record_index") % k == 0, other).otherwise(text(c))
    raw = table(spark, d, "product_catalog").select("parent_asin", F.col("product_title").alias("title"), "store", text("average_rating").alias("average_rating"), odd(7, "unknown", "rating_number").alias("rating_number"), odd(5, "-3", "price_at_collection").alias("price"), F.col("category_path").alias("categories"), "features")
    return checks.product_record(raw).select("parent_asin", "product_title", "store", "average_rating", "rating_number", F.col("price_at_collection").alias("price"), F.array_join("category_path", "|").alias("path"), F.array_join("features", "|").alias("features"), F.array_join("metadata_quality_flags", ",").alias("flags"))


@query(RANKED + ", o AS (SELECT niche, aspect_id, row_number() OVER (PARTITION BY niche, aspect_id ORDER BY negative_rank, mentions DESC, parent_asin) AS place, parent_asin, negative_rank FROM ranked WHERE negative_rank IS NOT NULL) SELECT * FROM o WHERE place <= 3")
def aspect_laggards(spark, d):
    return aspects.leaders(aspects.rankings(_mart(spark, d)), rank="negative_rank")


@query(f"WITH {MENTIONS} SELECT review_id, aspect_id, array_to_string(json_extract_string(evidence, '$[*].text'), '|') AS phrases FROM men WHERE evidence IS NOT NULL")
def evidence_phrases(spark, d):
    """JS1: the phrases of every mention's evidence, in order."""
    m = views.mentions(spark, d).where("evidence is not null")
    return m.select("review_id", "aspect_id", F.array_join(search.phrases_of("evidence"), "|").alias("phrases"))


# ------------------------------------------------------------------ structural checks


@query("SELECT review_id, aspect_id, count(*) AS n FROM aspect_marts GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, review_id NULLS FIRST, aspect_id NULLS FIRST LIMIT 20")
def repeated_mentions(spark, d):
    return checks.duplicates(table(spark, d, "aspect_marts"), ["review_id", "aspect_id"], 20)


@query("SELECT review_id, count(DISTINCT coalesce('=' || parent_asin, 'null')) AS parent_asin, count(DISTINCT coalesce('=' || split_name, 'null')) AS split_name FROM sentiment GROUP BY 1 HAVING greatest(count(DISTINCT coalesce('=' || parent_asin, 'null')), count(DISTINCT coalesce('=' || split_name, 'null'))) > 1")
def unstable_reviews(spark, d):
    return checks.depends(table(spark, d, "sentiment"), "review_id", ["parent_asin", "split_name"])


@query("WITH a AS (SELECT DISTINCT review_id AS x FROM sentiment), b AS (SELECT DISTINCT review_id AS y FROM error_analysis), j AS (SELECT * FROM a FULL JOIN b ON x = y) SELECT count(*) FILTER (WHERE y IS NULL) AS only_first, count(*) FILTER (WHERE x IS NULL) AS only_second, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS both FROM j")
def id_relation(spark, d):
    return checks.set_relation(table(spark, d, "sentiment"), table(spark, d, "error_analysis"), "review_id")


@query("SELECT split_name, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM sentiment GROUP BY 1")
def split_name_frequencies(spark, d):
    return checks.frequencies(table(spark, d, "sentiment"), "split_name")


@query(f"""WITH {PREDICTIONS}, s AS (SELECT review_id, sentiment_label, review_text, row_number() OVER (PARTITION BY sentiment_label ORDER BY md5(review_id || ':42'), review_id) AS r FROM pred),
b AS (SELECT (row_number() OVER (ORDER BY r, sentiment_label, review_id) - 1) // 50 AS batch, length(review_text) AS n FROM s)
SELECT batch, count(*) AS rows, CAST(sum(n) AS BIGINT) AS characters, min(n) AS shortest, max(n) AS longest FROM b GROUP BY 1""")
def batch_sizes(spark, d):
    rows = taxonomy.batches(views.predictions(spark, d).select("review_id", "sentiment_label", "review_text"), "sentiment_label", 50)
    return checks.size_profile(rows, "batch", "review_text")


_BY_RATING = "CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END"


@query(f"""WITH {PREDICTIONS}, m AS (SELECT *, CASE WHEN token_count > 16 THEN {_BY_RATING} ELSE ' ' END AS manual FROM pred), a AS (SELECT predicted_label AS review_group, count(*) AS rows, count(*) FILTER (WHERE trim(manual) <> '') AS reviewed,
count(*) FILTER (WHERE trim(manual) <> '' AND manual = sentiment_label) AS agrees_with_label, count(*) FILTER (WHERE trim(manual) <> '' AND manual = predicted_label) AS agrees_with_prediction FROM m GROUP BY 1)
SELECT *, agrees_with_label::DOUBLE / nullif(reviewed, 0) AS agrees_with_label_rate, agrees_with_prediction::DOUBLE / nullif(reviewed, 0) AS agrees_with_prediction_rate FROM a""")
def manual_agreement(spark, d):
    """AG35 with the rating of longer texts in the place of a person's label; the others count as not reviewed."""
    p = views.predictions(spark, d)
    manual = F.when(F.col("token_count") > 16, profile.sentiment_label(F.col("rating"))).otherwise(" ")
    return checks.manual_summary(p.withColumn("manual_label", manual).withColumn("review_group", F.col("predicted_label")))


# ------------------------------------------------------------------ samples


@query(f"""WITH {PREDICTIONS}, g AS (SELECT review_id, sentiment_label || '>' || predicted_label AS review_group FROM pred), o AS (SELECT *, row_number() OVER (PARTITION BY review_group ORDER BY md5(review_id || ':42'), review_id) AS rn, count(*) OVER (PARTITION BY review_group) AS population FROM g)
SELECT review_id, review_group, population, population::DOUBLE / least(population, 5) AS sampling_weight FROM o WHERE rn <= 5""")
def manual_review_queue(spark, d):
    p = views.predictions(spark, d).select("review_id", "sentiment_label", "predicted_label")
    return checks.review_queue(p, F.concat_ws(">", "sentiment_label", "predicted_label"), "review_id", 5).select("review_id", "review_group", "population", "sampling_weight")


@query(SAMPLED + ", e AS (SELECT * FROM s WHERE review_id NOT IN (SELECT review_id FROM t)) SELECT review_id, rating_group, count(*) OVER (PARTITION BY rating_group) AS group_size, 1.0::DOUBLE AS sampling_weight FROM e")
def nested_extension(spark, d):
    return sampling.extension(_strata(spark, d), stratified_sample(spark, d), "review_id", "rating_group").select("review_id", "rating_group", "group_size", "sampling_weight")


@query(SAMPLED + " SELECT printf('aspect:%04d', row_number() OVER (ORDER BY sha256(review_id || ':42'), review_id)) AS row_id, review_id, rating_group FROM t")
def annotation_rows(spark, d):
    return sampling.annotation_queue(stratified_sample(spark, d).select("review_id", "rating_group"), "review_id", "aspect")


@query(SAMPLED + ", x AS (SELECT 'representative' AS component, sampling_weight FROM t UNION ALL SELECT 'targeted', NULL FROM s WHERE rating_group = 'high_4_5' AND length_bucket = 'medium_41_120' AND review_id NOT IN (SELECT review_id FROM t)) SELECT component, count(*) AS rows, CAST(floor(sum(sampling_weight) + 0.5) AS BIGINT) AS weight FROM x GROUP BY 1")
def sample_components(spark, d):
    own = stratified_sample(spark, d)
    more = sampling.holdout(_strata(spark, d).where("rating_group = 'high_4_5' and length_bucket = 'medium_41_120'"), own, "review_id")
    both = sampling.combine(own, more, "review_id")
    return both.groupBy("component").agg(F.count("*").alias("rows"), F.floor(F.sum("sampling_weight") + 0.5).cast("long").alias("weight"))


SEGMENTS = {"low_1_2": 12, "mid_3": 10, "high_4_5": 40}
_TOTAL = "CASE rating_group " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENTS.items()) + " END"


@query(SAMPLED + f""", g AS (SELECT review_id, rating_group, year || '|' || length_bucket AS stratum FROM s WHERE review_id NOT IN (SELECT review_id FROM sentiment WHERE review_id IS NOT NULL AND lower(trim(split_name)) = 'validation')), h AS (SELECT rating_group, stratum, count(*) AS n, {_TOTAL} AS total FROM g GROUP BY ALL),
fl AS (SELECT *, least(n, 1) AS q FROM h), sm AS (SELECT rating_group, sum(q) AS q_all, coalesce(sum(q) FILTER (WHERE n <= q), 0) AS q_full, sum(n) FILTER (WHERE n > q) AS basis FROM fl GROUP BY 1),
op AS (SELECT fl.*, q_full, (total - q_all) * n::DOUBLE / basis AS ideal FROM fl JOIN sm USING (rating_group) WHERE n > q), wh AS (SELECT *, least(n, q + CAST(floor(ideal) AS BIGINT)) AS w FROM op),
r AS (SELECT *, sum(w) OVER (PARTITION BY rating_group) AS w_all, row_number() OVER (PARTITION BY rating_group, w < n ORDER BY ideal - floor(ideal) DESC, stratum) AS place FROM wh),
quo AS (SELECT fl.rating_group, fl.stratum, fl.n, coalesce(r.w + CASE WHEN r.w < r.n AND place <= fl.total - r.q_full - w_all THEN 1 ELSE 0 END, fl.q) AS quota FROM fl LEFT JOIN r ON r.rating_group = fl.rating_group AND r.stratum = fl.stratum),
ord AS (SELECT *, row_number() OVER (PARTITION BY rating_group, stratum ORDER BY md5(review_id || ':42'), review_id) AS rn FROM g)
SELECT review_id, ord.rating_group, ord.stratum, quo.n::DOUBLE / quota AS sampling_weight FROM ord JOIN quo ON quo.rating_group = ord.rating_group AND quo.stratum = ord.stratum WHERE rn <= quota""")
def segmented_sample(spark, d):
    """SMP3: a sample by rating group, of strata of year and length, without the reviews of the validation split."""
    held = table(spark, d, "sentiment").where(F.lower(F.trim("split_name")) == "validation")
    rows = _strata(spark, d).select("review_id", "rating_group", F.concat_ws("|", "year", "length_bucket").alias("stratum"))
    return sampling.segmented(rows, "rating_group", "stratum", "review_id", SEGMENTS, 1, taken=(held,)).select("review_id", "rating_group", "stratum", "sampling_weight")


# ------------------------------------------------------------------ taxonomy

OWNERS = {"scent": "fragrance", "packaging": "container", "texture": "feel", "hold": "feel"}
_OWNED = ", ".join(f"('{k}', '{v}')" for k, v in sorted(OWNERS.items()))
OWNED = OBSERVED + f", own(candidate_key, aspect) AS (VALUES {_OWNED}), m AS (SELECT DISTINCT aspect, review_id, o.parent_asin FROM o JOIN own ON own.candidate_key = o.candidate_key)"


def _owners(spark):
    return spark.createDataFrame(sorted(OWNERS.items()), "candidate_key string, aspect_id string")


@query(OWNED + """, one AS (SELECT aspect, review_id, min(parent_asin) AS parent_asin FROM m GROUP BY 1, 2), s AS (SELECT aspect, count(*) AS reviews, count(DISTINCT parent_asin) AS products FROM one GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY review_id) AS k FROM one)
SELECT s.aspect AS aspect_id, reviews, products, (SELECT string_agg(review_id, ',' ORDER BY k) FROM r WHERE r.aspect = s.aspect AND k <= 5) AS evidence FROM s""")
def taxonomy_proposal(spark, d):
    p = taxonomy.proposal(_observations(spark, d), _owners(spark))
    return p.select("aspect_id", "reviews", "products", F.array_join("evidence_ids", ",").alias("evidence"))


@query(OBSERVED + f", own(candidate_key, aspect) AS (VALUES {_OWNED}) SELECT DISTINCT candidate_key FROM o WHERE candidate_key IS NOT NULL AND candidate_key NOT IN (SELECT candidate_key FROM own)")
def unmapped_candidates(spark, d):
    return taxonomy.uncovered(taxonomy.candidates(_observations(spark, d)), _owners(spark)).select("candidate_key")


@query(OWNED + " SELECT review_id, string_agg(aspect, ',' ORDER BY aspect) AS aspects FROM (SELECT DISTINCT review_id, aspect FROM m) GROUP BY 1")
def aspect_training_labels(spark, d):
    return taxonomy.training_labels(_observations(spark, d), _owners(spark)).select("review_id", F.array_join("aspects", ",").alias("aspects"))


# ------------------------------------------------------------------ scores

_SCORES = {"negative": "score_negative", "neutral": "score_neutral", "positive": "score_positive"}
_MICRO = lambda x, n: f"CAST(floor(({x}) * 1000000 + 0.5) AS BIGINT) AS {n}"
_BRIER = " + ".join(f"pow({c} - CASE WHEN sentiment_label = '{k}' THEN 1 ELSE 0 END, 2)" for k, c in _SCORES.items())
_OWN = "CASE sentiment_label " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in _SCORES.items()) + " END"


@query(f"WITH {PREDICTIONS} SELECT {_MICRO(f'avg({_BRIER})', 'brier_micro')}, {_MICRO(f'avg(-ln(greatest({_OWN}, 1e-15)))', 'log_loss_micro')} FROM pred")
def proper_scores(spark, d):
    s = evaluation.proper_scores(views.predictions(spark, d), "sentiment_label", _SCORES)
    return s.select(*[F.floor(F.col(c) * 1000000 + 0.5).cast("long").alias(f"{c}_micro") for c in ("brier", "log_loss")])


@query(f"WITH {PREDICTIONS}, b AS (SELECT greatest(1, CAST(ceil(model_score * 10) AS BIGINT)) AS bin, count(*) AS rows, count(*) FILTER (WHERE sentiment_label = predicted_label) AS hits, sum(floor(model_score * 1000000 + 0.5)) AS micro FROM pred WHERE model_score IS NOT NULL AND NOT isnan(model_score) AND model_score BETWEEN 0 AND 1 GROUP BY 1) SELECT CAST(sum(rows) AS BIGINT) AS rows, {_MICRO('sum(abs(hits - micro / 1e6)) / sum(rows)', 'ece_micro')} FROM b")
def calibration_error(spark, d):
    bins = evaluation.calibration_bins(views.predictions(spark, d), "model_score", "sentiment_label", "predicted_label")
    return evaluation.calibration(bins).select("rows", F.floor(F.col("ece") * 1000000 + 0.5).cast("long").alias("ece_micro"))


@query(f"""WITH {PREDICTIONS}, t AS (SELECT unnest([50, 60, 70, 80, 90]) AS percent), k AS (SELECT percent, count(*) AS rows, count(*) FILTER (WHERE sentiment_label <> predicted_label) AS errors FROM t JOIN pred ON model_score >= percent / 100.0::DOUBLE AND NOT isnan(model_score) GROUP BY 1)
SELECT CAST(percent AS INTEGER) AS percent, rows, errors, rows::DOUBLE / (SELECT count(*) FROM pred) AS coverage, errors::DOUBLE / rows AS error_rate FROM k""")
def threshold_rates(spark, d):
    return evaluation.threshold_rates(views.predictions(spark, d), "model_score", "sentiment_label", "predicted_label", [50, 60, 70, 80, 90])


@query(f"WITH {PAIRS}, r AS (SELECT review_id, bool_and(p = t) AS equal FROM b GROUP BY 1) SELECT count(*) AS reviews, count(*) FILTER (WHERE equal) AS exact FROM r")
def exact_sets(spark, d):
    return evaluation.exact_sets(*_pairs(spark, d), "review_id", "aspect_id")


@query(f"WITH {REVIEWS}, {MENTIONS}, j AS (SELECT DISTINCT m.review_id, aspect_id, CASE WHEN rev.rating <= 2 THEN 'negative' WHEN rev.rating = 3 THEN 'neutral' ELSE 'positive' END AS predicted, sentiment AS given FROM men m JOIN rev ON rev.review_id = m.review_id WHERE sentiment IN ('negative', 'neutral', 'positive')) SELECT given, predicted, count(*) AS n FROM j GROUP BY 1, 2")
def pair_agreement(spark, d):
    """AG29: the sentiment of mentions against that of the review's rating, on pairs that both have; mixed and unclear ones do not count."""
    m = views.mentions(spark, d).select("review_id", "aspect_id", "sentiment")
    own = m.select("review_id", "aspect_id").join(views.reviews(spark, d).select("review_id", profile.sentiment_label(F.col("rating")).alias("sentiment")), "review_id")
    return evaluation.pair_agreement(own, m, ["review_id", "aspect_id"], "sentiment").select("given", "predicted", "n")


@query(f"WITH {MENTIONS}, o AS (SELECT review_id, aspect_id, probability, row_number() OVER (PARTITION BY review_id ORDER BY probability DESC, aspect_id) AS k FROM men WHERE probability IS NOT NULL AND NOT isnan(probability)) SELECT review_id, aspect_id FROM o WHERE k = 1")
def best_aspects(spark, d):
    return search.best_aspects(views.mentions(spark, d)).select("review_id", "aspect_id")


# ------------------------------------------------------------------ retrieval

ASKED = "the scent is too strong and smells bad"


@query(f"""WITH {REVIEWS}, {MENTIONS}, own AS (SELECT review_id, aspect_id, CASE WHEN NOT isnan(probability) THEN probability END AS probability FROM men WHERE aspect_id = 'scent' AND sentiment = 'negative'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY probability DESC NULLS LAST, aspect_id) AS k FROM own) WHERE k = 1),
tx AS (SELECT best.review_id, aspect_id, probability, rev.parent_asin, rev.helpful, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain FROM best JOIN rev ON rev.review_id = best.review_id),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY probability DESC NULLS LAST, aspect_id, review_id) AS k2 FROM tx WHERE length(plain) >= 2) WHERE k2 = 1),
doc AS (SELECT 'r' || review_id AS did, plain FROM one UNION ALL SELECT 'q', '{ASKED}'), {GRAMS('doc', 'did', 'plain')},
tf0 AS (SELECT id, term, count(*) AS tf FROM gr GROUP BY 1, 2), kept AS (SELECT term FROM tf0 GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 50000), tf AS (SELECT * FROM tf0 WHERE term IN (SELECT term FROM kept)), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
v AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM doc)) / (1.0 + df)) + 1) AS v FROM tf JOIN df USING (term)), nor AS (SELECT id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1), x AS (SELECT id, term, v / norm AS weight FROM v JOIN nor USING (id)),
lex AS (SELECT x.id, sum(x.weight * q.weight) AS lexical FROM x JOIN x q ON q.term = x.term AND q.id = 'q' WHERE x.id <> 'q' GROUP BY 1),
sc AS (SELECT one.*, lexical FROM one JOIN lex ON lex.id = 'r' || review_id WHERE lexical > 0),
ra AS (SELECT *, 0.80::DOUBLE * lexical + 0.15::DOUBLE * least(greatest(coalesce(probability, 0), 0), 1) + 0.05::DOUBLE * ln(1 + greatest(helpful, 0)) / ln(1 + greatest(1, (SELECT max(helpful) FROM sc))) AS score FROM sc),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY score DESC, helpful DESC, review_id) AS b FROM ra) WHERE b <= 2)
SELECT review_id, parent_asin, aspect_id, {_MICRO('lexical', 'lexical_micro')}, {_MICRO('score', 'score_micro')} FROM few ORDER BY score DESC, helpful DESC, review_id LIMIT 50""")
def evidence_search(spark, d):
    """ML13, MA3: the fifty reviews that answer a query best, at most two of a product."""
    found = search.retrieve(views.mentions(spark, d), views.reviews(spark, d), ASKED, "scent", "negative", k=50)
    micro = lambda c, n: F.floor(F.col(c) * 1000000 + 0.5).cast("long").alias(n)
    return found.select("review_id", "parent_asin", "aspect_id", micro("lexical_score", "lexical_micro"), micro("retrieval_score", "score_micro"))
