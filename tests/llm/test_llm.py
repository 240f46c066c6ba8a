"""Training-data operators against brute force, exact round trips and hand-written cases."""

import datetime as dt
import hashlib
import itertools
import random
import os
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sedgeline.llm import bags, bpe, components, leakage, neardup, overlap, sentences, stable, targets, topn
from sedgeline.llm.queries import QUERIES, VOCABULARY
from sedgeline.llm.sql import SQL
from sedgeline.session import table


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, tables, name):
    got, want = QUERIES[name](spark, tables).toPandas(), duck.execute(SQL[name]).df()
    assert rows(got) == rows(want)


# ---------------------------------------------------------------- P1

SAMPLING = "niche_id string, review_id string, rating float, review_timestamp timestamp, review_year int, rating_group string, length_bucket string, stratum_id string, category string"
TARGETS = "niche_id string, target_field string, category string, target_permille int, min_rows int, sample_size int"


def sampling_rows(spark, n=40):
    out = []
    for i in range(n):
        group = ["low_1_2", "HIGH_4_5 ", None][i % 3]
        out.append(("n1", f"r{i}", 1.0 if i % 3 == 0 else 5.0, dt.datetime(2022, 5, 1), None if i % 5 == 0 else 2022, group, "short_5_40", None, "extra"))
    out += out[:5]  # repeats
    out += [(None, "x", 1.0, None, None, None, None, None, None), ("n1", None, 1.0, None, None, None, None, None, None)]
    return spark.createDataFrame(out, SAMPLING)


def test_targets(spark):
    asked = spark.createDataFrame([("n1", "rating_group", "low_1_2", 300, 2, 30), ("n1", "rating_group", "high_4_5", 600, 0, 30), ("n1", "rating_group", "mid_3", 100, 1, 30), ("n2", "review_year", "2022", 1000, 0, 5), ("n1", None, "x", 0, 0, 0)], TARGETS)
    got = {(r["niche_id"], r["category"]): r for r in targets.report(sampling_rows(spark), asked).collect()}
    low = got["n1", "low_1_2"]
    assert (low["demand"], low["available"], low["allotted"]) == (9, 14, 9)
    mid = got["n1", "mid_3"]
    assert (mid["floor_short"], mid["margin_short"], mid["allotted"]) == (1, 2, 0)
    assert got["n2", "2022"]["margin_short"] == 5
    drawn = targets.sample(sampling_rows(spark), asked).toPandas()
    assert Counter(drawn.rating_group) == {"low_1_2": 9, "high_4_5": 18} and drawn.review_id.is_unique
    again = targets.sample(sampling_rows(spark).repartition(7), asked).toPandas()
    assert set(drawn.review_id) == set(again.review_id)


def test_targets_empty(spark):
    asked = spark.createDataFrame([("n1", "rating_group", "low_1_2", 300, 2, 30)], TARGETS)
    none = spark.createDataFrame([], SAMPLING)
    assert targets.shortfalls(none, asked).count() == 1
    assert targets.shortfalls(sampling_rows(spark), asked.limit(0)).count() == 0
    assert targets.sample(none, asked).count() == 0


def test_record_in_two_cells_is_reported_short(spark):
    """Five records of a category, three of which also stand in the other one, which asks for four of its own three."""
    two = lambda i, group: ("n1", f"r{i}", None, group, None, None, None, None)
    names = ["niche_id", "review_id", "stratum_id", "rating_group", "review_year", "length_bucket", "rating", "review_timestamp"]
    df = spark.createDataFrame([two(i, "a") for i in range(5)] + [two(i, "b") for i in range(3)], "niche_id string, review_id string, stratum_id string, rating_group string, review_year int, length_bucket string, rating float, review_timestamp timestamp").select(*names)
    asked = spark.createDataFrame([("n1", "rating_group", "a", 500, 0, 10), ("n1", "rating_group", "b", 400, 0, 10)], TARGETS)
    got = {r["category"]: r for r in targets.report(df, asked).collect()}
    assert (got["a"]["available"], got["b"]["available"]) == (5, 3)
    assert all(r["allotted"] + r["floor_short"] + r["margin_short"] == r["demand"] for r in got.values())
    assert sum(r["allotted"] for r in got.values()) == 5 == targets.sample(df, asked).count()
    assert [r["category"] for r in targets.shortfalls(df, asked).collect()] == ["b"]


def test_flow_is_least_cost():
    cells = [(["a"], "x", 7), (["a"], "y", 2), (["b"], "z", 1)]
    report, quotas = targets.solve("n", [("a", 6, 1, 9), ("b", 4, 3, 1)], cells, "s")
    assert [(r["category"], r["floor_short"], r["margin_short"], r["allotted"]) for r in report] == [("a", 0, 0, 6), ("b", 2, 1, 1)]
    q = {x["key"]: x["quota"] for x in quotas}
    assert q["x"] in (4, 5) and q["x"] + q["y"] == 6


# ---------------------------------------------------------------- P2, P7

BASE = "one two three four five six seven eight nine ten alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()


def alike(a, b):
    x, y = Counter(bags.words(a)), Counter(bags.words(b))
    return (x & y).total() >= 0.7 * (x | y).total()


def brute(texts):
    big = [(i, t) for i, t in texts if i and t and len(bags.words(t)) >= 20]
    return {(min(i, j), max(i, j)) for (i, s), (j, t) in itertools.combinations(big, 2) if i != j and alike(s, t)}


def test_alike_pairs_small(spark):
    texts = [("a", " ".join(BASE)), ("b", " ".join(reversed(BASE))), ("c", " ".join(BASE[:-4] + ["w", "x", "y"])), ("d", " ".join(BASE[:10] + ["q"] * 12)), ("e", " ".join(BASE[:19])), ("a", " ".join(BASE)), (None, " ".join(BASE)), ("f", None), ("g", ""), ("h", "<b>" + " ".join(BASE).upper() + "</b>"), ("i", " ".join(BASE * 500)), ("j", " ".join(BASE * 500 + ["z"]))]
    df = spark.createDataFrame(texts, "id string, text string").withColumn("bag", F.lit(1))
    got = {tuple(r) for r in neardup.all_pairs(df).collect()}
    assert got == brute(texts) and ("a", "b") in got and ("i", "j") in got
    assert neardup.all_pairs(df.limit(0)).count() == 0
    classes = {r["id"]: r["class_id"] for r in neardup.groups(df).collect()}
    assert classes["a"] == classes["b"] == classes["c"] != classes["d"]


def test_alike_pairs_on_table(spark, tables):
    df = neardup.review_texts(table(spark, tables, "error_analysis"))
    assert {tuple(r) for r in neardup.all_pairs(df).collect()} == brute([tuple(r) for r in df.distinct().collect()])


def test_groups_name_classes_copies_and_links(spark):
    texts = [(f"c{i}", " ".join(BASE if i % 2 else reversed(BASE))) for i in range(6)] + [("z", " ".join(BASE[:-1])), ("far", " ".join(f"w{i}" for i in range(25)))]
    got = {r["id"]: r for r in neardup.groups(spark.createDataFrame(texts, "id string, text string")).collect()}
    assert len({got[f"c{i}"]["bag"] for i in range(6)}) == 1 and got["c0"]["copies"] == 6 and got["c0"]["links"] == 1
    assert (got["z"]["copies"], got["z"]["links"], got["far"]["links"]) == (1, 1, 0)
    assert got["z"]["class_id"] == got["c0"]["class_id"] != got["far"]["class_id"]


def test_all_pairs_at_any_class_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(neardup, "PART", 16)
    mixed = list(reversed(BASE))
    texts = [(f"c{i:03}", " ".join(BASE if i % 2 else mixed)) for i in range(101)] + [("z", " ".join(BASE[:-1])), ("far", " ".join(f"w{i}" for i in range(25)))]
    spark.createDataFrame([(i, None, t) for i, t in texts], "review_id string, review_title string, review_text string").write.parquet(str(tmp_path / "error_analysis.parquet"))
    got = [tuple(r) for r in QUERIES["p2_found"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) == 5050 + 101 and set(got) == brute(texts)


def test_popcounts_bound_the_distance():
    for s, t in (("a b c d e f", "a b c x y"), ("a a a b", "a b b b c")):
        e, lens = bags.elements([sorted(bags.words(v)) for v in (s, t)], {})
        segs = bags.popcounts(e, lens)
        assert bags.apart(segs[:1], segs[1:])[0] <= lens.sum() - 2 * bags.common(" ".join(bags.words(s)), " ".join(bags.words(t)))


def test_overlaps_on_table(spark, tables):
    sent, rev = table(spark, tables, "sentiment"), table(spark, tables, "error_analysis")
    got = {r["review_id"]: r for r in overlap.overlaps(sent, rev).collect()}
    split, prints = {}, defaultdict(set)
    for r in sent.collect():
        s = (r["split_name"] or "").strip().lower().replace("-", "_")
        if s:
            split[r["review_id"]] = s
            if r["text_fingerprint"]:
                prints[r["text_fingerprint"].lower()].add((r["review_id"], s))
    want = {i for own in prints.values() if any(s == "train" for _, s in own) for i, s in own if s != "train"}
    assert {i for i, r in got.items() if r["by_print"]} == want
    texts = [tuple(r) for r in neardup.review_texts(rev).distinct().collect()]
    text_hits = {i for p in brute(texts) for i, j in (p, p[::-1]) if split.get(i, "train") != "train" and split.get(j) == "train"}
    assert {i for i, r in got.items() if r["by_text"]} == text_hits


def test_overlaps_empty(spark, tables):
    sent, rev = table(spark, tables, "sentiment"), table(spark, tables, "error_analysis")
    assert overlap.overlaps(sent.limit(0), rev).count() == 0
    assert overlap.overlaps(sent, rev.limit(0)).where("by_text").count() == 0


# ---------------------------------------------------------------- P3

KEYED = "review_id string, sampling_seed int, deterministic_key string, load_batch int, hash string"


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_frozen_sample_grows(spark):
    all_rows = [(f"r{i}", 42, None, 1 + i % 4, "clash") for i in range(200)]
    early = [r for r in all_rows if r[3] <= 2]
    late = [*all_rows, *[(r[0], 42, "wrong", 5, "clash") for r in all_rows[:20]]]
    take = lambda r: {x["review_id"] for x in stable.frozen_sample(spark.createDataFrame(r, KEYED)).collect()}
    first, full = take(early), take(late)
    assert first <= full and len(first) == 10 and len(full) == 20
    assert full == {x["review_id"] for x in stable.frozen_sample(spark.createDataFrame(late, KEYED).repartition(9)).collect()}


def test_unreliable_keys(spark):
    r = [("a", 42, md5("a:42").upper() + " ", 1, ""), ("b", 42, "0", 1, ""), ("b", 42, md5("b:42"), 2, ""), ("c", 42, None, 1, ""), ("d", None, md5("d:42"), None, ""), (None, 1, "x", 1, ""), ("e", 42, "", 1, "")]
    df = spark.createDataFrame(r, KEYED)
    assert sorted(x[0] for x in stable.unreliable(df).collect()) == ["b", "d", "e"]
    assert stable.unreliable(df.limit(0)).count() == 0


# ---------------------------------------------------------------- P4


@pytest.mark.parametrize("held", [10, 200_000])
def test_top_n_ties_and_skew(spark, monkeypatch, held):
    monkeypatch.setattr(topn, "HELD", held)
    data = [(("hot" if i % 3 else f"g{i % 11}"), float(i % 5), i % 2, f"r{i:04d}") for i in range(600)] + [(None, 1.0, 0, "z")]
    df = spark.createDataFrame(data, "g string, score double, votes int, rid string").repartition(6)
    got = {(r["g"], r["rid"]) for r in topn.top_n(df, ["g"], "score", [("votes", False), ("rid", True)], 3).collect()}
    want = set()
    for g in {d[0] for d in data}:
        want |= {(g, d[3]) for d in sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], -d[2], d[3]))[:3]}
    assert got == want


def test_top_mentions_cases(spark):
    t = lambda d: dt.datetime(2023, 1, d)
    r = [(" p1", "Scent ", "r1", 0.9, 1, t(1)), ("P1", "scent", "r1", 0.2, 1, t(2)), ("P1", "scent", "r1", 0.2, 1, t(2)), ("P1", "scent", "r2", float("nan"), 1, t(1)), ("P1", "scent", "r3", 1.5, 1, t(1)), ("P1", "scent", "r4", None, 1, t(1)), ("P1", "scent", "r5", 0.2, None, t(1)), ("P1", "scent", "r6", 0.2, 5, None), (None, "scent", "r7", 0.5, 1, t(1)), ("P1", "", "r8", 0.5, 1, t(1)), ("P1", "scent", None, 0.5, 1, t(1)), ("P1", "scent", "r9", 0.2, 0, t(1))]
    df = spark.createDataFrame(r, "parent_asin string, aspect_id string, review_id string, aspect_sentiment_score double, helpful_vote int, scored_at timestamp").withColumn("rank", F.lit("clash"))
    got = [tuple(x) for x in topn.top_mentions(df).orderBy("rank").collect()]
    assert got == [("P1", "scent", "r6", 1), ("P1", "scent", "r1", 2), ("P1", "scent", "r5", 3)]
    assert topn.top_mentions(df.limit(0)).count() == 0


# ---------------------------------------------------------------- P6


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60)] + [("hub", f"m{i}") for i in range(50)] + [("x", "x"), ("n000", "n001"), (None, "q")]
    got = {r["node"]: r["component"] for r in components.hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and {got[f"m{i}"] for i in range(50)} == {"hub"} and got["x"] == "x" and len(got) == 61 + 51 + 1


MANIFEST = "review_id string, parent_asin string, user_id string, split_name string, component string"


def test_splits_keep_ids_together(spark):
    data = [(f"r{i}", f"p{i % 40} ", None if i % 9 == 0 else f"u{i % 170}", ["train", " Test-Product", "test_product", None, ""][i % 5], "clash") for i in range(400)] + [("alone", None, "", "train", "")]
    df = spark.createDataFrame(data, MANIFEST)
    goal = spark.createDataFrame([("train", 700), ("Test-Product", 200), ("validation", 100), ("none", None)], "split_name string, target_permille int")
    got = {r["review_id"]: r["split_name"] for r in components.assign_splits(df, goal).collect()}
    assert len(got) == 401 and set(got.values()) <= {"train", "test_product", "validation"}
    for k in (1, 2):
        own = defaultdict(set)
        for d in data:
            if d[k]:
                own[d[k].strip()].add(got[d[0]])
        assert all(len(v) == 1 for v in own.values())
    torn = {tuple(r) for r in components.torn(df).collect()}
    want = set()
    for kind, k in (("parent_asin", 1), ("user_id", 2)):
        own = defaultdict(set)
        for d in data:
            s = (d[3] or "").strip().lower().replace("-", "_")
            if d[k] and d[k].strip() and s:
                own[d[k].strip().upper()].add(s)
        want |= {(kind, i) for i, v in own.items() if len(v) > 1}
    assert torn == want
    assert components.torn(df.limit(0)).count() == 0 and components.assign_splits(df.limit(0), goal).count() == 0


def test_rendezvous_shares_and_stability(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("c"))
    one = lambda goal: {r["c"]: r["s"] for r in df.select("c", components.rendezvous(F.col("c"), goal, "1").alias("s")).collect()}
    a = one([("train", 700), ("test", 300)])
    assert abs(sum(v == "train" for v in a.values()) / 20_000 - 0.7) < 0.015
    b = one([("train", 700), ("test", 300), ("new", 100)])
    assert all(b[k] in (v, "new") for k, v in a.items())


# ---------------------------------------------------------------- P8


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_ids_equal_the_library(spark, tables):
    tokenizers = pytest.importorskip("tokenizers")
    odd = [None, "", " ", "<|endoftext|> a", "aaaaaaaaaa bb", "it's they'LL 'x", "\x1c\x85 　 d  \n\n e", "🙂🙂 a‍b é", "x" * 20_000, "ab " * 5000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(odd)] + [(0, None, "")], "doc_id long, text string, ids string")
    lib = tokenizers.Tokenizer.from_file(VOCABULARY)
    lib.encode_special_tokens = True
    for frame in (df, table(spark, tables, "documents").select("doc_id", "text")):
        texts = frame.collect()
        got = bpe.token_ids(frame, VOCABULARY).collect()
        want = sorted((r["doc_id"], lib.encode(r["text"] or "", add_special_tokens=False).ids) for r in texts)
        assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want
    assert bpe.token_ids(df.limit(0), VOCABULARY).count() == 0


# ---------------------------------------------------------------- P9


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        w = bags.words(text)
        for i, lang, t in items:
            x = bags.words(t)
            if lang in ("zh", "ja"):
                a, b, n = "".join(w), "".join(x), 24
                hit = any(b[k : k + n] in a for k in range(len(b) - n + 1))
            else:
                a, b, n = " " + " ".join(w) + " ", x, 12
                hit = any(f" {' '.join(b[k : k + n])} " in a for k in range(len(b) - n + 1))
            if hit:
                out.add((d, i))
    return out


def test_leaks(spark, tables):
    docs = [tuple(r) for r in table(spark, tables, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, tables, "eval_items").select("item_id", "item_lang", "text").collect()]
    # whole, at the edges of 12 words, in a very long text, with markup and case changed
    w = next(t for _, g, t in items if g == "en").split()
    docs += [(10**6, " ".join(w[:12])), (10**6 + 1, " ".join(w[:11])), (10**6 + 2, "word " * 100_000 + "<b>" + " ".join(w).upper()), (10**6 + 3, None), (10**6 + 4, ""), (None, " ".join(w)), (10**6, " ".join(w[:12]))]
    items += [(None, "en", " ".join(w)), (10**6, None, "too short")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, item_lang string, text string").withColumn("doc_id", F.lit("clash"))
    got = {tuple(r) for r in leakage.leaked_passages(d, i).collect()}
    assert got == brute_leaks([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None])
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_leaks_of_changed_items_and_portions(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PORTION_BYTES", 500)
    item = [f"w{k}" for k in range(60)]
    changed = item[:30] + ["other"] + item[31:]
    items = spark.createDataFrame([(k, "en", " ".join(f"{x}_{k}".replace("_", "q") if k else x for x in item)) for k in range(5)], "item_id long, item_lang string, text string")
    docs = spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string")
    got = leakage.leaks(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["longest_run"]) for r in got] == [(1, 0, 30)] and 0.8 <= got[0]["similarity"] < 1


def test_recall_of_edited_passages():
    """Items laid into documents with one to six words changed, inserted or left out: whatever is alike at any place is found."""
    rng = random.Random(5)
    items = [[rng.choice(WORDS_OF) for _ in range(rng.randint(20, 150))] for _ in range(40)]
    probe = leakage.Probe(leakage.WORDS, list(range(len(items))), items).build(leakage.Hasher())
    docs, alike = [], set()
    for k in range(400):
        own = list(items[k % len(items)])
        for _ in range(1 + k % 6):
            at = rng.randrange(len(own))
            own[at : at + rng.choice((0, 1))] = rng.choice(([], ["changed"], ["more", "words"]))
        docs.append([rng.choice(WORDS_OF) for _ in range(9)] + own + ["end"])
        text = items[k % len(items)]
        if any(probe.similarity(text, docs[k][x : x + len(text)]) >= leakage.SIMILAR for x in range(len(docs[k]))):
            alike.add((k, k % len(items)))
    rows = leakage.matches(probe, docs, leakage.Hasher())
    assert len(alike) > 50 and alike <= {(d, i) for d, i, _, _ in rows}
    placed = {(d, i) for d, i, _, similarity in rows if similarity >= leakage.SIMILAR}  # laid over the places of hits only
    assert len(alike & placed) >= 0.9 * len(alike)


WORDS_OF = [f"word{i}" for i in range(3000)]


def test_simhash_blocks_find_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    p = leakage.Probe(12, [1], [[f"t{i}" for i in range(200)]]).build(leakage.Hasher())
    near = []
    for k in range(0, 180, 7):
        x = p.prints[k]
        for b in rng.choice(64, rng.integers(0, leakage.RADIUS + 1), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        near.append(x)
    left, right = p.near(np.array(near, np.uint64))
    assert {(i, k) for i, k in enumerate(range(0, 180, 7))} <= set(zip(left.tolist(), right.tolist()))


# ---------------------------------------------------------------- P10


def test_scripts_and_quotations_of_the_whole_text():
    mixed = "".join("б" if i % 4 == 0 else "a" for i in range(1600))  # a fixed stride of 4 sees only one of the scripts
    assert sentences.main_script(mixed) == sentences.script("a") != sentences.script("б")
    deep = "(" + "[ " * 40 + "x" + ")"
    assert sentences.outer_pairs(deep) == [(0, len(deep) - 1)]
    assert len(sentences.outer_pairs("(" * 200_000 + "x" + ")" * 200_000)) == 1


def test_sentences(spark, tables):
    docs = table(spark, tables, "documents").select("doc_id", "text", "lang")
    model = sentences.learn(docs.select("text", "lang"))
    own = sentences.Splitter(model)
    cut = lambda t, g="en": [t[a:b] for a, b in own.split(t, g)]
    assert cut(None) == cut("") == cut(" \n\t") == []
    assert cut("How to use\n\nIt is here. It is there!") == ["How to use", "It is here.", "It is there!"]
    assert cut("<p>One line\nis wrapped here.</p>\n<br/>\n<p>Two is next.</p>") == ["One line\nis wrapped here.", "Two is next."]
    assert cut("Items are these.\n- one thing\n* two things\n1. three") == ["Items are these.", "- one thing", "* two things", "1. three"]
    assert cut("“Too bad! Never again!” was what she said. It cost 3.5 dollars (yes, really!) and more. 👍 Next one is this.") == ["“Too bad! Never again!” was what she said.", "It cost 3.5 dollars (yes, really!) and more. 👍", "Next one is this."]
    assert cut("Wait... is that it? I waited… Then it came.") == ["Wait... is that it?", "I waited…", "Then it came."]
    assert cut("友人は「きつい。もう買わない！」と言って帰りました。次です。", "ja") == ["友人は「きつい。もう買わない！」と言って帰りました。", "次です。"]
    assert cut("แม่ซื้อมา 17 ขวดเพราะดี รุ่น 10 ของ Damon คุ้มราคา", "th") == ["แม่ซื้อมา 17 ขวดเพราะดี", "รุ่น 10 ของ Damon คุ้มราคา"]
    assert cut("यह अच्छा है। वह नहीं!", "hi") == ["यह अच्छा है।", "वह नहीं!"]
    assert cut("А. В. Иванов считает так.", "ru") == ["А. В. Иванов считает так."]
    assert cut("Q: Is it good? See Abc.example.invalid/x?id=3 for more.") == ["Q: Is it good?", "See Abc.example.invalid/x?id=3 for more."]
    got = sentences.sentences(docs.withColumn("start_char", F.lit("clash")), model).toPandas()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d, part in got.groupby("doc_id"):
        spans = sorted(zip(part.start_char, part.end_char))
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert all(not text[d][a].isspace() and not text[d][b - 1].isspace() for a, b in spans)
    assert sentences.sentences(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, "One is here. Two is here.", None), (2, "long text here. " * 20_000, "en")], "doc_id long, text string, lang string")
    assert sentences.sentences(nulls, model).count() == 2 + 1 or sentences.sentences(nulls, model).count() == 2 + 20_000
