"""Sources, sinks, streams, spans, models and taxonomy on small inputs."""

import gzip
import hashlib
import io
import itertools
import lzma
import tarfile
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgeline.functions import spans
from sedgeline.operators import ingest, models, taxonomy
from sedgeline.plans import views
from sedgeline.plans.queries import QUERIES
from sedgeline.sources import readers, sinks
from sedgeline.streaming import ingest as streams

LINES = '{"a": "1", "b": "x", "extra": 3}\n\n{"a": "2"}\n'
SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


@pytest.mark.parametrize("suffix,opener", [(".jsonl", open), (".jsonl.gz", gzip.open), (".jsonl.xz", lzma.open)])
def test_json_lines(spark, tmp_path, suffix, opener):
    path = tmp_path / f"x{suffix}"
    with opener(path, "wt") as f:
        f.write(LINES)
    got = readers.json_lines(spark, str(path), SCHEMA, staging=str(tmp_path / "stage")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [("1", "x"), ("2", None)]


def test_bad_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text(LINES + "not json\n[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        readers.json_lines(spark, str(path), SCHEMA).collect()
    got = readers.json_lines(spark, str(path), SCHEMA, strict=False).where("_corrupt is not null").collect()
    assert sorted(r["_corrupt"] for r in got) == ["[1]", "not json"]


def test_numbered_and_filters(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("k")).repartition(5)
    assert sorted(r["source_record_index"] for r in readers.numbered(df).collect()) == list(range(100))
    df.write.parquet(str(tmp_path / "p"))
    rows = lambda f: readers.parquet_rows(spark, str(tmp_path / "p"), ["id"], f).count()
    assert rows({"k": ["0", "1"]}) == 67 and rows({"k": []}) == 0 and rows({"k": "2"}) == 33
    with pytest.raises(ValueError, match="column"):
        rows({"k; drop": 1})


def test_config_and_archive(tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert readers.config(str(tmp_path / "c.json"), {"a"}) == {"a": 1}
    with pytest.raises(ValueError, match="missing or unknown"):
        readers.config(str(tmp_path / "c.json"), {"a", "b"})
    path = str(tmp_path / "x.tar.gz")
    with tarfile.open(path, "w:gz") as t:
        i = tarfile.TarInfo("m")
        i.size = 3
        t.addfile(i, io.BytesIO(b"abc"))
    assert readers.audit_archive(path, {"m": hashlib.sha256(b"abc").hexdigest(), "n": ""}) == {"m": "ok", "n": "missing"}


def test_atomic_writes(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write_all({a: spark.range(3), b: spark.range(4)})
    sinks.write_parquet(spark.range(5), a)
    assert spark.read.parquet(a).count() == 5 and spark.read.parquet(b).count() == 4
    bad = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_all({a: spark.range(9), b: bad})
    assert spark.read.parquet(a).count() == 5
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a", "b"]


def test_csv_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", ["x"]), (2, "a|b", None)], "n int, t string, l array<string>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(r["t"] for r in readers.by_suffix(spark, str(tmp_path / "c") + "/*.csv").collect()) == ["'=1+1", "a|b"]
    assert "| 2 | a\\|b |" in sinks.markdown_table(df.select("n", "t"))
    sinks.write_report({"n": 1}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == '{\n  "n": 1\n}\n'


def test_streams(spark, tmp_path):
    raw = [("5", "t", "x", "A", "P", "u", str(1672531200000 + i // 2 * 1000), "1", "true", i) for i in range(6)] + [("9", "t", "x", "A", "P", "u", "1672531200000", "1", "true", 9)]
    df = spark.createDataFrame(raw, T.StructType([*ingest.RAW.fields[:6], T.StructField("timestamp", T.StringType()), T.StructField("helpful_vote", T.StringType()), T.StructField("verified_purchase", T.StringType()), T.StructField("source_record_index", T.LongType())]))
    df.write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), df.schema)
    own = streams.canonical_stream(stream, "v", "c", "2022-12-01", "2023-02-01")
    assert streams.drain(own, "canonical_test").count() == 3
    events = spark.createDataFrame([(i, "x") for i in range(0, 20_000, 100)], "s long, k string").select(F.timestamp_seconds("s").alias("ts"), "k")
    events.write.parquet(str(tmp_path / "ev"))
    counts = streams.windowed_counts(streams.file_stream(spark, str(tmp_path / "ev"), events.schema), "ts", ["k"])
    got = streams.drain(counts, "window_test")
    assert got.count() >= 1 and got.agg(F.max("n")).first()[0] == 36


def test_spans_and_grounding(spark):
    text = "It is good. I like the scent!  Bad cap\nnew line"
    assert [text[a:b] for a, b in spans.pieces(text)] == ["It is good.", "I like the scent!", "Bad cap", "new line"]
    i = text.index("scent")
    assert spans.context_of(text, [{"start": i, "end": i + 5, "text": "scent"}]) == "I like the scent!"
    with pytest.raises(ValueError, match="does not stand"):
        spans.context_of(text, [{"start": 0, "end": 5, "text": "scent"}])
    for phrase in ("the scent", '"the scent"', "THE  scent", "I like teh scent!"):
        a, b = spans.ground(phrase, text)
        assert "scent" in text[a:b]
    assert spans.ground("nothing of that kind", text) is None
    df = spark.createDataFrame([(text, [(i, i + 5, "scent")]), (None, None)], "t string, e array<struct<start:int,end:int,text:string>>")
    assert [r[0] for r in df.select(spans.aspect_context("t", "e")).collect()] == ["I like the scent!", None]


def test_models(spark):
    rows = [(f"r{i}", f"p{i % 7}", "lovely great scent" if i % 2 else "broken bad pump", "positive" if i % 2 else "negative", ["scent"] if i % 2 else ["pump"]) for i in range(80)]
    df = spark.createDataFrame(rows, "review_id string, parent_asin string, text string, label string, labels array<string>")
    p, m = models.select_penalty(df, "text", "label", [0.01, 10.0], df, 1)
    got = models.predict(m, df, "text", "label")
    assert got.where("label = predicted_label").count() == 80 and {"score_negative", "score_positive"} <= set(got.columns)
    found = models.out_of_fold(df, ["scent", "pump", "absent"], k=2)
    truth = {(r[0], r[4][0]) for r in rows}
    assert {(r["review_id"], r["aspect_id"]) for r in found.collect()} == truth
    alias = spark.createDataFrame([("r1", "scent"), ("r1", "pump")], "review_id string, aspect_id string")
    both = {(r["review_id"], r["aspect_id"]): r["sources"] for r in models.hybrid_mentions(alias, found).collect()}
    assert both["r1", "scent"] == ["alias", "model"] and both["r1", "pump"] == ["alias"] and both["r0", "pump"] == ["model"]


def test_lsa(spark):
    df = spark.createDataFrame([("a", "broken spray pump"), ("b", "spray pump leaks"), ("c", "lovely scent of rose"), ("d", "rose scent")], "k string, t string")
    v = {r["k"]: r["embedding"] for r in models.lsa_vectors(df, "k", "t", 2).collect()}
    dot = lambda x, y: sum(p * q for p, q in zip(v[x], v[y]))
    assert dot("a", "b") > 0.9 > dot("a", "d") and dot("c", "d") > 0.9


def test_lsa_embeds_every_row(spark):
    df = spark.createDataFrame([("a", "broken spray pump"), ("b", "spray pump leaks"), ("c", "запах розы"), ("d", "запах свежий розы"), ("e", None), ("f", ""), ("g", "a the")], "k string, t string")
    v = {r["k"]: r["embedding"] for r in models.lsa_vectors(df, "k", "t", 2).collect()}
    assert set(v) == set("abcdefg") and all(v[x] == [0.0, 0.0] for x in "efg")
    assert all(abs(sum(x * x for x in v[y]) - 1) < 1e-6 for y in "abcd") and sum(p * q for p, q in zip(v["c"], v["d"])) > 0.9


def test_latent_vectors_recall(spark, tables):
    """The ten nearest of every tenth review against those of the exact decomposition of all its texts."""
    texts = views.reviews(spark, tables).select("review_id", "text").toPandas()
    got = QUERIES["latent_vectors"](spark, tables).toPandas()
    assert sorted(got.review_id) == sorted(texts.review_id)
    docs = [models.latent_terms(t) for t in texts.text]
    n, df, tf = sum(len((t or "").strip()) >= 2 for t in texts.text), Counter(t for d in docs for t in d), Counter()
    for d in docs:
        tf.update(d)
    kept = sorted(sorted((t for t in df if 3 <= df[t] <= 0.995 * n), key=lambda t: (-tf[t], t))[: 30_000])
    m = np.zeros((len(docs), len(kept)))
    place = {t: i for i, t in enumerate(kept)}
    for i, d in enumerate(docs):
        for t, c in d.items():
            if t in place:
                m[i, place[t]] = (1 + np.log(c)) * (np.log((1 + n) / (1 + df[t])) + 1)
    scaled = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    m = scaled(m)
    want = scaled(m @ np.linalg.svd(m, full_matrices=False)[2][:128].T)
    own = np.stack(got.set_index("review_id").embedding.loc[texts.review_id])
    assert own.shape == (len(texts), 128)
    hits = [(len(set(np.argsort(-own @ own[i], kind="stable")[:10]) & {j for j, x in enumerate(want @ want[i]) if x >= np.sort(want @ want[i])[-10] - 1e-3})) / 10 for i in range(0, len(own), 10)]
    assert np.mean(hits) >= 0.95


def test_taxonomy(spark):
    o = spark.createDataFrame([("r1", "p1", "Nice Scent", "t", 2.0, 1), ("r1", "p1", "nice scent!", "t", 2.0, 1), ("r2", "p2", "nice scent", None, 1.0, 2), ("r3", "p1", "Cap", "t", 1.0, 12), ("r4", "p1", "--", "t", 1.0, 3)], "review_id string, parent_asin string, label string, topic_type string, weight double, batch long")
    c = {r["candidate_key"]: r for r in taxonomy.candidates(o).collect()}
    assert c["nice scent"]["weighted_support"] == 3.0 and c["nice scent"]["reviews"] == 2 and c["nice scent"]["eligible"] and not c["cap"]["eligible"]
    assert c["nice scent"]["topic_types"] == {"t": 2, "unknown": 1} and c["nice scent"]["support_rank"] == 1
    s = taxonomy.saturation(o, "batch").orderBy("checkpoint").collect()
    assert [(r["checkpoint"], r["candidates"], r["new_candidates"]) for r in s] == [(1, 1, 1), (2, 1, 0), (3, 2, 1)]
    owners = spark.createDataFrame([("nice scent", "scent")], "candidate_key string, aspect_id string")
    assert [r["candidate_key"] for r in taxonomy.uncovered(taxonomy.candidates(o), owners).collect()] == ["cap"]
    assert taxonomy.proposal(o, owners).first()["evidence_ids"] == ["r1", "r2"]
    assert [r["aspects"] for r in taxonomy.training_labels(o, owners).collect()] == [["scent"], ["scent"]]
    b = taxonomy.batches(spark.createDataFrame([(f"r{i}", "a" if i < 6 else "b") for i in range(8)], "review_id string, s string"), "s", 4).collect()
    assert sorted(r["batch"] for r in b) == [0] * 4 + [1] * 4 and {r["s"] for r in b if r["batch"] == 0} == {"a", "b"}


def test_context_sentiment(spark):
    rows = [("lovely great scent" if i % 2 else "broken bad pump", "positive" if i % 2 else "negative") for i in range(40)]
    m = models.train(spark.createDataFrame(rows, "text string, label string"), "text", "label", 1)
    text = "A broken bad pump. But a lovely great scent!"
    reviews = spark.createDataFrame([("r1", text)], "review_id string, text string")
    spot = lambda w: [(w, text.index(w), text.index(w) + len(w))]
    mentions = spark.createDataFrame([("r1", "pump", spot("pump")), ("r1", "scent", spot("scent"))], "review_id string, aspect_id string, evidence array<struct<text:string,start:int,end:int>>")
    got = {r["aspect_id"]: r for r in models.score_contexts(m, mentions, reviews).collect()}
    assert got["pump"]["aspect_context"] == "A broken bad pump." and got["pump"]["aspect_sentiment"] == "negative"
    assert got["scent"]["aspect_sentiment"] == "positive" and got["scent"]["aspect_sentiment_score"] > 0.5


def test_queue_and_sets(spark):
    from sedgeline.operators import checks, sampling

    df = spark.createDataFrame([(f"r{i}", "=x") for i in range(5)], "review_id string, text string")
    q = sampling.annotation_queue(df, "review_id", "eval").collect()
    assert sorted(r["row_id"] for r in q) == [f"eval:000{i}" for i in range(1, 6)] and {r["text"] for r in q} == {"'=x"}
    assert [r["review_id"] for r in sorted(q, key=lambda r: r["row_id"])] == [r["review_id"] for r in sorted(sampling.annotation_queue(df.repartition(3), "review_id", "eval").collect(), key=lambda r: r["row_id"])]
    other = spark.createDataFrame([("r1",), ("r9",), ("r9",)], "review_id string")
    assert tuple(checks.set_relation(df, other, "review_id").first()) == (4, 1, 1)


def test_keys_union_and_sorted_files(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 7}", i) for i in range(70)], "k string, n int")
    sinks.write_parquet(df, str(tmp_path / "t"), order=["n"], group_bytes=1 << 20)
    keys = spark.createDataFrame([("k1",), ("k1",), (None,), ("none",)], "k string")
    got = readers.rows_of_keys(spark, str(tmp_path / "t"), ["n"], keys, "k")
    assert got.columns == ["n"] and sorted(r["n"] for r in got.collect()) == list(range(1, 70, 7))
    assert readers.rows_of_keys(spark, str(tmp_path / "t"), ["n"], keys.limit(0), "k").count() == 0
    files = sorted((tmp_path / "t").glob("*.parquet"))
    spans = [(t["n"].min(), t["n"].max(), t["n"].is_monotonic_increasing) for t in map(pd.read_parquet, files) if len(t)]
    assert all(x[2] for x in spans) and all(a[1] < b[0] for a, b in itertools.pairwise(sorted(spans)))
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n')
    (tmp_path / "b.jsonl").write_text('{"y": "z", "x": 2.5}\n')
    rows = {(r["x"], r["y"]) for r in readers.union_by_name(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).collect()}
    assert rows == {(1.0, None), (2.5, "z")}
    with pytest.raises(ValueError):
        readers.union_by_name(spark, [])


def test_char_grams(spark):
    df = spark.createDataFrame([("Ab c",), ("",), (None,)], "t string")
    got = [list(r[0]) for r in df.select(models.char_grams("t")).collect()]
    assert got == [[" ab", "ab ", " ab ", " ab ", " c ", " c ", " c "], [], []]
