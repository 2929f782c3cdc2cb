"""Steps that grew too fast: stages of a first batch, postings in order, words counted where they are read, statuses without cleaning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from presswire.functions import text as t
from presswire.operators import pages, textindex, vectors
from presswire.sources.scratch import new_path
from presswire.streaming import jobs


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_first_batch_is_stored_with_a_file_for_each_bucket_and_not_kept(spark):
    base, kept = new_path(spark, "first"), spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = spark.range(2_000, numPartitions=8).select((F.col("id") % 700).cast("string").alias("k"), "id")
    got = jobs.store_new(rows, base, 0, "k", [F.col("id")])
    assert sorted(int(r["id"]) for r in got.collect()) == list(range(700))
    files = got.select(F.input_file_name().alias("f")).distinct().count()
    assert files == got.select(F.pmod(F.xxhash64("k"), F.lit(jobs.BUCKETS))).distinct().count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    more = jobs.store_new(rows.unionByName(spark.range(5).select(F.lit("new").alias("k"), "id")), base, 1, "k", [F.col("id")])
    assert [(r["k"], r["id"]) for r in more.collect()] == [("new", 0)]


def test_postings_leave_a_task_in_order_of_term_and_id(spark):
    docs = spark.createDataFrame([(9, "en", "pear apple the pear"), (3, "en", "zebra apple"), (5, None, "the é ähre apple"), (7, "en", None)], "id long, lang string, text string").coalesce(1)
    for stems in (False, True):
        rows = textindex.build_text_index(docs, "id", "text", "lang", stems).collect()
        keys = [(r["term"].encode(), r["id"]) for r in rows]
        assert keys == sorted(keys)
    got = {(r["term"], r["id"]): (r["length"], r["positions"]) for r in textindex.build_text_index(docs, "id", "text", "lang").collect()}
    assert got == {("pear", 9): (3, [0, 3]), ("apple", 9): (3, [1]), ("zebra", 3): (2, [0]), ("apple", 3): (2, [1]), ("the", 5): (4, [0]), ("é", 5): (4, [1]), ("ähre", 5): (4, [2]), ("apple", 5): (4, [3])}


def test_chunks_get_vectors_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", [0.5, 0.25]), (3, None, None), (4, "", None)], "id int, text string, embedding array<float>").coalesce(1)
    done = vectors.embed_chunks(rows, "text", 40)
    assert "Union" not in done._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["embedding"] for r in done.collect()}
    assert got[2] == [0.5, 0.25]
    for i, text in ((1, "a"), (3, ""), (4, "")):
        assert got[i] == np.array(vectors.hash_embedding(text, 40), np.float32).tolist()
    other = vectors.embed_chunks(rows, "text", 1, lambda text, dim: [1.0] * (1 if text else 2))
    assert {r["id"]: r["embedding"] for r in other.collect()} == {1: [1.0], 2: [0.5, 0.25], 3: None, 4: None}


def test_status_counts_the_words_that_cleaning_leaves(spark):
    bits = ["word", " ", "\n", "a-b", "–", "@me", "x@y.z", "[in a b", "c]", "(d e)", "http://x.y/z", "www.q", "#tag", "\t"]
    pick = lambda i: F.element_at(F.array(*map(F.lit, bits)), (F.pmod(F.xxhash64("id", i), F.lit(len(bits))) + 1).cast("int"))
    texts = spark.range(300).select(F.array_join(F.transform(F.sequence(F.lit(1), 350 + F.col("id").cast("int")), pick), "").alias("x"))
    texts = texts.unionByName(spark.createDataFrame([("w " * n,) for n in (0, 199, 200, 1_500)] + [("lo" * 2_000 + " w" * 199,), ("lo" * 2_000 + " w" * 198,), ("-" * 200,), ("-" * 199,), (None,)], "x string"))
    plain = F.size(F.array_remove(F.split(t.clean_text(F.col("x")), " "), ""))
    found = texts.select("x", t.article_status(F.lit("title"), F.col("x")).alias("got"), F.when(plain < 200, "partial").otherwise("stored").alias("want")).collect()
    assert [(r["x"], r["got"]) for r in found if r["got"] != r["want"]] == [] and {r["want"] for r in found} == {"partial", "stored"}
    # words of texts without clutter are counted, nothing is replaced for them
    assert t.clean_words(F.lit("x"))._jc.toString().startswith("CASE WHEN")


def test_keywords_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "Pear apple pear with zebra apple kiwi éclair"), (2, None), (3, "fig")], "id long, text string")
    found = textindex.keywords(docs, "id", "text", ("with",), 3)
    assert _exchanges(found) == 0
    assert [(r["id"], r["word"], r["n"], r["rank"]) for r in found.collect()] == [(1, "pear", 2, 1), (1, "apple", 2, 2), (1, "zebra", 1, 3)]


def test_pages_are_dealt_once_at_most_and_cleaned_once(spark):
    html = "<html><head><title>T</title></head><body><article><p>Pears pears apples [x] a-b subscribe</p></article></body></html>"
    got = pages.parse_articles(spark.createDataFrame([(1, "http://a.b/c", html)], "page_id long, url string, html string"), spark.createDataFrame([("http://a.b/c", "E", "2024-01-30")], "url string, title string, published string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("\\[.*?\\]") <= 2  # once for the text itself, once to count what a second cleaning leaves
    r = got.first()
    assert (r["keywords"], r["text"], r["words"], r["minutes"], r["status"], r["reason"], r["paywalled"]) == (["pears", "apples", "subscribe"], "Pears pears apples a - b subscribe", 7, 1, "partial", "paywalled", True)


def test_hybrid_search_writes_no_positions(spark, monkeypatch):
    from presswire.plans import q_graph

    seen, real = {}, q_graph.written
    monkeypatch.setattr(q_graph, "written", lambda df, name: real(seen.setdefault(name, df), name))
    assert q_graph.v5_hybrid_search(spark, "/root/testdata/sf0.001").count() > 0
    assert "positions" not in seen["index"].columns and "tf" in seen["index"].columns
