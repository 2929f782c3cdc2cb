"""What is worked out once for each text, or stops early, gives what the plain way gives."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from presswire.operators import results, textindex, vectors
from presswire.operators.results import NOISE


def test_soft_relevance_prepares_a_text_once(spark):
    texts = ["Court ruling on asylum, today", "football odds\nof the week", "nothing", None, "weather for Court"]
    rows = [(i, t, (t or "") + f" {NOISE[i]}ing" * (i % 2), f"http://x/{i}/policy/", "a.gov" if i == 2 else "x.com", [t or ""]) for i, t in enumerate(texts)]
    articles = spark.createDataFrame(rows, "article_id long, title_norm string, clean_text string, url string, source_domain string, entities array<string>")
    queries = spark.createDataFrame([(1, "court asylum ruling"), (2, "football weather"), (3, None)], "query_id long, query string")
    found = queries.select("query_id").crossJoin(articles.select("article_id"))
    one = results.soft_relevance(found, queries, 3, articles=articles)
    two = results.soft_relevance(found.join(articles, "article_id"), queries, 3)
    picked = lambda df: sorted(df.select("query_id", "article_id", "soft_score").collect())
    assert picked(one) == picked(two)
    scores = {(r.query_id, r.article_id): r.soft_score for r in one.collect()}
    assert scores[3, 2] == 2.5 and scores[3, 1] == -1.5  # noise takes from what has little else


def test_places_are_those_of_word_boundaries():
    r = random.Random(3)
    for _ in range(2_000):
        text = "".join(r.choice("ab_é1 .-'") for _ in range(r.randrange(40)))
        word = "".join(r.choice("abé1_") for _ in range(r.randrange(1, 4)))
        assert list(results._places(text, word)) == [m.start() for m in re.finditer(rf"\b{re.escape(word)}\b", text)]


def test_match_context_stops_after_the_first(spark, monkeypatch):
    seen, real = [], results._places
    monkeypatch.setattr(results, "_places", lambda text, word: (seen.append(p) or p for p in real(text, word)))
    df = spark.createDataFrame([(1, 1, "aa bb " * 500, "AA bb cc")], "query_id long, article_id long, clean_text string, query string")
    rows = results.query_match_context(df).orderBy("position").collect()
    assert [(x.position, x.term) for x in rows] == [(0, "aa"), (3, "bb"), (6, "aa")]


def test_marks_say_what_texts_say(spark):
    texts = ["A b c d", "a b c d e (reuters) ", "", None, "x y", "b c d a http://z.com"]
    pairs = [(s, t, u, v) for s in texts for t in texts for u, v in (("q", "w"), (s, t))]
    df = spark.createDataFrame(pairs, "title_a string, title_b string, body_a string, body_b string")
    from presswire.functions.text import clean_for_hash, title_jaccard

    marks = df.select("*", *(textindex.duplicate_marks(clean_for_hash(F.col(f"title_{k}")), clean_for_hash(F.col(f"body_{k}"))).alias(k) for k in "ab"))
    assert marks.where(F.abs(textindex.alike(F.col("a.title"), F.col("b.title")) - title_jaccard(F.col("title_a"), F.col("title_b"))) > 1e-12).isEmpty()
    own = textindex.is_duplicate(df.distinct())
    assert own.columns == [*df.columns, "duplicate"] and own.where("duplicate").count() > 0


def test_products_are_held_in_small_steps(monkeypatch):
    r = np.random.default_rng(1)
    q, m = vectors.unit(r.normal(size=(50, 8))), vectors.unit(r.normal(size=(300, 8)))
    args = np.arange(50), q, np.arange(300), m, 4
    want = vectors._local_best(*args)
    monkeypatch.setattr(vectors, "CELLS", 700)
    assert vectors._local_best(*args).equals(want)


def test_diverse_rows_come_from_vectors_as_they_are(monkeypatch):
    import pyarrow as pa

    from presswire.operators import ranking

    r = np.random.default_rng(2)
    n = 60
    vectors = [None if i % 13 == 0 else r.normal(size=4).astype(np.float32).tolist() for i in range(n)]
    days = [None if i % 11 == 0 else int(r.integers(0, 30)) * 3_600_000_000 for i in range(n)]
    domains = [r.choice(["a.com", "a.org", "news.b.com", "", "c"]) if i % 7 else None for i in range(n)]
    score, rank = np.sort(r.random(n))[::-1].copy(), np.arange(1, n + 1)

    def alike(i, j):
        a, b = ((domains[k] or "") for k in (i, j))
        cos = float(np.dot(vectors[i], vectors[j]) / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j])) if vectors[i] and vectors[j] else 0.0
        near = 0.2 * np.exp(-abs(days[i] - days[j]) / 3.6e9 / 12) if None not in (days[i], days[j]) else 0.0
        return max(cos, near, 0.3 * (1.0 if a == b else 0.8 if "".join(a.split(".")[-2:-1]) == "".join(b.split(".")[-2:-1]) else 0.0))

    want = [0]
    while len(want) < 12:
        want.append(max((i for i in range(n) if i not in want), key=lambda i: (0.6 * score[i] - 0.4 * max(alike(i, j) for j in want), -i)))
    order = r.permutation(n)  # rows come in any order
    take = lambda x: [x[i] for i in order]
    rows = pa.table({"score": score[order], "rank": rank[order], "source_domain": pa.array(take(domains), pa.string()), "published_at": pa.array(take(days), pa.timestamp("us", "UTC")), "embedding": pa.array(take(vectors), pa.list_(pa.float32()))})
    for step in (7, 20_000):
        monkeypatch.setattr(ranking, "MMR_ROWS", step)
        assert [int(order[i]) for i in ranking.mmr_rows(rows, 12, 0.6)] == want
    bare = rows.set_column(4, "embedding", pa.array([None] * n, pa.list_(pa.float32())))
    assert len(ranking.mmr_rows(bare, 12, 0.6)) == 12


def test_relations_are_worked_out_before_names_become_rows(spark):
    from presswire.plans.q_joins import j8_entity_cooccurrence

    plan = j8_entity_cooccurrence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "invest|fund|acqui" not in plan


def test_vectors_of_chunks_come_without_dealing_out_texts(spark):
    from presswire.plans import fixtures

    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with a large table of vectors
    try:
        chunks = fixtures.chunks(spark, "/root/testdata/sf0.001")
        plan = chunks._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and chunks.where("embedding IS NOT NULL").count() > 0
    finally:
        spark.conf.set(key, old)


def test_pairs_of_words_are_counted_before_they_become_rows(spark, monkeypatch):
    from presswire.operators import joins

    r = random.Random(4)
    rows = [([r.choice(["a", "é", "Z", "z", "", None]) for _ in range(r.randrange(9))],) for _ in range(60)] + [(None,), ([],)]
    df = spark.createDataFrame(rows, "words array<string>").coalesce(1)
    want = {}
    for (words,) in rows:
        n = len(words or [])
        for i in range(n):
            for k in range(i + 1, min(i + 4, n)):
                if None not in (words[i], words[k]) and words[i] != words[k]:
                    pair = tuple(sorted((words[i], words[k]), key=str.encode))
                    want[pair] = want.get(pair, 0) + sum(s <= i and k < s + 4 for s in range(n - 3))
    for step in (7, 500_000):
        monkeypatch.setattr(joins, "WORDS", step)
        out = joins.word_cooccurrence(df)
        assert {(x["a"], x["b"]): x["weight"] for x in out.collect()} == {k: v for k, v in want.items() if v >= 2}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_given_on_a_few_at_a_time(spark, monkeypatch):
    import pandas as pd

    from presswire.operators import pages

    class Kept:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            return run(iter([pd.DataFrame({"page_id": range(250), "url": "http://x.com", "html": "<p>x</p>"})]))

    assert [len(x) for x in pages.extract_pages(Kept())] == [100, 100, 50]


def test_all_entities_meet(spark, monkeypatch):
    from presswire.operators import joins

    r = random.Random(6)
    kinds = ["mentions", "influences", "relates_to", None]
    docs = {d: (kinds[d % 4], [f"E{r.randrange(300)}é"[: r.randrange(3, 6)] for _ in range(r.randrange(60))]) for d in range(40)}
    docs[50] = ("mentions", [f"N{i}" for i in range(260)])
    rows = [(d, e, k) for d, (k, names) in docs.items() for e in [*names, None]]
    want = {}
    for k, names in docs.values():
        names = sorted(set(names), key=str.encode)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                n, least = want.get((a, b), (0, None))
                want[a, b] = n + 1, min([v for v in (k, least) if v], default=None)
    df = spark.createDataFrame(rows, "doc_id long, entity string, relation string")
    for step in (7, 4_000_000):
        monkeypatch.setattr(joins, "PAIRS", step)
        found = joins.entity_cooccurrence(df if step > 7 else df.where("doc_id < 50")).collect()
        assert {(x.a, x.b): (x.docs, x.relation) for x in found} == {p: v for p, v in want.items() if step > 7 or p[0][0] == "E"}
        assert all(x.weight == min(1.0, x.docs / 5) for x in found)
