"""The registered queries of the subpackage: against their SQL, and on tables that are empty, all null, or have clashing names."""

import math
import os

import pytest

from presswire.llm import bpe, bytebpe, decontam, licenses, lm, merkle, minhash, periodic, pii, pu, quality_rules, queries, warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    """All rows of the table are there; where there is SQL, its rows."""
    import duckdb

    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=repr)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    if name in queries.ORACLE:
        cursor = con.execute(queries.ORACLE[name])
        names = [d[0] for d in cursor.description]
        own = [names.index(c) for c in columns if c in names]
        kept = [i for i, c in enumerate(columns) if c in names]
        assert set(names) <= set(columns)
        assert sorted((tuple(r[i] for i in kept) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in own) for r in cursor.fetchall()), key=repr)
    else:
        assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]


@needs_tables
def test_scores_hold_on_labels_held_out(spark):
    """Quality and toxicity on rows whose labels weren't learned from."""
    labels = spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/labels.parquet")
    for name, label, least in (("op2_quality_classifier", "quality", 0.9), ("op9_toxicity", "toxic", 0.9)):
        met = queries.QUERIES[name](spark, f"{SF.rsplit('/', 1)[0]}/sf0.01").where("held_out").join(labels, "doc_id").select("predicted", label).collect()
        assert sum(r["predicted"] == r[label] for r in met) / len(met) >= least, name


OPERATORS = {
    "pii": lambda d, s: pii.with_spans(d),
    "masking": lambda d, s: pii.without_pii(d),
    "pu": lambda d, s: pu.learned(d, s.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int"), pu.F.lit(True))[1],
    "decontam": lambda d, s: decontam.contamination(d, s.createDataFrame([(1, "some words here")], "item_id long, text string")),
    "minhash": lambda d, s: minhash.near_duplicates(d),
    "deduplicated": lambda d, s: minhash.without_near_duplicates(d),
    "lm": lambda d, s: lm.lm_scores(d, d),
    "licenses": lambda d, s: licenses.license_scan(d),
    "bpe": lambda d, s: bpe.encoded(d, queries.tokenizer_model()),
    "bytebpe": lambda d, s: bytebpe.encoded(d, queries.byte_vocabulary()),
    "merkle": lambda d, s: merkle.manifest(d, fields=("doc_id", "row", "text"), tree_col="label").proofs,
    "periodic": lambda d, s: periodic.with_runs(d),
    "judged": lambda d, s: quality_rules.judged(d),
    "rules": lambda d, s: quality_rules.passing(d),
}
FEWER = {"deduplicated", "rules"}
#: Names that the operators use themselves, as columns of the table.
CLASHING = "doc_id long, text string, row string, h long, n long, component string, hits long, found string, score double, w string, f string, id string, bands string, u string, label string"


def values(rows, odd_names=False):
    """What an operator says of each row, by the row's id and text; of the row itself only those two."""
    out = []
    for r in rows:
        r = r.asDict(recursive=True)
        row = r.pop("row") if isinstance(r.get("row"), dict) else r
        own = {k: v for k, v in r.items() if row is not r}
        out.append(repr((row.get("doc_id", r.get("id")), row.get("text"), sorted((k, plain(v)) for k, v in own.items() if k not in ("row", "doc_id", "text")))))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, name):
    """No rows; rows of nulls alone; repeated rows; columns with names that the operator uses, which change nothing of what it finds."""
    width = CLASHING.count(",") - 1
    row = (1, "the same words stand here twice and once more again", *["x", 1, 2, "x", 3, "x", 0.5, "x", "x", "x", "x", "x", "x"][:width])
    for rows, want in (([], 0), ([(None,) * (width + 2)] * 3, 3), ([row, row, (2, *row[1:]), (3, "", *row[2:])], 4)):
        got = OPERATORS[name](spark.createDataFrame(rows, CLASHING), spark).collect()
        assert len(got) == want if name not in FEWER else len(got) <= want
        if name in ("pu", "merkle") or want < 4:  # a fit, and leaves over other columns; nothing to tell apart
            continue
        without = OPERATORS[name](spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark).collect()
        assert values(got) == values(without)
        if name in FEWER and got:
            kept = [tuple(r) for r in got]
            assert all(k in rows for k in kept)


LONG_WORDS = 260_000


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"pu", "merkle", "licenses", "lm"}))
def test_a_text_of_over_a_megabyte(spark, name):
    """A text longer than any run or batch among short ones: the short ones' results are as without it."""
    short = [(1, "the same words stand here twice and once more again"), (2, None), (3, "another text of ten words that no one else has")]
    long = (9, " ".join(f"w{i % 9_973}" for i in range(LONG_WORDS)))
    schema = "doc_id long, text string"
    got = OPERATORS[name](spark.createDataFrame([*short, long], schema).repartition(1), spark)
    alone = OPERATORS[name](spark.createDataFrame(short, schema), spark)
    of = lambda df: values([r for r in df.collect() if (r["row"]["doc_id"] if "row" in r and not isinstance(r["row"], str) else r["doc_id"] if "doc_id" in r else r["id"]) != 9])
    assert of(got) == of(alone)
    assert name in FEWER or got.count() == 4


def test_bounds_of_broadcasts_change_nothing(spark, monkeypatch, tmp_path):
    """With no room for any broadcast the same documents are kept and linked, and the same pages revisit others."""
    from presswire.operators import graph

    texts = [" ".join(f"w{(i // 7) * 50 + k}" for k in range(40)) + (" end" if i % 7 == 3 else "") for i in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pages = spark.createDataFrame([(i, "u", "p" * (1_000 + i // 5)) for i in range(30)], "page_id long, url string, html string")

    def found(k):
        near = sorted((r["id"], r["component"], r["n_shingles"]) for r in minhash.near_duplicates(docs).collect())
        kept = sorted(r["doc_id"] for r in minhash.without_near_duplicates(docs).collect())
        index = warc.archive(spark, pages, f"file://{tmp_path}/{k}")
        return near, kept, sorted((r["page_id"], r["record_type"], r["refers_to"] or -1) for r in warc.read_records(index).collect())

    before = found(1)
    for module, bound in ((minhash, "MAX_BROADCAST_IDS"), (warc, "MAX_BROADCAST_IDS"), (graph, "MAX_BROADCAST_NODES")):
        monkeypatch.setattr(module, bound, 0)
    assert found(2) == before and len(before[1]) == 10


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Every stage on no rows, rows of nulls, repeated rows and further columns whose names the operators use: rows go or stay whole."""
    import corpus_pipeline

    spark.createDataFrame([(1, "a passage of the benchmark that has more than ten words in a row")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "an ordinary text that says something of its own in more than ten words"
    more = "component string, h long, found string, ids string, w string"
    rows = [(1, text, "en", "s", 71, "c", 1, "f", "i", "w"), (1, text, "en", "s", 71, "c", 1, "f", "i", "w"), (2, f"{text} indeed, and me@x.org too", None, None, None, None, None, None, None, None), (None, text, "en", "s", 71, "c", 1, "f", "i", "w")]
    for table, schema in (([], DOCUMENT), ([(None,) * 5] * 2, DOCUMENT), ([r[:5] for r in rows], DOCUMENT), (rows, f"{DOCUMENT}, {more}")):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            kept = out.collect()
            own = [tuple(r[c] for c in docs.columns if c not in ("text", "ids")) for r in kept]
            mine = [tuple(v for v, c in zip(r, docs.columns, strict=True) if c not in ("text", "ids")) for r in table]
            assert all(r in mine for r in own), name
            if name in ("pii", "sentencepiece", "decontamination"):
                assert len(kept) == len(table), name
            if name == "quality_rules":
                assert len(kept) == sum(r[1] is not None for r in table)
            if name == "minhash_dedup" and rows[0][:5] in [r[:5] for r in table]:
                assert sum(r["doc_id"] == 1 for r in kept) == 1
            if name != "sentencepiece":
                assert out.columns == docs.columns, name


def test_odd_pages(spark, tmp_path):
    """Archives of no pages, of nulls alone, and of pages with columns that records have."""
    schema = "page_id long, url string, html string, payload string, digest string, refers_to string, bundle string"
    for k, (rows, want) in enumerate((([], 0), ([(None,) * 7] * 2, 2), ([(1, "u", "h", "p", "d", "r", "b")] * 2, 2))):
        index = warc.archive(spark, spark.createDataFrame(rows, schema), f"file://{tmp_path}/{k}")
        assert warc.read_records(index).count() == warc.read_bundles(index).count() == want
