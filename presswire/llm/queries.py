"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.llm import bpe, bytebpe, decontam, licenses, lm, merkle, minhash, periodic, pii, pu, quality_rules, warc
from presswire.llm.scratch import bounded_batches

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [F.col(f"found.{k.name}") for k in pii.BASE_KINDS]
    counts = [F.size(c).cast("long").alias(f"n_{k.name}") for c, k in zip(base, pii.BASE_KINDS, strict=True)]
    every = F.concat(*base, *(F.col(f"found.{k.name}") for k in pii.METHOD_KINDS))
    return found.select("row.doc_id", *counts, F.sha2(pii.listed(F.concat(*base)), 256).alias("base_sha256"), pii.listed(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def _classified(spark: SparkSession, sf_dir: str, label: str, folds: int, fold: int, cut: float, **how) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", lm.held_out("doc_id", folds, fold))
    labels = _table(spark, sf_dir, "labels").where(~lm.held_out("doc_id", folds, fold)).select("doc_id", F.col(label).alias("label"))
    _, found = pu.learned(docs, labels, ~F.col("held_out"), keep=["doc_id", "held_out"], **how)
    return found.select("row.*", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "quality", 3, 1, 0.5)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(spark, _table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).drop("payload", "url")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        decontam.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", lm.held_out("doc_id", 7, 2))
    return lm.lm_scores(docs, docs.where("not held_out"), keep=["doc_id", "held_out"]).select("row.*", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    own = F.transform("matches", lambda m: m["label"])
    return found.select(
        "row.doc_id",
        "n_words",
        F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def tokenizer_model() -> str:
    """The public merge-type vocabulary; on a cluster, the same file on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_model(), keep=["doc_id"], digests=True)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "toxic", 4, 2, 0.3, shape_z=pu.LEAST_Z)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    facts = [f"f.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("row.doc_id", *facts, "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    altered = merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), tampered)
    found = merkle.manifest(docs, keep={"doc_id": F.col("doc_id"), "altered": altered}).proofs
    found = found.select("row.doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("steps")).alias("proof_sha256"), merkle.folded(F.col("row.altered"), F.col("steps")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def byte_vocabulary() -> str:
    """The public byte-level vocabulary; on a cluster, the same file on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bytebpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), byte_vocabulary(), keep=["doc_id"], digests=True)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _with_copies(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by the hash of their id, with the words from a place on repeated with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    docs = docs.withColumns({"g": F.floor(h / 10), "words": F.when(h % 10 == 0, words)}).withColumn("n", F.greatest(F.size("words").cast("long"), F.lit(1)))
    docs = docs.withColumn("a", F.col("g") % F.col("n"))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    put = F.transform("words", lambda x, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(x))
    return docs.select("doc_id", F.coalesce(F.array_join(put, " "), "text").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(_with_copies(_table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    none = F.lit(None).cast(periodic.RUNS.elementType)
    # runs are in the order that ties go by, so only a greater exponent takes over
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _license_sql() -> str:
    rows = []
    for label, text in licenses.TEMPLATES:
        tokens = licenses._tokens(text)
        rows.append(f"('{label}', {tokens}, {math.ceil(licenses.THRESHOLD * len(tokens) - 1e-9)})")
    found = []
    for phrase, label in licenses.PHRASES.items():
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        found.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: {test})) - 1 AS place FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS ({" UNION ALL ".join(found)}),
b AS (SELECT doc_id, list_distinct({_WORDS.format("x")}) AS t FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.;:!?]) ', '\\1' || chr(10), 'g'), chr(10))) AS x FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(t, tokens)) / len(tokens) AS share FROM b, (VALUES {", ".join(rows)}) v(label, tokens, need) WHERE len(list_intersect(t, tokens)) >= need),
g AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(share, CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"


def _merkle_sql() -> str:
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(value, ("doc_id", "source", "lang", "n_chars")))
    up = "SELECT tree, lvl + 1, i // 3, (c + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {0} WHERE c > 1 GROUP BY tree, lvl, i // 3, c"
    fold = "SELECT id, {0}.tree, {0}.lvl + 1, {0}.i // 3, ({0}.c + 2) // 3, sha256(string_agg(CASE WHEN {1}.i = {0}.i THEN {0}.h ELSE {1}.h END, '' ORDER BY {1}.i)) FROM {0} JOIN {1} ON {1}.tree = {0}.tree AND {1}.lvl = {0}.lvl AND {1}.i // 3 = {0}.i // 3 WHERE {0}.c > 1 GROUP BY id, {0}.tree, {0}.lvl, {0}.i // 3, {0}.c"
    path = "SELECT {0}.id, '{1}' AS part, {1}.lvl, {1}.i, {1}.h FROM {0} JOIN {1} ON {1}.tree = {0}.tree AND {1}.lvl = {0}.lvl AND {1}.i // 3 = {0}.i // 3 AND {1}.i <> {0}.i WHERE {0}.c > 1"
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '-') AS tree, sha256({head} || {value("text")}) AS leaf,
    sha256({head} || CASE WHEN {_CRC} % 2 = 0 THEN {value("replace(text, chr(10), '')")} ELSE {value("text")} END) AS altered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS c FROM d),
n(tree, lvl, i, c, h) AS (SELECT tree, 0, i, c, leaf FROM l UNION ALL {up.format("n")}),
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS c FROM n WHERE c = 1),
m(tree, lvl, i, c, h) AS (SELECT '', 0, i, c, h FROM s UNION ALL {up.format("m")}),
f(id, tree, lvl, i, c, h) AS (SELECT id, tree, 0, i, c, altered FROM l UNION ALL {fold.format("f", "n")}),
g(id, tree, lvl, i, c, h) AS (SELECT id, '', 0, s.i, s.c, f.h FROM f JOIN s USING (tree) WHERE f.c = 1 UNION ALL {fold.format("g", "m")}),
p AS (SELECT id, string_agg(h, '' ORDER BY part DESC, lvl, i) AS h FROM ({path.format("f", "n")} UNION ALL {path.format("g", "m")}) GROUP BY id)
SELECT doc_id, leaf, s.h AS subroot, m.h AS root, sha256(coalesce(p.h, '')) AS proof_sha256, g.h AS folded_root, g.h = m.h AS verified
FROM l JOIN s USING (tree) JOIN m ON m.c = 1 JOIN g ON g.id = l.id AND g.c = 1 LEFT JOIN p ON p.id = l.id"""


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_license_scan": op7_license_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op11_merkle_manifest": _merkle_sql(),
    "op13_periodic_runs": f"""
WITH t AS (SELECT row_number() OVER () AS id, doc_id, {_CRC} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT *, greatest(len(w), 1) AS n, h // 10 AS g FROM t),
v AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM u),
d AS (SELECT id, doc_id, CASE WHEN h % 10 = 0 THEN list_transform(range(0, len(w)), lambda i: w[(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END) + 1]) ELSE w END AS w FROM v),
x AS (SELECT id, len(w) AS n, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
e AS (SELECT x.id, x.i, y.i - x.i AS q FROM x JOIN x y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS k FROM e) GROUP BY id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT id, start, length, min(q) AS period FROM s GROUP BY id, start, length),
m AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY id),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r),
z AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT x.id, string_agg(word, ' ' ORDER BY x.i) AS text FROM x ANTI JOIN z ON z.id = x.id AND z.i = x.i GROUP BY x.id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (id) LEFT JOIN (SELECT * FROM o WHERE k = 1) USING (id) LEFT JOIN c USING (id)""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM b),
r AS (SELECT *, payload_bytes >= 1000 AND page_id < last AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM r""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM v),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM g JOIN v USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op5_minhash_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.o) AS component_id, w.doc_id = min(r.o) AS kept
FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id""",
    "op7_license_scan": _license_sql(),
    "op10_quality_rules": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM g),
d AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, ln, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words
    OR 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 50 * word_chars
    OR 100 * length(regexp_replace(text, '[^0-9]+', '', 'g')) > 60 * word_chars
    OR (len(ln) >= 4 AND 100 * len(list_filter(ln, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) > 90 * len(ln))
    OR (len(ln) >= 4 AND 100 * n_dup_lines > 50 * len(ln)) OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b""",
}
