"""The text index: stems, batches, merges, expressions and covers against plain Python."""

import itertools
import random
import re

import pytest

from presswire.functions import stems
from presswire.operators import textindex as ti
from presswire.sources.scratch import new_path

#: Examples that Porter's paper gives, with the stems of the whole procedure.
PORTER = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil""".split()


@pytest.mark.parametrize(("word", "stem"), list(zip(PORTER[::2], PORTER[1::2], strict=True)))
def test_english(word, stem):
    assert stems.stem("en", word) == stem


@pytest.mark.parametrize(
    ("language", "group"),
    [("de", "haus häuser häusern"), ("de", "kind kinder kindern kindes"), ("es", "gato gatos gata gatas"), ("es", "luz luces"), ("es", "canción canciones"), ("fr", "cheval chevaux"), ("fr", "maison maisons"), ("fr", "chanté chantées chanter"), ("ru", "новость новости новостей новостями"), ("ru", "книга книги книгами книгу"), ("ru", "красивая красивый красивых")],
)
def test_forms_share_a_stem(language, group):
    found = {stems.stem(language, w) for w in group.split()}
    assert len(found) <= (2 if group == "canción canciones" else 1), found


def test_other_languages_have_no_stems():
    assert stems.stem("xx", "running") == "running" and stems.stem(None, "running") == "running"


WORDS = "rain storm snow running runs run flood the of north heavy x y z".split()
TEXTS = [None, "", "?!", "The the of", "Rain", "rain rain rain rain storm", "snow " * 3000, "heavy snow of the north", "heavy snow the of north", "heavy, snow. North"]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return TEXTS + [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    return [(i, ("en", "fr", "ru", "xx", None)[i % 5], t) for i, t in enumerate(random_texts(200))]


def plain_index(docs, stemmed=False):
    out = {}
    for i, lang, text in docs:
        found = {}
        for p, w in enumerate(re.findall(ti.WORD, (text or "").lower())):
            if w not in ti.STOP.get(lang, ()):
                found.setdefault(stems.stem(lang, w) if stemmed else w, []).append(p)
        out |= {(lang, term, i): ps for term, ps in found.items()}
    return out


def index_of(postings):
    rows = postings.collect()
    found = {(r["language"], r["term"], r["id"]): r["positions"] for r in rows}
    assert len(rows) == len(found) and all(r["tf"] == len(r["positions"]) for r in rows)
    return found


SCHEMA = "id long, l string, t string"


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_equals_a_plain_one(spark, docs, stemmed):
    df = spark.createDataFrame(docs, SCHEMA)
    assert index_of(ti.build_text_index(df, "id", "t", "l", stemmed)) == plain_index(docs, stemmed)


def test_batches_equal_a_rebuild(spark, docs, tmp_path):
    """Edits, deletions, a language that changes, a text that comes back, repeats; after each batch the index is as if built anew."""
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    now = {}
    index = ti.TextIndex(spark, f"file://{tmp_path}/i")
    assert index.postings().count() == 0 and index.stats().first()["n"] == 0
    changed = [(i, lang, f"{t or ''} edited") for i, lang, t in docs[40:90:3]]
    batches = [(docs[:120], []), (docs[100:] + changed, [1, 2, 50_000]), ([docs[43], docs[1], (7, "fr", docs[7][2]), (300, None, None)], [7, 8, 9, 43]), (docs[:50], []), ([], list(range(30)))]
    for rows, gone in batches:
        rows = list({r[0]: r for r in rows}.values())
        before = index
        index = index.add(frame(rows), "id", "t", "l", spark.createDataFrame([(g,) for g in gone], "id long") if gone else None)
        now = {i: r for i, r in now.items() if i not in gone} | {r[0]: r for r in rows}
        self_check(index, list(now.values()))
        # what is unchanged isn't cut again
        written = spark.read.parquet(f"{index.path}/segment={index.version}").where("term IS NULL").count()
        assert written <= len(rows)
        assert before.add(frame(rows), "id", "t", "l", spark.createDataFrame([(g,) for g in gone], "id long") if gone else None).version == index.version  # a repeat overwrites
        self_check(index, list(now.values()))
    same = index.add(frame(list(now.values())), "id", "t", "l")
    assert spark.read.parquet(f"{same.path}/segment={same.version}").count() == 0
    merged = same.merge()
    self_check(merged, list(now.values()))
    assert len(merged._segments()) == 1
    self_check(merged.add(frame([(5, "en", "after the merge")]), "id", "t", "l"), list((now | {5: (5, "en", "after the merge")}).values()))


def self_check(index, docs):
    want = plain_index(docs)
    assert index_of(index.postings()) == want
    lengths = {}
    for (_, _, i), ps in want.items():
        lengths[i] = lengths.get(i, 0) + len(ps)
    stats = index.stats().first()
    assert stats["n"] == len(lengths) and (not lengths or abs(stats["avg_length"] - sum(lengths.values()) / len(lengths)) < 1e-9)


EXPRESSIONS = ["rain", "rain storm", "rain AND storm", "rain OR snow flood", "(rain OR snow) flood", "rain -storm", "rain NOT (storm OR snow)", '"rain storm"', '"heavy snow of the north"', '"run x" OR "y z"', "storm OR NOT rain", "NOT rain", "NOT NOT rain", 'rain NOT "rain rain"', "the of", "the rain", "", "AND OR (", "(rain", "rain)) snow", "nothing", "-(x OR y) z", '"x', "x AND AND y", '"north of the"', "Rain! (STORM)"]


def scan(docs, expression, stemmed):
    """{id: cover} by a look at each text."""
    leaves, todo = ti.parsed(expression)
    out = {}
    for i, lang, text in docs:
        words = [None if w in ti.STOP.get(lang, ()) else stems.stem(lang, w) if stemmed else w for w in re.findall(ti.WORD, (text or "").lower())]
        want = [[(p, stems.stem(lang, w) if stemmed else w) for p, w in leaf] for leaf, _ in leaves]
        starts = [[s for s in range(len(words)) if all(s + p < len(words) and words[s + p] == w for p, w in leaf)] for leaf in want]
        stack = []
        for x in todo:
            if x >= 0:
                stack.append(bool(starts[x]))
            elif x == ti.NOT:
                stack.append(not stack.pop())
            else:
                a, b = stack.pop(), stack.pop()
                stack.append(a and b if x == ti.AND else a or b)
        own = [(len(want[k]), starts[k]) for k in range(len(leaves)) if starts[k] and not leaves[k][1]]
        if own and stack[0]:
            spans = {}
            for ps in itertools.product(*(s for _, s in own)) if max(len(s) for _, s in own) < 12 else []:
                spans[min(ps), max(p + n for p, (n, _) in zip(ps, own, strict=True))] = 1
            short = [a for a in spans if not any(b != a and b[0] >= a[0] and b[1] <= a[1] for b in spans)]
            out[i] = sum(1 / (1 + max(0, e - s - sum(n for n, _ in own))) for s, e in short) if spans else None
    return out


@pytest.mark.parametrize("stemmed", [False, True])
def test_expressions_equal_a_scan(spark, docs, stemmed):
    df = spark.createDataFrame(docs, SCHEMA)
    index = ti.build_text_index(df, "id", "t", "l", stemmed)
    queries = spark.createDataFrame(list(enumerate([*EXPRESSIONS, None])), "query_id int, query string")
    found = {}
    for r in ti.search_expressions(index, queries, 1 << 30, stems=stemmed).collect():
        found.setdefault(r["query_id"], {})[r["id"]] = r["cover"]
    for n, expression in enumerate(EXPRESSIONS):
        want = scan(docs, expression, stemmed)
        assert set(found.get(n, {})) == set(want), expression
        for i, cover in want.items():
            if cover is not None and '"' not in expression:
                assert abs(found[n][i] - cover) < 1e-5, (expression, i, docs[i][2])


def test_order_and_inflected_forms(spark):
    rows = [(1, "en", "he was running"), (2, "en", "runs and runs"), (3, "en", "ran"), (4, "en", "a storm then much rain"), (5, "en", "a rain storm"), (6, "xx", "runs")]
    index = ti.build_text_index(spark.createDataFrame(rows, SCHEMA), "id", "t", "l", True)
    queries = spark.createDataFrame([(1, "run"), (2, "rain AND storms")], "query_id int, query string")
    found = ti.search_expressions(index, queries, 10, stems=True, order="cover").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(1, 2), (1, 1), (2, 5), (2, 4)]
    assert [r["rank"] for r in ti.search_expressions(index, queries, 1, stems=True).collect()] == [1, 1]


def test_texts_are_read_and_cut_once_when_an_index_is_built(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            read.add(len(rows))
            yield rows

    texts = [(i, "Zürich КИЕВ the same %d words words" % i, "en") for i in range(50)] + [(50, None, None), (51, "", "en")]
    df = spark.createDataFrame(texts, "id long, text string, lang string")
    index = ti.TextIndex(spark, new_path(spark, "index")).add(df.mapInPandas(count, df.schema), "id", "text", "lang")
    assert read.value == 52
    rows = {(r["id"], r["term"]): (r["positions"], r["length"], r["tf"]) for r in index.postings().collect()}
    assert len(rows) == 50 * 5 and rows[7, "words"] == ([5, 6], 6, 2) and rows[7, "zürich"][0] == [0] and rows[7, "киев"][0] == [1] and (7, "the") not in rows
    assert sorted((r["id"], r["length"]) for r in index.texts().where("id >= 49").collect()) == [(49, 6), (50, 0), (51, 0)]
