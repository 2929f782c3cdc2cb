"""Manifests, byte-level encoding and periodic runs against plain Python and the library, with every odd case."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswire.llm import bytebpe, merkle, periodic, queries
from presswire.llm.wordhash import runs


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """(root, siblings of each leaf as (left, right) level by level)."""
    at, ways = list(range(len(leaves))), [[] for _ in leaves]
    while len(leaves) > 1:
        for i, k in enumerate(at):
            run = leaves[k // 3 * 3 : k // 3 * 3 + 3]
            ways[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        leaves = [digest("".join(leaves[k : k + 3])) for k in range(0, len(leaves), 3)]
        at = [k // 3 for k in at]
    return leaves[0], ways


def manifest_of(rows):
    """{row number: (leaf, subroot, root, steps)} of rows (doc_id, source, text)."""
    groups = collections.defaultdict(list)
    for n, (i, s, t) in enumerate(rows):
        groups["-" if s is None else "=" + s].append((i is not None, i or 0, digest("".join(map(value, (i, s, t)))), n))
    names = sorted(groups, key=str.encode)
    made = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = tree([made[g][0] for g in names])
    out = {}
    for k, g in enumerate(names):
        for x, way in zip(sorted(groups[g]), made[g][1], strict=True):
            out[x[3]] = (x[2], made[g][0], root, way + tops[k])
    return out


def trees_of(sizes, rng):
    rows = [(i, s, f"text {rng.randint(0, 9)}\n{i}") for s, n in sizes.items() for i in range(n)]
    rows += [(None, "odd", None), (None, "odd", ""), (7, "odd", "漢字"), (7, "odd", "same"), (7, "odd", "same"), (-3, "odd", "x" * 50_000), (1, None, "no source"), (1, "", "empty source")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("levels", "broadcast"), [(3, 200_000), (1, 0), (2, 0)])
def test_manifest(spark, monkeypatch, levels, broadcast):
    monkeypatch.setattr(merkle, "MAX_BROADCAST_RANGES", broadcast)
    rows = trees_of({"one": 1, "two": 2, "three": 3, "four": 4, "nine": 9, "ten": 10, "édge": 27, "more": 28, "most": 244, "zz": 81}, random.Random(1))
    df = spark.createDataFrame([(i, s, t, n, "x", 5) for n, (i, s, t) in enumerate(rows)], "doc_id long, source string, text string, n long, tree string, lo long").repartition(5)
    made = merkle.manifest(df, fields=("doc_id", "source", "text"), keep={"n": F.col("n")}, levels=levels)
    found = {r["row"]["n"]: (r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]]) for r in made.proofs.collect()}
    want = manifest_of(rows)
    # equal rows have neighbouring ranks, whichever has which
    same = collections.defaultdict(list)
    for n, row in enumerate(rows):
        same[row].append(n)
    assert len(found) == len(rows)
    for ns in same.values():
        assert sorted(found[n] for n in ns) == sorted(want[n] for n in ns), rows[ns[0]]
    assert made.proofs.where(merkle.folded(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    # nodes: a level covers its leaves without gaps, and a tree has one root
    for r in made.nodes.groupBy("tree", "level").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"), F.count("*").alias("nodes"), F.countDistinct("lo").alias("d")).collect():
        leaves = len([1 for x in rows if ("-" if x[1] is None else "=" + x[1]) == r["tree"]])
        assert (r["n"], r["nodes"]) == (leaves, r["d"]) and r["nodes"] == -(-leaves // 3 ** r["level"])


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    made = merkle.manifest(none, fields=("doc_id", "source", "text"))
    assert made.proofs.count() == made.nodes.count() == 0


def test_a_changed_text_fails(spark):
    rows = [(i, "s", f"line\n{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    altered = merkle.leaf(F.col("doc_id"), F.col("source"), F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text")))
    found = merkle.manifest(df, fields=("doc_id", "source", "text"), keep={"id": F.col("doc_id"), "altered": altered}).proofs
    bad = found.where(merkle.folded(F.col("row.altered"), F.col("steps")) != F.col("root")).select("row.id").collect()
    assert [r["id"] for r in bad] == [5]


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.Vocabulary(queries.byte_vocabulary())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(queries.byte_vocabulary())
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(vocabulary, texts):
    return [x.tolist() for _, data, at in runs(pa.array(texts, pa.string()), bytebpe.RUN_BYTES) for x in vocabulary.run(data, at)]


PIECES = ["'s", "'t", "'re", "'ve", "'ll", "'m", "'d", "'", "''", "s", "re", "l", "e", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "1", "22", "²", "!", "?!", "é", "漢字", "a", "the", "ing", "zz", "<|endoftext|>", "<|endof", "🙂", "́", "\x00"]


def byte_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(0, 200))) for _ in range(500)]
    texts += ["a" * k for k in range(120)] + ["ab" * k for k in range(60)] + ["", "x" * 20_000, " " * 20_000, "1 " * 20_000, "é" * 20_000, "=" * 5_000, "<|endoftext|>" * 50, " <|endoftext|> \n <|endoftext|>"]
    return texts + ["word " * 150_000]


def test_ids_are_the_librarys(vocabulary, library, monkeypatch):
    texts = byte_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for remembered in (bytebpe.REMEMBERED, 0):
        monkeypatch.setattr(bytebpe, "REMEMBERED", remembered)
        found = ids_of(vocabulary, texts)
        for t, own, theirs in zip(texts, found, want, strict=True):
            assert own == theirs, t[:60]
            assert vocabulary.decode(np.array(own, np.int64)) == library.decode(theirs, skip_special_tokens=False)


def test_every_code_point_is_cut_as_the_library_does(vocabulary, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0)]
    texts = ["".join(f"a{c}b1{c}2 {c}{c} '{c}'s{c}\n!" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    found = ids_of(vocabulary, texts)
    for t, own, theirs in zip(texts, found, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own == theirs.ids, t[:40]


def test_every_token_in_an_encoding_can_be_made(vocabulary, library):
    """Tokens that merges make of their own bytes are those that the library encodes to themselves."""
    own = [i for i in range(vocabulary.size) if vocabulary.bytes[i] and i not in vocabulary.special.values()]
    texts = {i: vocabulary.bytes[i].decode() for i in own if not vocabulary.bytes[i].decode("utf-8", "ignore").encode() != vocabulary.bytes[i]}
    for i, t in texts.items():
        if len(library.pre_tokenizer.pre_tokenize_str(t)) == 1:
            assert (vocabulary.ends.get(vocabulary.bytes[i], -1) == i) == (library.encode(t, add_special_tokens=False).ids == [i]), t


def test_encoded(spark, library):
    rows = [(1, "It's the  end\n"), (2, None), (3, ""), (1, "It's the  end\n"), (None, "y" * 30_000), (4, "<|endoftext|>x")]
    df = spark.createDataFrame([(i, t, "r", 9) for i, t in rows], "doc_id long, text string, row string, n_tokens long")
    found = bytebpe.encoded(df, queries.byte_vocabulary()).collect()
    assert sorted((str(r["row"]["doc_id"]), r["row"]["n_tokens"], r["ids"], r["decoded"]) for r in found) == sorted((str(i), 9, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    digests = {r["row"]["doc_id"]: r for r in bytebpe.encoded(df, queries.byte_vocabulary(), digests=True).collect()}
    for r in found:
        d = digests[r["row"]["doc_id"]]
        assert (d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) == (len(r["ids"]), digest(",".join(map(str, r["ids"]))), digest(r["decoded"]))


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(rng):
    letters, w = rng.randint(1, 6), []
    for _ in range(rng.randint(0, 8)):
        p = rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 50, rng.randint(1, 90)])
        base = [rng.randrange(letters if rng.random() < 0.5 else 1000) for _ in range(p)]
        w += [base[i % p] for i in range(int(p * rng.choice([1, 2, 3.2, 4, 6, 12])) + rng.randint(0, 24))]
        w += [rng.randrange(2000) for _ in range(rng.choice([0, 0, 1, 5, 40]))]
    return [f"w{x}" for x in w]


def test_transforms():
    a = np.random.default_rng(1).integers(0, periodic.PRIME, (3, 64))
    assert (periodic.transformed_back(periodic.transform(a)) == a).all()
    x, y = a[:, :32] % 3, a % 3
    want = [[(x[r] == y[r, s : s + 32]).all() for s in range(32)] for r in range(3)]
    assert (periodic.occurrences(x, y) == want).all()


def test_runs(spark):
    rng = random.Random(6)
    lists = [repetitive(rng) for _ in range(150)] + [["a"] * n for n in (1, 8, 23, 24, 25, 26, 200)] + [["a", "b"] * 12, ["x"] * 23 + ["y"], [f"u{i}" for i in range(500)] * 3, [f"u{i}" for i in range(3000)] * 7]
    lists += [[rng.choice("ab") for _ in range(400)] for _ in range(5)]
    texts = [rng.choice([" ", "\n", " \t "]).join(w) for w in lists] + [None, "", " \n ", "é " * 30, "z" * 700_000 + " z z"]
    df = spark.createDataFrame([(n, t, "x", "y") for n, t in enumerate(texts)] + [(0, texts[0], "x", "y")], "doc_id long, text string, row string, runs string").repartition(3)
    found = periodic.with_runs(df).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        w = (texts[r["row"]["doc_id"]] or "").split()
        want = brute_runs(w) if len(w) < 10_000 else [(0, 21_000, 3_000)]
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(w), want)
        dropped = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in dropped)


def test_runs_of_one_word_are_fast():
    s, e, q = periodic.find(np.zeros(100_000, np.uint64), np.array([0, 100_000]))
    assert (s.tolist(), e.tolist(), q.tolist()) == ([0], [100_000], [1])
