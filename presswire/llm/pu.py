"""Positive-unlabelled learning of text classifiers, for quality and for toxicity.

The classifier is linear over hashed features of a whole text: its words, the beginnings of its words, and its shape (shares of character
classes, repetition, lengths) in steps. Only trusted positives and unlabelled texts make it; rows labelled 0 are unlabelled like others.

- A start comes from a bounded sample, at most ``MAX_ROWS`` positives and as many unlabelled texts, chosen by a hash of the id: Spark counts
  its features, the ``MAX_FEATURES`` whose shares differ most, in standard errors, are kept, and numpy fits weights.
- Then all texts are brought down to the places of their kept features, once, as a table.
- The class prior is estimated by the best bin over all texts that are set aside: the least ratio of the shares of unlabelled and of positive
  texts that score above a cut.
- The weights minimise the non-negative risk pi E_p[l(+)] + max(0, E_u[l(-)] - pi E_p[l(-)]) (Kiryo and others, 2017) under logistic loss,
  in ``ROUNDS`` steps over all positives and all unlabelled texts that aren't set aside, each a sum that Spark takes.
- A value becomes a probability by the rising function that fits pi f_p(z) / f_u(z), the densities of values among texts set aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswire.llm.scratch import written
from presswire.llm.wordhash import ALNUM, NOT_SPACE, Lookup, Words, mix, words

#: Rows of each kind in the sample that the fit starts from.
MAX_ROWS = 10_000
MAX_FEATURES = 4_096
#: Steps over all texts.
ROUNDS = 12
#: Values are counted in this many bins from -EDGE to EDGE.
BINS, EDGE = 4_000, 40.0
#: A feature is kept if its shares among positive and unlabelled texts differ by so many standard errors; of a million features none does by chance.
LEAST_Z = 5.0
#: The same for features of shape, which are few.
LEAST_SHAPE_Z = 2.0
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature found this often in a text also counts as another one.
OFTEN = 3

_OFTEN_MARK = np.uint64(0x5851F42D4C957F2D)
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>{}=_~^\\", "stop": b".!?,;:", "bang": b"!", "line": b"\n"}


def _shape(raw: Words) -> Iterator[np.ndarray]:
    """Features of the shape of each text, from its words between spaces: one array over the texts for each kind."""
    n = np.maximum(np.diff(raw.bytes_at), 1)
    count = np.diff(raw.first)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[raw.bytes_at])
    per_word = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[raw.first])
    found = [np.minimum(np.log2(count + 1), 15).astype(np.int64)]
    for members in _CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        found.append(np.ceil(np.sqrt(total(table[raw.data]) / n) * 20).astype(np.int64))
    owner = np.repeat(np.arange(len(raw)), count)
    same = np.zeros(len(owner), bool)
    same[1:] = (raw.hashes[1:] == raw.hashes[:-1]) & (owner[1:] == owner[:-1])
    found.append(np.ceil(np.sqrt(per_word(same) / np.maximum(count, 1)) * 20).astype(np.int64))
    order = np.lexsort((raw.hashes, owner))
    h, o = raw.hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    found.append(np.floor(per_word(fresh) / np.maximum(count, 1) * 20).astype(np.int64))
    found.append(np.minimum(per_word(raw.ends - raw.starts) // np.maximum(count, 1), 40))
    for kind, step in enumerate(found):
        yield _shape_feature(kind, step)


def _shape_feature(kind: int, step: np.ndarray) -> np.ndarray:
    return mix((np.uint64(kind + 1) << np.uint64(40)) + step.astype(np.uint64))


#: All features of shape: ten kinds of at most 41 steps.
SHAPES = np.concatenate([_shape_feature(kind, np.arange(41)) for kind in range(10)]).view(np.int64).tolist()


def features(texts: pa.Array, lookup: Lookup | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, text in the run, feature) for each run of texts, each pair once; only features of ``lookup``, as their places."""
    for run, raw in zip(words(texts, ALNUM), words(texts, NOT_SPACE, lower=False), strict=True):
        owner = np.repeat(np.arange(len(run)), np.diff(run.first))
        parts = [(owner, run.hashes)]
        for size in PREFIXES:
            at, h = run.prefixes(size)
            parts.append((owner[at], h))
        if lookup is not None:
            # a feature that only counts where it is frequent has to be counted too
            parts = [(o[i], h[i]) for o, h in parts for i in [np.union1d(lookup.find(h)[0], lookup.find(h ^ _OFTEN_MARK)[0])]]
        o, h = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        order = np.lexsort((h, o))
        o, h = o[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
        often = first[np.diff(np.append(first, len(h))) >= OFTEN]
        shapes = list(_shape(raw))
        o = np.concatenate([o[first], o[often], *[np.arange(len(run))] * len(shapes)])
        h = np.concatenate([h[first], h[often] ^ _OFTEN_MARK, *shapes])
        if lookup is not None:
            at, place = lookup.find(h)
            o, h = o[at], place
        yield run.row, len(run), o, h


@dataclass
class Model:
    """Sorted feature hashes, their weights, the bias, the class prior that the fit took, and probabilities at values that rise."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    prior: float = 0.5
    at: np.ndarray | None = None
    chance: np.ndarray | None = None

    def probability(self, z: np.ndarray) -> np.ndarray:
        """Between 0 and 1, rising with the value; the sigmoid's share keeps apart what the steps don't."""
        s = _sigmoid(z)
        return s if self.at is None else (1 - 1e-6) * np.interp(z, self.at, self.chance) + 1e-6 * s

    def score(self, texts: pa.Array) -> np.ndarray:
        lookup = Lookup(self.hashes)
        out = [self.bias + np.bincount(o, self.weights[f], n) for _, n, o, f in features(texts, lookup)]
        return self.probability(np.concatenate(out) if out else np.zeros(0))


class _Rows:
    """Rows of 0/1 features: ``at`` has their features one row after another, ``owner`` the row of each."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray):
        self.n, self.at, self.sizes = len(sizes), at, sizes
        self.owner = np.repeat(np.arange(self.n), sizes)

    def where(self, flags: np.ndarray) -> _Rows:
        return _Rows(self.at[flags[self.owner]], self.sizes[flags])

    def value(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.owner, w[self.at], self.n)

    def slope(self, d: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        return np.bincount(self.at, d[self.owner], size) / max(self.n, 1), float(d.sum()) / max(self.n, 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_nnpu(p: _Rows, u: _Rows, prior: float, size: int, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk over a sample."""

    def sums(w: np.ndarray, b: float) -> Sums:
        zp, zu = p.value(w, b), u.value(w, b)
        gp, gu, one = p.slope(_sigmoid(zp), size), u.slope(_sigmoid(zu), size), p.slope(np.ones(p.n), size)
        return Sums(np.append(*gu), np.append(*gp), np.append(*one), np.logaddexp(0, zu).mean(), np.logaddexp(0, zp).mean())

    return descend(sums, np.zeros(size + 1), prior, steps, rate, decay)


@dataclass
class Sums:
    """Means over unlabelled (u) and positive (p) texts, the last entry of each array for the bias: of the probability times the features, of the features, of the loss as a negative."""

    u: np.ndarray
    p: np.ndarray
    ones: np.ndarray
    loss_u: float
    loss_p: float


def descend(sums: Callable[[np.ndarray, float], Sums], w: np.ndarray, prior: float, steps: int, rate: float, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by steps of Adam down the non-negative risk."""
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        s = sums(w[:-1], w[-1])
        away = s.u - prior * s.p
        # where the part of the negatives is below 0 the classifier has begun to fit the sample: take that part back
        g = -away if s.loss_u < prior * s.loss_p else prior * (s.p - s.ones) + away
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """The class prior by the best bin: q_u(c) / q_p(c) at the cut c that minimises its upper confidence bound (Garg and others, 2021).

    ``p``, ``u``: how many positive and unlabelled texts have a value in each bin, in order.
    """
    if not p.sum() or not u.sum():
        return 0.5
    at = np.flatnonzero(p)
    qp, qu = (np.cumsum(x[::-1])[::-1][at] / x.sum() for x in (p, u))
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(u.sum()) + 1 / np.sqrt(p.sum()))
    bound = (qu + slack) / qp
    return float(np.clip(qu[np.argmin(bound)] / qp[np.argmin(bound)], 0.001, 0.999))


def posterior(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and the probabilities of label 1 there: the rising step function nearest to pi f_p(z) / f_u(z), at the middles of its steps.

    Bins are as for ``estimate_prior``. Neighbouring bins are pooled until no step falls (pool adjacent violators). Without texts of a kind:
    the sigmoid's own values.
    """
    z = (np.arange(BINS) + 0.5) * 2 * EDGE / BINS - EDGE
    if not p.sum() or not u.sum():
        return z, _sigmoid(z)
    steps: list[list[float]] = []  # of each step: pi times the share of positives, the share of unlabelled, and that share times the value
    for k in np.flatnonzero(u):
        step = [prior * p[k] / p.sum(), u[k] / u.sum(), z[k] * u[k] / u.sum()]
        while steps and steps[-1][0] * step[1] >= step[0] * steps[-1][1]:
            step = [a + b for a, b in zip(steps.pop(), step, strict=True)]
        steps.append(step)
    a, b, at = np.array(steps).T
    return at / b, np.minimum(a / b, 1.0)


def _share(of: Column, wanted: int, there: int, salt: int) -> Column:
    """A part of the rows by a hash of their id: about ``wanted`` of ``there``."""
    return F.pmod(F.xxhash64(of, F.lit(salt)), F.lit(1_000_000)) < int(min(1.0, wanted / max(there, 1)) * 1_000_000)


def select_features(sample: DataFrame, max_features: int, shape_z: float) -> np.ndarray:
    """Sorted hashes of the features of a sample (p, u, text) whose shares among positive and unlabelled texts differ most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [np.asarray(batch.column(k)) for k in (0, 1)]
            for row, _, o, h in features(batch.column(2)):
                both = [np.unique(h[flag[o + row]], return_counts=True) for flag in flags]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in both]).view(np.int64)), pa.array(np.concatenate([both[0][1], 0 * both[1][1]])), pa.array(np.concatenate([0 * both[0][1], both[1][1]]))], ["h", "p", "u"])

    n = sample.agg(F.count_if("p").alias("p"), F.count_if("u").alias("u")).first()
    if not n["p"] or not n["u"]:
        return np.zeros(0, np.uint64)
    counted = sample.select("p", "u", "text").mapInArrow(count, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p + u >= 5")
    p, u = F.col("p") / n["p"], F.col("u") / n["u"]
    pool = (F.col("p") + F.col("u")) / (n["p"] + n["u"])
    z = F.abs(p - u) / F.sqrt(pool * (1 - pool) * (1 / n["p"] + 1 / n["u"]) + 1e-12)
    top = counted.where(z >= F.when(F.col("h").isin(SHAPES), shape_z).otherwise(LEAST_Z)).orderBy(z.desc(), "h").select("h").limit(max_features).toArrow()["h"].to_numpy()
    return np.sort(top.view(np.uint64))


def featured(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """``docs`` with the places of a text's features among ``hashes`` as ``f`` instead of ``text``."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(hashes)
        for batch in batches:
            for row, k, o, f in features(batch.column("text"), lookup):
                order = np.argsort(o, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(o[order], np.arange(k + 1)).astype(np.int32)), pa.array(f[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, k) for c in kept), lists], [*kept, "f"])

    schema = T.StructType([f for f in docs.schema if f.name != "text"]).add("f", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, schema)


def _lists(column: pa.ListArray) -> _Rows:
    return _Rows(np.asarray(column.flatten()), np.asarray(column.value_lengths()))


def _summed(table: DataFrame, size: int) -> Callable[[np.ndarray, float], Sums]:
    """The sums over a table (p, u, f) of any size; a task gives one row for each feature."""

    def sums(w: np.ndarray, b: float) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((3, size + 3))
            for batch in batches:
                rows = _lists(batch.column("f"))
                z, (p, u) = rows.value(w, b), (np.asarray(batch.column(k)).astype(float) for k in ("p", "u"))
                s, loss = _sigmoid(z), np.logaddexp(0, z)
                for k, each in enumerate((u * s, p * s, p)):
                    out[k, :size] += np.bincount(rows.at, each[rows.owner], size)
                    out[k, size] += each.sum()
                out[:2, size + 1] += u @ loss, p @ loss
                out[:2, size + 2] += u.sum(), p.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 3)), *map(pa.array, out)], ["j", "u", "p", "ones"])

        total = table.mapInArrow(run, "j long, u double, p double, ones double").groupBy("j").agg(F.sum("u"), F.sum("p"), F.sum("ones"))
        out = np.zeros((3, size + 3))
        for j, *x in total.collect():  # a row for each feature
            out[:, j] = x
        n_u, n_p = np.maximum(out[:2, size + 2], 1)
        return Sums(out[0, : size + 1] / n_u, out[1, : size + 1] / n_p, out[2, : size + 1] / n_p, out[0, size + 1] / n_u, out[1, size + 1] / n_p)

    return sums


def _binned(table: DataFrame, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """How many positive and unlabelled texts of a table (p, u, f) have their value in each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, BINS))
        for batch in batches:
            at = ((np.clip(_lists(batch.column("f")).value(w, b), -EDGE, EDGE * (1 - 1e-9)) + EDGE) * BINS / (2 * EDGE)).astype(np.int64)
            for k, flag in enumerate(("p", "u")):
                out[k] += np.bincount(at, np.asarray(batch.column(flag)), BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), *map(pa.array, out)], ["bin", "p", "u"])

    out = np.zeros((2, BINS))
    for k, *x in table.mapInArrow(run, "bin long, p double, u double").groupBy("bin").agg(F.sum("p"), F.sum("u")).collect():
        out[:, k] = x
    return out[0], out[1]


def learned(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, shape_z: float = LEAST_SHAPE_Z, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """(model, scores): a model of ``labels`` (id, label 0 or 1), and (row, score) for each row of ``docs``.

    Learned from are the texts of those rows for which ``learn`` holds: trusted positives are those with label 1, and all of them are
    unlabelled texts. Rows without id or label say nothing; of repeated labels of an id the largest holds. ``row``: the columns named by
    ``keep``, or all, as a struct, so that no name can clash; ``score``: the probability of label 1. Null and empty texts have a score too.
    Without positives, or without texts, every score is 0.5.
    """
    trusted = labels.where("label = 1").select(F.col(id_col).alias("id")).where("id is not null").distinct()
    kept = F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row")
    rows = docs.select(kept, F.col(f"`{id_col}`").alias("id"), F.coalesce(learn, F.lit(False)).alias("u"), F.col(f"`{text_col}`").alias("text"))
    there = rows.where("u").count(), trusted.count()
    part = lambda wanted, of, salt: F.coalesce(_share(F.col("id"), wanted, of, salt), F.lit(False))
    chosen = trusted.where(part(max_rows, there[1], 1)).withColumn("p", F.lit(True))
    sample = rows.where("u").join(F.broadcast(chosen), "id", "left").withColumn("u", part(max_rows, there[0], 2)).withColumn("p", F.coalesce("p", F.lit(False))).where("p or u")  # about max_rows ids
    sample = written(sample.select("id", "p", "u", "text"), "sample")
    hashes = select_features(sample, max_features, shape_z)
    size = len(hashes)
    if not size:
        return Model(hashes, np.zeros(0)), rows.select("row", F.lit(0.5).alias("score"))

    aside = F.coalesce(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10)) < 3, F.lit(False))
    small = featured(sample.where(~aside).select("p", "u", "text"), hashes).toArrow()  # max_rows of each kind
    every = _lists(small["f"].combine_chunks())
    w, b = fit_nnpu(every.where(np.asarray(small["p"])), every.where(np.asarray(small["u"])), 0.5, size, steps=100)

    table = written(featured(rows, hashes), "features")
    marked = table.where("u").join(trusted.withColumn("p", F.lit(True)), "id", "left").select("id", F.coalesce("p", F.lit(False)).alias("p"), "u", "f")
    marked = written(marked.withColumn("aside", aside), "marked")
    prior = estimate_prior(*_binned(marked.where("aside"), w, b))
    w, b = fit_nnpu(every.where(np.asarray(small["p"])), every.where(np.asarray(small["u"])), prior, size)
    w, b = descend(_summed(marked.where("not aside"), size), np.append(w, b), prior, rounds, 0.01)
    model = Model(hashes, w, b, prior, *posterior(*_binned(marked.where("aside"), w, b), prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _lists(batch.column("f")).value(model.weights, model.bias)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.probability(z))], ["row", "score"])

    return model, table.select("row", "f").mapInArrow(score, f"row {table.schema['row'].dataType.simpleString()}, score double")


def fit(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """The model of ``learned`` from all of ``docs``."""
    return learned(docs, labels, F.lit(True), **how)[0]


def scores(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, score) per row of ``docs``: the columns named by ``keep``, or all, as a struct, and the probability of label 1; null and empty texts have one too."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(known.value.score(batch.column("text")))], ["row", "score"])

    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(run, f"row {plain.schema['row'].dataType.simpleString()}, score double")
