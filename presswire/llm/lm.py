"""A smoothed bigram language model whose counts live in a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counting. Each task counts hashed unigrams and bigrams of a few runs of texts; Spark adds them up by hash. The lowest bit of a hash tells
bigrams from unigrams, the highest ones name its bin: rows are shuffled by bin, so that later a task finds whole regions of the filter
together.

Filter. A count c is quantised to the level q = 1 + floor(log2 c), and the n-gram is put in once for each level up to q. A query probes
levels 1, 2, ... until one is missing; a false positive can only raise a level, ever less likely. The filter has about ``BITS`` bits for
each entry, however many there are, in regions that are named by the highest bits of a hash. Up to ``MAX_FILTER_BYTES`` it is broadcast;
a larger one stays a table of regions, and the distinct n-grams of each chunk of texts are shuffled to their regions and back, so that
the work grows with the texts, not with texts times filter. Either way the same bits are probed.

Score. The sum over tokens w after v of log10((c(v w) + MU p(w)) / (c(v) + MU)), p(w) = (c(w) + 1) / (N + V + 1), counts by probes.

Base score. Exact counts: of the most frequent tokens, at most ``MAX_HEAVY``, every task has a table; the rest, as far as the filter
has them, are joined, once for each text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.llm.scratch import written
from presswire.llm.wordhash import NOT_SPACE, Words, mix, runs, words

BITS, PROBES, MU = 10, 4, 8.0
MAX_FILTER_BYTES = 128 << 20
MAX_HEAVY = 500_000
#: Bytes of text for each bin of counts and region of the filter, or up to twice that.
BIN_BYTES = 1 << 19
#: Counts that are put in together, and bytes of regions from which a task hands on what it has set.
ROWS_TOGETHER = 500_000
PUT_BYTES = 48 << 20
#: Runs of texts that are counted together, and bytes of texts in a chunk.
RUNS_TOGETHER = 8
CHUNK_BYTES = 4 << 20
RUN_BYTES = (1 << 19) - 1
END, START = np.uint64(0x51ED270B7A4A5C11), np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)


def tokens(run: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the tokens, with one end for each text; those of the bigrams that they end; offsets of texts)."""
    n_docs = len(run)
    first = run.first + np.arange(n_docs + 1)
    out = np.empty(first[-1], np.uint64)
    ends = np.zeros(first[-1], bool)
    ends[first[1:] - 1] = True
    out[ends], out[~ends] = END, run.hashes
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[first[:-1]] = START
    return out & ~_ONE, mix(before * np.uint64(0x9FB21C651E98DF25) ^ out) | _ONE, first


def _runs(texts: pa.Array) -> Iterator[Words]:
    return words(texts, NOT_SPACE, run_bytes=RUN_BYTES)


def _top(h: Column, bits: int) -> Column:
    """The number that the highest ``bits`` bits make."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def ngram_counts(docs: DataFrame, text_col: str, bits: int) -> DataFrame:
    """(h, c): how often each unigram (h even) and bigram (h odd) stands in the texts; rows of a bin, of 2 ** ``bits``, lie together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _runs(batch.column(0))
            while parts := [x for run in islice(found, RUNS_TOGETHER) for x in tokens(run)[:2]]:
                for kind in (0, 1):
                    h, n = np.unique(np.concatenate(parts[kind::2]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(count, "h long, n long").withColumn("bin", _top(F.col("h"), bits)).repartition("bin")
    return written(rows.groupBy("bin", "h").agg(F.sum("n").alias("c")).select("h", "c"), "ngrams")


def level(c: Column) -> Column:
    """1 + floor(log2 c) of a count: the number of bits up to its highest one."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseOR(F.shiftrightunsigned(c, k))
    return F.bit_count(c).cast("long")


def _summary(counts: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(n-grams, occurrences) by order (1, 2) and level."""
    rows = counts.groupBy((F.col("h").bitwiseAND(1) + 1).alias("order"), level(F.col("c")).alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("total"))
    return {(r["order"], r["level"]): (r["n"], r["total"]) for r in rows.collect()}  # at most 64 levels each


class LogBloom:
    """Regions of ``region`` bits each, from number ``first`` on; the highest ``top`` bits of a hash name its region."""

    def __init__(self, bits: np.ndarray, top: int, region: int, first: int = 0):
        self.bits, self.top, self.region, self.first = bits, top, region, first

    @staticmethod
    def places(h: np.ndarray, level: int, region: int) -> Iterator[np.ndarray]:
        """Bits inside the region of ``h``, one array for each probe."""
        x = mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
        step = mix(x) | _ONE
        for _ in range(PROBES):
            yield ((x >> np.uint64(32)) * np.uint64(region) >> np.uint64(32)).astype(np.int64)
            x = x + step

    def counts(self, h: np.ndarray) -> np.ndarray:
        """About how often each n-gram was seen: the middle of its highest level in a row."""
        base = (regions_of(h, self.top) - self.first) * self.region
        out = np.zeros(len(h))
        alive = np.arange(len(h))
        level = 1
        while len(alive):
            full = np.ones(len(alive), bool)
            for place in self.places(h[alive], level, self.region):
                at = base[alive] + place
                full &= (self.bits[at >> 3] >> (at & 7)) & 1 == 1
            alive = alive[full]
            out[alive] = 1.0 if level == 1 else 1.5 * 2.0 ** (level - 1) - 0.5
            level += 1
        return out


def regions_of(h: np.ndarray, top: int) -> np.ndarray:
    return (h >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(h), np.int64)


@dataclass
class Filter:
    """The table (number, bits) of the regions of a filter; ``top`` and ``region`` as of ``LogBloom``."""

    table: DataFrame
    top: int
    region: int

    @property
    def bytes(self) -> int:
        return (self.region << self.top) // 8

    def whole(self) -> LogBloom:
        """All of it, of ``MAX_FILTER_BYTES`` at most."""
        full = np.zeros(self.bytes, np.uint8)
        for row in self.table.toLocalIterator():
            a = row["number"] * self.region // 8
            full[a : a + self.region // 8] = np.frombuffer(row["bits"], np.uint8)
        return LogBloom(full, self.top, self.region)


def bloom(counts: DataFrame, summary: dict[tuple[int, int], tuple[int, int]], top: int) -> Filter:
    """Puts all counts into a filter of 2 ** ``top`` regions, one for each bin. What tasks set of a region is joined by OR."""
    region = -(-BITS * sum(n * q for (_, q), (n, _) in summary.items()) // (64 << top)) * 64 or 64

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for h, q in together(batches):
            order = np.argsort(regions_of(h := h.view(np.uint64), top), kind="stable")
            h, q = h[order], q[order]
            number = regions_of(h, top)
            edges = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                bits = own.setdefault(int(number[a]), np.zeros(region, bool))
                for level in range(1, int(q[a:b].max()) + 1):
                    for place in LogBloom.places(h[a:b][q[a:b] >= level], level, region):
                        bits[place] = True
            if len(own) * region >= PUT_BYTES:
                yield from packed(own)
        yield from packed(own)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for batch in batches:
            held.append([np.asarray(x) for x in batch.columns])
            n += batch.num_rows
            if n >= ROWS_TOGETHER:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def packed(own: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while own:
            number, bits = own.popitem()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["number", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bits = None, np.zeros(0, np.uint8)
        for batch in batches:
            for number, more in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if last is not None and number != last:
                    yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([bits.tobytes()])], ["number", "bits"])
                more = np.frombuffer(more.as_buffer(), np.uint8)
                bits = bits | more if number == last else more
                last = number
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([bits.tobytes()])], ["number", "bits"])

    parts = counts.select("h", level(F.col("c")).alias("q")).mapInArrow(put, "number long, bits binary")
    n_tasks = min(1 << top, max(16, (region << top) // (32 << 20)))
    return Filter(written(parts.repartition(n_tasks, "number").sortWithinPartitions("number").mapInArrow(join, "number long, bits binary"), "filter"), top, region)


@dataclass
class Known:
    """What a task needs besides the counts that the filter gives: exact counts of frequent tokens (sorted ``h``, ``c``), texts, N, V."""

    h: np.ndarray
    c: np.ndarray
    n_docs: int
    n: int
    v: int
    floor: int

    def scored(self, rows: pa.Array, run: Words, counts: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
        """(row, n_tokens, n_known, logs, score, rest) of the texts of a run; ``counts`` gives the filter's counts of hashes."""
        token, both, first = tokens(run)
        single, inverse = np.unique(token, return_inverse=True)
        alone = counts(single)
        at = np.minimum(np.searchsorted(self.h, single), max(len(self.h) - 1, 0))
        there = self.h[at] == single if len(self.h) else np.zeros(len(single), bool)
        own = np.where(there, self.c[at] if len(self.h) else 0, 0)
        rare = (~there & (alone > 0))[inverse] if self.floor > 1 else np.zeros(len(token), bool)
        there, own, alone = there[inverse], own[inverse], alone[inverse]
        prior = np.roll(alone, 1)
        prior[first[:-1]] = self.n_docs
        p = (np.minimum(counts(both), prior) + MU * (alone + 1) / (self.n + self.v + 1)) / (prior + MU)
        sums = [np.add.reduceat(x, first[:-1]) for x in (there.astype(np.int64), np.log10(own + 1.0), np.log10(np.minimum(p, 1.0)))]
        ends = np.searchsorted(np.flatnonzero(rare), first)
        rest = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(token[rare].view(np.int64)))
        return pa.RecordBatch.from_arrays([rows.slice(run.row, len(run)), pa.array(np.diff(first)), *map(pa.array, sums), rest], ["row", "n_tokens", "n_known", "logs", "score", "rest"])


def _score_whole(plain: DataFrame, schema: str, model: LogBloom, known: Known) -> DataFrame:
    """With the filter broadcast."""
    sent = plain.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value
        for batch in batches:
            for part in _runs(batch.column("text")):
                yield known.scored(batch.column("row"), part, model.counts)

    return plain.mapInArrow(run, schema)


def _score_routed(plain: DataFrame, schema: str, model: Filter, known: Known, salts: int) -> DataFrame:
    """With a filter of any size: n-grams go to their regions, each of which is there ``salts`` times, and counts come back to their texts."""
    kind = plain.schema["row"].dataType.simpleString()
    sent = plain.sparkSession.sparkContext.broadcast(known)
    top, region = model.top, model.region

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = uuid.uuid4().int >> 66, 0
        for batch in batches:
            for row, data, at in runs(batch.column("text"), RUN_BYTES):
                if size and size + len(data) > CHUNK_BYTES:
                    chunk, size = uuid.uuid4().int >> 66, 0
                size += len(data)
                part = batch.slice(row, len(at) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), *part.columns], ["chunk", "row", "text"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            chunk = np.asarray(batch.column(0))
            for part in _runs(batch.column(1)):
                token, both, first = tokens(part)
                own = chunk[part.row : part.row + len(part)]
                edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if last is not None and own[a] != last:
                        yield asks(last, held)
                        held = []
                    last = own[a]
                    held += [token[first[a] : first[b]], both[first[a] : first[b]]]
        if held:
            yield asks(last, held)

    def asks(chunk: int, held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk)), pa.array(h.view(np.int64))], ["chunk", "h"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            number, bits = np.asarray(batch.column("number")), batch.column("bits")
            edges = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if bits[a].is_valid:  # a region's own row comes before those that ask for it
                    part = LogBloom(np.frombuffer(bits[a].as_buffer(), np.uint8), top, region, int(number[a]))
                own = batch.slice(a, b - a).filter(pc.is_valid(batch.column("chunk").slice(a, b - a)))
                h = np.asarray(own.column("h")).view(np.uint64)
                found = part.counts(h) if part is not None and part.first == number[a] else np.zeros(len(h))
                yield pa.RecordBatch.from_arrays([own.column("chunk"), own.column("h"), pa.array(found)], ["chunk", "h", "found"])

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        h, c = found["h"].to_numpy().view(np.uint64), found["found"].to_numpy()
        order = np.argsort(h)
        h, c = h[order], c[order]
        texts = texts.combine_chunks()
        counts = lambda x: c[np.searchsorted(h, x)]
        rows, text = (texts[k].chunk(0) for k in ("row", "text"))
        return pa.Table.from_batches([sent.value.scored(rows, part, counts) for part in _runs(text)])

    chunks = written(plain.mapInArrow(chunked, f"chunk long, row {kind}, text string"), "chunks")
    wanted = chunks.select("chunk", "text").mapInArrow(asked, "chunk long, h long")
    salt = F.pmod(F.col("chunk"), F.lit(salts)).alias("salt")
    wanted = wanted.select(_top(F.col("h"), top).alias("number"), salt, "chunk", "h", F.lit(None).cast("binary").alias("bits"))
    table = model.table.select("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("long").alias("h"), "bits")
    n_tasks = min(salts << top, 1 << 16)
    met = wanted.unionByName(table).repartition(n_tasks, "number", "salt").sortWithinPartitions("number", "salt", F.col("chunk").asc_nulls_first())
    found = met.select("number", "chunk", "h", "bits").mapInArrow(answered, "chunk long, h long, found double")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, schema)  # CHUNK_BYTES each, or one long text


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a row without id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _size(docs: DataFrame, text_col: str):
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()


def lm_scores(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``, learning from the texts of ``train``.

    ``row``: the columns named by ``keep``, or all, as a struct, so that no name can clash. Tokens are words ``[^\\x20\\x09-\\x0D]+`` after
    lower-casing A-Z, then one end; a null text has the end alone. Without any training text every token has probability 1.
    """
    size = _size(train, text_col)
    bits = max(6, math.floor(math.log2((size["bytes"] + size["rows"] + 1) / BIN_BYTES)))
    counts = ngram_counts(train, text_col, bits)
    summary = _summary(counts)
    n = sum(t for (o, _), (_, t) in summary.items() if o == 1)
    v = sum(k for (o, _), (k, _) in summary.items() if o == 1)
    floor = 1
    while sum(k for (o, q), (k, _) in summary.items() if o == 1 and q >= floor) > MAX_HEAVY:
        floor += 1
    single = counts.where(F.col("h").bitwiseAND(1) == 0)
    heavy = single.where(level(F.col("c")) >= floor).toArrow()  # MAX_HEAVY rows of 16 bytes at most
    h, c = heavy["h"].to_numpy().view(np.uint64), heavy["c"].to_numpy()
    order = np.argsort(h)
    known = Known(h[order], c[order], size["rows"], n, v, floor)
    model = bloom(counts, summary, bits)

    plain = docs.select(F.struct(*(F.col(f"`{x}`") for x in keep or docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = f"row {plain.schema['row'].dataType.simpleString()}, n_tokens long, n_known long, logs double, score double, rest array<long>"
    if model.bytes <= MAX_FILTER_BYTES:
        scored = _score_whole(plain, schema, model.whole(), known)
    else:
        scored = _score_routed(plain, schema, model, known, max(1, math.ceil(_size(docs, text_col)["bytes"] / max(size["bytes"], 1))))
    if floor > 1:
        scored = written(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
        rest = scored.select("rid", F.explode("rest").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("times"))
        met = rest.join(single.where(level(F.col("c")) < floor), "h").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("add"))
        scored = scored.join(met, "rid", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "logs": F.col("logs") + F.coalesce("add", F.lit(0.0))})
    most = math.log10(n + v + 1)
    return scored.select("row", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(most)).alias("base_score"), "score")
