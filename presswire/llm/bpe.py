"""SentencePiece encoding and decoding with merge-type vocabularies.

A text's agenda holds its adjacent symbol pairs that make a piece, best score first and leftmost among equals; taking a pair joins its
symbols and puts the new neighbours on the agenda, until no pair is a piece. A character that is no piece falls back to its bytes, or to
the unknown piece where the vocabulary has no bytes. No piece has a word mark after another character, so no pair is joined across such
a place: texts are cut there. The distinct parts of a run of texts are encoded together: their agendas are the segments of one array, and
each round takes the first entry of each (``Agendas``). Long parts have a heap of their own. What a short part encodes to is remembered
under a 64-bit hash, within a bound.

The ids are the agenda's own. Batch by batch the sentencepiece library encodes every whole text too, and ``agrees`` says whether it has
the same ids; a text where it hasn't is encoded anew by a heap, without what is remembered. The library decodes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswire.llm.scratch import trimmed
from presswire.llm.wordhash import words

MARK = "▁"
#: Parts remembered by a worker, about 40 bytes each; when they are as many, they are forgotten.
REMEMBERED = 200_000
#: Bytes from which a part is neither remembered nor encoded together with others.
LONG = 64
#: Bytes of texts encoded at once.
RUN_BYTES = (1 << 19) - 1
#: Parts whose agendas are one array.
TOGETHER = 8_192
#: Bytes of parts: all but spaces.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[32] = False
_NEVER = np.iinfo(np.int32).max


class Agendas:
    """The agendas of many short parts at once.

    Symbols are numbered: a piece by its id, other characters of pieces after those, and one number for all characters of no piece. ``pairs``
    has the pairs that make a piece, in tables by hash: what doesn't fit into the first goes into the next.
    """

    def __init__(self, ids: dict[str, int], ranks: dict[str, int], n_pieces: int):
        number = dict(ids)
        for c in sorted({c for p in ids for c in p}):
            number.setdefault(c, n_pieces + len(number) - len(ids))
        self.other = n_pieces + len(number) - len(ids)
        self.n_pieces = n_pieces
        pairs = sorted((number[p[:i]] << 32 | number[p[i:]], ranks[p], k) for p, k in ids.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        codes, self.ranks, self.made = (np.array([x[i] for x in pairs] + [end], t) for i, t, end in ((0, np.int64, -1), (1, np.int32, _NEVER), (2, np.int32, 0)))
        self.codes, self.tables = codes, []
        left, bits = np.arange(len(pairs)), max(10, (4 * len(pairs)).bit_length())
        while len(left):
            table = np.full(1 << bits, len(pairs), np.int32)
            at = self._place(codes[left], len(self.tables), bits)
            table[at] = left
            self.tables.append(table)
            left = left[table[at] != left]
        self.bits = bits
        self.of_char = np.full(0x110000, self.other, np.int32)
        for c, k in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k

    @staticmethod
    def _place(code: np.ndarray, table: int, bits: int) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64((2 * table + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - bits)).view(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, number) of the pieces that pairs make; ``_NEVER`` where they make none."""
        code = left.astype(np.int64) << 32 | right
        found = np.full(len(code), len(self.codes) - 1, np.int32)
        rest = np.arange(len(code))
        for k, table in enumerate(self.tables):
            at = table[self._place(code[rest], k, self.bits)]
            there = self.codes[at] == code[rest]
            found[rest[there]] = at[there]
            rest = rest[~there & (at < len(self.codes) - 1)]  # an empty place: no later table has it
        return self.ranks[found], self.made[found]

    def run(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of all parts, one part after another; the first character of each symbol; the number of symbols of each part).

        ``first``: where in ``chars`` each part starts; none is empty.
        """
        n = len(chars)
        symbol = np.append(self.of_char[chars], self.other)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[np.append(first[1:], n) - 1] = before[first] = after[n] = n  # the place after the last is nobody's
        rank, made = self._pairs(symbol[:n], symbol[after[:n]])
        rank, made, there = np.append(rank, _NEVER), np.append(made, 0), np.ones(n, bool)
        places, starts = np.arange(n), first
        while len(starts):
            # the first entry of each agenda: the best rank, leftmost among equals
            best = np.minimum.reduceat(rank[places].astype(np.int64) << 32 | places, starts)
            more = best >> 32 < _NEVER
            left = best[more] & 0xFFFFFFFF
            if len(left) * 8 < len(starts) * 7 or len(left) * 8 < len(places):  # agendas without entries leave, and symbols that are joined to others
                owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(places))))
                keep = more[owner] & there[places]
                places, owner = places[keep], owner[keep]
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
            elif not len(left):
                break
            right = after[left]
            symbol[left] = made[left]
            there[right] = False
            after[left] = beyond = after[right]
            before[beyond] = left
            rank[right] = _NEVER
            rank[left], made[left] = self._pairs(symbol[left], symbol[beyond])
            ahead = before[left]
            rank[ahead], made[ahead] = self._pairs(symbol[ahead], symbol[left])
            rank[n], symbol[n] = _NEVER, self.other
        counts = np.add.reduceat(there, first, dtype=np.int64) if n else np.zeros(0, np.int64)
        return symbol[:n][there], chars[there], counts


class Encoder:
    """A merge-type vocabulary of identity normalisation, read through the sentencepiece library."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(lib.get_piece_size())]
        self.ids = {lib.id_to_piece(i): i for i, s in enumerate(special) if not s}
        order = sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True)
        ranks = {score: r for r, score in enumerate(order)}
        self.ranks = {p: ranks[lib.get_score(i)] for p, i in self.ids.items()}
        self.agendas = Agendas(self.ids, self.ranks, lib.get_piece_size())
        self.decimal = [str(i) for i in range(lib.get_piece_size())]
        self.bytes = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown = lib.unk_id()
        self.has_bytes = all(lib.is_byte(int(i)) for i in self.bytes)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces of this vocabulary cross words")
        self._forget()

    def _forget(self) -> None:
        """Nothing is remembered: of parts, by their sorted ``hashes``, the ids are ``flat[start : start + n]``."""
        self.hashes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def part(self, text: str) -> np.ndarray:
        """The ids of a text without cuts, by a heap."""
        symbols: list[str] = list(text)
        n, rank = len(symbols), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [e << 40 | i for i in range(n - 1) if (e := rank(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            item = pop(agenda)
            left = item & 0xFFFFFFFFFF
            right = after[left]
            if right >= n or not symbols[left] or rank(pair := symbols[left] + symbols[right]) != item >> 40:
                continue  # one of the two has been joined to another
            symbols[left], symbols[right] = pair, ""
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (e := rank(pair + symbols[right])) is not None:
                    push(agenda, e << 40 | left)
            if (left := before[left]) >= 0 and (e := rank(symbols[left] + pair)) is not None:
                push(agenda, e << 40 | left)
        left = [s for s in symbols if s]
        numbers = np.array([self.ids.get(s, self.agendas.other) for s in left], np.int32)
        return self._listed(numbers, np.array([ord(s[0]) for s in left], np.uint32), np.array([len(left)]))[0]

    def _listed(self, symbols: np.ndarray, chars: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part) of the symbols of parts."""
        odd = symbols >= self.agendas.n_pieces
        if not odd.any():
            return symbols, n
        size = np.ones(len(symbols), np.int64)
        if self.has_bytes:
            raw = chars[odd].tobytes().decode("utf-32-le")
            size[odd] = np.fromiter((len(c.encode()) for c in raw), np.int64, len(raw))
            own = self.bytes[np.frombuffer(raw.encode(), np.uint8)]
        else:  # unknown symbols in a row are one
            again = odd & np.append(False, odd[:-1])
            again[np.append(0, np.cumsum(n)[:-1])] = False
            size[again] = 0
            own = np.full(int((odd & ~again).sum()), self.unknown, np.int32)
        ids = np.repeat(symbols, size)
        ids[np.repeat(odd, size)] = own
        return ids, np.add.reduceat(size, np.cumsum(n) - n)

    def together(self, parts: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each part) of short parts, each with one mark, in front, as UTF-8."""
        chars = np.frombuffer(parts.decode().encode("utf-32-le"), np.uint32)
        return self._listed(*self.agendas.run(chars, np.flatnonzero(chars == ord(MARK))))

    def run(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, str, bool, str]]:
        """(ids, decoded text, whether the library has the same ids, the ids in decimal joined by commas) of each text."""
        if len(self.hashes) >= REMEMBERED:
            self._forget()
        listed = [x or "" for x in texts.to_pylist()]
        ids = [y for part in words(texts, NOT_BLANK, lower=False, run_bytes=1 << 62) for y in self._plain(part)]
        for text, own, theirs in zip(listed, ids, self.library.encode(listed, return_type="numpy", num_threads=1), strict=True):
            if MARK in text or "  " in text or text[:1] == " " or text[-1:] == " " or not np.array_equal(own, theirs):
                own = self.whole(text)
            yield own, self.library.decode(own) if len(own) else "", np.array_equal(own, theirs), ",".join([self.decimal[i] for i in own.tolist()])

    def _plain(self, run) -> Iterator[np.ndarray]:
        """The ids of each text of a run, as of texts where each space parts two parts."""
        # a part's mark is that of the space before it
        h, at, inverse = np.unique(run.hashes, return_index=True, return_inverse=True)
        size, raw = run.ends[at] - run.starts[at], run.data.tobytes()
        place = np.searchsorted(self.hashes, h)
        fresh = np.append(self.hashes, np.uint64(0))[place] != h
        fresh |= place == len(self.hashes)
        mark = MARK.encode()
        cut = lambda sel: [raw[a:b] for a, b in zip(run.starts[at[sel]].tolist(), run.ends[at[sel]].tolist(), strict=True)]
        short, large = np.flatnonzero(fresh & (size < LONG)), np.flatnonzero(fresh & (size >= LONG))
        if len(short):
            made = [self.together(b"".join([mark + x for x in cut(short[i : i + TOGETHER])])) for i in range(0, len(short), TOGETHER)]
            ids, n = (np.concatenate(x) for x in zip(*made, strict=True))
            self.hashes, self.n = np.insert(self.hashes, place[short], h[short]), np.insert(self.n, place[short], n)
            self.start = np.insert(self.start, place[short], len(self.flat) + np.cumsum(n) - n)
            self.flat = np.concatenate([self.flat, ids])
            place = np.searchsorted(self.hashes, h)
        other = [self.part(MARK + x.decode()) for x in cut(large)]
        ends = np.cumsum([0, *map(len, other)])
        start, n = np.append(self.start, 0)[np.minimum(place, len(self.start))], np.append(self.n, 0)[np.minimum(place, len(self.n))]
        start[large], n[large] = len(self.flat) + ends[:-1], np.diff(ends)
        flat = np.concatenate([self.flat, *other])
        start, n = start[inverse], n[inverse]
        stop = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(start - stop[:-1], n) + np.arange(stop[-1])]
        for a, b in zip(stop[run.first[:-1]].tolist(), stop[run.first[1:]].tolist(), strict=True):
            yield ids[a:b]

    def whole(self, text: str) -> np.ndarray:
        """The ids of any text, by heaps, one for each part."""
        parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK)) if text else []
        return np.concatenate([np.zeros(0, np.int32), *map(self.part, parts)])


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive rows of about ``RUN_BYTES``."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + RUN_BYTES, side="right")))
        yield texts.slice(row, end - row)
        row = end


def _encoder(model_file: str) -> Encoder:
    """One encoder for each Python worker and model; a name without a folder is a file sent along by ``addFile``."""
    made = _encoder.__dict__.setdefault("made", {})
    if model_file not in made:
        made[model_file] = Encoder(model_file if "/" in model_file else SparkFiles.get(model_file))
    return made[model_file]


def encoded(docs: DataFrame, model_file: str, text_col: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """(row, n_tokens, agrees) and (ids, decoded), or with ``digests`` (ids_sha256, decoded_sha256), per row of ``docs``.

    ``row``: the columns named by ``keep``, or all, as a struct, so that no name can clash. A null or empty text has no ids and decodes to
    the empty text. Digests are lower-case hex: of the decimal ids joined by commas, and of the decoded text in UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_file)
        for batch in batches:
            row = 0
            for texts in _runs(batch.column("text")):
                found = list(encoder.run(texts))
                n = pa.array([len(x[0]) for x in found], pa.int64())
                agrees = pa.array([x[2] for x in found], pa.bool_())
                if digests:
                    ids = pa.array([hashlib.sha256(x[3].encode()).hexdigest() for x in found], pa.string())
                    decoded = pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in found], pa.string())
                else:
                    ends = np.cumsum([0, *(len(x[0]) for x in found)], dtype=np.int32)
                    ids, decoded = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[0] for x in found]), pa.int32())), pa.array([x[1] for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, len(texts)), n, agrees, ids, decoded], [f.name for f in schema])
                row += len(texts)

    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([plain.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("agrees", T.BooleanType())])
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string") if digests else schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return plain.mapInArrow(trimmed(run), schema)
