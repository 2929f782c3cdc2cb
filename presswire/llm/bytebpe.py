"""Byte-level BPE encoding and decoding, by a trie of distinct words.

Texts are cut into words as the vocabulary's usual pattern cuts them, and the distinct words of a run of texts go into a trie. A word's
encoding ends in one token, and what stands before that token is the encoding of a shorter prefix. So a node of the trie needs one thing:
the last token of its prefix. It is the token that ends there and may stand after the last token of the prefix before it. Walking the trie
depth first, the last tokens of the nodes on the way are at hand, and words that share a prefix share its tokens. ``Vocabulary.apart`` says
which tokens may stand side by side: those across whose border no merge happens while both are made. The trie is walked in the order of
sorted words and never stored: its nodes are the prefixes of a word beyond what it has in common with the word before.

What a short word encodes to is remembered under a 64-bit hash, within a bound.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswire.llm.scratch import trimmed
from presswire.llm.wordhash import _LETTERS, _power, mix, runs

#: Words remembered by a worker, about 50 bytes each; when they are as many, they are forgotten.
REMEMBERED = 400_000
#: Bytes from which a word is not remembered.
LONG = 64
#: Pairs of tokens remembered by a worker, about 100 bytes each.
PAIRS = 500_000
#: Bytes of texts encoded at once; a longer text is a run of its own.
RUN_BYTES = (1 << 19) - 1
_NEVER = 1 << 60
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a token's name stands for: printable ones stand for themselves, others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def char_classes(file: str) -> np.ndarray:
    """For each code point: letter, number, white space or other, in the version of Unicode that the library has.

    The library cuts a text of all code points where the class changes; with a letter, a digit and a line break before it, the first
    character of each piece shows its class.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(file).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in (32, 39)]
    found = np.full(0x110000, _OTHER, np.uint8)
    for _, (a, b) in cut("".join(map(chr, points))):
        kinds = [k for k, c in ((_LETTER, "a"), (_NUMBER, "1"), (_SPACE, "\n")) if len(cut(c + chr(points[a]))) == 1]
        found[points[a:b]] = kinds[0] if kinds else _OTHER
    found[32] = _SPACE
    return found


class Vocabulary:
    """A byte-level BPE vocabulary, as the tokenizers library stores it."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_letters()
        kind = spec["pre_tokenizer"]
        if model["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        raw = {name: bytes(byte[c] for c in name) for name in model["vocab"] if name.encode() not in self.special}
        self.bytes = dict.fromkeys(range(max([*model["vocab"].values(), *self.special.values()]) + 1), b"") | {model["vocab"][n]: b for n, b in raw.items()} | {i: b for b, i in self.special.items()}
        self.size = len(self.bytes)
        self.rank, self.left, self.right = [-1] * self.size, [-1] * self.size, [-1] * self.size
        self.merges: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if self.rank[made] >= 0 or max(self.rank[left], self.rank[right]) >= r:
                raise ValueError("a merge comes before its parts")
            self.rank[made], self.left[made], self.right[made] = r, left, right
            self.merges[left * self.size + right] = r
        # a token that merges of its own bytes never make can't be in an encoding
        own = [i for n, i in model["vocab"].items() if n in raw]
        made = {i for i in own if self.rank[i] < 0}
        for i in sorted((i for i in own if self.rank[i] >= 0), key=lambda i: self.rank[i]):
            if self.left[i] in made and self.right[i] in made and self.apart(self.left[i], self.right[i], self.rank[i]):
                made.add(i)
        #: Every end of a token: the token, or -1 where none is just this.
        self.ends: dict[bytes, int] = {}
        for i in made:
            for k in range(1, len(self.bytes[i])):
                self.ends.setdefault(self.bytes[i][k:], -1)
        self.ends |= {self.bytes[i]: i for i in made}
        self.decimal = [str(i) for i in range(self.size)]
        self.classes = char_classes(file)
        lengths = np.array([len(self.bytes[i]) for i in range(self.size)])
        self.flat, self.at = np.frombuffer(b"".join(self.bytes[i] for i in range(self.size)), np.uint8), np.append(0, np.cumsum(lengths))
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Nothing is remembered: of words, by their sorted ``hashes``, the ids are ``ids[start : start + n]``."""
        self.hashes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def apart(self, a: int, b: int, limit: int = _NEVER) -> bool:
        """Whether no merge before ``limit`` joins across the border of tokens a and b.

        Merges are undone, the last one first, and of two that are the same the right one first, as they are done from the left.
        """
        rank, merges, size = self.rank, self.merges, self.size
        while True:
            if merges.get(a * size + b, _NEVER) < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                a = self.right[a]
            elif rank[b] >= 0:
                limit = rank[b] + 1
                b = self.left[b]
            else:
                return True

    def walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each of the sorted distinct ``words``, none empty, by a walk through their trie."""
        ends, pairs, size = self.ends, self.pairs, self.size
        last, length, before = [-1], [0], b""
        for word in words:
            d = _common(before, word)
            del last[d + 1 :], length[d + 1 :]
            for i in range(d + 1, len(word) + 1):
                some = []
                for k in range(i - 1, -1, -1):
                    t = ends.get(word[k:i])
                    if t is None:
                        break
                    if t >= 0:
                        some.append((k, t))
                for k, t in reversed(some):
                    if not k:
                        break
                    pair = last[k] * size + t
                    good = pairs.get(pair)
                    if good is None:
                        good = pairs[pair] = self.apart(last[k], t)
                    if good:
                        break
                else:
                    raise AssertionError("every prefix has an encoding")
                last.append(t)
                length.append(i - k)
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i -= length[i]
            yield out[::-1]
            before = word
        if len(pairs) > PAIRS:
            pairs.clear()

    def cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the byte where each word starts, and the end; which of them are special tokens), of texts that start at bytes ``first``.

        Runs of letters, numbers, white space and other characters are words; the last space before another word goes to that word, any
        other last white space is a word of its own; an apostrophe that starts a word takes s, t, m, d, re, ve or ll with it.
        """
        body = data.tobytes()
        edge_at, special = [first], []
        for token in self.special:
            at = body.find(token)
            while at >= 0:
                if not np.any((first > at) & (first < at + len(token))):
                    special.append((at, token))
                at = body.find(token, at + len(token))
        edge_at += [np.array([p for at, t in special for p in (at, at + len(t))], np.int64)]
        edges = np.unique(np.concatenate(edge_at))
        chars = np.frombuffer(body.decode().encode("utf-32-le"), np.uint32)
        n = len(chars)
        if n == len(data):
            byte_at = None
        else:
            byte_at = np.append(0, np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000).astype(np.int64)))
            edges = np.searchsorted(byte_at, edges)
        edge = np.zeros(n + 1, bool)
        edge[edges] = edge[n] = True
        kind = self.classes[chars]
        start = edge.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # the last of a run of white space, where another word follows in the text
        tail = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
        start[tail] = True
        start[tail[chars[tail] == 32] + 1] = False
        quote = np.flatnonzero((chars[: n - 1] == 39) & start[: n - 1] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
        if len(quote):
            one = chars[quote + 1]
            short = np.isin(one, [ord(c) for c in "stmd"])
            two = np.where(quote + 2 < n, chars[np.minimum(quote + 2, n - 1)], 0) * ~edge[np.minimum(quote + 2, n)]
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[quote[short | long] + 1] = False
            start[quote[short] + 2] = start[quote[long] + 3] = True
        at = np.flatnonzero(start)
        if byte_at is not None:
            at = byte_at[at]
        which = np.zeros(len(at) - 1, np.int32)
        for a, token in special:
            # a special token is one word, whatever characters it has
            i, j = np.searchsorted(at, [a, a + len(token)])
            which[i] = self.special[token] + 1
            which[i + 1 : j] = -1
        if special:
            keep = which >= 0
            at, which = at[np.append(keep, True)], which[keep]
        return at, which

    def run(self, data: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each of the texts that start at bytes ``first`` of ``data``, the last of ``first`` being the end."""
        n = len(data)
        if not n:
            yield from [np.zeros(0, np.int32)] * (len(first) - 1)
            return
        at, special = self.cut(data, first[:-1][first[:-1] < n])
        power, inverse = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[data] * power[:n], out=total[1:])
        a, b = at[:-1], at[1:]
        hashes = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        del total
        if len(self.hashes) >= REMEMBERED:
            self._forget()
        h, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        size = (b - a)[one]
        place = np.searchsorted(self.hashes, h)
        fresh = np.append(self.hashes, np.uint64(0))[place] != h
        fresh |= place == len(self.hashes)
        fresh = np.flatnonzero(fresh)
        body = data.tobytes()
        words = [body[i:j] for i, j in zip(a[one[fresh]].tolist(), b[one[fresh]].tolist(), strict=True)]
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list[list[int]] = [[]] * len(words)
        for k, ids in zip(order, self.walk([words[k] for k in order]), strict=True):
            found[k] = ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for ids in found for t in ids), np.int32, int(counts.sum()))
        starts = len(self.ids) + np.cumsum(counts) - counts
        # of this run's words, in the ids remembered before and those of its fresh words
        every = np.concatenate([self.ids, flat])
        own_start, own_n = np.append(self.start, 0)[np.minimum(place, len(self.start))], np.append(self.n, 0)[np.minimum(place, len(self.n))]
        own_start[fresh], own_n[fresh] = starts, counts
        short = size[fresh] < LONG
        if short.all():
            self.ids = every
        else:
            self.ids = np.concatenate([self.ids, flat[np.repeat(short, counts)]])
            starts = len(every) - len(flat) + np.cumsum(counts * short) - counts * short
        new = fresh[short]
        self.hashes, self.n = np.insert(self.hashes, place[new], h[new]), np.insert(self.n, place[new], counts[short])
        self.start = np.insert(self.start, place[new], starts[short])
        start, n_ids = own_start[inverse], own_n[inverse]
        if special.any():
            every = np.append(every, special[special > 0] - 1).astype(np.int32)
            start[special > 0] = np.arange(len(every) - int((special > 0).sum()), len(every))
            n_ids[special > 0] = 1
        stop = np.append(0, np.cumsum(n_ids))
        ids = every[np.repeat(start - stop[:-1], n_ids) + np.arange(stop[-1])]
        ends = stop[np.searchsorted(at, first)]
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[i:j]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        size = self.at[ids + 1] - self.at[ids]
        stop = np.append(0, np.cumsum(size))
        return self.flat[np.repeat(self.at[ids] - stop[:-1], size) + np.arange(stop[-1])].tobytes().decode("utf-8", "replace")


def _common(a: bytes, b: bytes) -> int:
    """How many bytes two words begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _vocabulary(file: str) -> Vocabulary:
    """One for each Python worker and file; a name without a folder is a file sent along by ``addFile``."""
    made = _vocabulary.__dict__.setdefault("made", {})
    if file not in made:
        made[file] = Vocabulary(file if "/" in file else SparkFiles.get(file))
    return made[file]


def encoded(docs: DataFrame, file: str, text_col: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """(row, n_tokens) and (ids, decoded), or with ``digests`` (ids_sha256, decoded_sha256), per row of ``docs``.

    ``row``: the columns named by ``keep``, or all, as a struct, so that no name can clash. A null or empty text has no ids and decodes to
    the empty text; equal rows have equal results, a row each; an empty table has none. Special tokens that stand in a text are taken as
    such. Digests are lower-case hex: of the decimal ids joined by commas, and of the decoded text in UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(file)
        for batch in batches:
            for row, data, at in runs(batch.column("text"), RUN_BYTES):
                found = list(vocabulary.run(data, at))
                texts = [vocabulary.decode(x) for x in found]
                n = pa.array([len(x) for x in found], pa.int64())
                if digests:
                    ids = pa.array([hashlib.sha256(",".join([vocabulary.decimal[i] for i in x.tolist()]).encode()).hexdigest() for x in found], pa.string())
                    decoded = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())
                else:
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    ids, decoded = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32())), pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, len(found)), n, ids, decoded], [f.name for f in schema])

    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([plain.schema["row"], T.StructField("n_tokens", T.LongType())])
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string") if digests else schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return plain.mapInArrow(trimmed(run), schema)
