"""Byte-level BPE encoding and decoding with public rank files.

Text is cut into pre-tokens by the tokenizer's pattern; each is merged on its
own. A pre-token's pairs wait in a hierarchical-bitmap rank queue: one bucket
for each merge rank holds the linked-list positions of pairs of that rank, two
levels of bitmaps say which buckets are in use, and find-first-set on them
gives the lowest rank. A bucket is a heap of positions, so equal ranks merge
from the left; entries whose pair has since changed are stale and skipped. A
merge touches its two neighbours only, so a pre-token of n bytes costs
O(n log n), however long it is.

Pre-tokens repeat, so each worker process remembers the ids of up to
``MEMORY`` of them in each of two generations: a full generation becomes the
old one, and what is met again moves to the new. The usual pattern is cut by class
tables over code points in numpy; any other runs as a regular expression.

Defined cases: a null text counts as empty; an empty text has no ids and
decodes to no bytes; texts are encoded whole; repeated rows are each encoded;
extra columns pass through where ``keep`` names them.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORY = 350_000
#: Rows that one Arrow batch of results may hold, and the characters after which it is passed on.
BATCH_CHARS = 4_000_000
#: Above this a text is cut by the regular expression, whose matches come one by one.
LONG = 4_000_000
#: The pattern that the class tables stand for (fixed value: that of the public tokenizers).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token.

    ``buckets[rank]`` is a position or a heap of them; ``low[word]`` has a bit
    for each rank in use of 64, ``top`` one for each word of ``low`` in use.
    The queue's steps stand inline: calls would cost more than they do.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]  # the rank of the pair that begins here
    pair.append(None)
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(pair):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)  # ascending, and so a heap
            else:
                buckets[rank] = [i]
                word = rank >> 6
                low[word] = low.get(word, 0) | 1 << (rank & 63)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) == 1:
            i = bucket[0]
            del buckets[rank]
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        else:
            i = heappop(bucket)
        if pair[i] != rank:
            continue  # stale
        j = after[i]
        own = parts[i] + parts[j]
        parts[i] = own
        pair[j] = None
        after[i] = k = after[j]
        h = before[i]
        fresh = []
        if k < n:
            before[k] = i
            pair[i] = found = get(own + parts[k])
            if found is not None:
                fresh.append((found, i))
        else:
            pair[i] = None
        if h >= 0:
            pair[h] = found = get(parts[h] + own)
            if found is not None:
                fresh.append((found, h))
        for found, at in fresh:
            if found in buckets:
                heappush(buckets[found], at)
            else:
                buckets[found] = [at]
                word = found >> 6
                low[word] = low.get(word, 0) | 1 << (found & 63)
                top |= 1 << word
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            points = np.frombuffer(m.group().encode("utf-32-le"), dtype=np.uint32)
            table[points] = kind
    return table


def cut_points(text: str, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of ``text`` start, and its length."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    if not n:
        return np.zeros(1, dtype=np.int64)
    kind = classes[points]
    space = kind == _SPACE
    starts = np.empty(n + 1, dtype=bool)
    starts[0] = starts[n] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:n])
    # A run of white space gives up its last character if something follows: a blank (U+0020) leads that token, any other stands alone.
    lead = np.flatnonzero(space[:-1] & ~space[1:]) if n > 1 else np.empty(0, dtype=np.int64)
    starts[lead] = True
    blank = lead[points[lead] == 32]
    starts[blank + 1] = False
    # An apostrophe that is a run of its own, with no blank before it, takes the letters of a contraction along.
    quote = np.flatnonzero((points[:-1] == 39) & (kind[1:] == _LETTER) & starts[: n - 1]) if n > 1 else ()
    for q in quote:
        rest = text[q + 1 : q + 3]
        k = 1 if rest[0] in "stmd" else 2 if rest in ("re", "ve", "ll") else 0
        if k:
            starts[q + 1] = False
            starts[q + 1 + k] = True
    return np.flatnonzero(starts)


class Encoder(dict):
    """Pre-token to the bytes of its ids (unsigned, two or four bytes each)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memory: int = MEMORY):
        super().__init__()
        self.ranks, self.memory = ranks, memory
        self.old: dict[str, bytes] = {}
        self.classes = _classes() if pattern == PATTERN else None
        self.regex = regex.compile(pattern)
        top = max(ranks.values(), default=0)
        self.code = "H" if top < 1 << 16 else "I"
        self.width = np.dtype(self.code)
        words = [b""] * (top + 1)
        for word, rank in ranks.items():
            words[rank] = word
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.bytes = np.frombuffer(b"".join(words), dtype=np.uint8)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array(self.code, merge(word.encode(), self.ranks)).tobytes()
        if len(word) <= 64:
            if len(self) >= self.memory:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if self.classes is None or len(text) > LONG:
            words: Iterator[str] = (m.group() for m in self.regex.finditer(text))
        else:
            at = cut_points(text, self.classes).tolist()
            words = (text[a:b] for a, b in zip(at, at[1:]))
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=self.width)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids)
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.begins[ids] - (ends - sizes), sizes)
        return self.bytes[shift + np.arange(ends[-1])].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 bytes and rank by line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines) if word}


def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """This process's encoder for a rank file; it outlives a task, so that what it remembers serves the next."""
    held = sys.__dict__.setdefault("_tessella_encoders", {})
    if (path, pattern) not in held:
        held[path, pattern] = Encoder(read_ranks(path), pattern)
    return held[path, pattern]


def coder(path: str, pattern: str = PATTERN):
    """Reads batches whose last column is the text; yields the other columns, ids, and the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts, begin = batch.column(batch.num_columns - 1), 0
            while begin < batch.num_rows:
                ids, decoded, chars, end = [], [], 0, begin
                while end < batch.num_rows and chars < BATCH_CHARS:
                    text = texts[end].as_py() or ""
                    ids.append(own.encode(text))
                    decoded.append(own.decode(ids[-1]))
                    chars += len(text)
                    end += 1
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                kept = [batch.column(i).slice(begin, end - begin) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.binary())], names=[*batch.schema.names[:-1], "ids", "decoded"])
                begin = end

    return run


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, ``ids array<int>`` and ``decoded binary``. ``path`` must be readable on the workers."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(coder(path, pattern), f"{schema}, ids array<int>, decoded binary")


def digester(path: str, pattern: str = PATTERN):
    """Like ``coder``, with the digests of its ids and bytes in place of them."""
    import hashlib

    inner = coder(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in inner(batches):
            if names is None:
                names = [b"%d" % i for i in range(len(encoder(path, pattern).sizes))]
            lists, flat = batch.column("ids"), batch.column("ids").flatten().to_numpy()
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            count, ids, text = [], [], []
            for a, b, raw in zip(bounds, bounds[1:], batch.column("decoded")):
                count.append(b - a)
                ids.append(hashlib.sha256(b" ".join(map(names.__getitem__, flat[a:b].tolist()))).hexdigest())
                text.append(hashlib.sha256(raw.as_buffer()).hexdigest())
            kept = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(count, pa.int64()), pa.array(ids), pa.array(text)], names=[*batch.schema.names[:-2], "n_tokens", "ids_sha256", "decoded_sha256"])

    return run
