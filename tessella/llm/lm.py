"""Document log-probability under a subword lattice.

The vocabulary is a public tokenizer's pieces, taken as it is. A word stands as
its word mark and characters; every way to cut that string into pieces is a
path of a lattice, a path's probability is the product of its pieces'
probabilities, and the log-space forward recursion sums all paths. Characters
without a piece of their own are spelt by the vocabulary's byte pieces.

The public file ranks its pieces; 1 / (rank + 10), normalised, are their
probabilities. Under these alone a document has its ``lattice_score``, which
owes nothing to the corpus but the vocabulary's choice. For ``score``,
``rounds`` of expectation-maximisation over all distinct training words fit
them to the corpus, and words seen in training are arcs of the lattice too:
such an arc weighs its count less ``DISCOUNT``, and the mass so freed weighs
all paths of subwords. One end closes a document.

As an option, a corpus has kinds of documents (``kind``: a column of few
values, such as a language): the model then learns one lattice for each kind
that training has, and a document's probability is the mixture over kinds,
weighed by their shares in training. When a document is scored its own kind is
not looked at. Of more than ``KINDS`` kinds the commonest keep their own lattice, and
all others share one.

Beside that stands a base: counts of whole words, smoothed by 0.1.

Words are counted once for the whole corpus. Words with a share of at least
``SHARE`` of all tokens (at most 1 / SHARE of them) go to every worker; other
words meet the table of counts in a join by word, where none is hot.

Defined cases: null texts count as empty, a text of one end; a null kind is a
kind; words are never cut short; repeated rows are each scored; with no
training document there is one kind, of first probabilities; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

MARK = "▁"
SHARE = 4e-6
SMOOTH = 0.1
ROUNDS = 2
#: Kinds of documents that get a lattice of their own.
KINDS = 16
DISCOUNT = 0.75
#: Characters beyond which a word is walked by itself.
LONG = 2000
#: Words held by a counting task before it passes them on.
HELD = 120_000
#: Documents whose words are held at once.
DOCS = 500
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased: runs of characters other than space and \\t to \\r."""
    return (text or "").encode().translate(_LOWER).split()


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model by rank, the byte pieces last (as bytes 0 to 255)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in sorted(ids, key=lambda i: -model.get_score(i))]


def _hash(points: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One step of a rolling hash over code points."""
    h = (before ^ points) * _BASE
    return h ^ (h >> np.uint64(29))


class Lattice:
    """Pieces with log probabilities (natural); the 256 byte pieces follow the others, then the end."""

    def __init__(self, pieces: list[str], logp: np.ndarray | None = None):
        self.size = len(pieces) + 257
        if logp is None:
            p = 1 / (np.arange(self.size) + 10.0)
            p[-1] = p.max()
            logp = np.log(p / p.sum())
        self.logp, self.end = logp, self.size - 1
        self.longest = max(map(len, pieces), default=1)
        points, keys = self._pad(pieces), np.zeros(len(pieces), dtype=np.uint64)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        for i in range(points.shape[1]):
            keys = np.where(sizes > i, _hash(points[:, i], keys), keys)
        # Open addressing: slots are the hash's top bits, and the next until free. Prefixes of pieces stand as -2.
        named: dict[int, int] = {}
        step = np.zeros(len(pieces), dtype=np.uint64)
        for i in range(points.shape[1]):
            step = _hash(points[:, i], step)
            for key in np.unique(step[sizes > i + 1]).tolist():
                named.setdefault(key, -2)
        named |= {key: i for i, key in enumerate(keys.tolist())}
        self.bits = max(12, int(np.ceil(np.log2(max(1, len(named)) * 8))))
        n = 1 << self.bits
        self.keys, self.ids = np.zeros(n + 64, dtype=np.uint64), np.full(n + 64, -1, dtype=np.int32)
        for key, i in named.items():
            k = key >> (64 - self.bits)
            while self.ids[k] != -1:
                k += 1
            self.keys[k], self.ids[k] = key, i
        self.single = {p: i for i, p in enumerate(pieces) if len(p) == 1}

    @staticmethod
    def _pad(words: list[str]) -> np.ndarray:
        width = max(map(len, words), default=0)
        flat = "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass")
        return np.frombuffer(flat, dtype="<u4").reshape(len(words), width).astype(np.uint64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash; -2: the beginning of one; -1: neither."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(hashes), -1, dtype=np.int32)
        open_ = np.flatnonzero(self.ids[slot] != -1)
        while len(open_):
            at = slot[open_]
            hit = self.keys[at] == hashes[open_]
            out[open_[hit]] = self.ids[at[hit]]
            open_ = open_[~hit]
            slot[open_] += 1
            open_ = open_[self.ids[slot[open_]] != -1]
        return out

    def _spelt(self, points: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log probability of each character as byte pieces; -inf where it has a piece of its own."""
        known, at = np.unique(points, return_inverse=True)
        byte = self.size - 257
        cost = [-np.inf if chr(int(c)) in self.single else sum(logp[byte + b] for b in chr(int(c)).encode("utf-8", "replace")) for c in known]
        return np.array(cost)[at.reshape(points.shape)] if points.size else np.zeros(points.shape)

    def _arcs(self, points: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, their pieces) for words of one length, by ``to``; places are sought all at once, length by length."""
        n, width = points.shape
        row, start = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
        h, found = np.zeros(n * width, dtype=np.uint64), []
        for size in range(1, min(width, self.longest) + 1):
            fits = start + size <= width
            row, start, h = row[fits], start[fits], h[fits]
            h = _hash(points[row, start + size - 1], h)
            ids = self.find(h)
            whole = ids >= 0
            found.append((start[whole] + size, start[whole], row[whole], ids[whole]))
            row, start, h = row[ids != -1], start[ids != -1], h[ids != -1]
            if not len(row):
                break
        if not found:
            return []
        to, at, row, ids = (np.concatenate(part) for part in zip(*found))
        order = np.lexsort((row, at, to))
        to, at, row, ids = to[order], at[order], row[order], ids[order]
        cuts = np.flatnonzero((np.diff(to) != 0) | (np.diff(at) != 0)) + 1
        heads = np.concatenate([[0], cuts]) if len(to) else cuts
        return list(zip(at[heads].tolist(), to[heads].tolist(), np.split(row, cuts), np.split(ids, cuts))) if len(to) else []

    def _batches(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Words of one length together, as code points behind their mark."""
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for width, members in by_size.items():
            step = max(1, 150_000 // (width + 1))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                yield part, self._pad([MARK + words[k] for k in part])

    def score_kinds(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """(kinds, words): natural log of each word's marginal probability under each row of ``logp``; arcs are sought once."""
        out = np.zeros((len(logp), len(words)))
        for part, points in self._batches(words):
            spelt = np.stack([self._spelt(points, row) for row in logp])
            out[:, part] = self._ahead(points, self._arcs(points), spelt, logp)[:, -1]
        return out

    def score(self, words: list[str], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each word's marginal probability, and the expected uses of each piece weighted by ``counts``."""
        out = np.zeros(len(words))
        used = np.zeros(self.size)
        for part, points in self._batches(words):
            arcs, spelt = self._arcs(points), self._spelt(points, self.logp)
            ahead = self._ahead(points, arcs, spelt[None], self.logp[None])[0]
            out[part] = ahead[-1]
            if counts is not None:
                self._expect(points, arcs, spelt, ahead, counts[part], used)
        return out, used

    @staticmethod
    def _ahead(points: np.ndarray, arcs: list, spelt: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """(kinds, places, words): log probability of all paths to each place."""
        n, width = points.shape
        ahead = np.full((len(logp), width + 1, n), -np.inf)
        ahead[:, 0] = 0
        if n == 1 and width > LONG:
            by_end: dict[int, list[tuple[int, int]]] = {}
            for i, j, _, ids in arcs:
                by_end.setdefault(j, []).append((i, int(ids[0])))
            for k, row in enumerate(logp):
                _walk(ahead[k, :, 0], range(1, width + 1), by_end, spelt[k, 0], row, -1)
            return ahead
        at = 0
        for j in range(1, width + 1):
            own = np.isfinite(spelt[0, :, j - 1])
            if own.any():
                ahead[:, j, own] = ahead[:, j - 1, own] + spelt[:, own, j - 1]
            while at < len(arcs) and arcs[at][1] == j:
                i, _, rows, ids = arcs[at]
                ahead[:, j, rows] = np.logaddexp(ahead[:, j, rows], ahead[:, i, rows] + logp[:, ids])
                at += 1
        return ahead

    def _expect(self, points: np.ndarray, arcs: list, spelt: np.ndarray, ahead: np.ndarray, weight: np.ndarray, used: np.ndarray) -> None:
        """Adds each piece's expected uses: paths to an arc, the arc, and paths from it, over all paths."""
        n, width = points.shape
        rear = np.full((width + 1, n), -np.inf)
        rear[width] = 0
        if n == 1 and width > LONG:
            by_start: dict[int, list[tuple[int, int]]] = {}
            for i, j, _, ids in arcs:
                by_start.setdefault(i, []).append((j, int(ids[0])))
            _walk(rear[:, 0], range(width - 1, -1, -1), by_start, spelt[0], self.logp, 1)
        else:
            arcs = sorted(arcs, key=lambda a: -a[0])
            at = 0
            for i in range(width - 1, -1, -1):
                own = np.isfinite(spelt[:, i])
                rear[i, own] = rear[i + 1, own] + spelt[own, i]
                while at < len(arcs) and arcs[at][0] == i:
                    _, j, rows, ids = arcs[at]
                    rear[i, rows] = np.logaddexp(rear[i, rows], rear[j, rows] + self.logp[ids])
                    at += 1
        row, place = np.nonzero(np.isfinite(spelt))
        share = np.exp(ahead[place, row] + spelt[row, place] + rear[place + 1, row] - ahead[width, row]) * weight[row]
        known, which = np.unique(points[row, place], return_inverse=True)
        for c, x in zip(known.tolist(), np.bincount(which, weights=share, minlength=len(known)).tolist()):
            for b in chr(c).encode("utf-8", "replace"):
                used[self.size - 257 + b] += x
        if arcs:
            size = [len(a[2]) for a in arcs]
            start, end = np.repeat([a[0] for a in arcs], size), np.repeat([a[1] for a in arcs], size)
            row, ids = np.concatenate([a[2] for a in arcs]), np.concatenate([a[3] for a in arcs])
            share = np.exp(ahead[start, row] + self.logp[ids] + rear[end, row] - ahead[width, row]) * weight[row]
            used += np.bincount(ids, weights=share, minlength=self.size)


def _walk(out: np.ndarray, places: range, arcs: dict[int, list[tuple[int, int]]], spelt: np.ndarray, logp: np.ndarray, back: int) -> None:
    """The recursion over one long word, place by place: ``out`` holds the log probability of all paths, ``arcs`` (other end, piece) by place."""
    sums, alone = out.tolist(), spelt.tolist()
    for j in places:
        ways = [sums[i] + logp[piece] for i, piece in arcs.get(j, ())]
        char = alone[j - 1 if back < 0 else j]
        if char != -math.inf:
            ways.append(sums[j + back] + char)
        top = max(ways)
        sums[j] = top if len(ways) == 1 or top == -math.inf else top + math.log(sum(math.exp(w - top) for w in ways))
    out[:] = sums


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by kind (-1: held out); the null word counts documents, that is, ends."""
    seen: dict[int, Counter] = {}
    docs: Counter = Counter()
    names = ["word", "k", "n"]

    def flush() -> Iterator[pa.RecordBatch]:
        for k, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array([k] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=names)
        seen.clear()

    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs[k] += 1
            seen.setdefault(k, Counter()).update(words_of(text.as_py()))
            if sum(map(len, seen.values())) > HELD:
                yield from flush()
    yield from flush()
    yield pa.RecordBatch.from_arrays([pa.array([None] * len(docs), pa.string()), pa.array(list(docs), pa.int32()), pa.array(list(docs.values()), pa.int64())], names=names)


def word_counts(docs: DataFrame, kinds: int, text: str = "text") -> DataFrame:
    """(word, t0, t1, ..., uses): counts in training by kind ``k`` of ``docs``, and in all; the null word is the end."""
    found = docs.select(F.col("k").cast("int").alias("k"), F.col(text).alias("text")).mapInArrow(_count, "word string, k int, n long")
    by_kind = [F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).alias(f"t{i}") for i in range(kinds)]
    return found.groupBy("word").agg(*by_kind, F.sum("n").alias("uses"))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 30_000) -> Iterator[pa.RecordBatch]:
    """Larger batches: the lattice works on words of one length at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _expect(pieces: list[str], logp: np.ndarray):
    """Expected uses of the pieces, by kind, over distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, used = Lattice(pieces), np.zeros(logp.shape)
        for batch in _gathered(batches):
            words = batch.column(0).to_pylist()
            for k, lattice.logp in enumerate(logp):
                own = [w for w, n in zip(words, batch.column(k + 1).to_pylist()) if n]
                used[k] += lattice.score(own, np.ones(len(own)))[1]
        k, at = np.nonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at), pa.array(used[k, at])], names=["k", "piece", "uses"])

    return run


def fit(counts: DataFrame, pieces: list[str], kinds: int, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log probabilities of the pieces and bytes, a row for each kind, from all distinct training words.

    Workers return one number for each kind and piece; their sums (as many as
    the vocabulary is large, whatever the corpus) come to the driver.
    """
    words = counts.where("word is not null").select("word", *[f"t{i}" for i in range(kinds)])
    logp = np.tile(Lattice(pieces).logp, (kinds, 1))
    for _ in range(rounds):
        rows = words.mapInArrow(_expect(pieces, logp), "k int, piece long, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).collect()
        used = np.full(logp.shape, SMOOTH)
        used[:, -1] = 1e-9  # no word holds the end
        for r in rows:
            used[r.k, r.piece] += r.uses
        logp = np.log(used / used.sum(axis=1, keepdims=True))
    return logp


def _score_words(pieces: list[str], logp: np.ndarray, sums: np.ndarray, types: np.ndarray):
    """Log10 probability of each word under the vocabulary alone (plain) and by kind: s0, s1, ... ; sums and types are each kind's tokens and distinct words."""
    names = ["plain", *(f"s{k}" for k in range(len(logp)))]
    freed = np.where(types > 0, DISCOUNT * types, 1) / np.maximum(sums, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        rows = np.vstack([lattice.logp, logp])
        for batch in _gathered(batches):
            words = batch.column(0).to_pylist()
            plain, *kinds = lattice.score_kinds(words, rows)
            out = [pa.array(plain / np.log(10))]
            for k, paths in enumerate(kinds):
                own = np.maximum(batch.column(k + 1).to_numpy() - DISCOUNT, 0) / max(sums[k], 1)
                with np.errstate(divide="ignore"):
                    out.append(pa.array(np.logaddexp(np.log(own), np.log(freed[k]) + paths) / np.log(10)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])

    return run


def _score_docs(common, end: np.ndarray):
    """Sums over each text's common words, and one row for each of its other words.

    ``common`` has the places of words and, by place, (known, base, plain, s0, ...); ``end`` is such a row.
    """
    names = ["row", "key", "train", "tokens", *_numbers(len(end) - 3), "word", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table = common.value
        for batch in (b.slice(at, DOCS) for b in batches for at in range(0, b.num_rows, DOCS)):
            tokens, sums, row, other, times = [], np.zeros((batch.num_rows, len(end))), [], [], []
            for i, text in enumerate(batch.column(3)):
                words = words_of(text.as_py())
                tokens.append(len(words) + 1)
                counts = Counter(words)
                n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                at = np.fromiter((places.get(w, -1) for w in counts), dtype=np.int64, count=len(counts))
                hit = at >= 0
                sums[i] = end + n[hit] @ table[at[hit]]
                if not hit.all():
                    found = [w for w, h in zip(counts, hit.tolist()) if not h]
                    other += found
                    times.append(n[~hit])
                    row.append(np.full(len(found), i))
            blank = [pa.nulls(batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens, pa.int64()), *map(pa.array, sums.T.copy()), *blank], names=names)
            if other:
                m = len(other)
                ids = batch.column(0).take(pa.array(np.concatenate(row)))
                blank = [pa.nulls(m, batch.column(1).type), pa.nulls(m, batch.column(2).type), pa.nulls(m, pa.int64()), *(pa.nulls(m, pa.float64()) for _ in end)]
                yield pa.RecordBatch.from_arrays([ids, *blank, pa.array(other, pa.binary()).cast(pa.string()), pa.array(np.concatenate(times))], names=names)

    return run


def _numbers(kinds: int) -> list[str]:
    return ["known", "base", "plain", *[f"s{k}" for k in range(kinds)]]


def kinds_of(docs: DataFrame, train: str, kind: str | None) -> tuple[DataFrame, int]:
    """``docs`` with ``k``, the number of its kind among those of training rows (-1: not for training).

    At most ``KINDS`` kinds: of more, the commonest stand for themselves and all others are one.
    """
    if kind is None:
        return docs.withColumn("k", F.when(F.col(train), 0).otherwise(-1)), 1
    counted = docs.where(F.col(train)).groupBy(F.col(kind).cast("string").alias("kind")).count().orderBy(F.desc("count"), "kind").limit(KINDS + 1).collect()
    more = len(counted) > KINDS
    found = sorted(counted[: KINDS - 1] if more else counted, key=lambda r: (r.kind is not None, r.kind or ""))
    k = F.lit(len(found) if more else 0)
    for i, r in enumerate(found):
        k = F.when(F.col(kind).cast("string").eqNullSafe(F.lit(r.kind)), i).otherwise(k)
    return docs.withColumn("k", F.when(F.col(train), k).otherwise(-1)), max(1, len(found) + more)


def score_documents(docs: DataFrame, train: str, pieces: list[str], kind: str | None = None, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """key, train flag, n_tokens, n_known, train_tokens, base_score, lattice_score and score (log10) of every row of ``docs``."""
    spark = docs.sparkSession
    marked, kinds = kinds_of(docs, train, kind)
    counts = materialize(word_counts(marked, kinds, text), "counts")
    ts = [f"t{i}" for i in range(kinds)]
    own = F.col("word").isNotNull()
    total = counts.agg(F.sum("uses").alias("uses"), *[F.sum(t).alias(t) for t in ts], *[F.count(F.when(own & (F.col(t) > 0), 1)).alias(f"v{t}") for t in ts], *[F.sum(F.when(~own, F.col(t))).alias(f"e{t}") for t in ts], F.count(F.when(F.expr(" + ".join(ts)) > 0, 1)).alias("v")).first()
    sums, types, ends = (np.array([total[p + t] or 0 for t in ts]) for p in ("", "v", "e"))
    n, divisor = int(sums.sum()), sums.sum() + SMOOTH * (total.v + 1)
    logp = fit(counts, pieces, kinds, rounds if n else 0)
    columns = ", ".join([*(f"{t} long" for t in ts), "uses long", "plain double", *(f"s{k} double" for k in range(kinds))])
    words = counts.where(own).mapInArrow(_score_words(pieces, logp, sums, types), f"word string, {columns}")
    seen = F.expr(" + ".join(ts))
    numbers = _numbers(kinds)
    words = materialize(words.withColumn("known", (seen > 0).cast("int")).withColumn("base", F.log10((seen + SMOOTH) / F.lit(float(divisor)))).select("word", "uses", *numbers), "words")
    # At most 1 / share words have that share of all tokens.
    least = share * (total.uses or 0)
    common = words.where(F.col("uses") >= least).select("word", *numbers).toPandas()
    table = common[numbers].to_numpy(dtype=float).reshape(len(common), len(numbers))
    places = {w.encode(): i for i, w in enumerate(common["word"])}
    log_end = np.log10(np.where(ends > 0, ends, SMOOTH) / np.maximum(sums, 1))
    end = np.array([float(ends.sum() > 0), np.log10((ends.sum() + SMOOTH) / divisor), Lattice(pieces).logp[-1] / np.log(10), *log_end])
    named = marked.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(train).alias("train"), F.col(text).alias("text"))
    schema = f"row long, key {docs.schema[key].dataType.simpleString()}, train boolean, tokens long, {', '.join(c + ' double' for c in numbers)}, word string, times long"
    found = materialize(named.mapInArrow(_score_docs(spark.sparkContext.broadcast((places, table)), end), schema), "sums")
    rare = found.where("word is not null").select("row", "word", "times").join(words.where(F.col("uses") < least).select("word", *numbers), "word")
    rare = rare.select("row", *[(F.col("times") * F.col(c)).alias(c) for c in numbers])
    whole = rare.unionByName(found.where("word is null").drop("word", "times"), allowMissingColumns=True)
    out = whole.groupBy("row").agg(F.max("key").alias("key"), F.max("train").alias("train"), F.sum("tokens").alias("tokens"), *[F.sum(c).alias(c) for c in numbers])
    prior = np.log10((ends + 1) / (ends.sum() + kinds))
    each = [F.col(f"s{k}") + float(prior[k]) for k in range(kinds)]
    top = F.greatest(*each) if kinds > 1 else each[0]
    score = top + F.log10(sum((F.pow(F.lit(10.0), e - top) for e in each), F.lit(0.0)))
    return out.select(F.col("key").alias(key), "train", F.col("tokens").alias("n_tokens"), F.round("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("plain").alias("lattice_score"), score.alias("score"))
