"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is lower-cased (A-Z), and its bag is every run of 3 to 6 bytes of its
words, a blank at a run's end marking a word's edge. A word's runs weigh the
square root of its uses within each window of ``WINDOW`` words, so that one
word repeated a thousand times is not the whole text. Runs are hashed into ``BUCKETS`` vectors; the text's vector is
their weighted mean, and a linear softmax over it gives the two classes. The
vectors and the softmax are trained together, in numpy, by AdaGrad on the
cross-entropy. A misspelling that training never saw shares most of its runs
with what it did see, and so their vectors.

A mean of vectors under a linear layer is a mean of numbers: for scoring, each
bucket's vector is folded with the softmax into one weight, which every worker
gets (``BUCKETS`` numbers, whatever the corpus).

The classifier is fitted on a bounded sample: of each class up to
``PER_CLASS`` times (1 for toxic, 3 for clean) labelled training rows, by order
of a hash of their ids, until their texts have passed ``CLASS_CHARS``
characters times the same. No row is left out for its own length, and every
row is scored, over its whole text.

The constant is set by folds: the sample is dealt into ``FOLDS``, each is
scored by a classifier fitted on the others, and the cut with the best F1 over
all of these (rows weighing as their class is sampled) becomes a score of 0.5.

Defined cases: null texts count as empty; a text without words gets the score
of the model's constant; labels that are null or unknown to ``docs`` are left
out; an id with several labels counts as toxic if one says so; if a class has
no rows, every score is the share of toxic labels (0 if there are none); with
fewer rows than folds in a class, the constant is the softmax's own;
repeated rows are each scored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

BITS = 20
BUCKETS = 1 << BITS
DIM = 4
SIZES = (3, 4, 5, 6)
PER_CLASS = 1500
CLASS_CHARS = 8_000_000
#: Buckets in fewer texts of the sample stay without weight.
MIN_TEXTS = 8
#: Pull of the vectors that a step touches towards zero.
DECAY = 3e-6
FOLDS = 3
#: Gradient steps, whatever the sample's size.
STEPS = 480
RATE = 0.5
#: Runs without weight that every bag holds, so that a few runs do not speak as loud as many.
PRIOR = 64.0
#: Words within which a word's uses are damped.
WINDOW = 256
BATCH = 128
#: Bytes that are hashed at once.
BLOCK = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> Iterator[tuple[bytes, int]]:
    """(word, uses) within each window of a text, A-Z lower-cased."""
    words = (text or "").encode().translate(_LOWER).split()
    for at in range(0, len(words), WINDOW):
        yield from Counter(words[at : at + WINDOW]).items()


def runs(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: (size, bucket at each place, whether a run of that size starts there)."""
    blank = data == 32
    h = data.astype(np.uint64)
    # Distance to what stops a run: places whose inner bytes hold no blank.
    inside = np.ones(len(data), dtype=bool)
    for size in range(2, max(SIZES) + 1):
        n = len(data) - size + 1
        if n <= 0:
            return
        if size > 2:
            inside = inside[:n] & ~blank[size - 2 : size - 2 + n]
        h = h[:n] * np.uint64(0x100000001B3) + data[size - 1 :].astype(np.uint64)
        if size in SIZES:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            yield size, (mixed >> np.uint64(64 - BITS)).astype(np.int32), inside[:n]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares of the bag."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    block: list[tuple[bytes, int]] = []

    def flush() -> None:
        data = np.frombuffer(b" " + b" ".join(w for w, _ in block) + b" ", dtype=np.uint8)
        weight = np.repeat(np.sqrt([n for _, n in block]), [len(w) + 1 for w, _ in block])
        for _, buckets, ok in runs(data):
            m = min(len(buckets), len(weight))
            found.append(_summed(buckets[:m][ok[:m]], weight[:m][ok[:m]]))
        block.clear()

    held = 0
    for word, n in words_of(text):
        block.append((word, n))
        held += len(word) + 1
        if held >= BLOCK:
            flush()
            held = 0
    if block:
        flush()
    if not found:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    at, n = _summed(np.concatenate([b for b, _ in found]), np.concatenate([w for _, w in found]))
    return at.astype(np.int32), (n / (n.sum() + PRIOR)).astype(np.float32)


def _summed(buckets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and the sums of their weights."""
    at, place = np.unique(buckets, return_inverse=True)
    return at, np.bincount(place, weights=weight, minlength=len(at))


@dataclass
class Model:
    weights: np.ndarray  # one for each bucket, folded with the softmax
    constant: float

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def train(texts: list[str | None], labels: list[int], of: list[float] | None = None, dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = 1) -> Model:
    """Embeddings and softmax, trained together on bags of subwords; ``of``: how many labelled rows each row stands for."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), 50.0 if share else -50.0)
    return train_bags([bag(t) for t in texts], labels, of, dim, steps, rate, seed)


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], of: list[float] | None = None, dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = 1) -> Model:
    """As ``train``, on the bags of the texts; ``bags`` is thinned in place, so that no second copy of them is held."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return train([], labels)
    seen = np.zeros(BUCKETS, dtype=np.int32)
    for at, _ in bags:
        seen[at] += 1
    few = seen < min(MIN_TEXTS, len(y))
    for k, (at, share) in enumerate(bags):
        bags[k] = at[~few[at]], share[~few[at]]
    model = _descend(bags, y, np.arange(len(y)), dim, steps, rate, seed)
    if np.bincount(y).min() < FOLDS:
        return model
    fold = np.zeros(len(y), dtype=np.int64)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % FOLDS
    odds = np.zeros(len(y))
    for f in range(FOLDS):
        part = _descend(bags, y, np.flatnonzero(fold != f), dim, steps, rate, seed)
        for k in np.flatnonzero(fold == f):
            odds[k] = part.weights[bags[k][0]] @ bags[k][1] + part.constant
    return Model(model.weights, model.constant - best_cut(odds, y, np.ones(len(y)) if of is None else np.asarray(of, dtype=float)))


def best_cut(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of ``odds`` that gives the best F1, midway between its two neighbours; of equal cuts the highest."""
    order = np.argsort(-odds, kind="stable")
    high, toxic = odds[order], y[order] == 1
    hits, taken = np.cumsum(weight[order] * toxic), np.cumsum(weight[order])
    f1 = 2 * hits / (taken + hits[-1])
    f1[:-1][high[:-1] == high[1:]] = -1  # equal odds are not cut apart
    at = int(np.argmax(f1))
    return float((high[at] + high[at + 1]) / 2) if at + 1 < len(high) else float(high[at] - 1)


def _descend(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, own: np.ndarray, dim: int, steps: int, rate: float, seed: int) -> Model:
    """A model fitted on the rows ``own``."""
    rng = np.random.default_rng(seed)
    seen = np.zeros(BUCKETS, dtype=np.int32)
    for k in own:
        seen[bags[k][0]] += 1
    kept = np.flatnonzero(seen >= min(MIN_TEXTS, len(own)))
    place = np.full(BUCKETS, len(kept), dtype=np.int32)  # the last: buckets without weight
    place[kept] = np.arange(len(kept))
    emb = rng.uniform(-1 / dim, 1 / dim, (dim, len(kept) + 1))
    emb[:, -1] = 0
    out, bias = rng.uniform(-1 / dim, 1 / dim, (dim, 2)), np.zeros(2)
    sq_emb, sq_out, sq_bias = np.full(emb.shape, 1e-8), np.full(out.shape, 1e-8), np.full(2, 1e-8)
    order = np.empty(0, dtype=np.int64)
    for done in range(steps):
        step = rate * (1 - done / steps)
        if not len(order):
            order = rng.permutation(own)
        part, order = order[:BATCH], order[BATCH:]
        ids, share = place[np.concatenate([bags[k][0] for k in part])], np.concatenate([bags[k][1] for k in part])
        row = np.repeat(np.arange(len(part)), [len(bags[k][0]) for k in part])
        mean = np.stack([np.bincount(row, weights=share * emb[d, ids], minlength=len(part)) for d in range(dim)], axis=1)
        odds = mean @ out + bias
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(part)), y[part]] -= 1
        p /= len(part)
        back = p @ out.T
        g_out, g_bias = mean.T @ p, p.sum(axis=0)
        for d in range(dim):
            grad = np.bincount(ids, weights=share * back[row, d], minlength=len(kept) + 1)
            grad = grad + DECAY * emb[d] * (grad != 0)
            grad[-1] = 0
            sq_emb[d] += grad**2
            emb[d] -= step * grad / np.sqrt(sq_emb[d])
        sq_out += g_out**2
        out -= step * g_out / np.sqrt(sq_out)
        sq_bias += g_bias**2
        bias -= step * g_bias / np.sqrt(sq_bias)
    weights = np.zeros(BUCKETS)
    weights[kept] = (out[:, 1] - out[:, 0]) @ emb[:, :-1]
    return Model(weights, float(bias[1] - bias[0]))


def logits(texts: Iterator[str | None], model: Model) -> np.ndarray:
    """The model's log odds of whole texts, hashed in blocks of many texts, or of pieces of a long one."""
    weights = model.weights.astype(np.float32)
    total: list[float] = []
    count: list[float] = []
    block: list[bytes] = []
    often: list[int] = []
    owner: list[int] = []

    def flush() -> None:
        if not block:
            return
        data = np.frombuffer(b" " + b" ".join(block) + b" ", dtype=np.uint8)
        starts = np.cumsum([0, *(len(w) + 1 for w in block)])[:-1]
        value, number = np.zeros(len(data)), np.zeros(len(data))
        for _, bucket, ok in runs(data):
            value[: len(bucket)] += np.where(ok, weights[bucket], 0)
            number[: len(bucket)] += ok
        damped, at = np.sqrt(often), np.array(owner)
        low = at[0]
        for sums, own in ((total, value), (count, number)):
            for k, v in enumerate(np.bincount(at - low, weights=damped * np.add.reduceat(own, starts)).tolist()):
                sums[low + k] += v
        block.clear()
        often.clear()
        owner.clear()

    held = 0
    for text in texts:
        total.append(0.0)
        count.append(0.0)
        for word, n in words_of(text):
            block.append(word)
            often.append(n)
            owner.append(len(total) - 1)
            held += len(word) + 1
            if held >= BLOCK:
                flush()
                held = 0
    flush()
    return np.array(total) / (np.array(count) + PRIOR) + model.constant


def _scorer(shared, at: int, kept: int):
    """Scores column ``at`` of its batches; passes the first ``kept`` columns on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            found = model.score(logits((t.as_py() for t in batch.column(at)), model))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(found)], names=[*batch.schema.names[:kept], "score"])

    return run


def sample(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS, class_chars: int = CLASS_CHARS) -> DataFrame:
    """(doc_id, toxic, stands_for, text): the bounded sample that the classifier is fitted on, and how many labelled rows each row stands for."""
    marks = labels.where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    thin = docs.where(usable).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    thin = thin.join(marks, "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n"))
    thin = materialize(thin.withColumn("h", F.xxhash64("doc_id")), "labelled")
    totals = thin.groupBy("toxic").count().withColumnRenamed("count", "total")
    before = "coalesce(sum(n) over (order by h, doc_id rows between unbounded preceding and 1 preceding), 0)"
    # At most ``times * per_class`` rows reach these windows.
    pick = lambda toxic, times: thin.where(F.col("toxic") == toxic).orderBy("h", "doc_id").limit(times * per_class).withColumn("before", F.expr(before)).where(F.col("before") < times * class_chars)
    picked = pick(1, 1).unionByName(pick(0, 3)).join(F.broadcast(totals), "toxic")
    picked = picked.withColumn("stands_for", F.col("total") / F.expr("count(*) over (partition by toxic)")).select("doc_id", "toxic", "stands_for")
    # Ids are picked first; at most 4 * per_class of them go to where the texts are, so texts are not shuffled.
    picked = F.broadcast(materialize(picked, "picked"))
    found = docs.where(usable).select("doc_id", "text").join(picked, "doc_id")
    return found.groupBy("doc_id", "toxic", "stands_for").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trains on all rows of its one partition, the bounded sample."""
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    marks: list[int] = []
    of: list[float] = []
    for batch in batches:
        # Bags are made as texts come: a text is not held once it has been read.
        bags += [bag(t.as_py()) for t in batch.column(0)]
        marks += batch.column(1).to_pylist()
        of += batch.column(2).to_pylist()
    model = train_bags(bags, marks, of)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([model.constant])], names=["weights", "constant"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS, class_chars: int = CLASS_CHARS) -> Model:
    """The classifier, trained in one task (its sample is bounded); the driver gets one number a bucket."""
    rows = sample(docs, labels, usable, per_class, class_chars).repartition(1).sortWithinPartitions("doc_id").select("text", "toxic", "stands_for")
    made = rows.mapInArrow(_trainer, "weights binary, constant double").first()
    return Model(np.frombuffer(made.weights, dtype="<f4"), made.constant) if made else train([], [])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row and its ``score`` (0 to 1)."""
    # Numbers, not an instance: broadcasts are pickled by reference, and workers have no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.constant))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    read = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    at = keep.index(text) if text in keep else len(keep)
    return read.mapInArrow(_scorer(shared, at, len(keep)), f"{schema}, score double")
