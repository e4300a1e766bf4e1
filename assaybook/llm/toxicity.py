"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its byte n-grams (3 to 5, with
word ends) and of the word itself, all hashed into one table; a window of 16
words is the mean of its words' vectors (a shorter one is filled up with zero
vectors), and a softmax over two classes reads
it. Table and softmax are trained jointly in numpy. A misspelling shares most
of its n-grams with the word it stands for, and so its vector.

Labels mark whole documents, of which a few words may be toxic: training first
gives every window its document's label, then goes on with each document's
highest window alone. A document's score is a
logistic function, fitted on documents that training left out, of its highest
window.

The model is fitted on at most ``ROWS_A_CLASS`` labelled documents of each
class, those first by a hash of the id, of at most ``LONGEST`` bytes each. Every
document is scored whole. Training never sees label rows whose
``crc32(doc_id) % 5`` is 0; language, source and id are no features.

Defined results: null or empty texts score as a document without words;
repeated rows score alike; with labels of one class only, or none, every score
is that class's share (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm.common import mix64, tidy_map

ROWS_A_CLASS, LONGEST = 1500, 65_536
BUCKETS, DIMENSIONS, WINDOW = 1 << 17, 8, 16
_GRAMS = (3, 4, 5)
RATE = 1.0
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
# bounds of a scoring worker's memory; no score depends on them
_TABLE_WORDS, _CHUNK_BYTES, _WORDS_AT_ONCE = 150_000, 1 << 20, 10_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, one word after the other, and where each word's begin."""
    cores = [b"<" + _EDGES.sub("", w).encode("utf-8", "replace") + b">" for w in words]
    length = np.array([len(c) for c in cores], np.int64)
    data = np.frombuffer(b"".join(cores), np.uint8).astype(np.uint64)
    first = np.cumsum(length) - length
    word_at = np.repeat(np.arange(len(words)), length)
    left = (first + length)[word_at] - np.arange(len(data))  # bytes from here to the word's end
    own, keys = [], []
    with np.errstate(over="ignore"):
        gram = np.zeros(len(data), np.uint64)
        for n in range(1, max(_GRAMS) + 1):
            shifted = np.zeros(len(data), np.uint64)
            shifted[: max(0, len(data) - n + 1)] = data[n - 1 :]
            gram = gram * np.uint64(257) + shifted + np.uint64(1)
            if n in _GRAMS:
                fits = left >= n
                own.append(word_at[fits])
                keys.append(mix64(gram[fits] * np.uint64(8) + np.uint64(n)))
        power = np.cumprod(np.full(int(length.max(initial=1)), 0x100000001B3, np.uint64))
        place = np.arange(len(data)) - first[word_at]
        whole = np.add.reduceat(data * power[place], first) if len(data) else np.zeros(0, np.uint64)
        own.append(np.arange(len(words)))
        keys.append(mix64(whole ^ np.uint64(0x5BD1E995)))
    own, keys = np.concatenate(own), np.concatenate(keys)
    order = np.argsort(own, kind="stable")
    return (keys[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(own[order], np.arange(len(words)))


@dataclass
class Model:
    """One number for each bucket: its vector's part in the difference of the two classes' logits."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        means = []
        for k in range(0, len(words), _WORDS_AT_ONCE):
            buckets, starts = subwords(words[k : k + _WORDS_AT_ONCE])
            means.append(np.add.reduceat(self.weight[buckets], starts) / np.diff(np.append(starts, len(buckets))))
        return np.concatenate(means)

    def top(self, scores: np.ndarray) -> float:
        """The highest window's logit."""
        if not len(scores):
            return self.bias
        starts = np.arange(0, len(scores), WINDOW)
        return float(np.add.reduceat(scores, starts).max()) / WINDOW + self.bias

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40))))


def _constant(share: float) -> Model:
    share = min(max(share, 0.0), 1.0)
    shift = -40.0 if share == 0 else 40.0 if share == 1 else float(np.log(share / (1 - share)))
    return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, shift)


class _Groups:
    """Means over runs of rows, and their gradients: ``of`` names each entry's row, ``starts`` each run's first entry.

    A run of fewer than ``over`` entries counts as that many.
    """

    def __init__(self, of: np.ndarray, starts: np.ndarray, rows: int, over: int = 0):
        self.of, self.starts, self.rows = of, starts, rows
        self.length = length = np.diff(np.append(starts, len(of)))
        self.count = np.maximum(length, over).astype(np.float32)[:, None]
        run = np.repeat(np.arange(len(starts)), length)
        order = np.argsort(of, kind="stable")
        self.back = run[order]
        self.used, self.back_starts = np.unique(of[order], return_index=True)

    def mean(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.of], self.starts) / self.count

    def gradient(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, g.shape[1]), np.float32)
        out[self.used] = np.add.reduceat((g / self.count)[self.back], self.back_starts)
        return out


class _Net:
    """The table of subword vectors and the softmax that reads a window's mean."""

    def __init__(self, words: list[str], seed: int):
        buckets, self.word_starts = subwords(words)
        self.used, self.compact = np.unique(buckets, return_inverse=True)
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((len(self.used), DIMENSIONS)) * 1e-4).astype(np.float32)
        self.out = rng.standard_normal((DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros((1, 2), np.float32)
        self.lengths = np.diff(np.append(self.word_starts, len(self.compact)))
        self.step = 0

    def margins(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        per_word = np.add.reduceat((self.table @ (self.out[:, 1] - self.out[:, 0]))[self.compact], self.word_starts) / self.lengths
        return np.add.reduceat(per_word[ids], starts) / WINDOW + float(self.bias[0, 1] - self.bias[0, 0])

    def descend(self, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, share: np.ndarray, doc: np.ndarray, steps: int) -> None:
        """Momentum steps on windows of words ``ids`` with labels ``y``, that count ``share`` each in document ``doc``."""
        words, ids = np.unique(ids, return_inverse=True)
        lengths = self.lengths[words]
        spans = np.repeat(self.word_starts[words] - np.cumsum(lengths) + lengths, lengths)
        entries = self.compact[spans + np.arange(len(spans))]
        by_word = _Groups(entries, np.cumsum(lengths) - lengths, len(self.used))
        by_window = _Groups(ids, starts, len(words), WINDOW)
        even = 0.5 / np.maximum(np.bincount(y, weights=share, minlength=2), 1e-9)
        # What chance does to an n-gram's gradient. Steps are in these units: neither rare n-grams, which could
        # memorise labels, nor common ones, whose sums differ by chance, outrun those that tell the classes apart.
        size = by_window.length
        pair, at = np.unique(np.repeat(doc, size) * np.int64(len(words)) + ids, return_inverse=True)
        part = np.bincount(at, weights=np.repeat(share / by_window.count[:, 0], size))
        square = np.bincount(pair % len(words), weights=part * part, minlength=len(words)) / lengths**2
        few = 5 * float(np.mean(part * part)) / float(np.mean(lengths)) ** 2
        noise = np.sqrt(np.bincount(entries, weights=np.repeat(square, lengths), minlength=len(self.used)) + few).astype(np.float32)[:, None]
        momentum = [np.zeros_like(x) for x in (self.table, self.out, self.bias)]
        for _ in range(steps):
            self.step += 1
            hidden = by_window.mean(by_word.mean(self.table))
            logits = hidden @ self.out + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = (p * (share * even[y])[:, None]).astype(np.float32)
            grads = (by_word.gradient(by_window.gradient(g @ self.out.T)) / noise, hidden.T @ g, g.sum(0, keepdims=True))
            for m, grad in zip(momentum, grads, strict=True):
                m *= 0.7
                m += 0.3 * grad
            # the strongest n-gram moves by a length that shrinks from step to step, all others in proportion
            pace = RATE / (1 + self.step / 20) / (np.sqrt((momentum[0] ** 2).sum(1).max()) + 1e-12)
            self.table -= pace * momentum[0]
            self.out -= 0.5 * momentum[1]
            self.bias -= 0.5 * momentum[2]


def fit(texts: list[str | None], labels: list[int], toxic_share: float | None = None, rounds: int = 12, seed: int = 7) -> Model:
    """Train on documents and their 0/1 labels; every fourth document only fits the logistic function.

    ``toxic_share`` is the class's share among all labels, of which the sample may hold another.
    """
    y_docs = np.array(labels, np.int64)
    if not len(y_docs) or y_docs.min() == y_docs.max():
        return _constant(float(y_docs.mean()) if len(y_docs) else 0.0)
    docs = [words_of(t) or [""] for t in texts]
    train = [i for i in range(len(docs)) if i % 4] if len(docs) >= 16 else list(range(len(docs)))
    # words of one document alone tell nothing of others: they keep their places, but no vector is trained for them
    spread = Counter(w for i in train for w in set(docs[i]))
    vocabulary = {"": 0}
    for w in sorted(w for w, n in spread.items() if n > 1):
        vocabulary.setdefault(w, len(vocabulary))
    n_words = np.array([len(docs[i]) for i in train])
    ids = np.fromiter((vocabulary.get(w, 0) for i in train for w in docs[i]), np.int32, int(n_words.sum()))
    windows = -(-n_words // WINDOW)
    doc_of = np.repeat(np.arange(len(train)), windows)
    starts = np.repeat(np.cumsum(n_words) - n_words, windows) + WINDOW * (np.arange(len(doc_of)) - np.repeat(np.cumsum(windows) - windows, windows))
    ends = np.append(starts[1:], len(ids))

    net = _Net(list(vocabulary), seed)
    y = y_docs[train][doc_of]
    net.descend(ids, starts, y, (1.0 / windows)[doc_of].astype(np.float32), doc_of, 6)  # a document counts once, however long
    highest: set[int] = set()
    for _ in range(rounds):
        order = np.lexsort((net.margins(ids, starts), doc_of))
        top = order[np.cumsum(windows) - 1]
        # windows of clean documents that were once highest stay in; a toxic document is its present highest
        highest |= set(top[y[top] == 0].tolist())
        chosen = np.array(sorted(highest | set(top[y[top] == 1].tolist())))
        length = (ends - starts)[chosen]
        first = np.cumsum(length) - length
        own = ids[np.repeat(starts[chosen] - first, length) + np.arange(length.sum())]
        net.descend(own, first, y[chosen], np.ones(len(chosen), np.float32), doc_of[chosen], 20)
    weight = np.zeros(BUCKETS, np.float32)
    weight[net.used] = net.table @ (net.out[:, 1] - net.out[:, 0])
    model = Model(weight, float(net.bias[0, 1] - net.bias[0, 0]), 1.0, 0.0)

    check = [i for i in range(len(docs)) if not i % 4] if len(train) < len(docs) else train
    if len(set(y_docs[check].tolist())) < 2:
        check = list(range(len(docs)))
    tops = np.array([model.top(model.word_scores(docs[i])) for i in check])
    model.slope, model.shift = _logistic(tops, y_docs[check])
    if toxic_share and toxic_share < 1:
        here = y_docs[check].mean()
        # half way from the sample's odds to the corpus's: to miss a toxic document is the worse of two errors
        model.shift += 0.5 * float(np.log(toxic_share / (1 - toxic_share)) - np.log(here / (1 - here)))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a weak prior and softened targets; the slope is not negative."""
    centre, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - centre) / scale, np.ones(len(x))], 1)
    target = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, z.T @ (p - target) + 1e-3 * w)
    slope = max(w[0], 0.0) / scale
    return float(slope), float(w[1] - slope * centre)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows_a_class: int = ROWS_A_CLASS, longest: int = LONGEST) -> tuple[list, float]:
    """The bounded sample: labelled documents of each class, first by a hash of the id; and the toxic share of all."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fits = docs.filter(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= longest).select(F.col(id_col).alias("doc_id"))
    known = known.join(fits, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [r for c in (0, 1) for r in known.filter(F.col("toxic") == c).orderBy(*order).limit(rows_a_class).collect()]
    if not picked:
        return [], 0.0
    share = known.agg(F.avg("toxic")).first()[0]
    chosen = docs.sparkSession.createDataFrame(picked, known.schema)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= longest)
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return rows.orderBy(*order).collect(), share


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows, share = training_rows(docs, labels, id_col, text_col)
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], share)


class Scorer:
    """Scores texts; keeps the scores of words it has met, a bounded number."""

    def __init__(self, model: Model):
        self.model, self.table = model, {}

    def scores(self, texts: list[str | None]) -> list[float]:
        docs = [words_of(t) for t in texts]
        new = list({w for d in docs for w in d}.difference(self.table))
        if len(self.table) + len(new) > _TABLE_WORDS:
            self.table = {}
            new = list({w for d in docs for w in d})
        self.table.update(zip(new, self.model.word_scores(new).tolist(), strict=True))
        get = self.table.__getitem__
        return [self.model.probability(self.model.top(np.fromiter(map(get, d), np.float64, len(d)))) for d in docs]


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity in a further column, which takes the place of one of its name."""
    docs = docs.drop(into)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            out, held, size = [], [], 0
            for item in batch.column(names.index(text_col)):
                text = item.as_py()
                held.append(text)
                size += len(text or "")
                if size >= _CHUNK_BYTES:
                    out += scorer.scores(held)
                    held, size = [], 0
            out += scorer.scores(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy_map(run), f"{schema}, `{into}` double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), train(docs, labels, id_col, text_col))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
