"""Exact top-k search by no-random-access aggregation over sorted lists.

Vectors are turned into whole numbers. Of each block of candidates every
component is a list of (value, candidate) entries sorted by value; a query reads
each list entry by entry from the end that its component's sign favours. What
it has read of a candidate adds up; what it hasn't is at most the list's
frontier (the last value read) and at least the list's other end, which gives
the score's upper and lower bound. A candidate whose upper bound is below the
k-th best lower bound, or below the k-th best final score of earlier blocks,
cannot qualify, nor can one that no list has shown yet once the sum of the
frontiers is below. When few candidates are left, reading stops and their
scores are resolved.

Many queries read together, to one of ``_DEPTHS`` after the other: the entries
read go to their candidates' places in a matrix that is zero elsewhere, and its
product with the queries gives the sums of all of them. ``Queries.read``
counts the entries that the queries have read and ``Queries.listed`` those there
were. Vectors of many components without structure are the hard case: most of
their lists must be read before the bounds part.

Queries are sent in rounds of at most ``ROUND`` to every partition of the
candidates, one round's broadcast at a time; each partition returns k rows a
query at most, the rows of all partitions meet by query, and the round's
result is written.

Defined results: vectors that are null or hold a null or non-finite component,
and rows without an id, take no part; only vectors of equal length are
compared; rows with the query's id are not its candidates; repeated candidate
rows each take a rank; equal query rows give one list; ties go to the smaller
id; scores beyond 64 bits count as the largest or smallest 64-bit number; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaybook.llm.common import stored

K, SCALE, QUERY_EVERY = 20, 64, 20
BLOCK, ROUND, _SEED, _CHUNK = 4096, 4096, 256, 128
_DEPTHS = (1 / 8, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1)  # parts of the lists after which bounds are compared
_FEW = 0.1  # reading stops for a query when at most this part of a block is left


def whole_vectors(batch: pa.RecordBatch, scale: float = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of an (id, vector) batch: ids and ``floor(scale * x)`` by vector length, unusable rows left out."""
    lists = batch.column(1)
    ok = ~np.asarray(lists.is_null()) & ~np.asarray(batch.column(0).is_null())
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    values = lists.flatten()
    flat = np.asarray(values.cast(pa.float64()).fill_null(float("nan")))
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(row[~np.isfinite(flat)], minlength=len(lengths)) > 0
    ok &= ~bad
    ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths[ok]).tolist():
        at = np.flatnonzero(ok & (lengths == n))
        out[n] = ids[at], np.floor(scale * flat[starts[at][:, None] + np.arange(n)])
    return out


class Queries:
    """Queries of one length and the best candidates met so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.largest = float(np.abs(vectors).max(initial=0))
        self.score = [np.zeros(0)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        self.floor = np.full(len(ids), -np.inf)
        self.stopped = np.zeros(len(ids), np.int64)  # which of _DEPTHS each query read to in the block before
        self.read = self.listed = self.resolved = self.scanned = 0

    def scan(self, ids: np.ndarray, block: np.ndarray) -> None:
        """Let a block of candidates take part."""
        self.scanned += len(ids)
        reach = self.largest * float(np.abs(block).max(initial=0)) * max(1, block.shape[1])
        kind = np.float32 if reach < 1 << 24 else np.float64
        # whole numbers beyond exact floating point: bounds give way by more than their error
        slack = 0.0 if reach < 1 << 53 else reach * 2.0**-40
        order = np.argsort(block, axis=0, kind="stable")
        values = np.take_along_axis(block, order, axis=0).astype(kind)
        for at in range(0, len(self.ids), _CHUNK):
            part = slice(at, min(at + _CHUNK, len(self.ids)))
            alive = self._read(part, ids, order, values, slack)
            self._resolve(part, ids, block, alive, reach < 1 << 53)

    def _read(self, part: slice, ids: np.ndarray, order: np.ndarray, values: np.ndarray, slack: float) -> np.ndarray:
        """Read the lists until few candidates are left; which may still qualify, a row each and a column for each query."""
        q = self.vectors[part].astype(values.dtype).T
        n, lists = values.shape
        up, down, own = np.maximum(q, 0), np.minimum(q, 0), ids[:, None] == self.ids[part][None, :]
        out = np.ones((n, q.shape[1]), bool)
        open_ = np.arange(q.shape[1])
        # what has been read from the lists' upper and lower ends: values, and marks where there are any
        ends = [(np.zeros((n, lists), values.dtype), np.zeros((n, lists), values.dtype)) for _ in range(2)]
        self.listed += n * lists * len(open_)
        depth, list_of = 0, np.arange(lists)

        def bound(above: np.ndarray, below: np.ndarray) -> np.ndarray:
            """Sums of what has been read, and for the rest one value a list."""
            rest = above @ up + below @ down
            return (ends[0][0] - ends[0][1] * above) @ up + (ends[1][0] - ends[1][1] * below) @ down + rest

        # bounds needn't be compared long before the depth at which the block before was settled
        first = max(0, int(self.stopped[part].min()) - 1)
        for turn in range(first, len(_DEPTHS)):
            to = max(1, int(n * _DEPTHS[turn]))
            if to == depth:
                continue
            for side, (seen, mark) in zip((slice(n - to, n - depth), slice(depth, to)), ends, strict=True):
                seen[order[side], list_of] = values[side]
                mark[order[side], list_of] = 1
            self.read += (to - depth) * lists * len(open_)
            depth = to
            upper = bound(values[n - depth], values[depth - 1])  # the frontiers
            limit = self.floor[part][open_]
            if np.isinf(limit).any() and n > self.k:
                lower = bound(values[0], values[-1])  # the other ends
                lower[own[:, open_]] = -np.inf
                limit = np.maximum(limit, -np.partition(-lower, self.k - 1, axis=0)[self.k - 1])
            alive = upper >= limit - slack
            out[:, open_] = alive
            self.stopped[part.start + open_] = turn
            more = alive.sum(0) > max(self.k, _FEW * n)
            if not more.any():
                break
            if not more.all():
                open_, up, down = open_[more], up[:, more], down[:, more]
        return out & ~own

    def _resolve(self, part: slice, ids: np.ndarray, block: np.ndarray, alive: np.ndarray, exact: bool) -> None:
        """Final scores of the candidates left, and each query's best so far."""
        qi, ci = np.nonzero(alive.T)
        q = self.vectors[part]
        spans = [slice(s, s + 65536) for s in range(0, len(qi), 65536)]
        if exact:
            score = np.concatenate([np.einsum("ij,ij->i", q[qi[s]], block[ci[s]]) for s in spans] or [np.zeros(0)])
        else:
            whole = lambda a: np.array([[int(v) for v in r] for r in a], dtype=object).reshape(a.shape)
            ints, theirs = whole(q), whole(block)
            score = np.concatenate([(ints[qi[s]] * theirs[ci[s]]).sum(1) for s in spans] or [np.zeros(0, object)]).clip(-(1 << 63), (1 << 63) - 1)
        self.resolved += len(qi)
        keep = score >= self.floor[part][qi]
        qi, score, own = qi[keep], score[keep], ids[ci[keep]]
        bounds = np.searchsorted(qi, np.arange(len(q) + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            s = slice(bounds[k], bounds[k + 1])
            n = part.start + k
            all_score, all_ids = np.concatenate([self.score[n], score[s]]), np.concatenate([self.found[n], own[s]])
            best = np.lexsort((all_ids, -all_score))[: self.k]
            self.score[n], self.found[n] = all_score[best], all_ids[best]
            if len(best) == self.k:
                # a whole number beyond exact floating point must not round up past itself
                last = float(all_score[best[-1]])
                self.floor[n] = last if abs(last) < 1 << 53 else np.nextafter(last, -np.inf)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, round_size: int = ROUND) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of highest integer inner product for every query row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    asked = rows.filter(is_query & F.col("v").isNotNull() & F.col("vec_id").isNotNull()).distinct()
    rounds = max(1, -(-asked.count() // round_size))
    parts = []
    for turn in range(rounds):
        table = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == turn).orderBy("vec_id").toArrow()
        batches = table.combine_chunks().to_batches()
        by_length = whole_vectors(batches[0], scale) if batches else {}
        sent = spark.sparkContext.broadcast(by_length)
        numbers, total = {}, 0
        for n, (ids, _) in by_length.items():
            numbers[n] = total
            total += len(ids)

        def run(found: Iterator[pa.RecordBatch], sent=sent, numbers=numbers) -> Iterator[pa.RecordBatch]:
            states = {n: Queries(ids, v, k) for n, (ids, v) in sent.value.items()}
            held: dict[int, list] = {}
            for batch in found:
                for n, (ids, v) in whole_vectors(batch, scale).items():
                    if n in states:
                        held.setdefault(n, []).append((ids, v))
                        if sum(len(i) for i, _ in held[n]) >= BLOCK:
                            _scan(states[n], held.pop(n))
            for n, blocks in held.items():
                _scan(states[n], blocks)
            for n, state in states.items():
                count = np.array([len(s) for s in state.score], np.int64)
                if count.sum():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.arange(len(count)) + numbers[n], count)), pa.array(np.repeat(state.ids, count)), pa.array(np.concatenate(state.found)), pa.array([int(s) for x in state.score for s in x], pa.int64())],
                        ["q", "query_id", "vec_id", "score"],
                    )

        order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), F.col("vec_id").asc())
        best = rows.mapInArrow(run, "q long, query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        parts.append(stored(best.select("query_id", "rank", "vec_id", "score"), "topk-round"))
        sent.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _scan(state: Queries, blocks: list) -> None:
    """A partition's first blocks are small: their best scores are what later ones are held against."""
    ids, v = np.concatenate([i for i, _ in blocks]), np.concatenate([x for _, x in blocks])
    at = 0
    while at < len(ids):
        size = min(BLOCK, max(_SEED, 3 * state.scanned))
        state.scan(ids[at : at + size], v[at : at + size])
        at += size


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % QUERY_EVERY == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
