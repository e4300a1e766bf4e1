"""Substring deduplication by a logarithmic family of suffix arrays.

A byte goes if it lies in a 50-byte string that also starts in a document with
a smaller id. Ids arrive in batches, in ascending order. A batch gets a suffix
array (cut off at 50 bytes, the length that decides); it is merge-scanned
against the levels that earlier batches have left, and then becomes a level
itself. Levels of about equal size are merged, so there are logarithmically
many and every suffix is merged logarithmically often.

The family is split by content, so that it needs no machine that sees
everything. Each 50-byte window is filed under the least hash of the 20-byte
strings in it; equal windows are filed alike, and neighbouring windows mostly
alike, too, in runs. A run whose hash occurs in one document only is done
(``shared_keys``). The others' bytes go to the bucket of their hash, equal
strings once for each task: of those, only the smallest id needs an answer from
the bucket; a larger one's windows all go. Each bucket runs its own family.

Defined results: null texts are empty; texts under 50 bytes lose nothing;
rows with one id never remove from each other, repeated rows get equal values;
rows without an id come after all others and never remove from each other; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm.common import BYTE_VALUE, mix64, text_bytes_total, utf8
from assaybook.llm.jaccard_join import _power
from assaybook.llm.shared_keys import buckets_for, find_shared

LENGTH, GRAM = 50, 20
_SPAN = LENGTH - GRAM + 1
_CHUNK = 1 << 21
_BATCH_BYTES, _FLUSH_BYTES = 1 << 16, 8 << 20
_LAST = (1 << 63) - 1  # stands for a missing id


def window_keys(data: bytes) -> np.ndarray:
    """For every 50-byte window of ``data``, the least hash of the 20-byte strings in it."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    up, down = _power(len(raw) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[raw] * up[: len(raw)])])
    least = mix64((run[GRAM:] - run[:-GRAM]) * down[: len(raw) - GRAM + 1])
    width = 1
    while 2 * width <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _SPAN - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of a long text that overlap so that each window lies in one of them."""
    at = 0
    while at == 0 or at + LENGTH <= len(data):
        yield at, data[at : at + _CHUNK + LENGTH - 1]
        at += _CHUNK


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: text number, key, first window, last window. Windows never cross texts."""
    found = []
    at = 0
    while at < len(texts):
        if len(texts[at]) > _CHUNK:
            for begin, part in _segments(texts[at]):
                key = window_keys(part)
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(key)) - 1 if len(key) else starts
                found.append((np.full(len(starts), at), key[starts], starts + begin, ends + begin))
            at += 1
            continue
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= _CHUNK):
            size += len(texts[to])
            to += 1
        group = texts[at:to]
        key = window_keys(b"".join(group))
        lengths = np.array([len(t) for t in group])
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(group)), lengths)[: len(key)]
        place = np.arange(len(key)) - first[owner] if len(key) else np.zeros(0, np.int64)
        inside = place + LENGTH <= lengths[owner] if len(key) else np.zeros(0, bool)
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (owner[1:] == owner[:-1]) & inside[:-1]]) if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(inside & ~same)
        closes = np.flatnonzero(inside & ~np.concatenate([same[1:] & inside[1:], [False]])) if len(key) else starts
        found.append((owner[starts] + at, key[starts], place[starts], place[closes]))
        at = to
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffixes(strings: list[bytes]) -> np.ndarray:
    """The 50-byte windows of each string, one string after the other, as fixed-width keys."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    first = np.cumsum(lengths) - lengths
    count = lengths - LENGTH + 1
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
    return np.ascontiguousarray(windows).view(f"S{LENGTH}").ravel()


class IndexFamily:
    """Suffix arrays of all batches so far: few levels, each at least twice the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def holds(self, ordered: np.ndarray) -> np.ndarray:
        """Which of the ascending suffixes stand in some level: one forward scan over each."""
        out = np.zeros(len(ordered), bool)
        for level in self.levels:
            place = np.minimum(np.searchsorted(level, ordered), len(level) - 1)
            out |= level[place] == ordered
        return out

    def add(self, ordered: np.ndarray) -> None:
        """Take in the new, distinct, ascending suffixes of a batch; merge levels of about equal size."""
        self.levels.append(ordered)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            a, b = self.levels.pop(), self.levels.pop()
            both = np.concatenate([b, a])
            both.sort(kind="stable")  # two ascending runs: a merge
            self.levels.append(both[np.concatenate([[True], both[1:] != both[:-1]])])

    def scan(self, strings: list[bytes], ids: np.ndarray) -> np.ndarray:
        """Which windows of a batch's strings also start under a smaller id; then the batch joins the family.

        Ids must be ascending over batches, and no id may stand in two batches.
        """
        keys = suffixes(strings)
        owner = np.repeat(ids, [len(s) - LENGTH + 1 for s in strings])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        least = np.minimum.reduceat(owner[order], heads)
        known = self.holds(ordered[heads])
        size = np.diff(np.append(heads, len(order)))
        gone = np.empty(len(keys), bool)
        gone[order] = np.repeat(known, size) | (owner[order] > np.repeat(least, size))
        if not known.all():
            self.add(ordered[heads][~known])
        return gone


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    held, size, first = [], 0, 0
    for i, item in enumerate(batch.column(column)):
        held.append(utf8(item.as_py()))
        size += len(held[-1])
        if size >= _CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, texts in _texts(batch, 2):
            owner, key, begin, _ = runs(texts)
            lengths = np.array([len(t) for t in texts])
            own = slice(first, first + len(texts))
            about = pa.record_batch({"doc_id": pa.array(ids[own], pa.int64()), "tag": pa.array(tags[own], pa.int64()), "bytes": pa.array(lengths, pa.int64())})
            yield key, owner, begin + (np.cumsum(lengths) - lengths)[owner], about, len(texts), int(lengths.sum())


def _by_document(about: pa.Table, refs: np.ndarray) -> pa.Table:
    """The first windows of each document's shared runs."""
    lengths = np.asarray(about["bytes"])
    first = np.cumsum(lengths) - lengths
    cuts = np.searchsorted(refs, np.append(first, lengths.sum()))
    has = np.flatnonzero(np.diff(cuts))
    return pa.table({
        "doc_id": about["doc_id"].take(pa.array(has)),
        "tag": about["tag"].take(pa.array(has)),
        "starts": pa.array([(refs[cuts[k] : cuts[k + 1]] - first[k]).astype("<u4").tobytes() for k in has], pa.binary()),
    })


_SENT = pa.schema([("bucket", pa.int32()), ("numbers", pa.binary()), ("strings", pa.binary())])
_SENT_SQL = "bucket int, numbers binary, strings binary"
_GONE = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("range", pa.int64())])
_GONE_SQL = "doc_id long, tag long, range long"  # a range of windows: first, shifted by 32 bits, and last


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, each as its bytes by place so that leading zeros stand together, compressed."""
    parts = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 4 * len(kinds)
    for n, kind in zip(np.frombuffer(raw, "<u4", len(kinds)).tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        places = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(places.T).view(kind).ravel())
        at += n * size
    return out


_NUMBERS = ("<i8", "<u4", "<u4", "<i8", "<u4")  # ids, lengths, copies of each string; tag and place of each copy


class _Outbox:
    """Run strings of a task: each distinct string once, with the places in the document of the smallest id."""

    def __init__(self, n_buckets: int):
        self.n, self.held, self.size, self.local = n_buckets, {}, 0, []

    def add(self, bucket: int, string: bytes, doc: int, tag: int, at: int) -> None:
        known = self.held.get(string)
        if known is None:
            self.held[string] = [bucket, doc, [(tag, at)]]
            self.size += len(string)
        elif doc == known[1]:
            known[2].append((tag, at))
        else:
            gone = [(doc, tag, at)]
            if doc < known[1]:
                gone = [(known[1], t, a) for t, a in known[2]]
                known[1], known[2] = doc, [(tag, at)]
            windows = len(string) - LENGTH
            self.local += [(d, t, a, a + windows) for d, t, a in gone]

    def flush(self) -> pa.RecordBatch | None:
        """What is held, by bucket; local answers ride along in rows of their own without strings."""
        pack = zstandard.ZstdCompressor(level=3).compress
        by_bucket: dict[int, list] = {}
        for string, (bucket, doc, places) in self.held.items():
            by_bucket.setdefault(bucket, []).append((string, doc, places))
        rows = []
        for bucket, entries in by_bucket.items():
            strings, docs, places = zip(*entries, strict=True)
            numbers = _packed(np.array(docs, "<i8"), np.array([len(s) for s in strings], "<u4"), np.array([len(p) for p in places], "<u4"), np.array([t for p in places for t, _ in p], "<i8"), np.array([a for p in places for _, a in p], "<u4"))
            rows.append((bucket, numbers, pack(b"".join(strings))))
        if self.local:
            d, t, a, z = zip(*self.local, strict=True)
            rows.append((hash(d[0]) % self.n, _packed(np.array(d, "<i8"), np.zeros(0, "<u4"), np.array(z, "<u4"), np.array(t, "<i8"), np.array(a, "<u4")), b""))
        self.held, self.size, self.local = {}, 0, []
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def _send(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Outbox(n_buckets)
        for batch in batches:
            ids, tags, starts = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for first, texts in _texts(batch, 2):
                owner, key, begin, end = runs(texts)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                for k, text in enumerate(texts):
                    own = slice(cuts[k], cuts[k + 1])
                    chosen = np.flatnonzero(np.isin(begin[own], np.frombuffer(starts[first + k], "<u4"))) + cuts[k]
                    doc = _LAST if ids[first + k] is None else ids[first + k]
                    for b, a, z in zip((key[chosen] % np.uint64(n_buckets)).tolist(), begin[chosen].tolist(), end[chosen].tolist(), strict=True):
                        out.add(b, text[a : z + LENGTH], doc, tags[first + k], a)
                    if out.size >= _FLUSH_BYTES and (rows := out.flush()) is not None:
                        yield rows
        if (rows := out.flush()) is not None:
            yield rows

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: strings in ascending order of their ids, batch by batch through an index family."""
    unpack = zstandard.ZstdDecompressor().decompress
    docs, strings, tags, ats, gone = [], [], [], [], []
    for numbers, packed in zip(table["numbers"].to_pylist(), table["strings"].to_pylist(), strict=True):
        ids, lengths, copies, tag, at = _unpacked(numbers, *_NUMBERS)
        if not packed:
            gone.append((ids, tag, at.astype(np.int64), copies.astype(np.int64)))
            continue
        data, ends = unpack(packed), np.cumsum(lengths, dtype=np.int64)
        strings += [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        docs.append(ids)
        cuts = np.cumsum(copies)[:-1]
        tags += np.split(tag, cuts)
        ats += np.split(at.astype(np.int64), cuts)
    if strings:
        docs = np.concatenate(docs)
        order = np.argsort(docs, kind="stable")
        family, batch, size = IndexFamily(), [], 0
        least: dict[bytes, int] = {}
        for n, k in enumerate(order.tolist()):
            string = strings[k]
            seen = least.setdefault(string, int(docs[k]))
            if seen < docs[k]:
                # the whole string has come under a smaller id: nothing to look up, nothing to add
                gone += [(docs[k : k + 1], tags[k][i : i + 1], ats[k][i : i + 1], ats[k][i : i + 1] + len(string) - LENGTH) for i in range(len(tags[k]))]
            else:
                batch.append(k)
                size += len(string)
            last = n + 1 == len(order)
            if batch and (last or (size >= _BATCH_BYTES and docs[order[n + 1]] != docs[k])):
                gone += _ranges(family.scan([strings[i] for i in batch], docs[batch]), batch, strings, docs, tags, ats)
                batch, size = [], 0
    if not gone:
        return _GONE.empty_table()
    doc, tag, first, last = (np.concatenate(x) for x in zip(*gone, strict=True))
    return pa.table({"doc_id": pa.array(doc, mask=doc == _LAST), "tag": tag, "range": first << 32 | last}).cast(_GONE)


def _ranges(hit: np.ndarray, batch: list[int], strings: list, docs: np.ndarray, tags: list, ats: list) -> list:
    """Ranges of windows that go, at each place of their string."""
    count = np.array([len(strings[k]) - LENGTH + 1 for k in batch])
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(batch)), count)
    edge = np.concatenate([[True], owner[1:] != owner[:-1]])
    opens = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
    closes = np.flatnonzero(hit & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([hit[1:], [False]])))
    out = []
    for a, z in zip(opens.tolist(), closes.tolist(), strict=True):
        k = batch[owner[a]]
        lo, hi = a - begin[owner[a]], z - begin[owner[a]]
        n = len(tags[k])
        out.append((np.full(n, docs[k]), tags[k], ats[k] + lo, ats[k] + hi))
    return out


def removed_runs(texts: DataFrame, n_bytes: int) -> DataFrame:
    """``doc_id, tag, range``: ranges of 50-byte windows that go, of rows ``doc_id, tag, text``."""
    spark = texts.sparkSession
    shared = find_shared(texts, _gather, buckets_for(spark, n_bytes), _by_document, "doc_id long, tag long, starts binary")
    shared = shared.dropDuplicates(["doc_id", "tag"]).select(F.col("doc_id").alias("i"), F.col("tag").alias("t"), "starts")
    n_buckets = buckets_for(spark, n_bytes, 1 << 20)
    joined = texts.join(shared, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t"))).select("doc_id", "tag", "text", "starts")
    return joined.mapInArrow(_send(n_buckets), _SENT_SQL).groupBy("bucket").applyInArrow(_answer, _GONE_SQL)


def spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under ranges of windows: first bytes, and ends."""
    order = np.argsort(first, kind="stable")
    a, z = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.concatenate([[True], a[1:] > z[:-1]])
    at = np.flatnonzero(new)
    return a[at], z[np.append(at[1:] - 1, len(z) - 1)]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row; ``kept`` are the bytes that stay."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))
    gone = removed_runs(texts, text_bytes_total(texts, "text")).groupBy("doc_id", "tag").agg(F.collect_list("range").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("i"), F.col("tag").alias("t"), "gone")
    joined = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t")), "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, begin = [], 0, 0
            for n in range(batch.num_rows):
                data, gone = utf8(batch.column(1)[n].as_py()), batch.column(2)[n]
                removed = count = 0
                kept = data
                if gone.is_valid:
                    ranges = np.asarray(gone.values)
                    a, z = spans(ranges >> 32, ranges & 0xFFFFFFFF)
                    removed, count = int((z - a).sum()), len(a)
                    kept = b"".join([data[p:q] for p, q in zip([0, *z.tolist()], [*a.tolist(), len(data)], strict=True)])
                rows.append((len(data), removed, count, hashlib.sha256(kept).hexdigest(), kept))
                size += len(kept)
                if size > 1 << 24 or n + 1 == batch.num_rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                    rows, size, begin = [], 0, n + 1

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
