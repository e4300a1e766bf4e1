"""Which keys occur in more than one document, without sending a hot key often.

A map task works on blocks of documents. Keys that several documents of a block
hold are known to be shared at once; for the others, and once for each of
those, the block sends 32 bits of the key to one of many buckets. A bucket
holds two blocks' copies of a key side by side and answers the blocks with
their shared entries. However many documents hold a key, it reaches its bucket
once for each block. Two keys that agree in bucket and 32 bits may pass for
one: an entry may be called shared that is not, never the other way round.

An entry is (key, document, reference); references come back by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assaybook.llm.common import tidy_group, tidy_map

ENTRIES_A_BLOCK, DOCUMENTS_A_BLOCK = 2_000_000, 100_000
_LOCAL = np.uint32(0xFFFFFFFF)
_PROBE, _ANSWER, _ABOUT = 0, 1, 2
_SCHEMA = "bucket int, block long, kind int, keys binary, refs binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary())])


def buckets_for(spark, total_bytes: int, each: int = 4 << 20) -> int:
    """Buckets so that each gets a bounded part of the input, and a few for every shuffle partition."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total_bytes // each, 1)


class Block:
    """Entries of one block while they are gathered."""

    def __init__(self):
        self.keys, self.docs, self.refs, self.about, self.entries, self.n_docs, self.span = [], [], [], [], 0, 0, 0

    def add(self, keys: np.ndarray, docs: np.ndarray, refs: np.ndarray, about: pa.RecordBatch, n_docs: int, span: int) -> None:
        """``docs`` number the documents of this call from 0, ``refs`` lie below ``span`` and are moved behind
        those of earlier calls; ``about``, a row a document, is passed through to the answers."""
        self.keys.append(keys)
        self.docs.append(docs.astype(np.uint32) + np.uint32(self.n_docs))
        self.refs.append(refs.astype(np.uint32) + np.uint32(self.span))
        self.span += span
        self.about.append(about)
        self.n_docs += n_docs
        self.entries += len(keys)

    def rows(self, block: int, n_buckets: int) -> pa.RecordBatch:
        keys, docs, refs = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((self.keys, np.uint64), (self.docs, np.uint32), (self.refs, np.uint32)))
        # the parts are joined: let go of them before the copies that follow
        self.keys, self.docs, self.refs = [], [], []
        order = np.argsort(keys, kind="stable")
        keys, docs, refs = keys[order], docs[order], refs[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts) if len(keys) else np.zeros(0, bool)
        local = np.repeat(several, np.diff(np.append(starts, len(keys))))
        out = [(block % n_buckets, block, _ABOUT, as_bytes(self.about), b""), (block % n_buckets, block, _ANSWER, b"", np.sort(refs[local]).tobytes())]
        send = ~local
        send[starts[several]] = True
        refs = np.where(local, _LOCAL, refs)[send]
        keys = keys[send]
        bucket = ((keys >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((refs, bucket))
        keys, refs, bucket = keys[order].astype(np.uint32), refs[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
            out.append((int(bucket[a]), block, _PROBE, keys[a:b].tobytes(), _packed(refs[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def as_bytes(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packed(refs: np.ndarray) -> bytes:
    """Ascending references as differences of one, two or four bytes."""
    steps = np.diff(refs, prepend=np.uint32(0))
    most = int(steps.max(initial=0)) if len(refs) else 0
    # the mark for locally shared keys makes one large step at the end
    last = refs == _LOCAL
    n = int(last.sum())
    steps = steps[: len(steps) - n]
    most = int(steps.max(initial=0))
    width = 1 if most < 256 else 2 if most < 65536 else 4
    return bytes((width,)) + n.to_bytes(4, "little") + steps.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[1:5], "little")
    refs = np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=5), dtype=np.uint64).astype(np.uint32)
    return np.concatenate([refs, np.full(n, _LOCAL)])


def _answers(table: pa.Table) -> pa.Table:
    kind = np.asarray(table["kind"])
    blocks = np.asarray(table["block"])
    probe = np.flatnonzero(kind == _PROBE)
    out = [table.filter(pa.array(kind != _PROBE))]
    if len(probe):
        rows = table.take(pa.array(probe))
        keys = [np.frombuffer(x.as_buffer(), "<u4") for x in rows["keys"]]
        refs = np.concatenate([_unpacked(x.as_py()) for x in rows["refs"]])
        own = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
        # a block has one row in a bucket, so rows stand for blocks
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, refs, own = keys[order], refs[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        shared = (np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)) | (np.maximum.reduceat(refs, starts) == _LOCAL)
        tell = np.repeat(shared, np.diff(np.append(starts, len(keys)))) & (refs != _LOCAL)
        refs, own = refs[tell], own[tell]
        order = np.lexsort((refs, own))
        refs, own = refs[order], own[order]
        names = blocks[probe]
        cuts = np.searchsorted(own, np.arange(len(names) + 1))
        told = [(0, int(names[i]), _ANSWER, b"", refs[cuts[i] : cuts[i + 1]].tobytes()) for i in range(len(names)) if cuts[i + 1] > cuts[i]]
        if told:
            out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), _ARROW, strict=True)], schema=_ARROW))
    return pa.concat_tables([t.cast(_ARROW) for t in out])


def find_shared(docs: DataFrame, gather: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], n_buckets: int, finish: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Run ``gather`` over the rows, find shared entries, and hand each block's to ``finish``.

    ``gather(batches)`` yields the arguments of ``Block.add``. ``finish(about, refs)``
    gets a block's ``about`` table and the ascending references of its shared
    entries, and returns a table with columns as in ``schema``.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 24, Block()
        for part in gather(batches):
            block.add(*part)
            if block.entries >= ENTRIES_A_BLOCK or block.n_docs >= DOCUMENTS_A_BLOCK:
                yield block.rows(number, n_buckets)
                number, block = number + 1, Block()
        if block.n_docs:
            yield block.rows(number, n_buckets)

    def end(table: pa.Table) -> pa.Table:
        own = next(k for k, kind in enumerate(table["kind"].to_pylist()) if kind == _ABOUT)
        refs = np.sort(np.concatenate([np.frombuffer(r.as_buffer(), "<u4") for r in table["refs"]]))
        return finish(pa.ipc.open_stream(table["keys"][own].as_buffer()).read_all(), refs)

    sent = docs.mapInArrow(tidy_map(emit), _SCHEMA)
    told = sent.groupBy("bucket").applyInArrow(tidy_group(_answers), _SCHEMA)
    return told.select("block", "kind", "keys", "refs").groupBy("block").applyInArrow(tidy_group(end), schema)
