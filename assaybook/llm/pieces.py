"""SentencePiece encoding and decoding by a table of distinct chunks.

If no piece of the model holds a white-space marker after another character,
no merge crosses from a word into the next marker: a text falls into chunks,
each a run of markers and the characters up to the next marker, and its ids
are the chunks' ids one after the other. So each distinct chunk of the corpus is
segmented once, and its ids are joined back by position:

1. A map task numbers the distinct chunks of a block of documents. A document
   becomes the list of its chunks' numbers.
2. Each chunk goes, once for each block, to the bucket of its hash, which holds
   all blocks' copies side by side, segments each distinct one once and
   answers the blocks with its ids.
3. A block's lists and answers meet; each of its distinct chunks is decoded
   from its ids, and ids and decoded chunks take their places.

However often a chunk occurs, it is sent once for each block. Chunks are
numbered by frequency and then by first use, so that those used once come in
order and need no number, and all lists are compressed. A model with pieces across
markers has whole texts for chunks.

Defined results: null and empty texts have no ids and decode to the empty text;
rows keep their number, repeated rows get equal values; an empty table gives
no rows; of the kept columns those named like a result are left out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm.common import text_bytes_total, tidy_group, tidy_map, utf8
from assaybook.llm.shared_keys import as_bytes, buckets_for

MARKER = "▁"
CHUNKS_A_BLOCK, DOCUMENTS_A_BLOCK = 3 << 20, 100_000
_CHUNK = re.compile(" +[^ ]*")
_ABOUT, _ASK, _ANSWER = 0, 1, 2
_SCHEMA = "bucket int, block long, kind int, numbers binary, counts binary, data binary, texts binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("numbers", pa.binary()), ("counts", pa.binary()), ("data", pa.binary()), ("texts", pa.binary())])
_DECODED_AT_ONCE = 20_000
_BETWEEN = b"\xff"  # never part of UTF-8


class ChunkCoder:
    """Splits texts into chunks, and encodes and decodes chunks, by one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # the model must leave characters as they are, put a marker before the text and keep every space
        plain = self.model.encode("a  ²ﬁ b ", out_type=str)
        faithful = "".join(plain).startswith(f"{MARKER}a{MARKER}{MARKER}") and self.model.decode(self.model.encode("a  ²ﬁ b ")) == "a  ²ﬁ b "
        self.by_chunk = faithful and not any(MARKER in p.lstrip(MARKER) for p in pieces)
        self.lone = [self.model.piece_to_id(MARKER)]

    def split(self, text: str) -> list[str]:
        """The chunks of a text, each without its first marker, which the model puts back."""
        if not text:
            return []
        if not self.by_chunk:
            return [text]
        text = text.replace(MARKER, " ")
        return [c[1:] for c in _CHUNK.findall(" " + text)] if "  " in text or text[0] == " " else text.split(" ")

    def segmented(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk."""
        return [x or self.lone for x in self.model.encode(chunks, num_threads=1)] if chunks else []

    def decoded(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1) if ids else []

    def joined(self, decoded: list[str]) -> str:
        """A text from its chunks' decodings: each chunk but the first begins with the marker that stands for a space."""
        return " ".join(decoded)


@lru_cache(maxsize=2)
def chunk_coder(path: str) -> ChunkCoder:
    """The process's coder for a model: a worker that runs many tasks keeps it."""
    return ChunkCoder(path)


def _pack(numbers) -> bytes:
    """Whole numbers, those bytes of all of them together that have the same place, compressed."""
    numbers = np.asarray(numbers, np.uint32)
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _pack_strings(strings: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(_BETWEEN.join(strings))


def _unpack_strings(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(_BETWEEN)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Block:
    """Documents of a block as lists of chunk numbers."""

    def __init__(self):
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.places, self.per_doc, self.about = array("I"), [], []

    def add(self, chunks: list[str]) -> None:
        self.places.extend(map(self.number.__getitem__, chunks))
        self.per_doc.append(len(chunks))

    def rows(self, block: int, n_buckets: int) -> pa.RecordBatch:
        """The lists, and the distinct chunks by bucket."""
        places = np.frombuffer(self.places, np.uint32) if self.places else np.zeros(0, np.uint32)
        used = np.bincount(places, minlength=len(self.number))
        by_use = np.argsort(-used, kind="stable")
        rank = np.empty(len(by_use), np.uint32)
        rank[by_use] = np.arange(len(by_use))
        rows = [(block % n_buckets, block, _ABOUT, _pack(np.minimum(rank, (used > 1).sum())[places]), _pack(self.per_doc), as_bytes(self.about), b"")]
        chunks = list(self.number)
        self.number.clear()
        raw = [chunks[k].encode() for k in by_use.tolist()]
        del chunks
        bucket = np.array([zlib.crc32(r) for r in raw], np.int64) % n_buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for own in np.split(order, cuts[1:]) if len(order) else []:
            rows.append((int(bucket[own[0]]), block, _ASK, _pack(np.diff(own, prepend=0)), b"", b"", _pack_strings([raw[k] for k in own.tolist()])))
        return _rows(rows)


def encode(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None, chunks_a_block: int = CHUNKS_A_BLOCK) -> DataFrame:
    """The kept columns (by default all but the text), ``ids`` and ``decoded`` of every row.

    ``chunks_a_block`` weighs a worker's memory, which grows with it, against what is sent: a block sends its distinct chunks once.
    """
    names = [f for f in docs.schema.fields if f.name in (keep if keep is not None else docs.columns) and f.name not in (text_col, "ids", "decoded")]
    kept = docs.select(F.col(text_col).alias("__text"), *[F.col(f"`{f.name}`") for f in names])
    n_buckets, most_docs = buckets_for(docs.sparkSession, text_bytes_total(docs, text_col), 16 << 20), DOCUMENTS_A_BLOCK

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, number, held = chunk_coder(model), TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            rest, first = batch.select([f.name for f in names]), 0
            for k, text in enumerate(batch.column(0), 1):
                held.add(coder.split(utf8(text.as_py()).decode()))
                if len(held.places) >= chunks_a_block or len(held.per_doc) >= most_docs:
                    held.about.append(rest.slice(first, k - first))
                    yield held.rows(number, n_buckets)
                    held, first, number = _Block(), k, number + 1
            if first < batch.num_rows:
                held.about.append(rest.slice(first))
        if held.per_doc:
            yield held.rows(number, n_buckets)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [tuple(r.values()) for r in rows if r["kind"] != _ASK]
        rows = [r for r in rows if r["kind"] == _ASK]
        chunks = [_unpack_strings(r["texts"]) for r in rows]
        distinct = list({c for own in chunks for c in own})
        table_of = dict(zip(distinct, chunk_coder(model).segmented([c.decode() for c in distinct]), strict=True))
        for row, own in zip(rows, chunks, strict=True):
            found = [table_of[c] for c in own]
            out.append((0, row["block"], _ANSWER, row["numbers"], _pack([len(i) for i in found]), _pack([x for i in found for x in i]), b""))
        return pa.Table.from_batches([_rows(out)])

    def place(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        mine = next(r for r in rows if r["kind"] == _ABOUT)
        about, places, per_doc = pa.ipc.open_stream(mine["data"]).read_all(), _unpack(mine["numbers"]), _unpack(mine["counts"])
        answers = [r for r in rows if r["kind"] == _ANSWER]
        numbers = [np.cumsum(_unpack(r["numbers"]), dtype=np.int64) for r in answers]
        n = sum(map(len, numbers))
        # the last number stands for all that are used once
        single = np.flatnonzero(places == places.max()) if len(places) and n > places.max() + 1 else []
        places[single] = n - len(single) + np.arange(len(single))
        begin, count, flat, at = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        for r, own in zip(answers, numbers, strict=True):
            size = _unpack(r["counts"])
            begin[own], count[own] = at + np.cumsum(size, dtype=np.int64) - size, size
            flat.append(_unpack(r["data"]))
            at += len(flat[-1])
        del rows, answers
        size = count[places]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        words: list[str] = []
        for k in range(0, n, _DECODED_AT_ONCE):
            own = slice(k, k + _DECODED_AT_ONCE)
            words += chunk_coder(model).decoded([flat[a : a + c].tolist() for a, c in zip(begin[own].tolist(), count[own].tolist(), strict=True)])
        ids = flat[np.repeat(begin[places] - total[:-1], size) + np.arange(total[-1])]
        ends = np.concatenate([[0], np.cumsum(per_doc, dtype=np.int64)])
        joined = chunk_coder(model).joined
        texts = [joined([words[k] for k in places[a:z].tolist()]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        columns = [about[f.name] for f in names] + [pa.LargeListArray.from_arrays(pa.array(total[ends]), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32())), pa.array(texts, pa.string())]
        return pa.table(columns, [f.name for f in names] + ["ids", "decoded"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in names] + ["ids array<int>", "decoded string"])
    asked = kept.mapInArrow(tidy_map(numbered), _SCHEMA)
    told = asked.groupBy("bucket").applyInArrow(tidy_group(answer), _SCHEMA)
    return told.groupBy("block").applyInArrow(tidy_group(place), schema)


def with_digests(coded: DataFrame) -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead of ids and texts."""
    kept = [c for c in coded.columns if c not in ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")]
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(*[F.col(f"`{c}`") for c in kept], F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_digests(encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"]))
