"""Token ids in independent zstandard frames with a trailing seek table.

A token file is a series of zstandard frames, each holding whole documents,
then one skippable frame with the document index and one with the seek table
of the zstandard seekable format. Any zstandard tool can decompress the file;
a reader that knows the seek table decompresses only the frames it needs.

    frame        u32 documents; i64 ids; u8 id is not null; u32 token counts; u32 token ids
    index        for each frame: i64 first id, u32 documents, u64 tokens
    seek table   for each frame: u32 compressed size, u32 size, u32 low half of the frame's xxh64;
                 then u32 frames, u8 0x80 (checksums), u32 0x8F92EAB1

All integers are little-endian. Null texts are empty; a document always has at
least its end token. Null ids sort first. Repeated ids are kept, ordered by
text. An empty table makes no files and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaybook.llm.common import filesystem, publish, shared_dir, text_or_empty
from assaybook.llm.tables import Distinct

END_ID = 1
FRAME_TOKENS = 1 << 17
_SKIPPABLE_INDEX, _SKIPPABLE_SEEK, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_INDEX = np.dtype([("first", "<i8"), ("documents", "<u4"), ("tokens", "<u8")])
_SEEK = np.dtype([("compressed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SPACE = re.compile("[ \t\n\r]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


class WordEncoder:
    """Token ids of whole texts by the tokenizers library, each distinct run between spaces once.

    The tokenizer's pre-tokens never hold white space, and its normaliser never
    joins across it, so the ids of a text are those of its runs one after the
    other. Runs of printable ASCII and Latin-1 letters go straight to the
    library's BPE model; any other run goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        spread = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        shown = {b: chr(256 + spread.index(b)) if b in spread else chr(b) for b in range(256)}
        self.bytes_shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.pieces = Distinct(self._piece, most)
        self.runs = Distinct(self._run, most)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.translate(self.bytes_shown)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if _PLAIN.fullmatch(run) and "<|" not in run:
            return b"".join([self.pieces[p] for p in _PIECE.findall(run.lower())])
        return np.array(self.whole.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        runs = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.runs.__getitem__, filter(None, runs)))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The process's encoder for a tokenizer file: a worker that runs many tasks keeps its table."""
    return WordEncoder(path)


class FrameWriter:
    """Writes documents, in ascending id order, to one token file."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.zstd = stream, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.seek, self.index, self.docs, self.tokens = [], [], [], 0
        self.all_docs = self.all_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, ids))
        self.tokens += len(ids) // 4
        if self.tokens >= FRAME_TOKENS:
            self._flush()

    def _flush(self) -> None:
        if not self.docs:
            return
        ids = np.array([0 if i is None else i for i, _ in self.docs], "<i8")
        valid = np.array([i is not None for i, _ in self.docs], "u1")
        counts = np.array([len(x) // 4 for _, x in self.docs], "<u4")
        raw = b"".join([struct.pack("<I", len(ids)), ids.tobytes(), valid.tobytes(), counts.tobytes(), *(x for _, x in self.docs)])
        packed = self.zstd.compress(raw)
        self.stream.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((ids[0] if valid[0] else -(1 << 63), len(ids), self.tokens))
        self.all_docs += len(ids)
        self.all_tokens += self.tokens
        self.docs, self.tokens = [], 0

    def close(self) -> None:
        self._flush()
        index = np.array(self.index, _INDEX).tobytes()
        self.stream.write(struct.pack("<II", _SKIPPABLE_INDEX, len(index)) + index)
        seek = np.array(self.seek, _SEEK).tobytes() + _FOOTER.pack(len(self.seek), 0x80, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE_SEEK, len(seek)) + seek)


class FrameReader:
    """Random access to a token file: the tail is read first, then only the frames asked for."""

    def __init__(self, source, size: int):
        self.source = source
        frames, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError("not a token file: no seek table with checksums at its end")
        table = size - _FOOTER.size - frames * _SEEK.itemsize
        self.seek = np.frombuffer(self._at(table, frames * _SEEK.itemsize), _SEEK)
        index = table - 8 - frames * _INDEX.itemsize
        self.index = np.frombuffer(self._at(index, frames * _INDEX.itemsize), _INDEX)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["compressed"], dtype=np.int64)])
        self.token_starts = np.concatenate([[0], np.cumsum(self.index["tokens"].astype(np.int64))])

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def frame(self, k: int) -> Iterator[tuple[int | None, bytes]]:
        """Documents of one frame: id and token bytes. Raises if the frame's checksum is wrong."""
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.seek["compressed"][k])), max_output_size=int(self.seek["size"][k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek["checksum"][k]:
            raise ValueError(f"frame {k} is damaged: its checksum differs")
        (n,) = struct.unpack_from("<I", raw)
        ids, valid = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "u1", n, 4 + 8 * n)
        ends = 4 + 13 * n + 4 * np.cumsum(np.frombuffer(raw, "<u4", n, 4 + 9 * n), dtype=np.int64)
        begin = 4 + 13 * n
        for i, ok, end in zip(ids.tolist(), valid.tolist(), ends.tolist(), strict=True):
            yield (i if ok else None), raw[begin:end]
            begin = end

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.seek)):
            yield from self.frame(k)

    def get(self, doc_id: int) -> list[bytes]:
        """Token bytes of every document with this id; other frames stay compressed."""
        first = self.index["first"]
        k, out = max(0, int(np.searchsorted(first, doc_id, "left")) - 1), []
        while k < len(first) and first[k] <= doc_id:
            out += [x for i, x in self.frame(k) if i == doc_id]
            k += 1
        return out


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode and write ``docs`` as token files under ``folder``, in ascending id order over files and within.

    Returns the manifest, written beside the files: ``part, file, documents, tokens``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end = word_encoder(tokenizer), struct.pack("<I", end_id)
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        done: list[FrameWriter] = []

        def payload(stream) -> None:
            writer = FrameWriter(stream)
            batch = first
            while batch is not None:
                for i, text in zip(batch.column(0), batch.column(1), strict=True):
                    writer.add(i.as_py(), encode(text.as_py()) + end)
                batch = next(batches, None)
            writer.close()
            done.append(writer)

        name = publish(folder, f"tokens-{part:06d}.zst", payload)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "documents": [done[0].all_docs], "tokens": [done[0].all_tokens]})

    ordered = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("__text")).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), "__text")
    manifest = ordered.mapInArrow(write, "part int, file string, documents long, tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the token files that the manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, root = filesystem(folder)
                path = f"{root}/{file}"
                with system.open_input_file(path) as source:
                    reader = FrameReader(source, source.size())
                    for k in range(len(reader.seek)):
                        docs = list(reader.frame(k))
                        counts = np.array([len(x) // 4 for _, x in docs], np.int64)
                        starts = base + int(reader.token_starts[k]) + np.cumsum(counts) - counts
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "start": starts, "n_tokens": counts, "ids": pa.array([x for _, x in docs], pa.binary())})

    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def with_crc(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "token-frames")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return with_crc(read_tokens(manifest, folder))


def crc_of(ids: list[int]) -> int:
    """The digest that the query reports, for one document's ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
