"""Token ids in files of bit or byte planes.

A file holds a run of documents: their ids, cut into blocks of a fixed number of ids.  Each
block is transposed into planes (all lowest bytes, then all second bytes, ...; or all lowest
bits, ...), and every plane is compressed with Zstandard by itself, so the upper planes of
small ids shrink to nothing.  The chunk index after the blocks says where each block is and
how long its planes are, and which documents the file holds; a reader may begin at any block.

    magic, plane kind, ids in a block | planes of block 0 | planes of block 1 | ...
    | chunk index, compressed | its length | magic

Files are written by tasks, one for each partition, to a folder that all executors share.
A task that is run again writes a file of another name; only files of the manifest, which
Spark commits, count.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lettermill.llm.bpe import Codec
from lettermill.llm.folders import open_folder
from lettermill.llm.textmap import text_parts, whole_ids
from lettermill.llm.wordcache import WordCache
from lettermill.session import scratch_path, ship_package

MAGIC = b"LMTK"
BLOCK_IDS = 65_536
_HEAD = struct.Struct("<4sBxxxI")
_TAIL = struct.Struct("<Q4s")
_INDEX = struct.Struct("<QQQ")
_KINDS = ("byte", "bit")


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes from the lowest to the highest; bits are packed to bytes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = np.ascontiguousarray(octets.T)
    if kind == "byte":
        return [p.tobytes() for p in planes]
    return [np.packbits(p >> b & 1).tobytes() for p in planes for b in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    octets = np.zeros((4, n), np.uint8)
    for k, plane in enumerate(planes):
        given = np.frombuffer(plane, np.uint8)
        if kind == "byte":
            octets[k] = given
        else:
            octets[k // 8] |= np.unpackbits(given, count=n) << (k % 8)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)


class TokenFileWriter:
    """Takes documents in order; keeps no more than one block and the index in memory."""

    def __init__(self, stream, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 1):
        self._out, self._kind, self._block = stream, kind, block_ids
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._waiting: list[np.ndarray] = []
        self._n_waiting = 0
        self._blocks: list[tuple[int, int, list[int]]] = []
        self._doc_ids: list[int | None] = []
        self._lengths: list[int] = []
        self.n_ids = 0
        self._at = self._out.write(_HEAD.pack(MAGIC, _KINDS.index(kind), block_ids))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._doc_ids.append(doc_id)
        self._lengths.append(len(ids))
        self.n_ids += len(ids)
        while len(ids):
            part, ids = np.split(ids, [self._block - self._n_waiting])
            self._waiting.append(part)
            self._n_waiting += len(part)
            if self._n_waiting == self._block:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self._waiting)
        packed = [self._zstd.compress(p) for p in to_planes(ids, self._kind)]
        self._blocks.append((self._at, len(ids), [len(p) for p in packed]))
        for plane in packed:
            self._at += self._out.write(plane)
        self._waiting, self._n_waiting = [], 0

    def close(self) -> None:
        if self._n_waiting:
            self._flush()
        docs, wide = len(self._doc_ids), len(self._blocks[0][2]) if self._blocks else 0
        index = b"".join((
            _INDEX.pack(len(self._blocks), wide, docs),
            np.array([[a, n, *sizes] for a, n, sizes in self._blocks], "<u8").tobytes(),
            np.array([d or 0 for d in self._doc_ids], "<i8").tobytes(),
            np.array([d is None for d in self._doc_ids], np.uint8).tobytes(),
            np.array(self._lengths, "<u8").tobytes(),
        ))
        index = self._zstd.compress(index)
        self._out.write(index)
        self._out.write(_TAIL.pack(len(index), MAGIC))


class TokenFileReader:
    """Random access to one file through its chunk index."""

    def __init__(self, stream, size: int):
        self._in = stream
        magic, kind, self.block_ids = _HEAD.unpack(self._range(0, _HEAD.size))
        length, again = _TAIL.unpack(self._range(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a token file, or not written to its end")
        self._kind = _KINDS[kind]
        self._zstd = zstandard.ZstdDecompressor()
        index = self._zstd.decompress(self._range(size - _TAIL.size - length, length))
        blocks, wide, docs = _INDEX.unpack_from(index)
        at = _INDEX.size
        self._blocks = np.frombuffer(index, "<u8", blocks * (2 + wide), at).reshape(blocks, 2 + wide)
        at += self._blocks.nbytes
        self.doc_ids = np.frombuffer(index, "<i8", docs, at)
        self.null_ids = np.frombuffer(index, np.uint8, docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(index, "<u8", docs, at + 9 * docs).astype(np.int64)
        self._held: tuple[int, np.ndarray | None] = (-1, None)

    def _range(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        return self._in.read(n)

    def block(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            at, n, *sizes = (int(x) for x in self._blocks[k])
            raw, planes = self._range(at, sum(sizes)), []
            for size in sizes:
                planes.append(self._zstd.decompress(raw[:size]))
                raw = raw[size:]
            self._held = k, from_planes(planes, n, self._kind)
        return self._held[1]

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids from place ``start`` on, block by block."""
        while n:
            k, at = divmod(start, self.block_ids)
            piece = self.block(k)[at : at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


class LibraryCoder(Codec):
    """The tokenizers library, asked once per distinct word while the word is remembered."""

    def __init__(self, path: str):
        super().__init__(path)
        self._model = self._library.model
        self._known = WordCache(lambda words: list(map(self._ask, words)), limit=200_000)

    def _ask(self, word: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()

    def _encode_words(self, words: set[str]) -> dict[str, bytes]:
        return self._known.lookup(words)


@lru_cache(maxsize=4)
def library_coder(path: str) -> LibraryCoder:
    return LibraryCoder(path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, kind: str = "byte",
                      block_ids: int = BLOCK_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents in ascending ``doc_id`` order; returns the manifest, one row per file.

    The texts are dealt out by ranges of ``doc_id``; rows of one ``doc_id`` are ordered by a
    hash of their text, so that even one id with very many rows is divided.  Null ids come
    first; ids that are not whole numbers raise ``TypeError``.  A null text counts as empty; ``end_id`` follows each document unless it is None.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(whole_ids(docs, doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, writer = library_coder(tokenizer), None
        number = TaskContext.get().partitionId()
        name = f"{number:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, texts in text_parts(batch.column("text")):
                for i, coded in zip(ids[start:], coder.encode_batch([t or b"" for t in texts])):
                    if writer is None:
                        system, root = open_folder(folder)
                        system.create_dir(root, recursive=True)
                        stream = system.open_output_stream(f"{root}/{name}")
                        writer = TokenFileWriter(stream, kind, block_ids)
                    writer.add(i, np.frombuffer(coded + end, "<u4"))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file_no": [number], "file": [name], "n_ids": [writer.n_ids],
                                              "n_docs": [len(writer._doc_ids)]})

    manifest = dealt.mapInArrow(write, "file_no long, file string, n_ids long, n_docs long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files alone: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32`` over all its ids."""
    ship_package(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(batch.column(c).to_pylist() for c in ("file", "base"))):
                system, root = open_folder(folder)
                with system.open_input_file(f"{root}/{name}") as stream:
                    reader = TokenFileReader(stream, stream.size())
                    starts = np.cumsum(reader.lengths) - reader.lengths
                    for a in range(0, len(starts), 10_000):
                        part = slice(a, a + 10_000)
                        sums = []
                        for start, n in zip(starts[part].tolist(), reader.lengths[part].tolist()):
                            crc = 0
                            for piece in reader.pieces(start, n):
                                crc = zlib.crc32(piece.tobytes(), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.doc_ids[part], mask=reader.null_ids[part]), pa.array(starts[part] + base),
                            pa.array(reader.lengths[part]), pa.array(sums, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    # the number keeps adaptive execution from putting small manifests into one task
    return files.repartition(max(1, files.count()), "file").mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None, **options) -> DataFrame:
    """Write the files to a new folder in shared storage and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer, end_id, **options)
    return read_token_files(docs.sparkSession, folder)
