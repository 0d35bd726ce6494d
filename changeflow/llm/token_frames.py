"""Token ids in binary files of independent zstandard frames, with a seek table and checksums.

A file holds the ids of consecutive documents, two or four bytes each (little-endian), cut into frames
of at most ``FRAME`` bytes. A document that fits into a frame lies in one; a longer one has frames of its
own. Every frame is a complete zstandard frame. Two skippable frames follow: the directory (document ids and
numbers of tokens) and, last, the seek table in zstandard's public seekable format: compressed and
decompressed size of each frame and 32 bits of the XXH64 of its content. So a plain decompressor returns the
ids, and a reader that wants one document reads the table, the directory and the frames that hold it.

Writing sorts documents by id over ranges, so files follow one another in ascending order of ids, and a
task closes a file at ``FILE_TOKENS`` tokens or ``FILE_DOCUMENTS`` documents and opens the next. Files have
names of their own at every attempt; a table beside them lists those of the attempts that counted, so a lost
executor or a repeated task leaves at most a file that nobody reads. The driver gets one row a file.

Defined results: a null or empty text is its end id alone. Documents without an id come first; rows that
repeat an id stand by a hash of their text, each with its ids. Very long texts span frames and are checked
frame by frame. An empty table is a folder with an empty list. A frame whose checksum is wrong raises
``ValueError``. Only the id and the text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.byte_bpe import byte_vocabulary

#: Bytes of ids in a frame; tokens and documents in a file.
FRAME, FILE_TOKENS, FILE_DOCUMENTS = 1 << 16, 1 << 25, 1 << 20

# Fixed values of the zstandard format: skippable frames and the seekable format's footer.
SKIPPABLE, SEEK_FRAME, SEEK_FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")

FILES = "part int, number int, name string, width int, n_docs long, n_tokens long, n_bytes long, first_id long, last_id long"


def digest(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FrameWriter:
    """Writes documents to an open stream, one after the other."""

    def __init__(self, stream, width: int):
        self.stream, self.type, self.width = stream, np.dtype(f"<u{width}"), width
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.buffer = bytearray()
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(self.type).tobytes()
        if self.buffer and len(self.buffer) + len(data) > FRAME:
            self._flush()
        for begin in range(0, len(data), FRAME):
            self.buffer += data[begin : begin + FRAME]
            if len(self.buffer) >= FRAME:
                self._flush()
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_tokens += len(ids)

    def _flush(self) -> None:
        if self.buffer:
            data = bytes(self.buffer)
            self._write(self.compressor.compress(data), len(data), digest(data))
            self.buffer.clear()

    def _write(self, frame: bytes, size: int, check: int) -> None:
        self.stream.write(frame)
        self.table.append((len(frame), size, check))

    def finish(self) -> int:
        """Write directory and seek table; returns the bytes of the file."""
        self._flush()
        nulls = sum(i is None for i in self.ids)  # they come first
        arrays = np.array([self.ids[nulls:], self.lengths[nulls:]], "<i8").tobytes()
        head = np.array(self.lengths[:nulls], "<i8").tobytes()
        directory = struct.pack("<IIQ", self.width, nulls, len(self.ids)) + self.compressor.compress(head + arrays)
        self._write(skippable(SKIPPABLE, directory), 0, digest(b""))
        entries = np.array(self.table, "<u4").tobytes()
        footer = FOOTER.pack(len(self.table), CHECKSUMS, SEEK_FOOTER)
        self.stream.write(skippable(SEEK_FRAME, entries + footer))
        return sum(t[0] for t in self.table) + 8 + len(entries) + len(footer)


class FrameReader:
    """Finds documents in a file that can be read at any place; ``frames_read`` counts decompressed frames."""

    def __init__(self, file, size: int):
        self.file, self.frames_read = file, 0
        self.decompressor = zstandard.ZstdDecompressor()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEK_FOOTER or flags != CHECKSUMS:
            raise ValueError("not a file of token frames")
        begin = size - FOOTER.size - 12 * n
        table = np.frombuffer(self._at(begin, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.data_begin = np.concatenate(([0], np.cumsum(table[:-1, 1])))
        self.table = table[:-1]
        directory = self._at(int(self.begin[-2]) + 8, int(table[-1, 0]) - 8)
        self.width, nulls, docs = struct.unpack("<IIQ", directory[:16])
        values = np.frombuffer(self.decompressor.decompress(directory[16:]), "<i8")
        known = docs - nulls
        self.nulls, self.ids = nulls, values[nulls : nulls + known]
        self.lengths = np.concatenate((values[:nulls], values[nulls + known :]))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def _at(self, begin: int, length: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        size, check = int(self.table[k, 1]), int(self.table[k, 2])
        data = self.decompressor.decompress(self._at(int(self.begin[k]), int(self.begin[k + 1] - self.begin[k])), max_output_size=size)
        if len(data) != size or digest(data) != check:
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        return data

    def doc_id(self, row: int) -> int | None:
        return None if row < self.nulls else int(self.ids[row - self.nulls])

    def pieces(self, rows: Iterable[int]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """For documents by ascending row: the row, a part of its ids, and whether it is the last part."""
        held, data = -1, b""
        for row in rows:
            at, end = int(self.starts[row]) * self.width, int(self.starts[row + 1]) * self.width
            if at == end:
                yield row, np.empty(0, f"<u{self.width}"), True
            while at < end:
                k = int(np.searchsorted(self.data_begin, at, side="right")) - 1
                if k != held:
                    held, data = k, self.frame(k)
                stop = min(end, int(self.data_begin[k + 1]))
                begin = int(self.data_begin[k])
                yield row, np.frombuffer(data[at - begin : stop - begin], f"<u{self.width}"), stop == end
                at = stop

    def rows_of(self, doc_id: int) -> range:
        """The rows of an id; several where documents repeat it."""
        return range(
            self.nulls + int(np.searchsorted(self.ids, doc_id)), self.nulls + int(np.searchsorted(self.ids, doc_id, side="right"))
        )


@dataclass(frozen=True)
class TokenFiles:
    """A written folder: its files in order, and how many ids stand before each."""

    folder: str
    files: list
    before: list[int]


def _reader(folder: str, name: str) -> FrameReader:
    system, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    return FrameReader(system.open_input_file(path), system.get_file_info(path).size)


def write_tokens(docs: DataFrame, path: str, folder: str, *, end_id: int = 0) -> None:
    """Encode documents with the vocabulary at ``path`` and write them, in ascending order of ids, to ``folder``."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = byte_vocabulary(path)
        width = 2 if max(vocabulary.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        system, root = fs.FileSystem.from_uri(folder)
        part, number, writer, name = TaskContext.get().partitionId(), 0, None, ""

        def closed() -> pd.DataFrame:
            with writer.stream:
                n_bytes = writer.finish()
            known = [i for i in writer.ids if i is not None]
            first, last = (known[0], known[-1]) if known else (None, None)
            row = (part, number, name, width, len(writer.ids), writer.n_tokens, n_bytes, first, last)
            columns = [c.split()[0] for c in FILES.split(", ")]
            return pd.DataFrame([row], columns=columns).astype({"first_id": "Int64", "last_id": "Int64"})

        for batch in batches:
            for doc_id, text in zip(batch.doc_id.astype("Int64"), batch.text, strict=True):
                if writer is None:
                    name = f"part-{part:05d}-{number:05d}-{uuid.uuid4().hex}.zst"
                    writer = FrameWriter(system.open_output_stream(f"{root}/{name}", compression=None), width)
                ids = np.append(vocabulary.ids(text or ""), end_id)
                writer.add(None if doc_id is pd.NA else int(doc_id), ids)
                if writer.n_tokens >= FILE_TOKENS or len(writer.ids) >= FILE_DOCUMENTS:
                    yield closed()
                    number, writer = number + 1, None
        if writer is not None:
            yield closed()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = chosen.repartitionByRange("doc_id").withColumn("_hash", F.xxhash64("text"))
    placed = dealt.sortWithinPartitions("doc_id", "_hash").drop("_hash")
    placed.mapInPandas(write, FILES).write.parquet(f"{folder}/files")


def open_tokens(spark: SparkSession, folder: str) -> TokenFiles:
    """The files of a written folder: one row a file comes to the driver."""
    files = spark.read.parquet(f"{folder}/files").orderBy("part", "number").collect()
    total = np.concatenate(([0], np.cumsum([f.n_tokens for f in files], dtype=np.int64)))
    return TokenFiles(folder, files, total[:-1].tolist())


def _each_file(spark: SparkSession, tokens: TokenFiles, fn, schema: str) -> DataFrame:
    """``fn(name, ids before the file)`` in one task a file."""
    rows = [(f.name, b) for f, b in zip(tokens.files, tokens.before, strict=True)]
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, before in zip(batch.name, batch.before, strict=True):
                yield from fn(name, int(before))

    listed = spark.createDataFrame(rows, "name string, before long").repartition(len(rows))
    return listed.mapInPandas(run, schema)


def token_digests(spark: SparkSession, tokens: TokenFiles) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, from all frames of all files.

    ``start`` counts the ids before the document; the CRC is that of its ids with four bytes each.
    """
    folder = tokens.folder

    def run(name: str, before: int) -> Iterator[pd.DataFrame]:
        reader, out, crc = _reader(folder, name), [], 0
        for row, ids, last in reader.pieces(range(len(reader.lengths))):
            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
            if last:
                out.append((reader.doc_id(row), before + int(reader.starts[row]), int(reader.lengths[row]), crc))
                crc = 0
                if len(out) == 10_000:
                    yield _frame(out)
                    out = []
        yield _frame(out)

    return _each_file(spark, tokens, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list, columns=("doc_id", "start", "n_tokens", "ids_crc32")) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(columns)).astype({"doc_id": "Int64"})


def _whole(reader: FrameReader, rows: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    parts: list[np.ndarray] = []
    for row, ids, last in reader.pieces(rows):
        parts.append(ids)
        if last:
            yield row, np.concatenate(parts).astype(np.int32)
            parts = []


def read_tokens(spark: SparkSession, tokens: TokenFiles) -> DataFrame:
    """``doc_id``, ``start`` and ``ids`` of every document."""
    folder = tokens.folder

    def run(name: str, before: int) -> Iterator[pd.DataFrame]:
        reader = _reader(folder, name)
        for row, ids in _whole(reader, range(len(reader.lengths))):
            yield _frame([(reader.doc_id(row), before + int(reader.starts[row]), ids)], ("doc_id", "start", "ids"))

    return _each_file(spark, tokens, run, "doc_id long, start long, ids array<int>")


def read_documents(wanted: DataFrame, tokens: TokenFiles) -> DataFrame:
    """``doc_id``, ``start``, ``ids`` and ``frames_read`` of the wanted ids (column ``doc_id``) only.

    An id goes to the files whose range holds it, found in a list with one entry a file; there only the
    frames that hold wanted documents are decompressed. ``frames_read`` counts them up to the document.
    """
    folder, schema = tokens.folder, "doc_id long, start long, ids array<int>, frames_read int"
    spark = wanted.sparkSession
    ranges = [(f.first_id, f.last_id, f.name, b) for f, b in zip(tokens.files, tokens.before, strict=True) if f.first_id is not None]
    shared = spark.sparkContext.broadcast(ranges)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        last_ids = [r[1] for r in known]
        for batch in batches:
            out = []
            for doc_id in batch.doc_id.tolist():
                at = bisect_right(last_ids, doc_id - 1)
                while at < len(known) and known[at][0] <= doc_id:
                    out.append((doc_id, known[at][2], known[at][3]))
                    at += 1
            yield pd.DataFrame(out, columns=["doc_id", "name", "before"])

    def fetch(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        reader = _reader(folder, group[0])
        places = [r for doc_id in sorted(rows.doc_id) for r in reader.rows_of(doc_id)]
        before = int(rows.before.iloc[0])
        out = [(reader.doc_id(r), before + int(reader.starts[r]), ids, reader.frames_read) for r, ids in _whole(reader, places)]
        return _frame(out, ("doc_id", "start", "ids", "frames_read"))

    ids = wanted.select(F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull()).distinct()
    return ids.mapInPandas(route, "doc_id long, name string, before long").groupBy("name").applyInPandas(fetch, schema)
