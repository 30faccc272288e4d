"""Token ids in seekable zstandard files: one independent frame for each document.

A file holds, in ascending order of doc_id, a zstandard frame for each document (its ids, four
little-endian bytes each), then a skippable frame with the doc_ids, then the seek table of the
public seekable format, again a skippable frame: compressed size, size and checksum of every
frame (the lowest 32 bits of XXH64 of its content), a frame count and a magic number. Any
zstandard decoder reads the file through; a reader of single documents takes the two tables from
its end, finds the doc_id by binary search, and fetches and decompresses that frame alone.

Spark sorts the documents by ranges of doc_id, and each partition becomes one file, written
under a name of its own and then renamed, so a task that runs again replaces its file. The manifest
(a row per file) is written last; a folder without one is not read.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultbench.llm.common import sliced, unused
from faultbench.llm.token_counts import BATCH_BYTES, BATCH_ROWS, encoder

#: Fixed values of the format: magic numbers of both skippable frames and of the footer.
SEEK_TABLE, DIRECTORY, FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
WITH_CHECKSUMS = 0x80
#: Bytes that a reader of whole files fetches at a time.
READ = 8 << 20

_entry = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])
FILE = "part int, name string, docs long, tokens long, least long, greatest long"


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents into ``out``; ``close`` adds the tables, without which nothing can be read."""

    def __init__(self, out, level: int = 3):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        packed = self.zstd.compress(ids)
        if max(len(ids), len(packed)) >= 1 << 32:
            raise ValueError("a frame of the format holds less than 4 GiB")
        self.out.write(packed)
        self.entries.append((len(packed), len(ids), _checksum(ids)))
        self.docs.append(doc)

    def close(self) -> None:
        """The directory (null flags, doc_ids) is a frame without content, so the seek table lists it too."""
        flags = bytes(d is None for d in self.docs)
        body = flags + np.array([d or 0 for d in self.docs], "<i8").tobytes()
        directory = struct.pack("<II", DIRECTORY, len(body)) + body
        self.out.write(directory)
        table = np.array([*self.entries, (len(directory), 0, _checksum(b""))], _entry).tobytes()
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table) + 9) + table)
        self.out.write(struct.pack("<IBI", len(self.entries) + 1, WITH_CHECKSUMS, FOOTER))


@dataclass
class FrameFile:
    """The tables of a file: where each document's frame is, what it must hold, whose it is."""

    source: object
    begins: np.ndarray
    entries: np.ndarray
    docs: np.ndarray
    null: np.ndarray

    @classmethod
    def open(cls, source) -> FrameFile:
        """``source``: a random-access file (``seek``, ``read``, ``size``)."""
        end = source.size()
        frames, kind, magic = struct.unpack("<IBI", _at(source, end - 9, 9))
        if magic != FOOTER or kind != WITH_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        begin = end - 9 - frames * _entry.itemsize - 8
        table = _at(source, begin, end - begin)
        if struct.unpack("<II", table[:8]) != (SEEK_TABLE, end - begin - 8):
            raise ValueError("the seek table does not fit its frame")
        entries = np.frombuffer(table[8:-9], _entry)
        stops = np.cumsum(entries["packed"], dtype=np.int64)
        if stops[-1] != begin:
            raise ValueError("the frames of the seek table do not fill the file")
        n = frames - 1
        body = _at(source, begin - int(entries["packed"][-1]) + 8, n * 9)
        null, docs = np.frombuffer(body[:n], np.uint8) != 0, np.frombuffer(body[n:], "<i8")
        return cls(source, (stops - entries["packed"])[:n], entries[:n], docs, null)

    def find(self, doc: int) -> range:
        """Numbers of the frames of a doc_id, by binary search; null ids stand first."""
        nulls = int(self.null.sum())
        low, high = (int(np.searchsorted(self.docs[nulls:], doc, side=s)) + nulls for s in ("left", "right"))
        return range(low, high)

    def read(self, i: int) -> bytes:
        """The ids of frame ``i``; only its bytes are fetched."""
        return self._checked(i, _at(self.source, int(self.begins[i]), int(self.entries["packed"][i])))

    def read_all(self) -> Iterator[bytes]:
        """The ids of every frame in order, fetched in larger blocks."""
        i, n = 0, len(self.begins)
        while i < n:
            start = int(self.begins[i])
            stop = max(i + 1, int(np.searchsorted(self.begins, start + READ, side="right")) - 1)
            end = int(self.begins[stop - 1]) + int(self.entries["packed"][stop - 1])
            block = memoryview(_at(self.source, start, end - start))
            for k in range(i, stop):
                a = int(self.begins[k]) - start
                yield self._checked(k, block[a : a + int(self.entries["packed"][k])])
            i = stop

    def _checked(self, i: int, packed) -> bytes:
        size = int(self.entries["size"][i])
        ids = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size) if size else b""
        if len(ids) != size or _checksum(ids) != int(self.entries["sum"][i]):
            raise ValueError(f"frame {i} does not match its checksum")
        return ids


def _at(source, begin: int, size: int) -> bytes:
    if begin < 0:
        raise ValueError("the file is too short")
    source.seek(begin)
    return source.read(size)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = 0, level: int = 3) -> DataFrame:
    """Encode ``docs`` with the vocabulary file ``path`` into files under ``folder``; returns its manifest.

    Every document is its ids followed by ``end``; files and documents in them ascend by doc_id,
    null ids first, equal ids in the table's order (a row each), so one id on many rows spreads over
    files. Null and empty texts are the closing id alone, extra columns are ignored, and an empty
    table gives a manifest without rows. ``folder`` must be one that driver and executors share.
    """
    spark = docs.sparkSession
    (row,) = unused(docs, "_row")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        store, base = _store(folder)
        name, made = f"part-{part:06d}.ids.zst", f"{base}/_{uuid.uuid4().hex}"
        writer, out = None, None
        for batch in sliced(batches, rows=BATCH_ROWS, size=BATCH_BYTES):
            if writer is None and batch.num_rows:
                store.create_dir(base)
                out = store.open_output_stream(made, buffer_size=1 << 20)
                writer = FrameWriter(out, level)
            ids, counts = enc.encode_flat(batch.column("text"))
            data, stops = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(counts) * 4).tolist()
            for doc, a, b in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), [0, *stops], stops):
                writer.add(doc, b"".join((data[a:b], last)))
        if writer:
            writer.close()
            out.close()
            store.move(made, f"{base}/{name}")
            known = [d for d in writer.docs if d is not None]
            own = (part, name, len(writer.docs), sum(n for _, n, _ in writer.entries) // 4, min(known, default=None), max(known, default=None))
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(own, kinds)], names=[x.split()[0] for x in FILE.split(", ")])

    ordered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias(row))
    ordered = ordered.repartitionByRange("doc_id", row).sortWithinPartitions("doc_id", row)
    ordered.select("doc_id", "text").mapInArrow(run, FILE).write.parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (part, name, docs, tokens, least, greatest doc_id), one for each file."""
    return spark.read.schema(FILE).parquet(f"{folder}/_manifest")


DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def _documents(spark: SparkSession, folder: str, wanted: list[int] | None) -> DataFrame:
    # One small row for each file, as the driver holds them for each task anyway.
    files, before, todo = manifest(spark, folder).orderBy("part").collect(), 0, []
    for f in files:
        if wanted is None or any(f.least is not None and f.least <= d <= f.greatest for d in wanted):
            todo.append((f.name, before))
        before += f.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist()):
                with store.open_input_file(f"{base}/{name}") as source:
                    file = FrameFile.open(source)
                    n = file.entries["size"].astype(np.int64) // 4
                    starts = first + np.cumsum(n) - n
                    if wanted is None:
                        every = enumerate(file.read_all())
                    else:
                        every = ((i, file.read(i)) for d in dict.fromkeys(wanted) for i in file.find(d))
                    rows, held = [], 0
                    for i, ids in every:
                        rows.append((None if file.null[i] else int(file.docs[i]), int(starts[i]), int(n[i]), ids))
                        held += len(ids)
                        if held >= READ:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    table = spark.createDataFrame(todo, "name string, first long")
    if todo:
        table = table.repartition(len(todo))
    return table.mapInArrow(run, DOCUMENT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"]
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    ids are little-endian unsigned 32-bit numbers. Every frame is held against its checksum.
    """
    return _documents(spark, folder, None)


def read_documents(spark: SparkSession, folder: str, wanted: list[int]) -> DataFrame:
    """As ``read_tokens``, for a stated list of doc_ids: only files whose range holds one of them are
    opened, and only the frames of these documents are fetched."""
    return _documents(spark, folder, list(wanted))
