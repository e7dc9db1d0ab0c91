"""Token-id files: all ids in a row, with the documents' boundaries as an Elias-Fano sequence.

A file holds, in little-endian order: the ids (2 or 4 bytes each), the documents' keys (8 bytes each), the boundaries' low
bits, their high bits, the select samples, and a trailer of nine 64-bit words: magic, bytes of an id, documents, documents
without a key (they come first), ids, low bits of a boundary, and the 64-bit words of the three sections.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlex.llm import common, tokens

MAGIC = 0x314645584C544F4B
TRAILER = 9
#: Ones between two select samples.
SAMPLE = 256
_READ = 1 << 20


@dataclass
class EliasFano:
    """A non-decreasing sequence of n integers up to u in about n * (2 + log2(u / n)) bits."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        shift = np.uint64(low_bits)
        at = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(at[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        bits[at] = 1
        low = (((values & ((np.uint64(1) << shift) - np.uint64(1)))[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        low = np.pad(low, (0, -len(low) % 64))
        pack = lambda b: np.packbits(b, bitorder="little").view("<u8")
        return cls(n, low_bits, pack(low), pack(bits), at[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Where the i-th one of the high bits stands: from the last sample on, word by word."""
        at = int(self.samples[i // SAMPLE])
        left, w = i % SAMPLE, at >> 6
        word = int(self.high[w]) >> (at & 63) << (at & 63)
        while (ones := word.bit_count()) <= left:
            left, w = left - ones, w + 1
            word = int(self.high[w])
        for _ in range(left):
            word &= word - 1
        return (w << 6) + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        """The i-th value, without any other being decoded."""
        low = 0
        if self.low_bits:
            first, off = divmod(i * self.low_bits, 64)
            both = int(self.low[first]) | (int(self.low[first + 1]) << 64 if off + self.low_bits > 64 else 0)
            low = both >> off & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def values(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The values from start to stop; only the words that hold them are opened."""
        stop = self.n if stop is None else stop
        if stop <= start:
            return np.empty(0, np.int64)
        first, last = self.select(start), self.select(stop - 1)
        w = first >> 6
        bits = np.unpackbits(self.high[w : (last >> 6) + 1].view(np.uint8), bitorder="little")
        ones = np.flatnonzero(bits) + (w << 6)
        ones = ones[(ones >= first) & (ones <= last)]
        out = (ones - np.arange(start, stop)) << self.low_bits
        if self.low_bits:
            begin, end = start * self.low_bits, stop * self.low_bits
            low = np.unpackbits(self.low[begin >> 6 : -(-end // 64)].view(np.uint8), bitorder="little")[begin & 63 :][: end - begin]
            out |= (low.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


class Writer:
    """Appends documents to one file; close() adds the boundaries."""

    def __init__(self, path: str, width: int) -> None:
        system, place = _filesystem(path)
        self.out, self.width, self.n_null, self.n_ids = system.open_output_stream(place), width, 0, 0
        self.keys: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.n_null += keys.null_count
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.sizes.append(sizes)
        self.n_ids += len(ids)
        self.out.write(np.ascontiguousarray(ids, f"<u{self.width}").tobytes())

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        keys = np.concatenate([np.empty(0, "<i8"), *self.keys])
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *self.sizes]))
        ef = EliasFano.build(ends)
        self.out.write(b"\0" * (-self.n_ids * self.width % 8))
        for part in (keys, ef.low, ef.high, ef.samples):
            self.out.write(part.tobytes())
        self.out.write(np.array([MAGIC, self.width, len(keys), self.n_null, self.n_ids, ef.low_bits, len(ef.low), len(ef.high), len(ef.samples)], "<u8").tobytes())
        self.out.close()
        return len(keys), self.n_ids


class Reader:
    """One file: keys and boundaries in memory, ids read on demand."""

    def __init__(self, path: str) -> None:
        system, place = _filesystem(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        trailer = np.frombuffer(self.file.read_at(8 * TRAILER, size - 8 * TRAILER), "<u8").tolist()
        magic, self.width, self.n_docs, self.n_null, self.n_ids, low_bits, n_low, n_high, n_samples = trailer
        if magic != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        at = -(-self.n_ids * self.width // 8) * 8
        take = lambda n, skip, kind: np.frombuffer(self.file.read_at(8 * n, at + 8 * skip), kind)
        self.keys = take(self.n_docs, 0, "<i8")
        skip = self.n_docs
        self.bounds = EliasFano(self.n_docs + 1, low_bits, take(n_low, skip, "<u8"), take(n_high, skip + n_low, "<u8"), take(n_samples, skip + n_low + n_high, "<u8"))

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * self.width, start * self.width), f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds[i], self.bounds[i + 1])


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Write docs in ascending order of key (nulls first, equal keys by text) and return the manifest.

    Rows (file, least_key, n_docs, n_ids, start): one for each file, with the ids of all files before it. Documents are
    dealt out by ranges of the key; each task streams one file. A task that is run again writes under a new name, and only
    the names of finished tasks reach the manifest. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    tokens.ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encoder, writer, file, least = tokens.encoder(vocabulary), None, "", None
        for batch in common.slices(batches):
            if not batch.num_rows:
                continue
            if writer is None:
                file, least = f"{folder}/{uuid.uuid4().hex}.ids", batch.column(0)[0].as_py()
                writer = Writer(file, width)
            ids, n = tokens.with_end(*encoder.encode(batch.column(1)), end_id)
            if len(ids) and int(ids.max()) >> 8 * width:
                raise ValueError(f"an id needs more than {width} bytes")
            writer.add(batch.column(0), ids, n)
        if writer:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"file": [file], "least_key": pa.array([least], pa.int64()), "n_docs": [n_docs], "n_ids": [n_ids]})

    ordered = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    files = common.stored(ordered.mapInArrow(run, "file string, least_key bigint, n_docs bigint, n_ids bigint"), "manifest")
    rows = sorted(files.collect(), key=lambda r: (r.least_key is not None, r.least_key or 0))  # one row for each task, not for each document
    starts = np.cumsum([0, *(r.n_ids for r in rows)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts, strict=False)], "file string, least_key bigint, n_docs bigint, n_ids bigint, start bigint")


def read(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, start, n_tokens, ids binary: little-endian 32-bit), one for each document of the files."""
    common.share_package(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = Reader(row["file"])
                i = 0
                while i < file.n_docs:
                    bounds = file.bounds.values(i, min(i + 4096, file.n_docs) + 1)
                    n = max(1, min(len(bounds) - 1, int(np.searchsorted(bounds, bounds[0] + _READ, "right")) - 1))
                    bounds = bounds[: n + 1]
                    ids = file.ids(int(bounds[0]), int(bounds[-1]))
                    at = (bounds - bounds[0]) * 4
                    keys = pa.array(file.keys[i : i + n], mask=np.arange(i, i + n) < file.n_null)
                    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([keys, pa.array(bounds[:-1] + row["start"]), pa.array(np.diff(bounds)), blobs.cast(pa.binary())], [key, "start", "n_tokens", "ids"])
                    i += n

    spark = manifest.sparkSession
    files = manifest.select("file", "start")
    return files.repartition(max(1, files.count())).mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids binary") if not files.isEmpty() else spark.createDataFrame([], f"`{key}` bigint, start bigint, n_tokens bigint, ids binary")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
