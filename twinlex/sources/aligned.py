"""A Python data source for line-aligned texts, split by ranges of line numbers with the help of a line index.

Lines can't be found by their number without counting line ends. So these are counted once, block by block in as many tasks; sums
over the blocks before give the number of each block's first line. Each reading task then opens all files where its range begins.
"""

from __future__ import annotations

import io
import json
import zipfile
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "line_no bigint, en string, am string, score string"
#: Files in the order of their columns; the last one may be missing.
SIDES = ("en", "am", "scores")
#: Bytes of a block of the index, which is also what a reading task takes of the first file.
BLOCK = 32 << 20
_ROWS, _CHUNK = 8192, 4 << 20
_ARROW = pa.schema([("line_no", pa.int64()), ("en", pa.string()), ("am", pa.string()), ("score", pa.string())])


def opened(path: str):
    """A seekable binary file of any file system that pyarrow knows."""
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def size_of(path: str) -> int:
    with opened(path) as file:
        return file.seek(0, 2)


def line_ends(raw, start: int, stop: int) -> int:
    """How many lines end within these bytes: at \\n, \\r\\n or \\r. One of two bytes ends at the second."""
    raw.seek(start)
    n, at, last = 0, start, b""
    while at < stop and (part := raw.read(min(_CHUNK, stop - at))):
        n += part.count(b"\n") + part.count(b"\r") - part.count(b"\r\n") - (last == b"\r" and part[:1] == b"\n")
        at, last = at + len(part), part[-1:]
    return n - (last == b"\r" and raw.read(1) == b"\n")


@dataclass
class LineIndex:
    """Of each block where it starts and how many lines end before it; the size of a block list is that of the file by block."""

    offsets: list[int]
    before: list[int]
    lines: int

    @classmethod
    def counted(cls, ends: list[int], size: int, block: int, open_end: bool) -> LineIndex:
        """ends: line ends by block; open_end: the last line has none."""
        before = [0]
        for n in ends:
            before.append(before[-1] + n)
        return cls(list(range(0, size, block)) or [0], before[: max(1, len(ends))], before[-1] + open_end)

    def seek(self, line: int) -> tuple[int, int]:
        """Where to start reading for a line, and how many line ends to pass from there."""
        if not line:
            return 0, 0
        i = bisect_left(self.before, line) - 1
        return self.offsets[i], line - self.before[i]


def line_index(spark: SparkSession, path: str, block: int | None = None) -> LineIndex:
    """The index of a text file, counted block by block by tasks that take some BLOCK bytes each, in small files fewer; of each block a number reaches the driver."""
    block = block or BLOCK
    size = size_of(path)
    many = max(1, -(-size // block))
    tasks = min(many, max(-(-size // BLOCK), spark.sparkContext.defaultParallelism))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as raw:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_pydict({"block": ids, "ends": [line_ends(raw, i * block, min(size, (i + 1) * block)) for i in ids]})

    found = spark.range(0, many, 1, tasks).mapInArrow(count, "block bigint, ends bigint").toArrow().sort_by("block")
    with opened(path) as raw:
        raw.seek(max(0, size - 1))
        open_end = raw.read(1) not in (b"", b"\n", b"\r")
    return LineIndex.counted(found.column("ends").to_pylist(), size, block, open_end)


class AlignedText(DataSource):
    """Options: `en`, `am` and, if there is one, `scores` (files of any file system pyarrow knows), or `zip` (one archive of such
    members); `index` (JSON: the line index of each file, see aligned()); `limit` (rows).

    Stops with the shortest file. Undecodable bytes are replaced; lines end as in text files, at \\n, \\r\\n or \\r. The score is a
    line of the third file as it stands, null without one. Filters on line_no choose which lines are read. With an index there is a
    partition for each block of the first file; without one, and for archives, there is only one.
    """

    @classmethod
    def name(cls) -> str:
        return "aligned_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AlignedReader(dict(self.options))


@dataclass
class LineRange(InputPartition):
    """Lines from first to before stop (None: to the end), and for each file where to open it and how many lines to pass there."""

    first: int
    stop: int | None
    seeks: list[tuple[int, int]]


class AlignedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [options[s] for s in SIDES if s in options]
        self.zip = options.get("zip")
        self.index = [LineIndex(**x) for x in json.loads(options["index"])] if "index" in options else None
        self.low, self.high = 0, int(options.get("limit", 0)) or None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of line_no are taken over whole; a list of numbers gives bounds but stays with Spark; all others stay."""
        for f in filters:
            if getattr(f, "attribute", None) != ("line_no",):
                yield f
            elif isinstance(f, IsNotNull):
                pass
            elif isinstance(f, In):
                numbers = [x for x in f.value if x is not None]
                self._within(min(numbers, default=0), max(numbers, default=-1) + 1)
                yield f
            elif isinstance(f, EqualTo):
                self._within(f.value, f.value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self._within(f.value + isinstance(f, GreaterThan), None)
            elif isinstance(f, LessThan | LessThanOrEqual):
                self._within(0, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _within(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)

    def partitions(self) -> list[InputPartition]:
        if self.index is None:
            return [LineRange(self.low, self.high, [(0, self.low)] * 3)]
        stop = min([i.lines for i in self.index] + ([] if self.high is None else [self.high]))
        starts = [0, *(n + 1 for n in self.index[0].before[1:])]  # lines that begin within a block
        ranges = [(max(a, self.low), min(b, stop)) for a, b in zip(starts, [*starts[1:], stop], strict=True)]
        return [LineRange(a, b, [i.seek(a) for i in self.index]) for a, b in ranges if a < b] or [LineRange(0, 0, [(0, 0)] * 3)]

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        if partition.stop is not None and partition.stop <= partition.first:
            return
        if self.zip:
            with opened(self.zip) as raw, zipfile.ZipFile(raw) as archive:
                yield from _batches([archive.open(m) for m in members(archive)], partition)
        else:
            files = [opened(p) for p in self.paths]
            for file, (offset, _) in zip(files, partition.seeks, strict=False):
                file.seek(offset)
            yield from _batches(files, partition)


def members(archive: zipfile.ZipFile) -> list[str]:
    """The members of an archive that hold aligned lines, told by their endings, in the order of SIDES."""
    found = [next((m for m in archive.namelist() if m.endswith(f".{end}")), None) for end in SIDES]
    if None in found[:2]:
        raise ValueError(f"the archive has no pair of .en and .am members: {archive.namelist()}")
    return [m for m in found if m]


def _batches(files: list, lines: LineRange) -> Iterator[pa.RecordBatch]:
    texts = []
    for file, (_, passed) in zip(files, lines.seeks, strict=False):
        text = io.TextIOWrapper(file, encoding="utf-8", errors="replace")
        next(islice(text, passed - 1, passed), None) if passed else None
        texts.append(text)
    at = lines.first
    while lines.stop is None or at < lines.stop:
        want = _ROWS if lines.stop is None else min(_ROWS, lines.stop - at)
        parts = [[line.rstrip("\n") for line in islice(text, want)] for text in texts]
        n = min(map(len, parts))
        columns = [pa.array(p[:n], pa.string()) for p in parts] + [pa.nulls(n, pa.string())] * (3 - len(parts))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + n), pa.int64()), *columns], schema=_ARROW)
        at += n
        if n < want:
            return


def unpacked(spark: SparkSession, archive: str, folder: str) -> list[str]:
    """The aligned members of a zip archive as plain files in a folder that all executors share, each unpacked by a task of its own.

    A deflated member can be read in one go only; its plain copy can be split. Names hold the members' checksums, so that an
    archive is unpacked once; a copy is written beside its place and moved when it is complete.
    """
    from pyarrow import fs

    with opened(archive) as raw, zipfile.ZipFile(raw) as z:
        names = members(z)
        targets = [f"{folder}/{i}-{z.getinfo(m).CRC:08x}-{z.getinfo(m).file_size}.{SIDES[i]}" for i, m in enumerate(names)]

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            for member, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target.removeprefix("file:"))
                if system.get_file_info(place).type == fs.FileType.File:
                    continue
                system.create_dir(place.rpartition("/")[0])
                part = f"{place}.{uuid.uuid4().hex}"
                with opened(archive) as raw, zipfile.ZipFile(raw) as z, z.open(member) as source, system.open_output_stream(part) as out:
                    while data := source.read(_CHUNK):
                        out.write(data)
                system.move(part, place)
            yield batch

    spark.createDataFrame(list(zip(names, targets, strict=True)), "member string, target string").repartition(len(names), "member").mapInArrow(copy, "member string, target string").count()
    return targets
