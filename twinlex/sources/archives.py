"""Texts from the members of a tar archive, read on executors where the archive lies: nothing is extracted to a disk."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from twinlex.sources.aligned import opened

_SCHEMA = "name string, value string"


def short(name: str) -> str:
    """A member's last folder and file name, by which it is asked for."""
    return "/".join(name.split("/")[-2:])


def offsets(path: str) -> dict[str, tuple[int, int]] | None:
    """Where the members of a plain archive begin and how long they are, from their headers alone; None if it is compressed."""
    with opened(path) as raw:
        try:
            with tarfile.open(fileobj=raw, mode="r:") as archive:  # goes from header to header by seeking
                return {short(m.name): (m.offset_data, m.size) for m in archive if m.isreg()}
        except tarfile.ReadError:
            return None


def texts(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows (name, value): the asked members as whole texts, undecodable bytes replaced. One that is lacking is an error.

    Of a plain archive each member is a range of bytes that a task of its own reads. A compressed one has to be read from its
    start: one task streams it and keeps the asked members alone.
    """
    found = offsets(path)
    if found is not None and (lacking := [n for n in names if n not in found]):
        raise FileNotFoundError(f"the archive lacks {lacking}")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(path) as raw:
                    raw.seek(row["start"])
                    yield _row(row["name"], raw.read(row["size"]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {n for batch in batches for n in batch.column(0).to_pylist()}
        with opened(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
            for member in archive:
                if member.isreg() and short(member.name) in wanted:
                    wanted.discard(short(member.name))
                    yield _row(short(member.name), archive.extractfile(member).read())
                if not wanted:
                    return
        if wanted:
            raise FileNotFoundError(f"the archive lacks {sorted(wanted)}")

    if found is None:
        return spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).mapInArrow(stream, _SCHEMA)
    asked = spark.createDataFrame([(n, *found[n]) for n in names], "name string, start bigint, size bigint")
    return asked.repartition(len(names), "name").mapInArrow(ranges, _SCHEMA)


def _row(name: str, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"name": [name], "value": [data.decode("utf-8", "replace")]})
