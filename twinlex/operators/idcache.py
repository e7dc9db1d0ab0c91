"""Token ids in flat files of 16 bits each, with an index by which single samples are read without their neighbours."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlex.sources.aligned import opened
from twinlex.sources.sink import file_system

#: Bytes between two ranges of a file from which on they are read apart.
GAP = 16 << 10
_INDEX = "sample bigint, file string, start bigint, n_en int, n_am int"


def write(rows: DataFrame, folder: str, sample: str = "pair", en: str = "en_ids", am: str = "am_ids") -> DataFrame:
    """rows as flat files of a folder, one for each task, and their index as a table in it, which is returned.

    A sample's ids stand together, those of en before those of am; start counts ids. The index holds what finished tasks have
    said, so that files of tasks that failed or ran twice are never read. Null ids are none. An id beyond 16 bits is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(folder)
        system.create_dir(place)
        name, at, out = f"{uuid.uuid4().hex}.u16", 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                out = out or system.open_output_stream(f"{place}/{name}")
                sides = [_flat(batch.column(i)) for i in (1, 2)]
                n_en, n_am = (n for _, n in sides)
                ids = np.empty(n_en.sum() + n_am.sum(), np.int64)
                starts = np.cumsum(n_en + n_am) - n_en - n_am
                for (flat, n), begin in zip(sides, (starts, starts + n_en), strict=True):
                    ids[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(flat))] = flat
                if len(ids) and not 0 <= ids.min() <= ids.max() < 1 << 16:
                    raise ValueError("ids must lie within 16 bits")
                out.write(ids.astype("<u2").tobytes())
                files = pa.array([name] * batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), files, pa.array(starts + at), pa.array(n_en.astype(np.int32)), pa.array(n_am.astype(np.int32))], ["sample", "file", "start", "n_en", "n_am"])
                at += len(ids)
        finally:
            if out:
                out.close()

    index = rows.select(F.col(sample).cast("bigint").alias("sample"), F.col(en).cast("array<int>"), F.col(am).cast("array<int>")).mapInArrow(run, _INDEX)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return load(rows.sparkSession, folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n


def read_ranges(file, starts: np.ndarray, sizes: np.ndarray, gap: int = GAP) -> list[bytes]:
    """These ranges of a file of 16-bit ids, counted in ids, in the order given. Ranges that lie close together are read at once."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    out: list[bytes] = [b""] * len(starts)
    begin, end = 2 * starts[order], 2 * (starts + sizes)[order]
    reach = np.maximum.accumulate(end)
    cuts = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1] + gap]))
    for i, j in zip(cuts, [*cuts[1:], len(begin)], strict=True):
        file.seek(int(begin[i]))
        data = file.read(int(reach[j - 1] - begin[i]))
        for at in range(i, j):
            out[order[at]] = data[begin[at] - begin[i] : end[at] - begin[i]]
    return out


def fetch(samples: DataFrame, folder: str, sample: str = "sample") -> DataFrame:
    """Rows (sample, en_ids, am_ids) of the asked samples, of which only their own ranges are read.

    What is shuffled are the samples' places, by file; a task opens a file once for the ranges that it has been dealt of it.
    """
    index = load(samples.sparkSession, folder)
    placed = samples.select(F.col(sample).cast("bigint").alias("sample")).join(index, "sample").repartition("file").sortWithinPartitions("file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            files = columns["file"]
            edges = [i for i in range(len(files)) if not i or files[i] != files[i - 1]]
            for i, j in zip(edges, [*edges[1:], len(files)], strict=True):
                n_en, n_am = columns["n_en"][i:j].astype(np.int64), columns["n_am"][i:j].astype(np.int64)
                with opened(f"{folder}/{files[i]}") as file:
                    parts = read_ranges(file, columns["start"][i:j].astype(np.int64), n_en + n_am)
                ids = [np.frombuffer(p, "<u2").astype(np.int32) for p in parts]
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("sample").slice(i, j - i), pa.array([x[:n] for x, n in zip(ids, n_en, strict=True)], kind), pa.array([x[n:] for x, n in zip(ids, n_en, strict=True)], kind)], ["sample", "en_ids", "am_ids"])

    return placed.mapInArrow(run, "sample bigint, en_ids array<int>, am_ids array<int>")
