"""A sink for ordered or judged rows: Parquet files whose row groups are counted in rows, put in place by one commit.

Tasks write hidden files under names of their own and tell Spark what they wrote. Only the commit shows files: those of finished
tasks. So a task that runs twice adds nothing, and a write that fails leaves what was there before.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows of a row group.
ROW_GROUP = 100_000
#: The column that says why a row isn't kept. It's counted, and not written.
REASON = "reason"


@dataclass
class Wrote(WriterCommitMessage):
    """What one task has written: its file (None if it kept no row), its kept rows, and the others by reason."""

    file: str | None
    kept: int
    rejected: dict[str, int] = field(default_factory=dict)


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class RowSink(DataSource):
    """Options: `path` (the folder of the files); `marker` (a JSON file, which names the files and counts rows; written at the commit);
    `about` (JSON: fields that the marker starts with); `began` (seconds since 1970, for the marker's seconds); `row_group` (rows).

    Rows with a column named reason are kept where it is null; the others are counted by it. Files are numbered by partition, so
    that their order is that of the rows.
    """

    @classmethod
    def name(cls) -> str:
        return "row_sink"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RowWriter(dict(self.options))


class RowWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.marker = options["path"].rstrip("/"), options.get("marker")
        self.about, self.began = json.loads(options.get("about", "{}")), float(options.get("began", time.time()))
        self.row_group = int(options.get("row_group", ROW_GROUP))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, folder = file_system(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        held, n, kept, rejected, out = [], 0, 0, Counter(), None
        system.create_dir(folder)
        try:
            for batch in iterator:
                if REASON in batch.schema.names:
                    why = batch.column(REASON)
                    rejected.update({x["values"]: x["counts"] for x in pc.value_counts(why.drop_null()).to_pylist()})
                    batch = batch.filter(pc.is_null(why)).drop_columns([REASON])
                if not batch.num_rows:
                    continue
                out = out or pq.ParquetWriter(f"{folder}/.{name}", batch.schema, compression="zstd", filesystem=system)
                held.append(batch)
                n, kept = n + batch.num_rows, kept + batch.num_rows
                while n >= self.row_group:
                    table = pa.Table.from_batches(held)
                    out.write_table(table.slice(0, self.row_group), row_group_size=self.row_group)
                    held, n = table.slice(self.row_group).to_batches(), n - self.row_group
            if n:
                out.write_table(pa.Table.from_batches(held), row_group_size=self.row_group)
        finally:
            if out:
                out.close()
        return Wrote(name if out else None, kept, dict(rejected))

    def commit(self, messages: list[Wrote | None]) -> None:
        """With a marker: show the new files, name them in the marker (this is the moment that counts), remove all others.

        Without one, others are removed before the new ones are shown, so that no reader meets both.
        """
        done = [m for m in messages if m is not None]
        files = sorted(m.file for m in done if m.file)
        if not self.marker:
            self._sweep(set(), {f".{f}" for f in files})
        system, folder = file_system(self.path)
        for f in files:
            system.move(f"{folder}/.{f}", f"{folder}/{f}")
        if self.marker:
            rejected = sum((Counter(m.rejected) for m in done), Counter())
            kept = sum(m.kept for m in done)
            stats = {**self.about, "read": kept + rejected.total(), "kept": kept, "rejected": dict(rejected), "seconds": round(time.time() - self.began, 1), "files": files}
            system, place = file_system(self.marker)
            part = f"{place}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(json.dumps(stats, indent=2).encode())
            system.move(part, place)
            self._sweep(set(files), set())

    def abort(self, messages: list[Wrote | None]) -> None:
        system, folder = file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{folder}/.{m.file}")

    def _sweep(self, shown: set[str], hidden: set[str]) -> None:
        """Remove the folder's files, of earlier writes and of tasks that didn't finish, but for these."""
        from pyarrow import fs

        system, folder = file_system(self.path)
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.is_file and info.base_name not in shown | hidden:
                system.delete_file(info.path)


def write_rows(rows: DataFrame, path: str, **options: str | int | float) -> None:
    """rows, in the order of their partitions and within them, as the files of a folder; options as of RowSink."""
    rows.sparkSession.dataSource.register(RowSink)
    rows.write.format("row_sink").mode("append").options(path=str(path), **options).save()


def row_groups(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows (file, row_group, n) from the footers alone, read by a task for some files each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                system, place = file_system(path)
                footer = pq.read_metadata(place, filesystem=system)
                rows += [{"file": path, "row_group": i, "n": footer.row_group(i).num_rows} for i in range(footer.num_row_groups)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("n", pa.int64())]))

    many = max(1, min(len(files), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(many).mapInArrow(read, "file string, row_group int, n bigint")
