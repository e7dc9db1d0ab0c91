"""What the operators of this subpackage share: the shared folder, Arrow text buffers, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a Python worker looks at together.
SLICE_ROWS, SLICE_BYTES = 2048, 4 << 20
_own_dirs: dict[str, str] = {}


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it (an installed package needs nothing)."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = root + (os.pathsep + have if have else "")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share; one of our own where it is unset (local runs)."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^]-]*\])?", spark.sparkContext.master):
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        folder = tempfile.mkdtemp(prefix="twinlex-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dirs[app] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors, and has a known size."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_open: list[list[str]] = []


def settled(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """stored(make()); all tables that make() has stored on the way are deleted then."""
    _open.append([])
    try:
        frame = make()
        path = new_path(frame.sparkSession, what)
        frame.write.parquet(path)
    finally:
        made = _open.pop()
    _delete(frame.sparkSession, made)
    if _open:
        _open[-1].append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, whatever case it is told apart in."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of steps that are written. Spark does so once the driver's JVM has collected their
    plans, which a small driver with much memory free puts off for up to half an hour; here it is asked to collect them now."""
    gc.collect()
    spark._jvm.System.gc()


_memory: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """What this worker process remembers for one operator. What it has kept for others is let go: workers live on from stage to stage."""
    if owner not in _memory:
        _memory.clear()
        gc.collect()
        trim()
    return _memory.setdefault(owner, {})


def trim() -> None:
    """Return freed memory to the system, which Arrow's and the C library's allocators would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries return memory by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same for mapInArrow, with what a task has freed returned at its end: the worker waits for the next one without it."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each row starts (one more than rows). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, starts, data = texts.buffers()
    at = np.frombuffer(starts, np.int64)[texts.offset : texts.offset + len(texts) + 1] if starts else np.zeros(1, np.int64)
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def strings(raw: bytes | np.ndarray, at: np.ndarray) -> pa.LargeStringArray:
    """The inverse of buffers(). The bytes must be UTF-8."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(raw))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and, but for single longer texts, of bounded bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        i = 0
        while i < batch.num_rows:
            most = (ends[i - 1] if i else 0) + size
            j = min(i + SLICE_ROWS, max(i + 1, int(np.searchsorted(ends, most, "right"))), batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def spaced_words(raw: bytes, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of texts whose separators are ASCII white space: all words in a row, and how many each text has."""
    lists = pc.ascii_split_whitespace(strings(raw, at))
    flat, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # an empty word stands where a text begins or ends with white space
        run = np.concatenate([[0], np.cumsum(full)])
        ends = np.cumsum(n)
        n = run[ends] - run[ends - n]
        flat = flat.filter(pa.array(full))
    return flat, n


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal spans in order; touching spans are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[first], reach[np.append(first[1:] - 1, len(reach) - 1)]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u, v): rows (node, root), root the smallest node of the component.

    Alternates large-star and small-star steps until the edge set no longer changes, each round written to the shared
    folder. Each step sends a node's neighbours to the smallest of them; minima are taken with partial aggregation and joined
    back, so that a hub is split like any skewed join. Nulls and loops are left out; an empty input gives an empty result.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select("u", "v", "m")
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        new = stored(step.filter("u > v").distinct(), "edges")
        was, mark = mark, new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_stored(now)
        now = new
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


