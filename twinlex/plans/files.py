"""Small text files on any file system that Spark reaches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that stand in a folder."""
    place, system = _place(spark, path)
    return [str(x.getPath()) for x in system.listStatus(place) if x.isDirectory()]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """Written beside its place and renamed, so that a reader sees all or nothing."""
    place, system = _place(spark, path)
    part, _ = _place(spark, f"{path}.part")
    out = system.create(part, True)
    for i in range(0, len(raw), 8 << 20):
        out.write(bytearray(raw[i : i + (8 << 20)]))
    out.close()
    system.delete(place, False)
    system.rename(part, place)


def edges(spark: SparkSession, uri: str, n: int = 3) -> tuple[bytes, bytes]:
    """The first and the last n bytes of a file, named by its URI as DataFrame.inputFiles() gives it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(uri))
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.open(place)
    try:
        head = bytes(stream.readNBytes(n))
        stream.seek(max(0, system.getFileStatus(place).getLen() - n))
        return head, bytes(stream.readNBytes(n))
    finally:
        stream.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(str(path)).select("content").first()[0])


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a local one in local runs."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="twinlex-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        root = f"file://{_local[app]}"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def read_text(spark: SparkSession, path: str) -> str:
    place, system = _place(spark, path)
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
