"""Sources of a corpus by kind, held-out texts, and saved tables."""

from __future__ import annotations

import json
import os
import tarfile
import urllib.parse
import urllib.request
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlex.functions import charclass as cc
from twinlex.plans import files
from twinlex.plans.config import HeldOutConfig, SourceConfig
from twinlex.sources import archives
from twinlex.sources.aligned import BLOCK, SIDES, AlignedText, line_index, size_of, unpacked

SHARD_SCHEMA = "en string, am string, source string, score float, priority smallint, key_hash bigint"
HELD_OUT_FILES = {"dev": "valid", "devtest": "test"}


def parse_score(text: Column) -> Column:
    """A number as float, or null."""
    return text.try_cast("double").cast("float")


def aligned(spark: SparkSession, block: int | None = None, **options: str) -> DataFrame:
    """Rows (line_no, en, am, score) of aligned files or of an archive; options as of AlignedText.

    Plain files are indexed first and then read by a task a block; bounds of line_no reach the reader, for which the session's
    switch of filter push-down into Python sources is turned on. Files of one block, and archives, need no index.
    """
    spark.dataSource.register(AlignedText)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    paths = [options[s] for s in SIDES if s in options]
    if paths and size_of(paths[0]) > (block or BLOCK):
        options["index"] = json.dumps([asdict(line_index(spark, p, block)) for p in paths])
    rows = spark.read.format("aligned_text").options(**options).load()
    return rows.select("line_no", "en", "am", parse_score(F.col("score")).alias("score"))


def numbered(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rows (line_no, text) of text files in order of file name and place."""
    return in_file_order(lines, {text: F.col(text)})


def zip_lines(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """The positional join of numbered lines (line_no, value): rows (line_no, left, right); the shorter side ends it, or fails it if strict."""
    if strict and (counts := (left.count(), right.count()))[0] != counts[1]:
        raise ValueError(f"{counts[0]} lines against {counts[1]}")
    return left.withColumnRenamed("value", "left").join(right.withColumnRenamed("value", "right"), "line_no")


def table_source(spark: SparkSession, src: SourceConfig, raw_dir: Path) -> DataFrame:
    """A hosted data set staged as Parquet or JSON lines under <raw>/<path>[/<subset>]/<split>; columns may be nested."""
    folder = Path(src.path) if os.path.isabs(src.path) else raw_dir / src.path
    for part in (src.subset, src.split):
        folder = folder / part if part and (folder / part).exists() else folder
    rows = spark.read.parquet(str(folder)) if any(folder.rglob("*.parquet")) else spark.read.json(str(folder))
    return first_rows(in_file_order(rows, {"en": dig(src.en_column), "am": dig(src.am_column)}).withColumn("score", F.lit(None).cast("float")), src.max_pairs)


def dig(path: str) -> Column:
    """A field by its dotted path, as text. What is missing is the text None, on which existing corpora rely."""
    return F.coalesce(F.col(path).cast("string"), F.lit("None"))


def in_file_order(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows (line_no, columns) numbered by file name, by where in the file their split starts, and by their place in it.

    The numbers don't depend on which task reads which split. What is gathered are splits and their sizes, a row each; Spark
    broadcasts them while they are few.
    """
    where = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    at = rows.select(*[c.alias(n) for n, c in where.items()], F.monotonically_increasing_id().alias("_at"), *[c.alias(n) for n, c in columns.items()])
    sizes = at.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_file").alias("_of"), F.col("_start").alias("_from"), "_first", before.alias("_before"))
    joined = at.join(starts, (F.col("_file") == F.col("_of")) & (F.col("_start") == F.col("_from")))
    return joined.select((F.col("_before") + F.col("_at") - F.col("_first")).alias("line_no"), *columns)


def first_rows(rows: DataFrame, n: int | None) -> DataFrame:
    """The first n rows by line_no; None and 0 mean all."""
    return rows.orderBy("line_no").limit(n) if n else rows


def read_source(spark: SparkSession, src: SourceConfig, raw_dir: Path) -> DataFrame:
    """Rows (line_no, en, am, score) of a source. Of an archive whose first lines alone are asked for, no more is unpacked."""
    limit = {"limit": str(src.max_pairs)} if src.max_pairs else {}
    if src.kind == "opus_moses":
        archive = str(staged(src.url, raw_dir / f"{src.name}.zip"))
        if limit:
            return aligned(spark, zip=archive, **limit)
        return aligned(spark, **dict(zip(SIDES, unpacked(spark, archive, f"{raw_dir}/{src.name}.lines"), strict=False)))
    if src.kind == "local_pair":
        return aligned(spark, en=str(src.en_file), am=str(src.am_file), **limit)
    return table_source(spark, src, raw_dir)


def staged(url: str, target: Path) -> Path:
    """The file behind url, fetched once: written beside its place and renamed when complete."""
    parts = urllib.parse.urlparse(url)
    if parts.scheme in ("", "file"):
        return Path(urllib.request.url2pathname(parts.path))
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")
        urllib.request.urlretrieve(url, part)
        part.replace(target)
    return target


def split_lines(text: Column) -> Column:
    """The lines of a whole text, at all line ends that Unicode knows; a last line end opens no line."""
    lines = F.split(text, cc.LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


#: Line ends of split_lines() that Spark's reader of lines doesn't know, and the bytes of each.
_OTHER_END = "[\\x0b\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"
_OTHER_ENDS = tuple(c.encode() for c in "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")
_BOM = "\ufeff"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line_no, value) of a text file, or of a folder's files in order of name, as split_lines() cuts whole texts; no task holds a file.

    Spark cuts at the common line ends and leaves out a mark of byte order; what else ends a line is cut within its rows. Whether
    a file begins with such a mark, or ends with one of the other line ends, which opens no line, is told from its first and last bytes.
    """
    rows = spark.read.text(path)
    edges = {p.replace(":///", ":/", 1): files.edges(spark, p) for p in rows.inputFiles()}
    cut = rows.select("_metadata", F.explode(F.split("value", _OTHER_END, -1)).alias("value"))
    lines = in_file_order(cut, {"value": F.col("value"), "_path": F.replace(F.col("_metadata.file_path"), F.lit(":///"), F.lit(":/"))})

    def places(paths: list[str], which) -> list[int]:
        return [r.at for r in lines.filter(F.col("_path").isin(paths)).groupBy("_path").agg(which("line_no").alias("at")).collect()] if paths else []

    marked = places([p for p, (head, _) in edges.items() if head == _BOM.encode()], F.min)
    open_ends = sorted(places([p for p, (_, tail) in edges.items() if tail.endswith(_OTHER_ENDS)], F.max))
    if marked:
        lines = lines.withColumn("value", F.when(F.col("line_no").isin(marked), F.concat(F.lit(_BOM), "value")).otherwise(F.col("value")))
    if open_ends:
        earlier = F.size(F.filter(F.array(*map(F.lit, open_ends)), lambda at: at < F.col("line_no")))
        lines = lines.filter(~F.col("line_no").isin(open_ends)).withColumn("line_no", F.col("line_no") - earlier)
    return lines.select(F.col("line_no").cast("int").alias("line_no"), "value")


def held_out_dir(cfg: HeldOutConfig, raw_dir: Path) -> Path:
    """The folder with {split}/{code}.{split} files: given, or extracted from the archive, of which only these are taken."""
    if cfg.local_dir is not None:
        return cfg.local_dir
    if cfg.url is None:
        raise ValueError("held-out texts need `local_dir` or `url`")
    names = [f"{split}/{code}.{split}" for split in HELD_OUT_FILES for code in (cfg.en_code, cfg.am_code)]
    folder = raw_dir / "held_out"
    if not all((folder / n).exists() for n in names):
        with tarfile.open(staged(cfg.url, raw_dir / "held_out.tar.gz")) as archive:
            members = {"/".join(m.name.split("/")[-2:]): m for m in archive if m.isfile()}
            if lacking := [n for n in names if n not in members]:
                raise FileNotFoundError(f"the archive lacks {lacking}")
            for n in names:
                (folder / n).parent.mkdir(parents=True, exist_ok=True)
                (folder / n).write_bytes(archive.extractfile(members[n]).read())
    return folder


def read_held_out(spark: SparkSession, cfg: HeldOutConfig, raw_dir: Path, split: str) -> DataFrame:
    """Rows (line_no, en_raw, am_raw) of one split; both languages must have as many lines. Archives are read where they lie."""
    if cfg.local_dir is None and cfg.url is None:
        raise ValueError("held-out texts need `local_dir` or `url`")
    archive = None if cfg.local_dir is not None else str(staged(cfg.url, raw_dir / "held_out.tar.gz"))

    def side(code: str) -> DataFrame:
        if archive is not None:
            whole = archives.texts(spark, archive, [f"{split}/{code}.{split}"])
            return whole.select(F.posexplode(split_lines(F.col("value"))).alias("line_no", "value"))
        return text_lines(spark, str(cfg.local_dir / split / f"{code}.{split}"))

    return zip_lines(side(cfg.en_code), side(cfg.am_code), strict=True).select("line_no", F.col("left").alias("en_raw"), F.col("right").alias("am_raw"))


def shard_files(spark: SparkSession, shard: str) -> list[str]:
    """What to read of a shard: the files that its marker names, or the whole folder if it has no marker or not all of them."""
    marker = f"{shard.removesuffix('.parquet')}.stats.json"
    if files.exists(spark, marker):
        names = json.loads(files.read_text(spark, marker)).get("files")
        paths = [f"{shard}/{n}" for n in names or []]
        if names is not None and all(files.exists(spark, p) for p in paths):
            return paths
    return [shard]


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Shards of a corpus, with columns that older ones lack read as null."""
    found = [f for p in paths for f in shard_files(spark, p)]
    return spark.read.schema(SHARD_SCHEMA).parquet(*found) if found else spark.createDataFrame([], SHARD_SCHEMA)
