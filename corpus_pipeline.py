"""Corpus pipeline: classify, drop repeated lines, drop near-duplicates, decontaminate, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlex.llm import common, decontam, line_dedup, near_copies, packing, pu_quality, tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The shortest line that drop_lines looks at.
LINE_CHARS = 40
#: No SQL: the classifier is a trained network. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, in all their columns. It is fitted on the texts that come in.

    Null and empty texts are scored like any other, and so are ties and repeated rows; an empty table stays empty; columns named
    like the classifier's are left as they are.
    """
    model = pu_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = tuple(common.fresh(docs, "_score", "_predicted"))
    return pu_quality.score(docs, model, names=names).filter(F.col(names[1]) == 1).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat or nearly repeat an earlier line; n_chars follows the text.

    Lines of fewer than LINE_CHARS characters stay: short ones are alike by chance. Null and empty texts stay as they are, a
    text may become empty, rows repeated with equal text are one place; all columns stay; an empty table stays empty.
    """
    return _counted(line_dedup.drop_repeated(docs, least_chars=LINE_CHARS), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Five-word shingles, Jaccard similarity of 0.8 or more.

    Links within three bits of SimHash fingerprints come first, and are verified; links beyond their reach are found by shared
    shingles. Texts without words are copies of each other; rows that repeat the kept doc_id stay; a null doc_id is never the
    smallest while another is there; all columns stay; an empty table stays empty.
    """
    return near_copies.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up less than a twentieth, in all columns.

    Documents without words stay. A doc_id goes with all rows that have it if one of them is contaminated, and so do null ones.
    """
    marked = decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    (name,) = common.fresh(docs, "_found")
    found = marked.filter(decontam.contaminated()).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: one row for each piece of a document. Null and empty texts are one end id; repeated rows are packed each; other columns aren't read."""
    return packing.pack(docs, tokens.vocabulary_path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("classify", classify),
    ("drop_lines", drop_lines),
    ("drop_near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def _counted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind)).select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on all that the one before kept; nulls, ties, repeats, empty tables and other columns as the stages have it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = common.settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if before is not None:
            common.drop_stored(before)
        before = docs
    return docs
