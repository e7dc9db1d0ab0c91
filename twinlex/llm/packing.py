"""Best-fit packing of tokenized documents into sequences of bounded length, in bulk-synchronous rounds.

In each round, documents and gaps stand in one range-sorted row, and a sweep over it finds each document the smallest gap left
that takes it. Partitions sweep what they hold; what they leave over meets by rank, which takes two counts of each partition.
Then the gaps shrink, and the next round begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlex.llm import common, tokens

CAPACITY = 4096
#: Words whose ids a worker remembers.
_MEMO = 160_000


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, piece, start, length, ids binary: little-endian 32-bit): documents with their end id, cut only beyond capacity."""
    tokens.ready(docs.sparkSession)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, _MEMO)
        for batch in common.slices(batches):
            ids, n = tokens.with_end(*encoder.encode(batch.column(1)), end_id)
            many = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            keys = batch.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blobs], [key, "piece", "start", "length", "ids"])
            del ids, blobs
            common.trim()  # what one slice has freed would otherwise stay beside what the next one needs

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids binary")


def sweep(step: np.ndarray) -> np.ndarray:
    """For gaps (+1) and documents (-1) in falling order of size, gaps first: the place of each one's partner, or -1.

    A document takes the gap that was last passed and is still free: the smallest one that is large enough. Gaps and documents
    match like brackets: those of one depth alternate.
    """
    total = np.cumsum(step)
    least = np.minimum(np.minimum.accumulate(total), 0)
    free = (step > 0) | (least == np.concatenate([[0], least[:-1]]))  # a document that makes a new minimum finds no gap
    at = np.flatnonzero(free)
    depth = np.cumsum(step[at]) + (step[at] < 0)
    by = np.argsort(depth, kind="stable")
    at, depth = at[by], depth[by]
    hit = np.flatnonzero((step[at[1:]] < 0) & (step[at[:-1]] > 0) & (depth[1:] == depth[:-1]))
    partner = np.full(len(step), -1)
    partner[at[hit]], partner[at[hit + 1]] = at[hit + 1], at[hit]
    return partner


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """How the rest of the partitions meets: runs (part, kind, first rank, ranks, first link), kind 0 for gaps and 1 for documents.

    left has (part, documents, gaps) in the order of the row. A partition's first documents take the last gaps of the partitions
    before it, latest first; equal links belong together. Gaps of a run have falling links, documents rising ones.
    """
    stack: list[list[int]] = []
    runs, link = [], 0
    for part, documents, gaps in left:
        done = 0
        while done < documents and stack:
            of, have = stack[-1]
            n = min(have, documents - done)
            runs += [(part, 1, done, n, link), (of, 0, have - n, n, link)]
            done, link = done + n, link + n
            stack[-1][1] -= n
            if have == n:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return runs


_SWEPT = "part int, kind int, rank bigint, id bigint, length bigint, seq bigint, slot bigint, gap bigint"


def _round(items: DataFrame, gaps: DataFrame, top: int, low: int) -> tuple[DataFrame, DataFrame]:
    """One round for documents (id, length) between low and top, and gaps (seq, gap): tables swept and linked.

    A gap stands in the row once for each document of the longest length that it could take, so that it can take several in a
    round: as slots of equal size. Swept rows with both id and seq are placed; the others are left over with their rank by kind,
    and linked has those of them that meet, or stay (seq or id is null).
    """
    spark = items.sparkSession
    many = F.greatest(F.floor(F.col("gap") / top), F.lit(1)).cast("bigint")
    slots = gaps.filter(F.col("gap") >= low).select("seq", "gap", many.alias("many"), F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1)).alias("slot"))
    offered = slots.select(F.floor(F.col("gap") / F.col("many")).cast("bigint").alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("who"), "slot", "gap")
    wanted = items.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("id").alias("who"), F.lit(0).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("gap"))
    order = [F.col("size").desc(), "kind", "who", "slot"]
    row = offered.unionByName(wanted).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        size, kind, who, slot, gap, part = (table.column(i).to_numpy() for i in range(6))
        partner = sweep(1 - 2 * kind)
        alone = partner < 0
        document = kind == 1
        keep = alone | document  # a placed pair is one row, the document's
        rank = np.where(document, np.cumsum(alone & document), np.cumsum(alone & ~document)) - 1
        of = np.where(document, np.where(alone, 0, partner), np.arange(len(kind)))  # where the gap of a row stands
        no_gap, no_item = (document & alone)[keep], ~document[keep]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[keep].astype(np.int32)),
                pa.array(kind[keep].astype(np.int32)),
                pa.array(rank[keep].astype(np.int64), mask=~alone[keep]),
                pa.array(who[keep], mask=no_item),
                pa.array(size[keep], mask=no_item),
                pa.array(who[of][keep], mask=no_gap),
                pa.array(slot[of][keep], mask=no_gap),
                pa.array(gap[of][keep], mask=no_gap),
            ],
            ["part", "kind", "rank", "id", "length", "seq", "slot", "gap"],
        )

    swept = common.stored(row.mapInArrow(run, _SWEPT), "swept")
    count = lambda kind: F.count_if((F.col("kind") == kind) & F.col("rank").isNotNull())
    left = swept.groupBy("part").agg(count(1).alias("documents"), count(0).alias("gaps")).orderBy("part").collect()  # a row for each partition
    plan = spark.sparkContext.broadcast(np.array(sorted(across([tuple(r) for r in left])), np.int64).reshape(-1, 5))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        keys = (runs[:, 0] * 2 + runs[:, 1] << 40) + runs[:, 2]
        for batch in batches:
            part, kind, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            at = np.searchsorted(keys, (part * 2 + kind << 40) + rank, "right") - 1
            run = runs[np.maximum(at, 0)] if len(runs) else np.zeros((len(part), 5), np.int64)
            inside = rank - run[:, 2]
            on = (at >= 0) & (run[:, 0] == part) & (run[:, 1] == kind) & (inside < run[:, 3])
            number = run[:, 4] + np.where(kind == 1, inside, run[:, 3] - 1 - inside)
            # what stays has a negative number of its own
            own = -1 - ((part * 2 + kind << 40) + rank)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(on, number, own)), *batch.columns[3:]], ["link", "id", "length", "seq", "slot", "gap"])

    rest = swept.filter("rank is not null").mapInArrow(link, "link bigint, id bigint, length bigint, seq bigint, slot bigint, gap bigint")
    linked = common.stored(rest.groupBy("link").agg(*[F.max(c).alias(c) for c in ("id", "length", "seq", "slot", "gap")]), "linked")
    return swept, linked


def assigned(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (id, sequence_id, offset), one for each row (id, length) of lengths, which must be a written table with different ids.

    As many sequences as all lengths need at least stand open from the start, and the longest documents go first; when no gap
    takes any of the documents left, as many sequences are opened as those need at least. Each round places one document or more
    for each gap that can take one, so there are about as many rounds as the capacity has powers of two. The driver sees two
    counts of each partition, and four numbers a round.
    """
    spark = lengths.sparkSession
    measured = (F.count("*"), F.max("length"), F.min("length"), F.sum("length"))
    items, gaps = lengths.select("id", F.col("length").cast("bigint").alias("length")), None
    n, top, low, total = items.agg(*measured).first()
    if n and not 1 <= low <= top <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    placed: list[DataFrame] = []
    tables: list[DataFrame] = []
    n_seq, turn = 0, 0
    while n:
        if gaps is None:
            more = -(-total // capacity)
            gaps = spark.range(n_seq, n_seq + more).select(F.col("id").alias("seq"), F.lit(capacity).cast("bigint").alias("gap"))
            n_seq += more
        swept, linked = _round(items, gaps, top, low)
        tables += [swept, linked]
        columns = ["id", "length", "seq", "slot", "gap"]
        both = swept.filter("rank is null").select(*columns).unionByName(linked.select(*columns))
        done = both.filter("id is not null and seq is not null")
        placed.append(done.select("id", "length", "seq", F.lit(turn).alias("turn"), "slot"))
        items = linked.filter("seq is null").select("id", "length")
        before = n
        n, top, low, total = items.agg(*measured).first()
        size = F.max("gap") - F.sum(F.coalesce("length", F.lit(0)))
        gaps = both.filter("seq is not null").groupBy("seq").agg(size.alias("gap")) if n < before else None
        turn += 1
    if not placed:
        return lengths.select("id", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    every = placed[0]
    for part in placed[1:]:
        every = every.unionByName(part)
    so_far = Window.partitionBy("seq").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    out = common.stored(every.select("id", F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(so_far), F.lit(0)).cast("bigint").alias("offset")), "places")
    for table in tables:
        common.drop_stored(table)
    return out


def place(items: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """items with sequence_id and offset, every row in exactly one sequence of at most `capacity`.

    Lengths must lie between 1 and capacity; ties and repeated rows get a place each; an empty table gives an empty result.
    Columns named sequence_id or offset must not be there; all others stay.
    """
    (row,) = common.fresh(items, "_at")
    rows = common.stored(items.withColumn(row, F.monotonically_increasing_id()), "pieces")
    found = assigned(rows.select(F.col(row).alias("id"), F.col(length).alias("length")), capacity)
    return rows.join(found.withColumnRenamed("id", row), row).select(*items.columns, "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """pieces() with their ids, placed: rows (key, piece, start, length, ids, sequence_id, offset).

    Null and empty texts are their end id alone; rows that repeat a key are packed each; other columns aren't read. Only the
    pieces' lengths go through the rounds; the ids join their places by a row number, written with them.
    """
    cut = common.stored(pieces(docs, vocabulary, end_id, capacity, key, text).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    found = assigned(cut.select(F.col("_row").alias("id"), "length"), capacity)
    return cut.join(found.withColumnRenamed("id", "_row"), "_row").drop("_row")
