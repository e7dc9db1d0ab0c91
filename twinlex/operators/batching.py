"""From pairs of id arrays to padded batches under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Ids framing a sequence: a tag or begin, and an end.
FRAME = 2
#: Batches that a pool holds, about.
POOL = 100
#: Rows whose lengths one task adds up.
_SPAN = 100_000
LANGUAGES = {"en-am": ("en", "am"), "am-en": ("am", "en")}
PAD, BOS, EOS, UNK, TO_AM, TO_EN = range(6)
TAGS = {"am": TO_AM, "en": TO_EN}


def length_gate(en_ids: Column, am_ids: Column, max_len: int) -> Column:
    """Neither side is empty or longer than max_len with its frame."""
    return F.size(en_ids).between(1, max_len - FRAME) & F.size(am_ids).between(1, max_len - FRAME)


def gate_counts(pairs: DataFrame, max_len: int, en: str = "en", am: str = "am") -> DataFrame:
    """One row (read, dropped, kept)."""
    ok = length_gate(F.col(en), F.col(am), max_len)
    return pairs.agg(F.count("*").alias("read"), F.count_if(~ok).alias("dropped"), F.count_if(ok).alias("kept"))


def framed(source: Column, target: Column, tag: Column) -> tuple[Column, Column, Column]:
    """src, tgt_in and tgt_out of a sample."""
    one = lambda i: F.array(F.lit(i))
    return F.concat(F.array(tag), source, one(EOS)), F.concat(one(BOS), target), F.concat(target, one(EOS))


def directed(pairs: DataFrame, directions: list[str], pair: str = "pair", en: str = "en", am: str = "am") -> DataFrame:
    """Rows (idx, pair, direction, src, tgt_in, tgt_out, length): a sample for each pair and direction, idx = pair * directions + place of the direction."""
    sides = {"en": F.col(en), "am": F.col(am)}
    samples = []
    for d, direction in enumerate(directions):
        source, target = LANGUAGES[direction]
        src, tgt_in, tgt_out = framed(sides[source], sides[target], F.lit(TAGS[target]))
        samples.append(F.struct((F.col(pair) * len(directions) + d).alias("idx"), F.lit(direction).alias("direction"), src.alias("src"), tgt_in.alias("tgt_in"), tgt_out.alias("tgt_out")))
    length = (F.greatest(F.size(en), F.size(am)) + FRAME).cast("bigint")
    return pairs.select(F.col(pair), length.alias("length"), F.explode(F.array(*samples)).alias("s")).select("s.idx", pair, "s.direction", "s.src", "s.tgt_in", "s.tgt_out", "length")


def padded(ids: Column, size: Column, pad: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0)).cast("int")))


def collate(samples: DataFrame, batch: str = "batch", columns: tuple[str, ...] = ("src", "tgt_in", "tgt_out")) -> DataFrame:
    """Each of the columns right-padded to the longest of its batch."""
    longest = {f"_{c}": F.max(F.size(c)).over(Window.partitionBy(batch)) for c in columns}
    return samples.withColumns(longest).withColumns({c: padded(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*longest)


def truncated_source(ids: Column, tag: int, max_len: int) -> Column:
    return F.concat(F.array(F.lit(tag)), F.slice(ids, 1, max_len - FRAME), F.array(F.lit(EOS)))


def pack(lengths: np.ndarray, budget: int) -> np.ndarray:
    """Batch numbers of samples in ascending order of length: a batch closes when its next sample, padded throughout, breaks the budget."""
    out, batch, size = np.empty(len(lengths), np.int64), 0, 0
    for i, length in enumerate(lengths.tolist()):
        if size and length * (size + 1) > budget:
            batch, size = batch + 1, 0
        out[i], size = batch, size + 1
    return out


def token_budget_batches(samples: DataFrame, budget: int, seed: int, epoch: int = 0, idx: str = "idx", length: str = "length") -> DataFrame:
    """Rows (batch_order, idx, length): every sample once, in batches whose samples times their longest length stay in the budget.

    Samples are dealt to pools of about a hundred batches by a seeded hash, sorted by length within a pool, and packed pool by
    pool; batches then follow in a seeded order. Only sums reach the driver. The same seed and epoch give the same batches.
    """
    n, total, longest = samples.agg(F.count("*"), F.sum(length), F.max(length)).first()
    if n and longest > budget:
        raise ValueError(f"a sample of length {longest} exceeds the budget of {budget}")
    mean = max(int(total / n), 1) if n else 1
    n_pools = max(1, -(-(n or 0) // max(budget // mean * POOL, 1)))
    salt = f"{seed}:{epoch}"
    mixed = samples.select(F.col(idx).alias("idx"), F.col(length).alias("length"), F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col(idx))), 1, 15), 16, 10).cast("bigint").alias("mix"))
    pooled = mixed.withColumn("pool", F.pmod("mix", F.lit(n_pools)))

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["length", "mix", "idx"], kind="stable")
        return pool.assign(batch=pack(pool["length"].to_numpy(), budget))[["pool", "batch", "idx", "length"]]

    packed = pooled.groupBy("pool").applyInPandas(run, "pool bigint, batch bigint, idx bigint, length bigint")
    return packed.select(F.md5(F.concat_ws(":", F.lit(salt), "pool", "batch")).alias("batch_order"), "idx", "length")


def resumed(batches: DataFrame, done: int) -> DataFrame:
    """What is left after the first `done` batches of the order."""
    order = batches.select("batch_order").distinct()
    first = order.orderBy("batch_order").limit(done)
    return batches.join(first, "batch_order", "left_anti")


def offsets(lengths: DataFrame, order: str, length: str) -> DataFrame:
    """Running start of each array in a flat concatenation, in the order of different whole numbers.

    Two levels, so that no task sees all rows: an order's range is parted into spans of equal width, about _SPAN rows each if the
    numbers lie evenly; a row's span follows from its number alone, whatever the layout of the data.
    """
    n, low, high = lengths.agg(F.count("*"), F.min(order), F.max(order)).first()
    width = max(1, (high - low + 1) * _SPAN // n) if n else 1
    ranged = lengths.withColumn("_part", F.floor((F.col(order) - F.lit(low or 0)) / width))
    inside = F.coalesce(F.sum(length).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy("_part").agg(F.sum(length).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.withColumn("_inside", inside).join(before, "_part").withColumn("offset", (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_part", "_inside", "_before")


def length_sorted(rows: DataFrame, length: Column, batch_rows: int) -> DataFrame:
    """rows with batch: `batch_rows` at a time in order of length (whole numbers; null first), equal lengths by a hash of the row.

    A row's batch follows from the rows alone, whatever their layout, so that a plan evaluated twice finds the same batches. Rows
    are counted by length, frequent lengths in several slots; a row's place is its slot's start and its rank there.
    """
    hashed = [F.col(f.name) for f in rows.schema if not _holds_map(f.dataType)]
    found = rows.withColumns({"_length": F.coalesce(length, F.lit(-1)).cast("bigint"), "_mix": F.xxhash64(*hashed)})
    most = found.groupBy("_length").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    slots = max(1, -(-most // _SPAN))
    found = found.withColumn("_slot", F.col("_length") * slots + F.pmod("_mix", F.lit(slots)))
    starts = offsets(found.groupBy("_slot").agg(F.count("*").alias("_n")), "_slot", "_n").select("_slot", F.col("offset").alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_slot").orderBy("_mix")) - 1
    placed = found.withColumn("_nth", nth).join(starts, "_slot")
    return placed.withColumn("batch", F.floor((F.col("_start") + F.col("_nth")) / batch_rows)).select(*rows.columns, "batch")


def _holds_map(kind: DataType) -> bool:
    return '"map"' in kind.json()


def as_iterator(batches: DataFrame) -> Iterator[list[int]]:
    """Batches one by one, in order."""
    for row in batches.groupBy("batch_order").agg(F.sort_array(F.collect_list("idx")).alias("ids")).orderBy("batch_order").toLocalIterator():
        yield row.ids
