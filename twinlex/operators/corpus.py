"""Leak exclusion, dedup by trust and score, splits, and statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlex.functions.filters import HELD_OUT, reject_reason
from twinlex.functions.normalize import dedup_key
from twinlex.plans.config import FilterConfig, SubsetConfig

#: Buckets that a group's values are parted into for exact quantiles.
_PARTS = 64
QUANTILES = {"min": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0}


def held_out_keys(texts: DataFrame, *columns: str) -> DataFrame:
    """Rows (key): the different dedup keys of all columns, without the empty one."""
    keys = texts.select(F.explode(F.array(*[dedup_key(F.col(c)) for c in columns])).alias("key"))
    return keys.filter("key is not null and key <> ''").distinct()


def with_reasons(pairs: DataFrame, cfg: FilterConfig, keys: DataFrame | None = None, work: str | None = None) -> DataFrame:
    """pairs with key_en, key_am and reason: the first rule that rejects a pair, then the held-out rule, or null.

    Each side is matched with the held-out keys by an existence join, which Spark broadcasts if the keys are few. With a folder
    `work` keys may be many: see leaks_marked, which writes the judged pairs there.
    """
    out = pairs.withColumns({"key_en": dedup_key(F.col("en")), "key_am": dedup_key(F.col("am")), "reason": reject_reason(F.col("en"), F.col("am"), cfg)})
    if keys is None:
        return out
    out = leaks_marked(out, keys, work) if work else _joined(out, keys)
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("_leak"), HELD_OUT))).drop("_leak")


def _joined(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    for side in ("en", "am"):
        pairs = pairs.join(keys.select(F.col("key").alias(f"key_{side}"), F.lit(True).alias(f"_leak_{side}")), f"key_{side}", "left")
    return pairs.withColumn("_leak", F.coalesce("_leak_en", "_leak_am", F.lit(False))).drop("_leak_en", "_leak_am")


def key_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """A Bloom filter of keys in blocks of 4,096 bits: rows (block, words array<bigint>), and how many blocks there may be.

    Bits are set by an aggregate that merges partial results. Blocks, about 12 bits a key, are bounded, so that the filter can be
    broadcast whatever the number of keys; beyond the bound it lets more keys through, and never fewer.
    """
    blocks = int(min(max(1, -(-keys.count() * 12 // 4096)), _BLOCKS))
    spots = keys.select(_block(F.col("key"), blocks).alias("block"), F.explode(_spots(F.col("key"))).alias("spot"))
    word = F.shiftright("spot", 6)
    bits = spots.groupBy("block", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("spot").bitwiseAND(F.lit(63)))).alias("bits"))
    held = bits.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    none = F.lit(0).cast("bigint")
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.try_element_at("set", w), none)).alias("words")), blocks


#: Blocks of a filter of keys at most: 32 MB.
_BLOCKS = 1 << 16
#: Held-out keys from which on pairs are filtered before they are joined.
MANY_KEYS = 200_000


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _spots(key: Column) -> Column:
    """Four bits of a block, 12 bits of a second hash each."""
    h = F.xxhash64(key, F.lit(1))
    return F.array(*[F.shiftrightunsigned(h, 12 * i).bitwiseAND(F.lit(4095)).cast("int") for i in range(4)])


def possible(rows: DataFrame, keys: tuple[DataFrame, int], *columns: str) -> DataFrame:
    """rows with _maybe: whether one of the columns passes a key_filter. Each column is looked up in the broadcast blocks; nothing is shuffled."""
    blocks, n = keys

    def passes(column: str, words: str) -> Column:
        hit = lambda s: F.getbit(F.get(F.col(words), F.shiftright(s, 6)), s.bitwiseAND(F.lit(63))) == 1
        return F.coalesce(F.forall(_spots(F.col(column)), hit), F.lit(False))

    out, tests = rows, []
    for c in columns:
        out = out.withColumn(f"_block_{c}", _block(F.col(c), n)).join(F.broadcast(blocks.select(F.col("block").alias(f"_block_{c}"), F.col("words").alias(f"_words_{c}"))), f"_block_{c}", "left")
        tests.append(passes(c, f"_words_{c}"))
    maybe = tests[0]
    for t in tests[1:]:
        maybe = maybe | t
    return out.select(*rows.columns, maybe.alias("_maybe"))


def leaks_marked(pairs: DataFrame, keys: DataFrame, work: str) -> DataFrame:
    """pairs with _leak, for more keys than a broadcast takes: a filter of the keys lets only possible leaks into the exact joins.

    Pairs are written once to the folder `work`, parted by what the filter says; those that can't be leaks aren't shuffled at all.
    """
    rows = possible(pairs, key_filter(keys), "key_en", "key_am")
    rows.write.mode("overwrite").partitionBy("_maybe").parquet(work)
    saved = pairs.sparkSession.read.schema(rows.schema).parquet(work)
    sure = saved.filter("not _maybe").drop("_maybe").withColumn("_leak", F.lit(False))
    return sure.unionByName(_joined(saved.filter("_maybe").drop("_maybe"), keys).select(*pairs.columns, "_leak"))


def reason_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows (by, reason, n); kept rows have the reason 'kept'."""
    return rows.groupBy(*by, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def source_stats(rows: DataFrame, source: str = "source") -> DataFrame:
    """Rows (source, read, kept, rejected map<string, bigint>)."""
    counts = reason_counts(rows, source)
    out = F.col("reason") != "kept"
    return counts.groupBy(source).agg(
        F.sum("n").alias("read"),
        F.sum(F.when(out, 0).otherwise(F.col("n"))).alias("kept"),
        F.map_from_entries(F.array_compact(F.collect_list(F.when(out, F.struct("reason", "n"))))).alias("rejected"),
    )


def best_of_key(rows: DataFrame, key: str | list[str], priority: str = "priority", score: str = "score", ties: tuple[str, ...] = ("en", "am")) -> DataFrame:
    """One row of each key: the most trusted source's, of these the best-scored (nulls last), of these the first by `ties`.

    Written as a rank limited to one, so that map tasks already drop all but one row of a key before the shuffle.
    """
    best = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.col(priority).asc_nulls_last(), F.col(score).desc_nulls_last(), *ties)
    return rows.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def shuffle_key(key: Column, seed: int) -> Column:
    """A seeded order: the same in every run, for every layout of the data."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def holdout_size(n: int, wanted: int) -> int:
    return min(wanted, n // 10)


def split_holdout(rows: DataFrame, order: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(train, holdout): the hold-out is the first `size` rows by the unique column `order`, found as a top-k without a global sort."""
    first = rows.orderBy(order).limit(size)
    last = first.agg(F.max(order)).first()[0] if size else None
    return (rows.filter(F.col(order) > last), rows.filter(F.col(order) <= last)) if last is not None else (rows, rows.limit(0))


def score_quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rows (by, min, p10 ... max): exact interpolated quantiles of non-null values, four digits.

    Approximate quantiles cut each group's range into _PARTS buckets. From their counts follows which buckets hold the values asked
    for; only these are ranked, each in a task of its own, so that no task holds or sorts a whole group.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    cuts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_of")).agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / _PARTS) for i in range(1, _PARTS)]), 10 * _PARTS).alias("cuts"))
    bucket = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    placed = counted.join(cuts, F.col("_by").eqNullSafe(F.col("_of"))).select("_by", "x", "n", bucket.alias("bucket"))
    sizes = placed.groupBy("_by", "bucket").agg(F.sum("n").alias("size"))
    group = Window.partitionBy("_by")
    before = F.coalesce(F.sum("size").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = sizes.withColumns({"before": before, "whole": F.sum("size").over(group)})
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("whole") - 1) * q), F.ceil((F.col("whole") - 1) * q)) for q in QUANTILES.values()])))
    asked = whole.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))).filter(F.size("ranks") > 0)
    inside = Window.partitionBy("_by", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = placed.join(asked.select(F.col("_by").alias("_of"), F.col("bucket").alias("_in"), "before", "whole", "ranks"), F.col("_by").eqNullSafe(F.col("_of")) & (F.col("bucket") == F.col("_in")))
    last = F.col("before") + F.sum("n").over(inside)
    hit = near.withColumn("last", last).select("_by", "whole", "x", F.explode(F.filter("ranks", lambda r: (r < F.col("last")) & (r >= F.col("last") - F.col("n")))).alias("rank"))
    found = hit.groupBy("_by", "whole").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def quantile(q: float) -> Column:
        place = (F.col("whole") - 1) * F.lit(q)
        low, high = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)]
        return F.round(low + (high - low) * (place - F.floor(place)), 4)

    return found.select(F.col("_by").alias(by), *[quantile(q).alias(name) for name, q in QUANTILES.items()])


def subset(cfg: SubsetConfig) -> Column:
    """Rows of the subset. A floor is compared as float, as scores are; a null score fails its source's floor."""
    test = F.lit(True) if cfg.sources is None else F.col("source").isin(cfg.sources)
    for source, floor in cfg.min_score.items():
        test = test & ((F.col("source") != source) | (F.col("score") >= F.lit(float(floor)).cast("float")))
    return test


def subset_sql(cfg: SubsetConfig) -> str:
    """The same as text, for reports."""
    parts = []
    if cfg.sources is not None:
        parts.append("source IN (" + ", ".join(f"'{s}'" for s in cfg.sources) + ")")
    parts += [f"(source <> '{s}' OR score >= {float(floor)})" for s, floor in cfg.min_score.items()]
    return " AND ".join(parts) or "TRUE"


def seeded_sample(rows: DataFrame, columns: list[str], n: int | None, seed: int, by: str | None = None) -> DataFrame:
    """n rows (by, columns), of each group if there is one, all if there are fewer, or n is None: first in an order that depends on
    their columns and the seed alone.

    Equal rows are numbered, and each is drawn by itself. They are counted first, so that many copies cost one row in the shuffle.
    """
    group = [by] if by else []
    if n is None:
        return rows.select(*group, *columns)
    counted = rows.groupBy(*group, *columns).agg(F.count("*").alias("_n")).select(*group, *columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_nth"))
    order = [F.md5(F.concat_ws(chr(0), *[_text(c) for c in columns], F.col("_nth").cast("string"), F.lit(str(seed)))), *columns, "_nth"]
    if by:  # a rank limited to n, of which Spark takes each task's first n before the shuffle
        ranked = counted.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
        return ranked.filter(F.col("_at") <= n).select(by, *columns)
    return counted.orderBy(*order).limit(n).drop("_nth")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def capped(rows: DataFrame, columns: list[str], n: int | None, seed: int) -> DataFrame:
    """The first n rows in an order by a hash of columns and seed; equal rows stand together. None: all, 0: none."""
    if n is None:
        return rows
    return rows.orderBy(F.md5(F.concat(*[_text(c) for c in columns], F.lit(str(seed)))), *columns).limit(n)


def peek(rows: DataFrame, by: str, order: Column, n: int = 3) -> DataFrame:
    """n rows of each group, first in order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("nth") <= n)
