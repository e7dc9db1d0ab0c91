"""Streams: pairs that arrive as files, and the append-only log of a training run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from twinlex.plans.build import judged
from twinlex.plans.config import DataConfig
from twinlex.sources.readers import SHARD_SCHEMA

LOG_SCHEMA = "step bigint, time double, event string, loss double, nll double, n bigint, tokens bigint"


def arriving_pairs(spark: SparkSession, folder: str, schema: str = "line_no bigint, en string, am string, score float") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def clean_stream(pairs: DataFrame, cfg: DataConfig, keys: DataFrame, out: str, checkpoint: str):
    """Normalize, filter and append what arrives, each file once. The held-out keys are a static side of the joins."""

    def append(batch: DataFrame, number: int) -> None:
        judged(batch, cfg, keys).filter("reason is null").select("en", "am", "score").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pairs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Running pairs by source over a folder of shards."""
    return spark.readStream.schema(SHARD_SCHEMA).parquet(folder).groupBy("source").agg(F.count("*").alias("n"))


def first_of_key(pairs: DataFrame, key: str = "key_hash", time: str = "arrived", late: str = "1 day") -> DataFrame:
    """Stream dedup: the first pair of a key within the watermark. Trust and score can't be waited for in a stream; see corpus.best_of_key."""
    return pairs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def log_means(log: DataFrame, every: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, window, loss, tokens_per_second) of train events: means over windows of `every` steps, of each run if `by` tells runs apart."""
    train = log.filter("event = 'train'").withColumn("window", F.floor((F.col("step") - 1) / every))
    took = F.max("time") - F.min("time")
    return train.groupBy(*by, "window").agg(F.avg("loss").alias("loss"), F.when(took > 0, F.sum("tokens") / took).alias("tokens_per_second"))


def eval_loss(log: DataFrame) -> DataFrame:
    """Rows (step, nll, ppl, best): token-weighted hold-out loss of each evaluation, and the lowest so far."""
    per = log.filter("event = 'eval'").groupBy("step").agg((F.sum("nll") / F.greatest(F.sum("n"), F.lit(1))).alias("nll"))
    return running_min(per, "step", "nll").select("step", "nll", F.exp("nll").alias("ppl"), "best")


def running_min(rows: DataFrame, order: str, value: str, by: str | None = None, span: int = 10_000) -> DataFrame:
    """rows with best, the least value up to a row's place by the whole number `order`, in its group if there is one.

    Places are parted into spans: the least value of each, the least of all spans before, then the least within. No task sees
    more than a span of a group, and one number a span.
    """
    span_of = F.floor(F.col(order) / span)
    group = [by] if by else [F.lit(0)]
    least = rows.groupBy(*([by] if by else []), span_of.alias("_span")).agg(F.min(value).alias("_least"))
    before = F.min("_least").over(Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    starts = least.select(*([F.col(by).alias("_by")] if by else []), F.col("_span").alias("_at"), before.alias("_before"))
    same = (F.col("_span") == F.col("_at")) & (F.col(by).eqNullSafe(F.col("_by")) if by else F.lit(True))
    inside = Window.partitionBy(*([by] if by else []), "_span").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn("_span", span_of).join(starts, same)
    return joined.withColumn("best", F.least(F.min(value).over(inside), F.col("_before"))).select(*rows.columns, "best")


def append_log(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)




#: Waiting lines are flat buffers: as arrays each of their numbers would be a Python object at every trigger.
_WAITING = "best double, steps binary, times binary, values binary"
#: Rows of a frame that leaves a state; what stands for a step that is null.
_FRAME, _NO_STEP = 100_000, np.iinfo(np.int64).min


def best_so_far(log: DataFrame, run: str = "run", step: str = "step", value: str = "value", time: str = "time", late: str = "10 minutes") -> DataFrame:
    """Rows (run, step, value, best) of an arriving log, in which later steps of a run have later times: as running_min, run by run.

    A line waits in its run's state until the watermark has passed its time: then no earlier one can come, and it leaves with the
    best value so far. Lines may arrive in any order within the watermark; later ones are dropped, as the watermark has it. Lines
    without a time are left out. A null or NaN value leaves the best as it is; of a run whose values were all null so far it is null.
    """
    rows = log.select(F.col(run).cast("string").alias("run"), F.col(step).cast("bigint").alias("step"), F.col(value).cast("double").alias("value"), F.col(time).alias("time")).filter("time is not null").withWatermark("time", late)

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, *held = state.get if state.exists else (None, b"", b"", b"")
        found = [[np.frombuffer(h, kind) for h, kind in zip(held, (np.int64, np.int64, np.float64), strict=True)]]
        for frame in frames:
            at = (frame["time"].astype("datetime64[us]").astype("int64") // 1000).to_numpy()
            n = frame["step"].fillna(_NO_STEP).astype("int64").to_numpy()
            found.append([n, at, frame["value"].astype("float64").to_numpy()])
        steps, times, values = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.lexsort((times, steps))
        steps, times, values = steps[order], times[order], values[order]
        reached = state.getCurrentWatermarkMs()
        due = times <= reached
        bests = np.fmin.accumulate(np.concatenate([[np.nan if best is None else best], values[due]]))
        left = [part[~due] for part in (steps, times, values)]
        state.update((None if np.isnan(bests[-1]) else float(bests[-1]), *(bytearray(part.tobytes()) for part in left)))
        if len(left[1]):
            state.setTimeoutTimestamp(max(int(left[1].min()), reached + 1))
        steps, values, bests = steps[due], values[due], bests[1:]
        for i in range(0, max(len(steps), 1), _FRAME):
            part = slice(i, i + _FRAME)
            numbers = pd.Series(steps[part], dtype="Int64").mask(steps[part] == _NO_STEP)
            yield pd.DataFrame({"run": pd.Series([key[0]] * len(numbers), dtype=object), "step": numbers, "value": values[part], "best": bests[part]})

    return rows.groupBy("run").applyInPandasWithState(settle, "run string, step bigint, value double, best double", _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
