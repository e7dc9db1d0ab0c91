"""A stream's running best against the batch one, whatever order lines arrive in."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from twinlex.streaming import feeds

SCHEMA = "run string, step bigint, value double, time timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_and_batch_agree_for_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    rows = [(run, s, None if rng.random() < 0.1 else rng.uniform(1, 9) - s / 20, start + timedelta(seconds=20 * s)) for run in ("a", "b") for s in range(40)]
    order = sorted(rows, key=lambda r: r[3] + timedelta(seconds=rng.uniform(0, 500)))  # nothing is later than ten minutes
    end = start + timedelta(days=1)
    for i, part in enumerate([order[:25], order[25:50], order[50:], [("a", 999, 0.0, end)], [("b", 3, -50.0, start)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    found = feeds.best_so_far(stream)
    name = f"best_{seed}"
    run = found.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.run, r.step): (r.value, r.best) for r in spark.table(name).collect()}
    batch = feeds.running_min(spark.createDataFrame(rows, SCHEMA), "step", "value", "run")
    assert got == {(r.run, r.step): (r.value, r.best) for r in batch.collect()}
    assert spark.table(name).count() == 80 and spark.table(name).filter(F.col("best") < -40).count() == 0
