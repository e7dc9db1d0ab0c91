"""Flat id files: samples come back whole, and only their own ranges are read."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlex.operators import batching, idcache
from twinlex.plans import training


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


def test_ranges_are_read_alone():
    data = np.arange(60_000, dtype="<u2")
    starts, sizes = np.array([50_000, 10, 40, 10, 59_999]), np.array([7, 5, 0, 20, 1])
    file = Counted(data.tobytes())
    parts = idcache.read_ranges(file, starts, sizes, gap=100)
    assert [np.frombuffer(p, "<u2").tolist() for p in parts] == [data[s : s + n].tolist() for s, n in zip(starts, sizes, strict=True)]
    assert file.got <= 2 * (7 + 40 + 1) + 100
    assert idcache.read_ranges(file, starts[:0], sizes[:0]) == []


def test_samples_come_back_from_flat_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 65_536, rng.integers(0, 30)).tolist(), None if i % 9 == 0 else rng.integers(0, 99, rng.integers(0, 5)).tolist()) for i in range(300)]
    folder = str(tmp_path / "flat")
    index = idcache.write(spark.createDataFrame(rows, "pair bigint, en_ids array<int>, am_ids array<int>").repartition(4), folder)
    assert index.count() == 300
    size = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".u16"))
    assert size == 2 * sum(len(e) + len(a or []) for _, e, a in rows)
    (tmp_path / "flat" / "left-over.u16").write_bytes(b"1")  # of a task that failed
    asked = spark.createDataFrame([(i,) for i in (5, 9, 17, 200, 999)], "sample bigint")
    found = {r.sample: (r.en_ids, r.am_ids) for r in idcache.fetch(asked, folder).collect()}
    assert found == {i: (rows[i][1], rows[i][2] or []) for i in (5, 9, 17, 200)}
    with pytest.raises(Exception, match="16 bits"):
        idcache.write(spark.createDataFrame([(1, [70_000], [1])], "pair bigint, en_ids array<int>, am_ids array<int>"), str(tmp_path / "bad"))


def test_a_batch_reads_its_own_pairs(spark, tmp_path):
    pairs = spark.range(200).select(F.col("id").alias("pair"), F.array_repeat(F.col("id").cast("int"), 3).alias("en_ids"), F.array(F.lit(1)).alias("am_ids"))
    folder = str(tmp_path / "flat")
    idcache.write(pairs, folder)
    batches = batching.token_budget_batches(batching.directed(pairs, ["en-am", "am-en"], "pair", "en_ids", "am_ids").select("idx", "length"), 60, 1).cache()
    number = batches.agg(F.min("batch_order")).first()[0]
    wanted = {r.idx // 2 for r in batches.filter(F.col("batch_order") == number).collect()}
    found = training.batch_samples(batches, number, folder, 2).collect()
    assert {r.sample for r in found} == wanted and all(r.en_ids == [r.sample] * 3 and r.am_ids == [1] for r in found)
