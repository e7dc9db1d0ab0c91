"""Tables that lie in ranges of an order: dedup decides anew only what a changed shard touches, and unchanged shards aren't shuffled.

The order is a seeded hash of a pair's key, so a range follows from the key. Ranges are Spark's buckets: a range is told by a number
whose bucket it is. So tables of the same ranges join without a shuffle, and files in order of bucket are rows in order.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlex.operators import corpus
from twinlex.plans import files
from twinlex.sources import readers

#: Tables in the same ranges join by range and key, though ranges alone lay them out; scans keep ranges apart; a union of such tables
#: doesn't pass for one that lies in ranges itself, as Spark 4.1 would have it, which leaves equal keys in different tasks.
_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.unionOutputPartitioning": "false"}
_KEYS = ["slot", "key_hash"]
_PAIRS = f"{readers.SHARD_SCHEMA}, order_key string, slot int"
#: Rows that a range should hold.
RANGE_ROWS = 1_000_000


@contextmanager
def settings(spark: SparkSession):
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def slots(spark: SparkSession, n: int) -> list[int]:
    """For each of n ranges a number that Spark puts into the bucket of that place."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")
    rows = spark.range(0, n * (n.bit_length() + 20)).select(at, F.col("id").cast("int").alias("x")).groupBy("at").agg(F.min("x").alias("x"))
    found = {r.at: r.x for r in rows.collect()}
    return [found[i] for i in range(n)]


def slot(order_key: Column, numbers: list[int]) -> Column:
    """The number of the range of a hexadecimal order key: equal shares of all keys, in order."""
    share = F.conv(F.substring(order_key, 1, 8), 16, 10).cast("bigint") * len(numbers)
    return F.get(F.array(*[F.lit(x) for x in numbers]), F.shiftright(share, 32).cast("int"))


class Layout:
    """The state of a corpus's dedup in a folder: each shard's pairs and the best pair of each key, in the same ranges."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.names, self.schemas = spark, folder, [], {}
        mark = f"{folder}/state.json"
        self.state = json.loads(files.read_text(spark, mark)) if files.exists(spark, mark) else None

    def write(self, rows: DataFrame, what: str, n: int) -> str:
        """rows as a table in ranges, under a new name; they are shuffled unless they already lie so."""
        path, name = f"{self.folder}/{what}-{uuid.uuid4().hex}", f"twinlex_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(n, "slot").sortBy("order_key").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.names.append(name)
        self.schemas[path] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return path

    def table(self, path: str, n: int) -> DataFrame:
        """A table of write(), or of the state, whose tables have the columns of pairs."""
        name = f"twinlex_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} ({self.schemas.get(path, _PAIRS)}) using parquet clustered by (slot) sorted by (order_key) into {n} buckets location '{path}'")
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Forget the tables' names; their files stay."""
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        self.names = []

    def decide(self, shards: dict[str, str], seed: int) -> tuple[DataFrame, dict]:
        """The best pair of each key of all shards (path by source, most trusted first), in ranges; and the state to commit().

        A shard counts as changed if its place among the sources or its files aren't those of the state. If all are, or ranges
        would grow too large, everything is decided. Otherwise only the keys of changed shards are, as they were and as they
        are: the pairs of other shards with such keys are found by joins within ranges, and so are those that they replace.
        """
        spark = self.spark
        marks = {s: [i, readers.shard_files(spark, p)] for i, (s, p) in enumerate(shards.items())}
        old = self.state or {"seed": None, "shards": {}, "n": 0}
        # a folder without named files may have changed: it always counts as such
        changed = [s for s, m in marks.items() if old["shards"].get(s, {}).get("mark") != m or m[1] == [shards[s]]]
        gone = [s for s in old["shards"] if s not in shards]
        rows = readers.read_shards(spark, list(shards.values())).count()
        n = old["n"] if 0 < rows <= 4 * RANGE_ROWS * old["n"] else max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
        whole = not self.state or old["seed"] != seed or n != old["n"] or len(changed) == len(shards)
        if whole:
            changed = list(shards)
        numbers = slots(spark, n)
        tables = {s: old["shards"][s]["pairs"] for s in shards if s not in changed}
        for s in changed:
            order = corpus.shuffle_key(F.col("key_hash"), seed)
            pairs = readers.read_shards(spark, [shards[s]]).withColumn("order_key", order).withColumn("slot", slot(F.col("order_key"), numbers).cast("int"))
            tables[s] = self.write(pairs.repartition(n, "slot"), "pairs", n)
        if whole:
            every = self._union([self.table(p, n) for p in tables.values()])
            winners = self.write(corpus.best_of_key(every, _KEYS).repartition(n, "slot"), "best", n)
        elif not changed and not gone:
            winners = old["best"]
        else:
            own = [self.table(tables[s], n) for s in changed]
            before = [self.table(old["shards"][s]["pairs"], n) for s in [*changed, *gone] if s in old["shards"]]
            touched = self.table(self.write(self._union([t.select(*_KEYS, "order_key") for t in [*own, *before]]).distinct().repartition(n, "slot"), "touched", n), n)
            rest = [self.among(self.table(tables[s], n), touched) for s in shards if s not in changed]
            decided = corpus.best_of_key(self._union([*own, *rest]), _KEYS)
            values = [c for c in decided.columns if c not in (*_KEYS, "order_key")]
            changes = touched.join(decided.withColumn("there", F.lit(True)).drop("order_key"), _KEYS, "left")
            laid = self.table(self.write(changes.repartition(n, "slot"), "changes", n), n)
            best = self.replaced(self.table(old["best"], n), laid, values)
            winners = self.write(best.select(*self.table(old["best"], n).columns), "best", n)
        state = {"rows": rows, "seed": seed, "n": n, "best": winners, "shards": {s: {"mark": marks[s], "pairs": tables[s]} for s in shards}, "decided": changed}
        return self.table(winners, n), state

    @staticmethod
    def among(pairs: DataFrame, touched: DataFrame) -> DataFrame:
        return pairs.join(touched.select(*_KEYS), _KEYS, "left_semi")

    @staticmethod
    def replaced(best: DataFrame, changes: DataFrame, values: list[str]) -> DataFrame:
        """best without the keys of changes, and with the rows of changes that are there."""
        a, b = best.alias("a"), changes.withColumn("changed", F.lit(True)).alias("b")
        both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in _KEYS], "full_outer")
        pick = lambda c: F.when(F.col("b.changed"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
        return both.filter("b.changed is null or b.there").select(*[pick(c) for c in (*values, "key_hash", "order_key", "slot")])

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def commit(self, state: dict) -> None:
        """Make this the folder's state, and delete what no state needs any more."""
        self.close()
        files.write_text(self.spark, f"{self.folder}/state.json", json.dumps(state, indent=2))
        needed = {state["best"], *(s["pairs"] for s in state["shards"].values())}
        for path in files.folders(self.spark, self.folder):
            if path.rsplit("/", 1)[-1] not in {p.rsplit("/", 1)[-1] for p in needed}:
                files.delete(self.spark, path)
        self.state = state
