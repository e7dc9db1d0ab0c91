"""Corpus build: sources to shards, to one deduplicated, shuffled corpus with a hold-out, held-out splits and a data card."""

from __future__ import annotations

import json
import time
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlex.functions.normalize import key_hash, normalize
from twinlex.operators import corpus, layout
from twinlex.plans import files
from twinlex.plans.config import Config, DataConfig, SourceConfig
from twinlex.sources import readers, sink


#: Rows of a held-out split in a file; files follow one another in order of line.
HELD_OUT_ROWS = 2000


def normalized(rows: DataFrame, cfg: DataConfig, en: str = "en", am: str = "am") -> DataFrame:
    rule, app = cfg.normalize, rows.sparkSession.sparkContext.applicationId
    return rows.withColumns({"en": _side(app, en, "en", True, True), "am": _side(app, am, "am", rule.fold_homophones, rule.numerals_to_digits)})


@lru_cache(maxsize=64)
def _side(app: str, column: str, lang: str, fold: bool, digits: bool):
    """The long expression of one side, made once for each column and rule in an application."""
    return normalize(F.col(column), lang, fold, digits)


def write_held_out(spark: SparkSession, cfg: DataConfig, raw_dir, out_dir) -> tuple[dict[str, int], DataFrame]:
    """Held-out splits as Parquet (normalized and raw); sizes by name, and the keys that training pairs must not have."""
    sizes, keys = {}, None
    for split, name in readers.HELD_OUT_FILES.items():
        raw = readers.read_held_out(spark, cfg.flores, raw_dir, split)
        path = f"{out_dir}/{name}.parquet"
        # dealt out by line number before they are normalized: a file of lines is read by one task
        spread = raw.repartitionByRange(max(1, -(-raw.count() // HELD_OUT_ROWS)), "line_no").sortWithinPartitions("line_no")
        normalized(spread, cfg, "en_raw", "am_raw").select("en", "am", "en_raw", "am_raw").write.mode("overwrite").parquet(path)
        saved = spark.read.parquet(path)
        sizes[name] = saved.count()
        own = corpus.held_out_keys(saved, "en", "am", "en_raw", "am_raw")
        keys = own if keys is None else keys.unionByName(own).distinct()
    return sizes, keys


def judged(rows: DataFrame, cfg: DataConfig, keys: DataFrame, work: str | None = None) -> DataFrame:
    """Raw pairs with their normalized sides and the reason they go, if they do. work: a folder, where held-out keys are many."""
    return corpus.with_reasons(normalized(rows, cfg), cfg.filters, keys, work)


def write_shard(spark: SparkSession, src: SourceConfig, priority: int, cfg: DataConfig, raw_dir, shard: str, keys: DataFrame) -> dict:
    """One source's kept pairs as Parquet, with counts by reason, in one pass; the shard's statistics are its marker.

    Both appear at the commit of the sink: until then an older shard stays as it is. Rejected pairs reach the sink without texts.
    """
    from twinlex.functions.filters import HELD_OUT, REASONS

    began = time.time()
    work = f"{shard}.judged" if keys.count() > corpus.MANY_KEYS else None
    rows = judged(readers.read_source(spark, src, raw_dir), cfg, keys, work)
    kept = lambda c: F.when(F.col("reason").isNull(), c)
    columns = {"en": F.col("en"), "am": F.col("am"), "source": F.lit(src.name), "score": F.col("score"), "priority": F.lit(priority).cast("smallint"), "key_hash": key_hash(F.col("key_en"), F.col("key_am"))}
    sink.write_rows(rows.select(*[kept(c).alias(n) for n, c in columns.items()], "reason"), f"{shard}.parquet", marker=f"{shard}.stats.json", about=json.dumps({"name": src.name}), began=began)
    if work:
        files.delete(spark, work)
    stats = shard_stats(spark, shard)
    return stats | {"rejected": {r: stats["rejected"][r] for r in (*REASONS, HELD_OUT) if r in stats["rejected"]}}


def shard_stats(spark: SparkSession, shard: str) -> dict:
    """What a complete shard's marker says of its source."""
    stats = json.loads(files.read_text(spark, f"{shard}.stats.json"))
    return {k: v for k, v in stats.items() if k != "files"}


def dedup_and_split(spark: SparkSession, shards: dict[str, str], out_dir, holdout: int, seed: int) -> dict:
    """Best pair of each key, in a seeded order, parted into train and hold-out; returns the card's section on dedup.

    The best pairs lie in ranges of that order, so that train is written range by range without a shuffle, and after a change
    of one shard only its keys are decided anew: see Layout.
    """
    laid = layout.Layout(spark, f"{out_dir}/_state")
    with layout.settings(spark):
        pairs, state = laid.decide(shards, seed)
        before = state["rows"]
        by_source = {r.source: r.n for r in pairs.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()}
        after = sum(by_source.values())
        quantiles = {r.source: {k: r[k] for k in corpus.QUANTILES} for r in corpus.score_quantiles(pairs, "source", "score").orderBy("source").collect()}
        size = corpus.holdout_size(after, holdout)
        train, held = corpus.split_holdout(pairs, "order_key", size)
        # without the column of ranges a scan wouldn't keep to them
        for name, part in (("train", train), ("train_holdout", held.repartitionByRange("order_key"))):
            sink.write_rows(part.sortWithinPartitions("order_key", "slot").select("en", "am", "source", "score"), f"{out_dir}/{name}.parquet")
        laid.commit(state)
    return {"before": before, "after": after, "removed": before - after, "by_source": by_source, "score_quantiles": quantiles, "train": after - size, "train_holdout": size}


def build(spark: SparkSession, cfg: Config, rebuild: set[str] | None = None) -> dict:
    """Build the corpus under paths.data_processed and return its data card.

    Shards that are complete are used again, unless named in rebuild ('all' names every one). Only shards of the configured
    sources enter the corpus; those of sources no longer configured are left alone.
    """
    if cfg.data is None:
        raise ValueError("config has no `data` section")
    data, rebuild = cfg.data, rebuild or set()
    if unknown := sorted(rebuild - {s.name for s in data.sources} - {"all"}):
        raise ValueError(f"rebuild names unknown sources: {unknown}")
    raw_dir, out_dir = cfg.paths.resolve("data_raw"), cfg.paths.resolve("data_processed")
    began = time.perf_counter()
    sizes, keys = write_held_out(spark, data, raw_dir, out_dir)
    stats, shards = [], {}
    for priority, src in enumerate(data.sources):
        shard = f"{out_dir}/shards/{src.name}"
        shards[src.name] = f"{shard}.parquet"
        done = files.exists(spark, f"{shard}.stats.json") and files.exists(spark, f"{shard}.parquet")
        if done and not rebuild & {"all", src.name}:
            stats.append(shard_stats(spark, shard))
        else:
            stats.append(write_shard(spark, src, priority, data, raw_dir, shard, keys))
    dedup = dedup_and_split(spark, shards, out_dir, data.holdout_size, cfg.project.seed)
    card = {
        "project": cfg.project.name,
        "built_at": time.strftime("%Y-%m-%dT%H:%M:%S"),
        "seconds": round(time.perf_counter() - began, 1),
        "sources": stats,
        "dedup": dedup,
        "splits": {"train": dedup["train"], "train_holdout": dedup["train_holdout"], **sizes},
        "config": data.model_dump(mode="json"),
    }
    files.write_text(spark, f"{out_dir}/data_card.json", json.dumps(card, indent=2, ensure_ascii=False))
    return card
