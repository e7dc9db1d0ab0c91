"""From a built corpus to a vocabulary, a token cache and batches; scores of translations and their report."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlex.operators import batching, corpus, idcache, metrics, vocabulary
from twinlex.operators.vocabulary import Vocabulary
from twinlex.plans import files
from twinlex.plans.config import Config, TrainingConfig


def train_vocabulary(spark: SparkSession, cfg: Config) -> dict:
    """Sample each language of the subset on its own, learn a joint vocabulary, save it with statistics on the hold-out."""
    if cfg.tokenizer is None:
        raise ValueError("config has no `tokenizer` section")
    part, began = cfg.tokenizer, time.perf_counter()
    data, out = cfg.paths.resolve("data_processed"), f"{cfg.paths.resolve('artifacts')}/tokenizer"
    rows = spark.read.parquet(f"{data}/train.parquet").filter(corpus.subset(part.subset))
    texts = [corpus.seeded_sample(rows.select(F.col(c).alias("text")), ["text"], part.sample_per_lang, cfg.project.seed) for c in ("en", "am")]
    both = texts[0].unionAll(texts[1])
    learnt = vocabulary.train(both, "text", part.vocab_size, part.min_frequency)
    files.write_text(spark, f"{out}/vocabulary.json", learnt.to_json())
    stats = {
        **vocabulary_stats(spark.read.parquet(f"{data}/train_holdout.parquet"), learnt),
        "trained_on_sentences": both.count(),
        "subset_where": corpus.subset_sql(part.subset),
        "seconds": round(time.perf_counter() - began, 1),
        "path": f"{out}/vocabulary.json",
    }
    files.write_text(spark, f"{out}/stats.json", json.dumps(stats, indent=2))
    return stats


def vocabulary_stats(holdout: DataFrame, learnt: Vocabulary) -> dict:
    spark = holdout.sparkSession
    found, exact = {}, []
    for lang in ("en", "am"):
        rows = holdout.select(F.col(lang).alias("text")).withColumn("ids", vocabulary.encoded(F.col("text"), learnt, spark))
        found[lang] = vocabulary.column_stats(rows, "text", "ids").first().asDict()
        exact.append(rows.agg(F.count_if(vocabulary.decoded(F.col("ids"), learnt, spark) == F.col("text")), F.count("*")).first())
    en = found["en"]["tokens_per_sentence"]
    return {"vocab_size": len(learnt.tokens), **found, "am_en_length_ratio": round(found["am"]["tokens_per_sentence"] / en, 3) if en else None, "roundtrip_exact": sum(e[0] for e in exact) / max(sum(e[1] for e in exact), 1)}


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    return Vocabulary.from_json(files.read_text(spark, path))


def cache_key(inputs: dict) -> str:
    """A short name for a set of inputs."""
    return hashlib.blake2b(json.dumps(inputs, sort_keys=True, default=str).encode(), digest_size=6).hexdigest()


def tokenized(pairs: DataFrame, learnt: Vocabulary, cfg: TrainingConfig, seed: int) -> DataFrame:
    """Rows (en_ids, am_ids) of the capped subset, before the length gate."""
    if len(learnt.tokens) > 1 << 16:
        raise ValueError("a vocabulary of more than 65,536 tokens doesn't fit the cache")
    rows = corpus.capped(pairs.filter(corpus.subset(cfg.subset)), ["en", "am"], cfg.max_pairs, seed)
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(learnt)
    return rows.select(*[vocabulary.encoded(F.col(c), learnt, spark, shared).alias(f"{c}_ids") for c in ("en", "am")])


def token_cache(spark: SparkSession, cfg: Config, learnt: Vocabulary) -> tuple[DataFrame, dict]:
    """Rows (pair, en_ids, am_ids) and counts, written once for each set of inputs and read back after."""
    part = cfg.training
    source = f"{cfg.paths.resolve('data_processed')}/train.parquet"
    inputs = {"source": source, "vocabulary": hashlib.sha256(learnt.to_json().encode()).hexdigest(), "where": corpus.subset_sql(part.subset), "max_len": part.max_len, "max_pairs": part.max_pairs, "seed": cfg.project.seed}
    path = f"{cfg.paths.resolve('artifacts')}/cache/{cache_key(inputs)}"
    if not files.exists(spark, f"{path}.stats.json"):
        raw = tokenized(spark.read.parquet(source), learnt, part, cfg.project.seed)
        raw.write.mode("overwrite").parquet(f"{path}.raw")
        rows = spark.read.parquet(f"{path}.raw")
        counts = batching.gate_counts(rows, part.max_len, "en_ids", "am_ids").first().asDict()
        kept = rows.filter(batching.length_gate(F.col("en_ids"), F.col("am_ids"), part.max_len))
        kept.withColumn("pair", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}.parquet")
        files.delete(spark, f"{path}.raw")
        files.write_text(spark, f"{path}.stats.json", json.dumps(counts))
    return spark.read.parquet(f"{path}.parquet"), json.loads(files.read_text(spark, f"{path}.stats.json"))


def flat_cache(spark: SparkSession, cfg: Config, learnt: Vocabulary) -> str:
    """The folder of the token cache as flat files, from which idcache.fetch reads single samples; written once for each set of inputs."""
    rows, _ = token_cache(spark, cfg, learnt)
    folder = f"{rows.inputFiles()[0].rsplit('/', 1)[0].removesuffix('.parquet')}.flat"
    if not files.exists(spark, f"{folder}/index/_SUCCESS"):
        idcache.write(rows, folder)
    return folder


def batch_samples(batches: DataFrame, number: str, folder: str, directions: int) -> DataFrame:
    """Rows (sample, en_ids, am_ids) of the pairs of one batch of an epoch; nothing else of the cache is read."""
    pairs = batches.filter(F.col("batch_order") == number).select(F.floor(F.col("idx") / directions).alias("sample")).distinct()
    return idcache.fetch(pairs, folder)


def epoch(pairs: DataFrame, cfg: TrainingConfig, seed: int, number: int = 0, done: int = 0) -> DataFrame:
    """Rows (batch_order, idx, length) of an epoch, without its first `done` batches."""
    samples = batching.directed(pairs, cfg.directions, "pair", "en_ids", "am_ids").select("idx", "length")
    batches = batching.token_budget_batches(samples, cfg.batch_tokens, seed, number)
    return batching.resumed(batches, done) if done else batches


def evaluate(rows: DataFrame, name: str, limit: int | None = None, examples: int = 5, spm: str | None = None) -> dict:
    """Scores of rows (ordinal, direction, src, hyp, ref, ref_raw): each direction against normalized and raw references; spBLEU with a SentencePiece model file."""
    used = rows.filter(F.col("ordinal") < limit) if limit else rows
    out: dict = {"checkpoint": name, "n": used.select("ordinal").distinct().count(), "directions": {}}
    for direction in sorted(r.direction for r in used.select("direction").distinct().collect()):
        own = used.filter(F.col("direction") == direction)
        against = lambda ref, own=own: metrics.score(own.select(F.col("ordinal").alias("id"), "hyp", F.col(ref).alias("ref")), spm).as_dict()
        shown = own.filter(F.col("ordinal") < examples).orderBy("ordinal").select("src", "hyp", "ref")
        out["directions"][direction] = {"vs_normalized_ref": against("ref"), "vs_raw_ref": against("ref_raw"), "examples": [r.asDict() for r in shown.collect()]}
    return out


def to_markdown(result: dict, title: str) -> str:
    lines = [f"# {title}", "", "| direction | BLEU | chrF++ | BLEU (raw) | chrF++ (raw) |", "| --- | --- | --- | --- | --- |"]
    for name, d in result["directions"].items():
        norm, raw = d["vs_normalized_ref"], d["vs_raw_ref"]
        lines.append(f"| {name} | {norm['bleu']} | {norm['chrf']} | {raw['bleu']} | {raw['chrf']} |")
    lines += ["", "## Examples"]
    for name, d in result["directions"].items():
        for e in d["examples"]:
            lines += ["", f"**{name}**", "", f"- source: {e['src']}", f"- output: {e['hyp']}", f"- reference: {e['ref']}"]
    return "\n".join(lines) + "\n"


def save_report(spark: SparkSession, result: dict, folder: str, stem: str) -> None:
    files.write_text(spark, f"{folder}/{stem}.json", json.dumps(result, indent=2, ensure_ascii=False))
    files.write_text(spark, f"{folder}/{stem}.md", to_markdown(result, f"{stem}: {result['checkpoint']}"))
