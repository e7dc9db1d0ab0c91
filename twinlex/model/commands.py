"""What the command line does with a network."""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlex.functions import filters
from twinlex.model import trainer
from twinlex.operators import batching
from twinlex.operators.vocabulary import Vocabulary
from twinlex.plans import files, training
from twinlex.plans import translate as plan
from twinlex.plans.config import Config
from twinlex.sources import readers

#: Characters of one text that the service takes.
MOST_CHARS = 2000


def _vocabulary_file(cfg: Config) -> str:
    return f"{cfg.paths.resolve('artifacts')}/tokenizer/vocabulary.json"


def _run(cfg: Config) -> str:
    return f"{cfg.paths.resolve('artifacts')}/run"


def _checkpoint(spark: SparkSession, cfg: Config, args: argparse.Namespace) -> str:
    best, last = (f"{_run(cfg)}/{n}.npz" for n in ("best", "last"))
    return args.checkpoint or (best if files.exists(spark, best) else last)


def held_out(spark: SparkSession, cfg: Config, learnt: Vocabulary) -> DataFrame:
    """Rows (pair, en_ids, am_ids) of the hold-out that are short enough."""
    rows = trainer.training.tokenized(spark.read.parquet(f"{cfg.paths.resolve('data_processed')}/train_holdout.parquet"), learnt, cfg.training.model_copy(update={"max_pairs": None}), cfg.project.seed)
    kept = rows.filter(batching.length_gate(F.col("en_ids"), F.col("am_ids"), cfg.training.max_len))
    folder = files.scratch(spark, "holdout")
    kept.withColumn("pair", F.monotonically_increasing_id()).write.parquet(folder)
    return spark.read.parquet(folder)


def train(spark: SparkSession, cfg: Config, args: argparse.Namespace) -> dict:
    changed = {k: v for k, v in (("max_steps", args.max_steps), ("time_limit_minutes", args.time_limit)) if v is not None}
    cfg = cfg.with_training(**changed) if changed else cfg
    learnt = training.load_vocabulary(spark, _vocabulary_file(cfg))
    pairs, counts = training.token_cache(spark, cfg, learnt)
    run = trainer.Trainer(spark, cfg, _run(cfg), len(learnt.tokens))
    resumed = not args.fresh and run.resume()
    return {**counts, "resumed": resumed, "parameters": run.net.count(), **run.run(pairs, held_out(spark, cfg, learnt))}


class Translator:
    """A network with its vocabulary: whole tables of texts at a time."""

    def __init__(self, spark: SparkSession, cfg: Config, checkpoint: str) -> None:
        self.spark, self.cfg = spark, cfg
        self.learnt = training.load_vocabulary(spark, _vocabulary_file(cfg))
        self.score = trainer.scorer(spark, trainer.load_network(spark, checkpoint, cfg.model, len(self.learnt.tokens)))

    def table(self, rows: DataFrame, direction: str, beam: int = 4, alpha: float = 1.0) -> DataFrame:
        """rows (idx, text) with output."""
        return plan.translate(rows, self.learnt, self.score, direction, files.scratch(self.spark, "search"), min(self.cfg.training.max_len if self.cfg.training else 128, self.cfg.model.max_len), size=beam, alpha=alpha)

    def texts(self, texts: list[str], direction: str, beam: int = 4, alpha: float = 1.0) -> list[str]:
        rows = self.spark.createDataFrame(list(enumerate(texts)), "idx bigint, text string")
        return [r.output for r in self.table(rows, direction, beam, alpha).orderBy("idx").collect()]


def translate(spark: SparkSession, cfg: Config, args: argparse.Namespace) -> list[dict]:
    """Of the texts given, or of the lines of a file, in their order."""
    own = Translator(spark, cfg, _checkpoint(spark, cfg, args))
    if args.input:
        rows = readers.numbered(spark.read.text(args.input)).select(F.col("line_no").alias("idx"), F.col("value").alias("text"))
    else:
        rows = spark.createDataFrame(list(enumerate(args.texts)), "idx bigint, text string")
    return [{"text": r.text, "output": r.output} for r in own.table(rows, args.direction, args.beam, args.alpha).orderBy("idx").collect()]


def eval(spark: SparkSession, cfg: Config, args: argparse.Namespace) -> dict:  # noqa: A001  (the command's name)
    """Both directions of a held-out split, scored against normalized and raw references; the report is saved."""
    checkpoint = _checkpoint(spark, cfg, args)
    own = Translator(spark, cfg, checkpoint)
    rows = readers.in_file_order(spark.read.parquet(f"{cfg.paths.resolve('data_processed')}/{args.split}.parquet"), {c: F.col(c) for c in ("en", "am", "en_raw", "am_raw")})
    every = None
    for direction, (source, target) in batching.LANGUAGES.items():
        found = own.table(rows.select(F.col("line_no").alias("idx"), F.col(source).alias("text")), direction, args.beam, args.alpha)
        one = found.join(rows, F.col("idx") == F.col("line_no")).select(F.col("idx").alias("ordinal"), F.lit(direction).alias("direction"), F.col("text").alias("src"), F.col("output").alias("hyp"), F.col(target).alias("ref"), F.col(f"{target}_raw").alias("ref_raw"))
        every = one if every is None else every.unionByName(one)
    path = files.scratch(spark, "outputs")
    every.write.parquet(path)
    result = training.evaluate(spark.read.parquet(path), checkpoint.rsplit("/", 1)[-1], args.limit, spm=args.spm)
    training.save_report(spark, result, f"{cfg.paths.resolve('artifacts')}/eval", f"{args.split}_beam{args.beam}")
    return {d: s["vs_normalized_ref"] for d, s in result["directions"].items()}


def export(spark: SparkSession, cfg: Config, args: argparse.Namespace) -> dict:
    return trainer.export(spark, _checkpoint(spark, cfg, args), args.out, cfg, _vocabulary_file(cfg))


def inspect(spark: SparkSession, cfg: Config, args: argparse.Namespace) -> list[dict]:
    learnt = training.load_vocabulary(spark, _vocabulary_file(cfg))
    return [{"token": t, "id": i, "class": k} for t, i, k in learnt.inspect(args.text)]


def answer(own: Translator, path: str, body: bytes | None) -> tuple[int, dict]:
    """Status and reply of one request: GET /health (no body) or POST /translate."""
    if body is None:
        return (200, {"status": "ok"}) if path == "/health" else (404, {"error": "not found"})
    if path != "/translate":
        return 404, {"error": "not found"}
    try:
        asked = json.loads(body)
        texts, direction, beam, alpha = asked["texts"], asked["direction"], int(asked.get("beam_size", 4)), float(asked.get("length_penalty", 1.0))
        if direction not in batching.LANGUAGES or not isinstance(texts, list) or not all(t is None or isinstance(t, str) for t in texts):
            return 422, {"error": "malformed request"}
    except (ValueError, KeyError, TypeError):
        return 422, {"error": "malformed request"}
    one = own.spark.createDataFrame([(texts,)], "texts array<string>")
    status = one.select(filters.request_error(F.col("texts"), F.lit(beam), F.lit(alpha), MOST_CHARS).alias("e")).first().e
    if status:
        return status, {"error": "malformed request" if status == 422 else "a text is too long"}
    return 200, {"translations": own.texts(texts, direction, beam, alpha)}


def serve(spark: SparkSession, cfg: Config, args: argparse.Namespace) -> dict:
    """Answers requests until it is stopped."""
    own = Translator(spark, cfg, _checkpoint(spark, cfg, args))

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, body: bytes | None) -> None:
            status, reply = answer(own, self.path, body)
            raw = json.dumps(reply, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._reply(None)

        def do_POST(self) -> None:
            self._reply(self.rfile.read(int(self.headers.get("Content-Length", 0))))

    with ThreadingHTTPServer((args.host, args.port), Handler) as server:
        server.serve_forever()
    return {}
