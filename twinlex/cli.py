"""Command line: version, config validate, data build, tokenizer train, batches plan, train, translate, eval, export, serve, inspect, score."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

__version__ = "0.1.0"


def session(name: str = "twinlex"):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _config(args: argparse.Namespace):
    from twinlex.plans.config import load_config

    cfg = load_config(args.config)
    changed = {k: v for k, v in (("root", args.root), ("data_raw", args.raw_dir)) if v is not None}
    return cfg.with_paths(**changed) if changed else cfg


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinlex", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    check = commands.add_parser("config").add_subparsers(dest="action", required=True).add_parser("validate")
    check.add_argument("path", type=Path)

    def job(group: str, action: str) -> argparse.ArgumentParser:
        p = commands.add_parser(group).add_subparsers(dest="action", required=True).add_parser(action)
        p.add_argument("--config", "-c", type=Path, required=True)
        p.add_argument("--root", type=Path)
        p.add_argument("--raw-dir", type=Path)
        return p

    job("data", "build").add_argument("--rebuild", action="append", default=[])
    job("tokenizer", "train")
    job("batches", "plan").add_argument("--epoch", type=int, default=0)

    def model(command: str) -> argparse.ArgumentParser:
        p = commands.add_parser(command)
        p.add_argument("--config", "-c", type=Path, required=True)
        p.add_argument("--root", type=Path)
        p.add_argument("--raw-dir", type=Path)
        return p

    learn = model("train")
    learn.add_argument("--max-steps", type=int)
    learn.add_argument("--time-limit", type=int, help="minutes")
    learn.add_argument("--fresh", action="store_true", help="start anew instead of going on from the last checkpoint")
    for command in ("translate", "eval", "serve"):
        p = model(command)
        p.add_argument("--checkpoint", help="weights; by default the best of the run")
        p.add_argument("--beam", type=int, default=4)
        p.add_argument("--alpha", type=float, default=1.0)
        if command == "translate":
            p.add_argument("--direction", choices=["en-am", "am-en"], required=True)
            p.add_argument("--input", help="a file with one sentence a line")
            p.add_argument("texts", nargs="*")
        elif command == "eval":
            p.add_argument("--split", choices=["valid", "test"], default="test")
            p.add_argument("--limit", type=int)
            p.add_argument("--spm", help="a SentencePiece model for spBLEU")
        else:
            p.add_argument("--host", default="127.0.0.1")
            p.add_argument("--port", type=int, default=8000)
    bundle = model("export")
    bundle.add_argument("--checkpoint")
    bundle.add_argument("--out", required=True)
    shown = model("inspect")
    shown.add_argument("text")
    score = commands.add_parser("score")
    score.add_argument("table", help="Parquet with ordinal, direction, src, hyp, ref, ref_raw")
    score.add_argument("--out", required=True)
    score.add_argument("--limit", type=int)
    score.add_argument("--spm", help="a SentencePiece model for spBLEU")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
    elif args.command == "config":
        from twinlex.plans.config import load_config

        print(load_config(args.path).model_dump_json(indent=2))
    elif args.command == "data":
        from twinlex.plans.build import build

        card = build(session(), _config(args), set(args.rebuild))
        print(json.dumps({k: card[k] for k in ("sources", "dedup", "splits")}, indent=2))
    elif args.command == "tokenizer":
        from twinlex.plans.training import train_vocabulary

        print(json.dumps(train_vocabulary(session(), _config(args)), indent=2))
    elif args.command == "batches":
        from twinlex.plans import training

        spark, cfg = session(), _config(args)
        learnt = training.load_vocabulary(spark, f"{cfg.paths.resolve('artifacts')}/tokenizer/vocabulary.json")
        pairs, counts = training.token_cache(spark, cfg, learnt)
        batches = training.epoch(pairs, cfg.training, cfg.project.seed, args.epoch)
        print(json.dumps({**counts, "batches": batches.select("batch_order").distinct().count()}))
    elif args.command in ("train", "translate", "eval", "serve", "export", "inspect"):
        from twinlex.model import commands

        print(json.dumps(getattr(commands, args.command)(session(), _config(args), args), indent=2, ensure_ascii=False))
    else:
        from twinlex.plans import training

        spark = session()
        result = training.evaluate(spark.read.parquet(args.table), Path(args.table).stem, args.limit, spm=args.spm)
        training.save_report(spark, result, args.out, "score")
        print(json.dumps({k: d["vs_normalized_ref"] for k, d in result["directions"].items()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
