import math
from argparse import Namespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlex.functions import numeric
from twinlex.model import commands, network, trainer
from twinlex.operators import batching
from twinlex.plans import files, training, translate
from twinlex.plans.config import Config, ModelConfig, load_config

TINY = ModelConfig(d_model=8, n_heads=2, d_ff=12, n_encoder_layers=1, n_decoder_layers=2, dropout=0.0, max_len=32, activation="gelu")


def test_weights_are_as_many_as_the_formula_says():
    for cfg, size in ((TINY, 11), (ModelConfig(d_model=16, n_heads=4, d_ff=8, n_encoder_layers=3, n_decoder_layers=1), 20)):
        assert network.Network(cfg, size).count() == numeric.parameter_count(size, cfg.d_model, cfg.d_ff, cfg.n_encoder_layers, cfg.n_decoder_layers)


@pytest.mark.parametrize("activation", ["relu", "gelu"])
def test_gradients_match_differences(activation):
    rng = np.random.default_rng(1)
    net = network.Network(TINY.model_copy(update={"activation": activation}), 11, seed=3)
    for w in net.weights.values():
        w.data = w.data.astype(np.float64)
    src, tgt, out = np.array([[4, 7, 8, 2], [5, 9, 2, 0]]), np.array([[1, 6, 7], [1, 10, 0]]), np.array([[6, 7, 2], [10, 2, 0]])
    loss = lambda: network.smoothed_loss(net(src, tgt), out, 0.1)[0]
    logits = net(src, tgt)
    logits.backward(network.smoothed_loss(logits, out, 0.1)[3].astype(np.float64))
    for w in net.weights.values():
        for _ in range(2):
            at = tuple(rng.integers(0, n) for n in w.data.shape)
            old = w.data[at]
            w.data[at] = old + 1e-5
            up = loss()
            w.data[at] = old - 1e-5
            down = loss()
            w.data[at] = old
            assert (up - down) / 2e-5 == pytest.approx(w.grad[at], rel=2e-3, abs=2e-5)


def test_nothing_sees_padding_or_what_comes_later():
    net = network.Network(TINY, 11)
    src, tgt = np.array([[4, 7, 8, 2]]), np.array([[1, 6, 7, 9]])
    whole = net(src, tgt).data
    assert np.allclose(whole[:, :2], net(src, tgt[:, :2]).data, atol=1e-5)
    assert np.allclose(whole, net(np.pad(src, ((0, 0), (0, 3))), tgt).data, atol=1e-5)
    assert np.allclose(network.positions(5, 8)[3], [math.sin(3 * 10_000 ** (-i / 8)) if i % 2 == 0 else math.cos(3 * 10_000 ** (-(i - 1) / 8)) for i in range(8)], atol=1e-5)


def test_loss_matches_the_expression(spark):
    rng = np.random.default_rng(2)
    z, target = rng.normal(0, 1, (1, 6, 7)).astype(np.float32), np.array([[3, 1, 6, 0, 2, 5]])
    total, nll, n, _ = network.smoothed_loss(network.Value(z), target, 0.1)
    rows = spark.createDataFrame([([float(x) for x in z[0, i]], int(target[0, i])) for i in range(6)], "z array<double>, t int")
    found = rows.select(numeric.smoothed_loss(F.col("z"), F.col("t"), 0.1, pad=0).alias("l")).agg(F.sum("l.loss"), F.sum("l.nll"), F.sum("l.n")).first()
    assert (total, nll, n) == (pytest.approx(found[0]), pytest.approx(found[1]), found[2])


def config(root, **changed):
    part = {"max_len": 16, "batch_tokens": 64, "directions": ["en-am"], "max_steps": 60, "warmup_steps": 20, "peak_lr": 0.01, "eval_every": 20, "save_every": 20, "log_every": 20, "label_smoothing": 0.0, **changed}
    model = {**TINY.model_dump(), "d_model": 16, "d_ff": 32, "n_decoder_layers": 1, "activation": "relu"}
    return Config.model_validate({"project": {"name": "m", "seed": 5}, "paths": {"root": str(root)}, "model": model, "training": part})


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    """Targets are the sources turned round."""
    rng = np.random.default_rng(4)
    rows = [(i, ids, ids[::-1]) for i, ids in enumerate([int(x) for x in rng.integers(6, 12, rng.integers(2, 5))] for _ in range(120))]
    path = str(tmp_path_factory.mktemp("pairs") / "t")
    spark.createDataFrame(rows, "pair bigint, en_ids array<int>, am_ids array<int>").coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def test_training_learns_stops_and_goes_on_where_it_was(spark, pairs, tmp_path):
    held = pairs.filter("pair < 20")
    whole = trainer.Trainer(spark, config(tmp_path), str(tmp_path / "whole"), 12)
    start = whole.evaluate(list(trainer.batches(held, whole.cfg.training, 5)))
    out = whole.run(pairs, held)
    assert out["steps"] == 60 and out["best_nll"] < 0.75 * start and [r["step"] for r in whole.log if r["event"] == "eval"] == [20, 40, 60]
    first = trainer.Trainer(spark, config(tmp_path, max_steps=40), str(tmp_path / "parts"), 12)
    first.run(pairs, held)
    second = trainer.Trainer(spark, config(tmp_path), str(tmp_path / "parts"), 12)
    assert second.resume() and second.adam.steps == 40
    second.run(pairs, held)
    assert all(np.allclose(a, second.net.arrays()[n], atol=1e-6) for n, a in whole.net.arrays().items())
    log = spark.read.json(str(tmp_path / "parts/metrics.jsonl"))
    assert log.filter("event = 'train'").count() == 4
    halted = trainer.Trainer(spark, config(tmp_path, time_limit_minutes=0), str(tmp_path / "halted"), 12)
    assert halted.run(pairs)["steps"] <= 1 and not trainer.Trainer(spark, config(tmp_path), str(tmp_path / "none"), 12).resume()


def test_search_with_the_network_is_its_own_greedy_decoding(spark, pairs, tmp_path):
    run = trainer.Trainer(spark, config(tmp_path), str(tmp_path / "run"), 12)
    run.run(pairs)
    trainer.save_weights(spark, str(tmp_path / "half.npz"), run.net, half=True)
    net = trainer.load_network(spark, str(tmp_path / "half.npz"))
    sources = [[4, *r.en_ids, 2] for r in pairs.orderBy("pair").limit(12).collect()]
    rows = spark.createDataFrame(list(enumerate(sources)), "item bigint, src array<int>")
    found = {r.item: list(r.tokens) for r in translate.search(rows, trainer.scorer(spark, net), str(tmp_path / "w"), size=1, a=0.0, b=6, forbidden=(0,)).collect()}
    for i, src in enumerate(sources):
        own = net.greedy(np.array([src]), batching.BOS, batching.EOS, 6)[0].tolist()
        assert found[i] == [t for t in (own[: own.index(2)] if 2 in own else own) if t != 0]
    with pytest.raises(ValueError, match="needs the model"):
        trainer.load_network(spark, str(tmp_path / "run/last.npz"))
    with pytest.raises(ValueError, match="don't fit"):
        trainer.load_network(spark, str(tmp_path / "run/last.npz"), TINY)


def test_commands_from_corpus_to_service(spark, tmp_path):
    root = tmp_path
    words = {"river": "ወንዝ", "stone": "ድንጋይ", "bread": "ዳቦ", "paper": "ወረቀት"}
    texts = [(f"{a} {b} {c}.", f"{words[a]} {words[b]} {words[c]}።") for a in words for b in words for c in words]
    rows = spark.createDataFrame([(e, m, "s", None) for e, m in texts], "en string, am string, source string, score float")
    rows.write.parquet(str(root / "data/processed/train.parquet"))
    rows.limit(6).select("en", "am").write.parquet(str(root / "data/processed/train_holdout.parquet"))
    for split in ("valid", "test"):
        rows.limit(3).select("en", "am", F.col("en").alias("en_raw"), F.col("am").alias("am_raw")).coalesce(1).write.parquet(str(root / f"data/processed/{split}.parquet"))
    base = config(root, max_steps=4, eval_every=2, save_every=2, directions=["en-am", "am-en"], max_len=32, batch_tokens=200)
    cfg = Config.model_validate({**base.model_dump(mode="json"), "tokenizer": {"vocab_size": 320, "min_frequency": 1}})
    training.train_vocabulary(spark, cfg)
    args = Namespace(max_steps=2, time_limit=None, fresh=True, checkpoint=None, beam=2, alpha=1.0, direction="en-am", input=None, texts=["river stone.", " "], split="test", limit=2, spm=None, out=str(root / "bundle"), text="river 1")
    assert commands.train(spark, cfg, args)["steps"] == 2 and not commands.train(spark, cfg, args)["resumed"]
    found = commands.translate(spark, cfg, args)
    assert [f["text"] for f in found] == args.texts and found[1]["output"] == ""
    assert set(commands.eval(spark, cfg, args)) == {"en-am", "am-en"} and (root / "artifacts/eval/test_beam2.md").exists()
    assert commands.export(spark, cfg, args)["parameters"] > 0 and files.exists(spark, str(root / "bundle/model.npz"))
    shown = commands.inspect(spark, cfg, args)
    learnt = training.load_vocabulary(spark, str(root / "artifacts/tokenizer/vocabulary.json"))
    assert learnt.decode([s["id"] for s in shown]) == "river 1" and {s["class"] for s in shown} <= {"text", "byte"}
    own = commands.Translator(spark, cfg, str(root / "bundle/model.npz"))
    assert commands.answer(own, "/health", None) == (200, {"status": "ok"}) and commands.answer(own, "/other", None)[0] == 404
    assert commands.answer(own, "/translate", b'{"texts": ["river"], "direction": "am-en", "beam_size": 1}')[0] == 200
    for body, status in ((b"{", 422), (b'{"texts": [], "direction": "en-am"}', 422), (b'{"texts": ["a"], "direction": "en-fr"}', 422), (b'{"texts": ["%s"], "direction": "en-am"}' % (b"x" * 2001), 413), (b'{"texts": ["a"], "direction": "en-am", "beam_size": 9}', 422)):
        assert commands.answer(own, "/translate", body)[0] == status


@pytest.mark.parametrize("name", ["tiny", "full"])
def test_shipped_configurations_load(name):
    from pathlib import Path

    cfg = load_config(Path(__file__).resolve().parents[1] / "configs" / f"{name}.yaml")
    assert cfg.project.name == name and cfg.model and cfg.training.subset == cfg.tokenizer.subset
    assert cfg.with_training(max_steps=3).training.max_steps == 3
    with pytest.raises(ValueError):
        cfg.with_training(max_steps="many")
