"""Plans that go span by span or bucket by bucket, against the plain definition."""

import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from twinlex.functions import registry
from twinlex.operators import batching, corpus, metrics, vocabulary
from twinlex.sources import readers
from twinlex.streaming import feeds


def test_quantiles_of_skewed_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    groups = {"one": [3.5], "same": [2.0] * 50, "steps": [0.0] * 40 + [1.0] * 3 + [7.0], "wide": rng.normal(0, 1e6, 2000).tolist(), None: [1.0, 2.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("one", None), ("empty", None)]
    found = corpus.score_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(3), "g", "x").collect()
    assert {r.g for r in found} == set(groups)
    for r in found:
        for name, q in corpus.QUANTILES.items():
            assert r[name] == pytest.approx(float(np.quantile(groups[r.g], q)), abs=1e-4)


def test_running_minimum_across_spans(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(i), float(rng.normal())) for g in ("a", "b", None) for i in rng.choice(500, 120, replace=False)]
    docs = spark.createDataFrame(rows, "g string, step int, x double").repartition(3)
    for by in ("g", None):
        found = feeds.running_min(docs, "step", "x", by, span=40).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r.best == min(x for g, i, x in rows if i <= r.step and (by is None or g == r.g))


def test_offsets_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(batching, "_SPAN", 7)
    rng = np.random.default_rng(3)
    rows = [(int(k), int(n)) for k, n in zip(np.sort(rng.choice(10_000, 200, replace=False)) - 50, rng.integers(0, 9, 200), strict=True)]
    expected = {k: sum(n for o, n in rows if o < k) for k, _ in rows}
    for parts in (1, 5):
        found = batching.offsets(spark.createDataFrame(rows, "k int, n int").repartition(parts), "k", "n").collect()
        assert {r.k: r.offset for r in found} == expected
    assert batching.offsets(spark.createDataFrame([], "k int, n int"), "k", "n").count() == 0


def test_samples_draw_copies_one_by_one(spark):
    rows = spark.createDataFrame([("copy",)] * 60 + [(f"t{i}",) for i in range(60)], "text string").repartition(4)
    drawn = Counter(r.text for r in corpus.seeded_sample(rows, ["text"], 40, 7).collect())
    assert sum(drawn.values()) == 40 and 5 < drawn["copy"] < 35
    assert drawn == Counter(r.text for r in corpus.seeded_sample(rows.repartition(2), ["text"], 40, 7).collect())
    capped = Counter(r.text for r in corpus.capped(rows, ["text"], 40, 7).collect())
    assert sum(capped.values()) == 40 and capped["copy"] in (0, 40) or capped["copy"] > 0
    assert corpus.capped(rows, ["text"], 0, 7).count() == 0 and corpus.capped(rows, ["text"], None, 7).count() == 120


def plain_counts(pairs, cut, orders):
    out = Counter()
    for hyp, ref in pairs:
        for n in range(1, orders + 1):
            h, r = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (cut(hyp or ""), cut(ref or "")))
            out[n, "matched"] += sum((h & r).values())
            out[n, "n_hyp"] += sum(h.values())
            out[n, "n_ref"] += sum(r.values())
    return out


def test_ngrams_counted_in_the_row(spark):
    pairs = [("a b a b c", "a b c a"), ("", "x y"), (None, "z"), ("one  two", "two one"), ("aaaa", "aa aa")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, hyp string, ref string").repartition(2)
    found = {r.n: r for r in metrics.bleu_counts(rows).collect()}
    expected = plain_counts(pairs, str.split, 4)
    assert all(found[n][c] == expected[n, c] for n in found for c in ("matched", "n_hyp", "n_ref")) and set(found) == {n for n in range(1, 5) if expected[n, "n_hyp"] + expected[n, "n_ref"]}
    chars = plain_counts(pairs, lambda t: "".join(t.split()), 6)
    by = {(r.kind, r.n): r for r in metrics.chrf_counts(rows).collect()}
    assert all(by["char", n][c] == chars[n, c] for n in range(1, 7) if ("char", n) in by for c in ("matched", "n_hyp", "n_ref"))


def test_bleu_over_sentence_pieces(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = spark.createDataFrame([(1, "the house stands by the lake", "the house stands by the lake"), (2, "the tree", "the hill by the road")], "id int, hyp string, ref string")
    model = public.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    counts = plain_counts([(r.hyp, r.ref) for r in rows.collect()], lambda t: own.encode(t, out_type=str), 4)
    expected = metrics.bleu_of({n: tuple(counts[n, c] for c in ("matched", "n_hyp", "n_ref")) for n in range(1, 5)})
    assert 0 < expected < 100 and metrics.score(rows, model).spbleu == round(expected, 2) and metrics.score(rows).spbleu is None


def test_vocabulary_use_and_inspection(spark):
    learnt = vocabulary.learn({"▁ab": 5, "▁abc": 4, "d": 1}, 300, 1)
    assert [k for _, _, k in learnt.inspect("ab é")][-1] == "byte" and learnt.decode([i for _, i, _ in learnt.inspect("ab é, abc")]) == "ab é, abc"
    rows = spark.createDataFrame([([6, 7, 7, 300],), ([0],), ([],)], "ids array<int>")
    found = {r.kind: (r.in_vocabulary, r.used, r.n) for r in vocabulary.use_by_class(rows, "ids", 310).collect()}
    assert found == {"special": (6, 1, 1), "byte": (256, 2, 3), "text": (48, 1, 1)}


def test_hosted_rows_keep_the_order_of_files(spark, tmp_path):
    for n, keys in enumerate((range(5), range(5, 6), range(6, 40))):
        spark.createDataFrame([(k,) for k in keys], "k int").coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
    rows = spark.read.parquet(*[str(tmp_path / f"part{n}") for n in (2, 0, 1)])
    found = readers.in_file_order(rows, {"k": F.col("k")}).collect()
    assert {r.k: r.line_no for r in found} == {k: k for k in range(40)}


def test_functions_in_sql(spark):
    names = registry.register(spark, "tl_")
    assert "tl_dedup_key" in names
    row = spark.sql("select tl_dedup_key('Straße, 12!') k, tl_squash_space('  a\t b ') s, tl_length_penalty(7, 0.5) p, tl_inverse_sqrt_factor(400, 100) f, tl_inverse_sqrt_factor(0, 100) g, tl_perplexity(4.0, 2) x, tl_ethiopic_share('ሀb') e, tl_latin_share('12') l").first()
    assert (row.k, row.s, row.f, row.g, row.e, row.l) == ("strasse12", "a b", 0.5, 0.01, 0.5, 0.0)
    assert row.p == pytest.approx(math.sqrt(2)) and row.x == pytest.approx(math.exp(2))


def test_many_held_out_keys_are_filtered_before_they_are_joined(spark, tmp_path):
    keys = spark.range(0, 40_000).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key")).cache()
    pairs = spark.range(0, 20_000, 1, 4).select(F.concat(F.lit("a"), "id").alias("key_en"), F.concat(F.lit("k"), F.col("id") + 280_000 - 70).alias("key_am"), F.col("id"))
    pairs = pairs.unionByName(spark.createDataFrame([("k7", None, -1), (None, None, -2), (None, "k14", -3), ("", "", -4)], "key_en string, key_am string, id bigint"))
    found = corpus.leaks_marked(pairs, keys, str(tmp_path / "work"))
    leaks = {r.id for r in found.filter("_leak").collect()}
    assert leaks == {-1, -3} | {i for i in range(20_000) if i + 280_000 - 70 < 280_000 and (i + 280_000 - 70) % 7 == 0}
    assert found.count() == 20_004
    joined = spark.read.parquet(str(tmp_path / "work")).filter("_maybe = 'true'").count()  # what the exact joins shuffle
    assert len(leaks) <= joined < len(leaks) + 600


def test_a_build_with_many_keys_gives_the_same(spark, tmp_path, monkeypatch):
    from test_build import LEAKED_DEV, config, pair, saved, text_source

    from twinlex.plans.build import build

    cards = []
    for many in (10**9, 0):
        monkeypatch.setattr(corpus, "MANY_KEYS", many)
        root = tmp_path / str(many)
        root.mkdir()
        card = build(spark, config(root, [text_source(root, "s", [pair(i) for i in range(15)] + [pair(LEAKED_DEV), ("x", "ሀ")])]))
        cards.append(({k: v for k, v in card["sources"][0].items() if k != "seconds"}, saved(root, "train")))
        assert not (root / "out/shards/s.judged").exists()
    assert cards[0] == cards[1] and cards[0][0]["rejected"] == {"too_short": 1, "flores": 1}
