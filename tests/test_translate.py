import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinlex.operators import vocabulary
from twinlex.plans import translate

SIZE, FORBIDDEN = 9, (0, 1, 3, 4, 5)


def network():
    """A made-up one: logits that depend on all of the source and of the prefix. Nested, so that workers get it by value."""
    size = SIZE

    def logits(src, tokens):
        return np.random.default_rng([*map(int, src), 99, *map(int, tokens)]).normal(0, 2, size)

    return logits


def scorer(rows):
    logits = network()

    def run(frames):
        for frame in frames:
            yield frame.assign(logits=[logits(s, t).tolist() for s, t in zip(frame["src"], frame["tokens"], strict=True)])

    return rows.mapInPandas(run, "item bigint, beam int, score double, tokens array<int>, src array<int>, logits array<double>")


def plain_search(src, size, alpha, bound):
    beams, ended = [(0.0, ())], []
    for step in range(bound):
        every = []
        for b, (score, tokens) in enumerate(beams):
            x = network()(src, tokens)
            p = x - np.log(np.exp(x).sum())
            every += [(score + p[t], -b, -t, (*tokens, t)) for t in range(SIZE) if t not in FORBIDDEN]
        every = sorted(every, reverse=True)[: 2 * size]
        for rank, (score, _, _, tokens) in enumerate(every):
            if tokens[-1] == 2 and rank < size and len(ended) < size:
                ended.append((score / ((5 + step + 1) / 6) ** alpha, tokens[:-1]))
        beams = [(s, t) for s, _, _, t in every if t[-1] != 2][:size]
        if len(ended) >= size:
            return max(ended)
    return max(ended + [(s / ((5 + bound) / 6) ** alpha, t) for s, t in beams])


@pytest.mark.parametrize("size", [1, 3])
def test_search_matches_a_plain_one(spark, tmp_path, size):
    sources = [(i, list(map(int, np.random.default_rng(i).integers(6, 9, 1 + i % 3)))) for i in range(6)]
    found = translate.search(spark.createDataFrame(sources, "item bigint, src array<int>"), scorer, str(tmp_path), size, 0.8, 1.0, 3).collect()
    assert len(found) == 6
    for r in found:
        src = dict(sources)[r.item]
        score, tokens = plain_search(src, size, 0.8, len(src) + 3)
        assert tuple(r.tokens) == tuple(tokens) and r.score == pytest.approx(score)


def test_translate_keeps_order_and_blanks(spark, tmp_path):
    texts = ["ab ba", "", " \t", None, "b"]
    learnt = vocabulary.learn({"▁ab": 3, "▁ba": 2, "▁b": 1}, 300, 1)
    eos = len(learnt.tokens)

    def echo(rows):
        def run(frames):
            for frame in frames:
                out = []
                for s, t in zip(frame["src"], frame["tokens"], strict=True):
                    x = np.full(eos, -50.0)
                    x[int(s[len(t) + 1])] = 50.0  # the source again, token by token, with its end
                    out.append(x.tolist())
                yield frame.assign(logits=out)

        return rows.mapInPandas(run, "item bigint, beam int, score double, tokens array<int>, src array<int>, logits array<double>")

    rows = spark.createDataFrame(pd.DataFrame({"idx": range(5), "text": texts}), "idx bigint, text string")
    found = translate.translate(rows, learnt, echo, "en-am", str(tmp_path), size=1)
    assert [r.output for r in found.orderBy("idx").collect()] == ["ab ba", "", "", "", "b"]
    assert found.filter(F.col("idx") == 3).first().text is None
