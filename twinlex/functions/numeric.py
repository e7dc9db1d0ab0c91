"""Schedules, losses, attention masks and beam steps as expressions over numbers and arrays."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlex.functions.expr import once

#: Elements of an array whose largest one is taken together.
_PIECE = 128


def inverse_sqrt_factor(step: Column, warmup: int) -> Column:
    """Learning-rate factor: linear warm-up, then the inverse square root."""
    s = F.greatest(step.cast("double"), F.lit(1.0))
    return F.when(s < warmup, s / warmup).otherwise(F.sqrt(F.lit(float(warmup)) / s))


def length_penalty(length: Column, alpha: float) -> Column:
    return F.pow((F.lit(5.0) + length) / 6.0, F.lit(alpha))


def _log_sum(logits: Column, f: Callable[[Column], Column]) -> Column:
    """f of the logarithm of the sum of exponentials, which is taken once a row."""
    total = lambda top: F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))) + top
    return once(F.array_max(logits).cast("double"), lambda top: once(total(top), f))


def log_softmax(logits: Column) -> Column:
    """Logarithms of probabilities, in time that is linear in the length."""
    return _log_sum(logits, lambda log_sum: F.transform(logits, lambda x: x.cast("double") - log_sum))


def smoothed_loss(logits: Column, target: Column, smoothing: float, pad: int | None = None) -> Column:
    """struct<loss, nll, n> of one position with label smoothing; target counts from 0; padding counts for nothing."""
    on = F.lit(1) if pad is None else F.when(target == pad, 0).otherwise(1)
    zero = lambda c: F.when(on == 1, c).otherwise(F.lit(0.0))

    def loss(log_sum: Column) -> Column:
        nll = log_sum - F.get(logits, target).cast("double")
        mean = log_sum - F.aggregate(logits, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(logits)
        return F.struct(zero(nll * (1 - smoothing) + mean * smoothing).alias("loss"), zero(nll).alias("nll"), on.cast("bigint").alias("n"))

    return _log_sum(logits, loss)


def perplexity(nll: Column, n: Column) -> Column:
    return F.exp(nll / F.greatest(n, F.lit(1)))


def position_encoding(position: Column, width: int) -> Column:
    """array<double>: sine and cosine in turn, at wavelengths from 2 pi to 10,000 times that."""
    rate = lambda i: F.exp((F.floor(i / 2) * 2).cast("double") * (-math.log(10_000.0) / width))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i % 2 == 0, F.sin(position * rate(i))).otherwise(F.cos(position * rate(i))))


def embedded(vector: Column, position: Column, width: int) -> Column:
    """A scaled vector plus its position's encoding."""
    return F.zip_with(vector, position_encoding(position, width), lambda x, p: x * math.sqrt(width) + p)


def padding_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: x != pad)


def causal_mask(size: Column) -> Column:
    to = F.sequence(F.lit(0), size - 1)
    return F.transform(to, lambda i: F.transform(to, lambda j: j <= i))


def target_mask(ids: Column, pad: int) -> Column:
    """May position i attend j: j isn't later and isn't padding."""
    return F.transform(causal_mask(F.size(ids)), lambda row: F.zip_with(row, padding_mask(ids, pad), lambda a, b: a & b))


def argmax(values: Column) -> Column:
    """First place of the largest value, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def largest(values: Column, k: int) -> Column:
    """array<struct<minus, index>> of the k largest values, in order; of equal ones the first. Null and NaN aren't ranked.

    Of the largest values of pieces of the array the k-th is a bound: at least k values reach it. Only these few are sorted, so
    that time is linear in the length.
    """

    def above(v: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _PIECE).cast("int")), lambda i: F.array_max(F.slice(v, i * _PIECE + 1, _PIECE)))
        reach = lambda least: F.transform(v, lambda x, i: F.when(F.coalesce(x >= least, x.isNotNull()), F.struct((-x).alias("minus"), i.alias("index"))))
        return once(F.get(F.sort_array(pieces, asc=False), F.lit(k - 1)), lambda least: F.slice(F.array_sort(F.array_compact(reach(least))), 1, k))

    return once(F.transform(values, lambda x: F.when(~F.isnan(x), x)), above)


def top_k(values: Column, k: int) -> Column:
    """array<struct<value, index>> of the k largest values; of equal ones the first."""
    return F.transform(largest(values, k), lambda p: F.struct((-p["minus"]).alias("value"), p["index"].alias("index")))


def continued(beams: DataFrame, size: int, forbidden: tuple[int, ...] = ()) -> DataFrame:
    """Rows (item, tokens, token, total, rank): the 2 * size best continuations of each item's beams (item, beam, score, tokens, logits)."""
    barred = F.array(*[F.lit(i) for i in forbidden]).cast("array<int>")
    # an item's best are among the best of each of its beams: only these leave the row
    first = largest(F.transform(log_softmax(F.col("logits")), lambda p, i: F.when(~F.array_contains(barred, i), p)), 2 * size)
    scored = beams.select("item", "beam", "score", "tokens", F.inline(first).alias("minus", "token")).withColumn("total", F.col("score") - F.col("minus")).drop("minus")
    best = Window.partitionBy("item").orderBy(F.desc("total"), "beam", "token")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= 2 * size).select("item", "tokens", "token", "total", "rank")


def beam_step(beams: DataFrame, size: int, eos: int, step: int, alpha: float, forbidden: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One step of beam search over beams(item, beam, score, tokens array<int>, logits array).

    Returns the beams that go on (item, beam, score, tokens) and the hypotheses that end (item, tokens, score, rank): of the 2 * size
    best continuations of an item, an end counts only among the first `size`; the first `size` others go on.
    """
    ranked = continued(beams, size, forbidden)
    ended = ranked.filter((F.col("token") == eos) & (F.col("rank") <= size))
    hypotheses = ended.select("item", "tokens", (F.col("total") / length_penalty(F.lit(step + 1), alpha)).alias("score"), "rank")
    alive = ranked.filter(F.col("token") != eos).withColumn("slot", F.row_number().over(Window.partitionBy("item").orderBy("rank"))).filter(F.col("slot") <= size)
    return alive.select("item", (F.col("slot") - 1).alias("beam"), F.col("total").alias("score"), F.concat("tokens", F.array("token")).alias("tokens")), hypotheses


def parameter_count(vocabulary: int, width: int, hidden: int, encoders: int, decoders: int) -> int:
    """Weights of an encoder-decoder with one tied vocabulary matrix: attention has four maps with biases, a layer two or three norms."""
    attention, norm = 4 * (width * width + width), 2 * width
    feed = 2 * width * hidden + hidden + width
    return vocabulary * width + encoders * (attention + feed + 2 * norm) + decoders * (2 * attention + feed + 3 * norm) + 2 * norm
