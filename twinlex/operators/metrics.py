"""Corpus BLEU and chrF++ as aggregates over n-grams of hypothesis and reference pairs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from twinlex.functions import charclass as cc

BLEU_ORDER, CHAR_ORDER, WORD_ORDER, BETA = 4, 6, 2, 2
#: Rows of a batch that are Python objects at a time.
_ROWS = 64
_MARKS = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


@dataclass(frozen=True)
class Scores:
    bleu: float
    chrf: float
    spbleu: float | None = None

    def as_dict(self) -> dict[str, float | None]:
        return asdict(self)


def tokens_13a(text: Column) -> Column:
    """Words of the 13a scheme: skipped markers and entities, then marks set apart, but for stops and commas within numbers."""
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, to in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.split(text, f"{cc.SPACE}+"), lambda w: w != "")


def chrf_words(text: Column) -> Column:
    """Words with one leading or trailing mark set apart: the trailing one if there are both."""
    words = F.filter(F.split(text, f"{cc.SPACE}+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when(n == 1, F.array(w))
            .when(w.rlike(f"(?s){_MARKS}$"), F.array(F.substring(w, F.lit(1), n - 1), F.substring(w, n, F.lit(1))))
            .when(w.rlike(f"(?s)^{_MARKS}"), F.array(F.substring(w, 1, 1), F.substring(w, F.lit(2), n - 1)))
            .otherwise(F.array(w))
        )

    return F.flatten(F.transform(words, cut))


def characters(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, f"{cc.SPACE}+", ""), ""), lambda c: c != "")


def _tally(hyp: Sequence[str] | None, ref: Sequence[str] | None, orders: int) -> list[int]:
    """For each order: n-grams of both sides, of the hypothesis, of the reference."""
    out: list[int] = []
    sides = [[] if t is None else list(t) for t in (hyp, ref)]
    grams = sides
    for n in range(1, orders + 1):
        if n > 1:
            grams = [list(zip(*(t[i:] for i in range(n)), strict=False)) for t in sides]
        h, r = map(Counter, grams)
        out += [sum(min(c, r[g]) for g, c in h.items() if g in r), len(grams[0]), len(grams[1])]
    return out


def tallies(hyp: Column, ref: Column, orders: int) -> Column:
    """array<bigint>: _tally of two token arrays. Nothing crosses a row, so no n-gram is ever shuffled."""

    @F.arrow_udf(ArrayType(LongType()))
    def count(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        kind, parts = pa.list_(pa.int64()), []
        for at in range(0, len(hyps), _ROWS):
            sides = (t.slice(at, _ROWS).to_pylist() for t in (hyps, refs))
            parts.append(pa.array([_tally(h, r, orders) for h, r in zip(*sides, strict=True)], kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return count(hyp, ref)


def matches(pairs: DataFrame, tokens: dict[str, tuple[Callable[[Column], Column], int]]) -> DataFrame:
    """Rows (kind, n, matched, n_hyp, n_ref): sums over all pairs of the n-grams both sides have, and of each side's.

    tokens: by kind, how a text of the columns hyp and ref is cut, and the longest n-gram. Each row counts its own; what is summed,
    within tasks first, are three numbers for each kind and n. Pairs without any n-gram of a length leave out its row.
    """
    rows = pairs.select(*[tallies(cut(_clean("hyp")), cut(_clean("ref")), orders).alias(kind) for kind, (cut, orders) in tokens.items()])
    sums = [F.sum(F.get(kind, F.lit(3 * n + i))).alias(f"{kind}_{n}_{i}") for kind, (_, orders) in tokens.items() for n in range(orders) for i in range(3)]
    each = [
        F.struct(F.lit(kind).alias("kind"), F.lit(n + 1).alias("n"), *[F.col(f"{kind}_{n}_{i}").alias(c) for i, c in enumerate(("matched", "n_hyp", "n_ref"))])
        for kind, (_, orders) in tokens.items()
        for n in range(orders)
    ]
    return rows.agg(*sums).select(F.inline(F.array(*each))).filter("n_hyp > 0 or n_ref > 0")


def _clean(c: str) -> Column:
    return F.coalesce(F.rtrim(F.col(c)), F.lit(""))


def bleu_counts(pairs: DataFrame) -> DataFrame:
    return matches(pairs, {"word": (tokens_13a, BLEU_ORDER)})


def chrf_counts(pairs: DataFrame) -> DataFrame:
    return matches(pairs, {"char": (characters, CHAR_ORDER), "word": (chrf_words, WORD_ORDER)})


def bleu_of(counts: dict[int, tuple[int, int, int]]) -> float:
    """From (matched, of the hypotheses, of the references) for each order; zero matches are smoothed by halving."""
    found = [counts.get(n, (0, 0, 0)) for n in range(1, BLEU_ORDER + 1)]
    hyp, ref = found[0][1], found[0][2]
    if not any(m for m, _, _ in found) or any(t == 0 for _, t, _ in found):
        return 0.0
    smooth, logs = 1.0, 0.0
    for matched, total, _ in found:
        if not matched:
            smooth *= 2
        logs += math.log(100.0 * matched / total if matched else 100.0 / (smooth * total))
    brevity = math.exp(1 - ref / hyp) if hyp < ref else 1.0
    return brevity * math.exp(logs / BLEU_ORDER)


def chrf_of(counts: dict[tuple[str, int], tuple[int, int, int]]) -> float:
    """Precision and recall averaged over the orders that both sides have, then the F score that weighs recall twice."""
    both = [(m / h, m / r) for m, h, r in counts.values() if h and r]
    if not both:
        return 0.0
    p, r = (sum(x) / len(both) for x in zip(*both, strict=True))
    weight = BETA * BETA
    return 100 * (1 + weight) * p * r / (weight * p + r) if p + r else 0.0


def corpus_bleu(pairs: DataFrame) -> float:
    return bleu_of({r.n: (r.matched, r.n_hyp, r.n_ref) for r in bleu_counts(pairs).collect()})  # four rows


def corpus_chrf(pairs: DataFrame) -> float:
    return chrf_of({(r.kind, r.n): (r.matched, r.n_hyp, r.n_ref) for r in chrf_counts(pairs).collect()})  # eight rows


def sentence_pieces(model: str) -> Callable[[Column], Column]:
    """Cuts texts by a SentencePiece model file, which each Python worker loads once."""

    def cut(text: Column) -> Column:
        @F.pandas_udf(ArrayType(StringType()))
        def pieces(texts: pd.Series) -> pd.Series:
            found = _model(model)
            return texts.map(lambda t: found.encode(t or "", out_type=str))

        return pieces(text)

    return cut


@cache
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def corpus_spbleu(pairs: DataFrame, model: str) -> float:
    """BLEU over the pieces of a SentencePiece model."""
    return bleu_of({r.n: (r.matched, r.n_hyp, r.n_ref) for r in matches(pairs, {"word": (sentence_pieces(model), BLEU_ORDER)}).collect()})


def score(pairs: DataFrame, spm: str | None = None) -> Scores:
    """All metrics, two digits; spBLEU where a SentencePiece model file is given."""
    return Scores(round(corpus_bleu(pairs), 2), round(corpus_chrf(pairs), 2), round(corpus_spbleu(pairs, spm), 2) if spm else None)


def align(hyps: DataFrame, refs: DataFrame, key: str = "id") -> DataFrame:
    """Hypotheses (key, hyp) and references (key, ref) joined one to one; fails if the counts differ."""
    h, r = hyps.count(), refs.count()
    if h != r:
        raise ValueError(f"{h} hypotheses vs {r} references")
    return hyps.join(refs, key)
