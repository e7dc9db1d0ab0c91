"""Pair filters: one CASE expression whose first matching branch names the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlex.functions import charclass as cc
from twinlex.functions.normalize import casefold
from twinlex.plans.config import FilterConfig

#: In the order in which they are tried.
REASONS = ("empty", "identical", "too_short", "too_long", "too_many_words", "ratio", "am_script", "en_script", "url", "markup")
HELD_OUT = "flores"
URL = f"(?i)(https?://|www\\.){cc.NOT_SPACE}+"
# What counts as markup.
MARKUP = r"(?i)</?[a-z][^<>]*>|&[a-z]+;|&#\p{Nd}+;|%\(?[a-z_]*\)?[sdfBAYeIMpHS]|\{[\p{L}\p{N}_]*\}|_BAR_"


def share(pattern: str, text: Column) -> Column:
    """Matches of the pattern per letter; 0 without letters. May exceed 1, as the pattern may match marks."""
    letters = F.regexp_count(text, F.lit(cc.LETTER))
    return F.when(letters > 0, F.regexp_count(text, F.lit(pattern)) / letters).otherwise(F.lit(0.0))


def n_words(text: Column) -> Column:
    """Words of a text whose white space has been squashed."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def has_ethiopic(text: Column) -> Column:
    return text.rlike(cc.ETHIOPIC)


def reject_reason(en: Column, am: Column, cfg: FilterConfig | None = None) -> Column:
    """Why a normalized pair goes, or null. A null side counts as empty."""
    cfg = cfg or FilterConfig()
    en, am = F.coalesce(en, F.lit("")), F.coalesce(am, F.lit(""))
    either = lambda test: test(en) | test(am)
    ratio = F.length(en) / F.length(am)
    rules = [
        ("empty", either(lambda t: t == "")),
        ("identical", casefold(en) == casefold(am) if cfg.drop_identical else None),
        ("too_short", either(lambda t: F.length(t) < cfg.min_chars)),
        ("too_long", either(lambda t: F.length(t) > cfg.max_chars)),
        ("too_many_words", either(lambda t: n_words(t) > cfg.max_words)),
        ("ratio", (ratio > cfg.max_char_ratio) | (ratio < 1.0 / cfg.max_char_ratio)),
        ("am_script", share(cc.ETHIOPIC, am) < cfg.min_am_ethiopic_share),
        ("en_script", (share(cc.LATIN, en) < cfg.min_en_latin_share) | has_ethiopic(en)),
        ("url", either(lambda t: t.rlike(URL)) if cfg.drop_urls else None),
        ("markup", either(lambda t: t.rlike(MARKUP)) if cfg.drop_markup else None),
    ]
    case = None
    for name, test in rules:
        if test is not None:
            case = F.when(test, name) if case is None else case.when(test, name)
    return case


def wrong_direction(text: Column, direction: str) -> Column:
    """Whether the script contradicts the direction's source language."""
    return has_ethiopic(text) != F.lit(direction.startswith("am"))


def blank_as_empty(text: Column, output: Column) -> Column:
    """Blank inputs have empty outputs."""
    return F.when(F.regexp_replace(text, f"{cc.SPACE}+", "") == "", "").otherwise(output)


def request_error(texts: Column, beam: Column, penalty: Column, most_chars: int) -> Column:
    """Why a translation request is refused: 422 malformed, 413 too large; null if it is fine."""
    blank = F.exists(texts, lambda t: t.isNull())
    bad = texts.isNull() | (F.size(texts) < 1) | (F.size(texts) > 64) | blank | ~beam.between(1, 8) | ~penalty.between(0.0, 2.0)
    return F.when(F.coalesce(bad, F.lit(True)), 422).when(F.exists(texts, lambda t: F.length(t) > most_chars), 413)
