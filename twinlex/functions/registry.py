"""Rules of this package as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from twinlex.functions import charclass as cc
from twinlex.functions.normalize import FOLDED_SERIES, UNCASED, folds

_FROM = "".join(chr(c) for first, last, _ in FOLDED_SERIES for c in range(first, last + 1))
_TO = "".join(chr(to + c - first) for first, last, to in FOLDED_SERIES for c in range(first, last + 1))


def _raw(pattern: str) -> str:
    return "r'" + pattern + "'"


def _share(pattern: str) -> str:
    letters = f"regexp_count(t, {_raw(cc.LETTER)})"
    return f"case when {letters} > 0 then regexp_count(t, {_raw(pattern)}) / {letters} else 0.0D end"


def _casefold(text: str) -> str:
    """normalize.casefold as SQL, from the same tables."""
    before, after, several = folds()
    rest = {c: f for c, f in several.items() if c not in "ßẞ"}
    table = f"str_to_map('{','.join(map('='.join, rest.items()))}', ',', '=')"
    sharp = "replace(replace(x, 'ẞ', 'ss'), 'ß', 'ss')"
    written = f"array_join(transform(regexp_extract_all({sharp}, {_raw('(?s).')}, 0), c -> coalesce(try_element_at({table}, c), c)), '')"
    full = f"translate(case when x rlike '[{''.join(rest)}]' then {written} else {sharp} end, '{before}', '{after}')"
    plain = "lower(replace(replace(x, 'ß', 'ss'), 'µ', 'μ'))"
    folded = f"case when x rlike {_raw(UNCASED)} then {full} else {plain} end"
    return f"transform(array({text}), x -> {folded})[0]"


#: Name, parameters, type, body.
FUNCTIONS = (
    ("dedup_key", "t string", "string", _casefold(f"regexp_replace(t, {_raw(cc.NOT_WORD_RUN)}, '')")),
    ("fold_homophones", "t string", "string", f"translate(t, '{_FROM}', '{_TO}')"),
    ("squash_space", "t string", "string", f"trim(regexp_replace(t, {_raw(cc.SPACE + '+')}, ' '))"),
    ("ethiopic_share", "t string", "double", _share(cc.ETHIOPIC)),
    ("latin_share", "t string", "double", _share(cc.LATIN)),
    ("length_penalty", "n double, alpha double", "double", "pow((5.0D + n) / 6.0D, alpha)"),
    ("inverse_sqrt_factor", "step bigint, warmup bigint", "double", "case when greatest(step, 1) < warmup then greatest(step, 1) / warmup else sqrt(warmup / greatest(step, 1)) end"),
    ("perplexity", "nll double, n bigint", "double", "exp(nll / greatest(n, 1))"),
)


def register(spark: SparkSession, prefix: str = "twinlex_") -> list[str]:
    """Temporary SQL functions under these names; they are expanded into the query, so nothing leaves the JVM."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {prefix}{name}({parameters}) returns {kind} return {body}")
    return [f"{prefix}{name}" for name, *_ in FUNCTIONS]
