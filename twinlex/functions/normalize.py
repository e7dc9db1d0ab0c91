"""Normalization of English and Amharic text as Column expressions.

Everything stays in the JVM but canonical composition and entity decoding, for which Spark has no function; only texts that
need either are sent to an Arrow UDF.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from twinlex.functions import charclass as cc
from twinlex.functions.expr import once

# Fixed values, on which results depend: code points that are deleted, quotes with their plain forms, folded letters, numerals,
# and the marks that spaces are taken from and that are written once.
INVISIBLE = "​‌‍⁠﻿­"
QUOTES_FROM, QUOTES_TO = "“”„‘’‚´", "\"\"\"''''"
#: Series of letters that sound alike, as (first, last, first of the series kept).
FOLDED_SERIES = ((0x1210, 0x1216, 0x1200), (0x1217, 0x1217, 0x128B), (0x1280, 0x1286, 0x1200), (0x1287, 0x1287, 0x128B), (0x1220, 0x1227, 0x1230), (0x12D0, 0x12D6, 0x12A0), (0x1340, 0x1347, 0x1338))
#: Ge'ez numerals in code point order from U+1369, and what each is worth.
NUMERALS = "".join(map(chr, range(0x1369, 0x137D)))
NUMERAL_VALUES = (*range(1, 10), *range(10, 100, 10), 100, 10_000)
WORDSPACE, FULL_STOP = "፡", "።"
_BEFORE_MARK = r"([።-፨,.;:!?%)\]}])"
_REPEATABLE = r"([።-፦,;:!?])"


#: Rows of a batch that are Python objects at a time.
_ROWS = 64


@F.arrow_udf(StringType())
def _compose_and_unescape(texts: pa.Array) -> pa.Array:
    one = lambda t: None if t is None else html.unescape(unicodedata.normalize("NFC", t))
    parts = [pa.array(map(one, texts.slice(at, _ROWS).to_pylist()), pa.string()) for at in range(0, len(texts), _ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def compose_and_unescape(text: Column) -> Column:
    """NFC, then HTML entities decoded once. Texts that neither can change don't leave the JVM."""
    affected = F.contains(text, F.lit("&")) | text.rlike("[^" + cc.COMPOSED[1:])
    return F.coalesce(_compose_and_unescape(F.when(affected, text)), text)  # no lambda: Spark runs no Python in one


def _where(text: Column, test: Callable[[Column], Column], rule: Callable[[Column], Column]) -> Column:
    """rule(text) for the texts that pass a cheap test, others as they are; text is evaluated once."""
    return once(text, lambda t: F.when(test(t), rule(t)).otherwise(t))


def _with(mark: str) -> Callable[[Column], Column]:
    return lambda t: F.contains(t, F.lit(mark))


def strip_invisible(text: Column) -> Column:
    return _where(text, lambda t: t.rlike(f"[{INVISIBLE}]"), lambda t: F.translate(t, INVISIBLE, ""))


def blank_controls(text: Column) -> Column:
    """Control characters but tab and line ends become spaces."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")


def straighten_quotes(text: Column) -> Column:
    return _where(text, lambda t: t.rlike(f"[{QUOTES_FROM}]"), lambda t: F.translate(t, QUOTES_FROM, QUOTES_TO))


def undo_escapes(text: Column, space: str = cc.SPACE) -> Column:
    """`a @-@ b` becomes `a-b`; so for commas and stops."""
    return _where(text, _with("@"), lambda t: F.regexp_replace(t, f"{space}*@([-,.])@{space}*", "$1"))


def plain_spaces(text: Column) -> Column:
    """All white space and control characters become spaces, one each. Rules that follow need to know but one space then."""
    return F.regexp_replace(text, cc.NOT_PLAIN, " ")


def clean(text: Column) -> Column:
    """What both languages need first: composed, unescaped, nothing invisible, plain spaces and quotes, no escapes."""
    text = _where(compose_and_unescape(text), lambda t: t.rlike("[\xad\xb4\u200b-\u2060\ufeff]"), lambda t: F.translate(F.translate(t, INVISIBLE, ""), QUOTES_FROM, QUOTES_TO))
    return undo_escapes(plain_spaces(text), " ")


def fold_homophones(text: Column) -> Column:
    pairs = [(chr(c), chr(to + c - first)) for first, last, to in FOLDED_SERIES for c in range(first, last + 1)]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def numeral_value(run: Column) -> Column:
    """A Ge'ez numeral's value (bigint): units and tens add up, 100 multiplies what stands before it, 10,000 everything so far."""
    values = F.array(*[F.lit(v).cast("bigint") for v in NUMERAL_VALUES])
    digits = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.get(values, F.instr(F.lit(NUMERALS), c) - 1))
    zero = F.lit(0).cast("bigint")
    or_one = lambda c: F.when(c == 0, F.lit(1).cast("bigint")).otherwise(c)
    make = lambda total, block, low: F.struct(total.alias("total"), block.alias("block"), low.alias("low"))

    def step(s: Column, v: Column) -> Column:
        hundred = make(s["total"], s["block"] + or_one(s["low"]) * 100, zero)
        myriad = make(s["total"] + or_one(s["block"] + s["low"]) * 10_000, zero, zero)
        return F.when(v < 100, make(s["total"], s["block"], s["low"] + v)).when(v == 100, hundred).otherwise(myriad)

    return F.aggregate(digits, make(zero, zero, zero), step, lambda s: s["total"] + s["block"] + s["low"])


def numerals_to_digits(text: Column) -> Column:
    """Every run of Ge'ez numerals replaced by its value: the pieces between runs, and the values, set in turn."""
    runs = f"[{NUMERALS[0]}-{NUMERALS[-1]}]+"

    def written(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(runs), F.lit(0)), lambda r: numeral_value(r).cast("string"))
        both = F.zip_with(F.split(t, runs, -1), found, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
        return F.when(t.rlike(runs), F.array_join(both, "")).otherwise(t)

    return once(text, written)


def detokenize(text: Column, space: str = cc.SPACE) -> Column:
    text = F.regexp_replace(text, f"{space}+{_BEFORE_MARK}", "$1")
    text = _where(text, lambda t: t.rlike(r"[(\[{]"), lambda t: F.regexp_replace(t, rf"([(\[{{]){space}+", "$1"))
    text = _where(text, _with('"'), lambda t: F.regexp_replace(t, f'"{space}+([^"]*?){space}+"', '"$1"'))
    text = _where(text, _with(":"), lambda t: F.regexp_replace(t, f"({cc.DIGIT}):{space}+({cc.DIGIT})", "$1:$2"))
    return collapse_marks(text)


def collapse_marks(text: Column) -> Column:
    """A repeated mark is written once; dots stay."""
    return F.regexp_replace(text, rf"{_REPEATABLE}\1+", "$1")


def squash_space(text: Column, runs: str = cc.SPACE + "+") -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, runs, " "))


def join_clitics(text: Column, space: str = cc.SPACE) -> Column:
    return _where(text, _with("'"), lambda t: F.regexp_replace(t, f"(?i)({cc.WORD}) ?'{space}?(s|t|re|ve|ll|d|m)(?!{cc.WORD})", "$1'$2"))


def wordspaces(text: Column, space: str = cc.SPACE) -> Column:
    """Two word spaces are a full stop; a single one is a space."""
    return _where(text, _with(WORDSPACE), lambda t: F.replace(F.regexp_replace(t, f"{WORDSPACE}{space}*{WORDSPACE}", FULL_STOP), F.lit(WORDSPACE), F.lit(" ")))


def normalize_amharic(text: Column, fold: bool = True, digits: bool = True) -> Column:
    text = wordspaces(clean(text), " ")
    if fold:
        text = fold_homophones(text)
    if digits:
        text = numerals_to_digits(text)
    return squash_space(detokenize(text, " "), " {2,}")


def normalize_english(text: Column) -> Column:
    return squash_space(detokenize(join_clitics(clean(text), " "), " "), " {2,}")


def normalize(text: Column, lang: str, fold: bool = True, digits: bool = True) -> Column:
    if lang not in ("en", "am"):
        raise ValueError(f"unknown language {lang!r}")
    return normalize_english(text) if lang == "en" else normalize_amharic(text, fold, digits)


#: What isn't surely folded by lower() but for sharp s and the micro sign: all but Latin-1 and Ethiopic.
UNCASED = r"[^\x00-\xff\u1200-\u137f]"


@cache
def folds() -> tuple[str, str, dict[str, str]]:
    """Full case folding by the interpreter's Unicode data: code points that become one other, what they become, and those that become several."""
    changed = {c: f for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if (f := c.casefold()) != c}
    one = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in changed.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding of every code point, in the JVM.

    Latin-1 and Ethiopic texts need lower() alone, but for sharp s and the micro sign. In others the few code points that become
    several are written out first (sharp s by itself, as it is frequent; the rest only where a text has one), then all others
    are translated.
    """
    before, after, several = folds()
    rest = {c: f for c, f in several.items() if c not in "ßẞ"}
    table = F.str_to_map(F.lit(",".join(map("=".join, rest.items()))), F.lit(","), F.lit("="))  # one node of a plan, folded to a literal

    def full(t: Column) -> Column:
        t = F.replace(F.replace(t, F.lit("ẞ"), F.lit("ss")), F.lit("ß"), F.lit("ss"))
        written = F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        return F.translate(F.when(t.rlike(f"[{_ranges(rest)}]"), written).otherwise(t), before, after)

    plain = lambda t: F.lower(F.replace(F.replace(t, F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ")))
    return once(text, lambda t: F.when(t.rlike(UNCASED), full(t)).otherwise(plain(t)))


def _ranges(chars: Iterable[str]) -> str:
    """The characters as ranges of a regex class: Java tests the members of a class one after another."""
    points, found = sorted(map(ord, chars)), []
    for p in points:
        if found and p == found[-1][1] + 1:
            found[-1][1] = p
        else:
            found.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in found)


def dedup_key(text: Column) -> Column:
    """Letters and digits alone, case folded."""
    return casefold(F.regexp_replace(text, cc.NOT_WORD_RUN, ""))


def key_hash(key_en: Column, key_am: Column) -> Column:
    return F.xxhash64(key_en, key_am)
