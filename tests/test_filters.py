"""Every rule at its threshold, just below and just above; which of two broken rules is named; rules switched off."""

import itertools

import pytest
from pyspark.sql import functions as F

from twinlex.functions import filters
from twinlex.plans.config import FilterConfig

CFG = FilterConfig()
ETHIOPIC, LATIN = "በ", "b"


def reasons(spark, pairs, cfg=None):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, en string, am string")
    return [r.r for r in rows.select("i", filters.reject_reason(F.col("en"), F.col("am"), cfg).alias("r")).orderBy("i").collect()]


def plain(n, letter):
    """n characters of one letter."""
    return letter * n


def shared(n, of):
    """of letters, n of which are Ethiopic and the others Latin."""
    return ETHIOPIC * n + LATIN * (of - n)


def at(limit, make, broken_above, reason):
    """(pair, reason) at a limit and one to either side of it."""
    return [(make(limit + d), reason if (d > 0) == broken_above and d else None) for d in (-1, 0, 1)]


THRESHOLDS = {
    "characters at least": at(CFG.min_chars, lambda n: (plain(n, LATIN), plain(2, ETHIOPIC)), False, "too_short"),
    "characters at most": at(CFG.max_chars, lambda n: (plain(n, LATIN), plain(n, ETHIOPIC)), True, "too_long"),
    "words at most": at(CFG.max_words, lambda n: (" ".join([LATIN] * n), " ".join([ETHIOPIC] * n)), True, "too_many_words"),
    "longer English": at(30, lambda n: (plain(n, LATIN), plain(10, ETHIOPIC)), True, "ratio"),
    "longer Amharic": at(30, lambda n: (plain(10, LATIN), plain(n, ETHIOPIC)), True, "ratio"),
    "Ethiopic share": at(12, lambda n: (plain(20, LATIN), shared(n, 20)), False, "am_script"),
}


@pytest.mark.parametrize("rule", THRESHOLDS)
def test_limits_are_inclusive(spark, rule):
    pairs, expected = zip(*THRESHOLDS[rule], strict=True)
    assert reasons(spark, pairs) == list(expected)


def test_latin_share_counts_letters_and_one_ethiopic_letter_is_too_many(spark):
    other = "ж"
    pairs = [(LATIN * n + other * (10 - n), plain(10, ETHIOPIC)) for n in (5, 6, 10)] + [(LATIN * 19 + ETHIOPIC, plain(20, ETHIOPIC)), ("1234567890", plain(10, ETHIOPIC))]
    assert reasons(spark, pairs) == ["en_script", None, None, "en_script", "en_script"]


def test_links_and_markup_on_either_side(spark):
    links = ["http://a", "HTTPS://a.b", "www.a", "no www. here", "http:// a"]
    marks = ["<i>", "</p >", "&copy;", "&#12;", "%d", "%(name)s", "{0}", "{}", "_BAR_", "a < b > c", "100 %", "& co"]
    body = (plain(12, LATIN), plain(12, ETHIOPIC))
    for found, expected in ((links, ["url"] * 3 + [None] * 2), (marks, ["markup"] * 9 + [None] * 3)):
        assert reasons(spark, [(f"{body[0]} {x}", body[1]) for x in found]) == expected
        assert reasons(spark, [(body[0], f"{plain(18, ETHIOPIC)} {x}") for x in found]) == expected


def test_missing_sides_are_empty(spark):
    sides = ("", None, plain(5, LATIN))
    pairs = list(itertools.product(sides, (*sides[:2], plain(5, ETHIOPIC))))
    assert reasons(spark, pairs) == ["empty"] * (len(pairs) - 1) + [None]


def test_the_first_broken_rule_is_named(spark):
    """Each text breaks its own rule and at least one that comes later."""
    long, many = plain(CFG.max_chars + 1, LATIN), " ".join([LATIN] * (CFG.max_words + 1))
    ordered = [("", "http://x"), ("Tag <b>", "tag <B>"), ("b", "<b>"), (long, "bb"), (many, "bb"), (plain(40, LATIN), "bb"), (plain(8, LATIN), "http://x"), ("жжжж www.x", plain(10, ETHIOPIC)), ("bbbb www.x {}", plain(10, ETHIOPIC))]
    assert reasons(spark, ordered) == ["empty", "identical", "too_short", "too_long", "too_many_words", "ratio", "am_script", "en_script", "url"]
    assert list(dict.fromkeys(r for r in filters.REASONS if r != "markup")) == reasons(spark, ordered)


@pytest.mark.parametrize("flag, text", [("drop_urls", "www.b"), ("drop_markup", "{b}")])
def test_rules_can_be_switched_off(spark, flag, text):
    pairs = [(f"{plain(9, LATIN)} {text}", plain(12, ETHIOPIC))]
    assert reasons(spark, pairs) != [None] and reasons(spark, pairs, FilterConfig(**{flag: False})) == [None]
    if flag == "drop_urls":
        same = [(plain(9, LATIN), plain(9, LATIN).upper())]
        assert (reasons(spark, same), reasons(spark, same, FilterConfig(drop_identical=False))) == (["identical"], ["am_script"])


def test_requests_at_their_limits(spark):
    good = (["text"], 4, 1.0)
    cases = [good, (["t"] * 64, 8, 2.0), (["t"], 1, 0.0), (["t" * 10], 1, 0.0)]
    bad = [([], 4, 1.0), (["t"] * 65, 4, 1.0), (["t"], 0, 1.0), (["t"], 9, 1.0), (["t"], 4, -0.1), (["t"], 4, 2.1), (None, 4, 1.0), ([None], 4, 1.0), (["t"], None, 1.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate([*cases, *bad, (["t" * 11], 1, 0.0)])], "i int, t array<string>, b int, p double")
    found = [r.e for r in rows.select("i", filters.request_error(F.col("t"), F.col("b"), F.col("p"), 10).alias("e")).orderBy("i").collect()]
    assert found == [None] * len(cases) + [422] * len(bad) + [413]


def test_direction_and_blank_texts(spark):
    row = spark.range(1).select(
        filters.wrong_direction(F.lit(ETHIOPIC), "en-am").alias("a"), filters.wrong_direction(F.lit(LATIN), "en-am").alias("b"), filters.wrong_direction(F.lit(LATIN), "am-en").alias("c"),
        filters.blank_as_empty(F.lit(" \n"), F.lit("out")).alias("d"), filters.blank_as_empty(F.lit(" . "), F.lit("out")).alias("e"),
    ).first()
    assert tuple(row) == (True, False, True, "", "out")
