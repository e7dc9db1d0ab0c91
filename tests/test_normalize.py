import pytest
from pyspark.sql import functions as F

from twinlex.functions import normalize as n

# Texts with known results.
AMHARIC = [
    ("ሐ", "ሀ"), ("ኀ", "ሀ"), ("ሠላም", "ሰላም"), ("ዓመት", "ኣመት"), ("ፀሐይ", "ጸሀይ"), ("ሕይወት", "ህይወት"), ("ሰላም", "ሰላም"),
    ("ሰላም፡ለዓለም፡ ፡", "ሰላም ለኣለም።"), ("ሰላም ፡ ፡ እንዴት", "ሰላም። እንዴት"), ("ይናገር ነበር ፤ ደግሞም ።", "ይናገር ነበር፤ ደግሞም።"),
    ("( ሰሎሞን ) ስለ", "(ሰሎሞን) ስለ"), ("ሰላም ።።።", "ሰላም።"), ("  ሰላም​  \tለዓለም \n", "ሰላም ለኣለም"),
    ('" ሰላም ለዓለም " አለ ።', '"ሰላም ለኣለም" አለ።'), ("በ፲፱፻፺፪ ዓ.ም", "በ1992 ኣ.ም"), ("፩፪ x ፻", "3 x 100"),
]
ENGLISH = [
    ("Jehovah 's creation , he said .", "Jehovah's creation, he said."), ("don 't do it !", "don't do it!"), ("I 'm here ; you 're not", "I'm here; you're not"),
    ("[ Solomon ] spoke", "[Solomon] spoke"), ('She said : " I was well . "', 'She said: "I was well."'), ("- Psalm 55 : 22 .", "- Psalm 55:22."),
    ("at 10 : 30 and 11 : 45", "at 10:30 and 11:45"), ('He said " hi', 'He said " hi'), ("Note: see below", "Note: see below"),
    ("wrong @-@ doers &amp; others", "wrong-doers & others"), ("&quot;hi&quot;", '"hi"'), ("“Hello” it’s", "\"Hello\" it's"), ("éa", "éa"), ("a...b !!!", "a...b!"), ("a\x1cb\x07c", "a b c"),
]
NUMERALS = {"፩": 1, "፲": 10, "፲፪": 12, "፻": 100, "፪፻": 200, "፪፻፲": 210, "፲፱፻፺፪": 1992, "፼": 10_000, "፪፼": 20_000, "፲፼": 100_000, "፻፼": 1_000_000, "፩፼፭፻": 10_500}


def apply(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


def test_amharic(spark):
    assert apply(spark, [a for a, _ in AMHARIC], n.normalize_amharic) == [b for _, b in AMHARIC]


def test_english(spark):
    assert apply(spark, [a for a, _ in ENGLISH], n.normalize_english) == [b for _, b in ENGLISH]


@pytest.mark.parametrize(("cases", "f"), [(AMHARIC, n.normalize_amharic), (ENGLISH, n.normalize_english)])
def test_idempotent(spark, cases, f):
    once = [b for _, b in cases]
    assert apply(spark, once, f) == once


def test_numerals(spark):
    assert apply(spark, list(NUMERALS), n.numeral_value) == list(NUMERALS.values())
    assert apply(spark, ["በ፲፱፻፺፪ ዓ.ም", "፩a፪", "none", ""], n.numerals_to_digits) == ["በ1992 ዓ.ም", "1a2", "none", ""]


def test_flags(spark):
    assert apply(spark, ["ሐሰት"], lambda c: n.normalize_amharic(c, fold=False)) == ["ሐሰት"]
    assert apply(spark, ["በ፲፱፻፺፪ ዓ.ም"], lambda c: n.normalize_amharic(c, digits=False)) == ["በ፲፱፻፺፪ ኣ.ም"]
    with pytest.raises(ValueError, match="unknown language"):
        n.normalize(F.lit("x"), "xx")


def test_dedup_key(spark):
    a, b, c, d, e, f, g = apply(spark, ["Hello, World!", "hello world", "ሰላም ለዓለም።", "ሰላምለዓለም", "Straße_1", "STRASSE 1", None], n.dedup_key)
    assert a == b and c == d and e == f == "strasse1" and g is None


def test_null_and_composed_texts(spark):
    assert apply(spark, [None, "", "é", "&#233;&lt;"], n.compose_and_unescape) == [None, "", "é", "é<"]


def test_casefold_is_full_on_every_code_point(spark):
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    rows = ["|".join(every[i : i + 2048]) for i in range(0, len(every), 2048)] + ["ΣΑΣ ς ẞß ﬃ İI ŉ ǰ", "plain ASCII", "ሰላም Word", ""]
    assert apply(spark, rows, n.casefold) == [r.casefold() for r in rows]


def test_the_sql_function_folds_alike(spark):
    from twinlex.functions import registry

    registry.register(spark, "nf_")
    texts = ["Straße 12", "ΣΑΣ ς, ﬃ İ ŉ", "ሰላም Word", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.selectExpr("nf_dedup_key(t)").collect()] == apply(spark, texts, n.dedup_key)
