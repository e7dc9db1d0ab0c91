"""Spelling variants: words one edit apart, found by their three rarest bigrams, and the form that each one probably stands for.

An edit touches two bigrams of a word at most. So of three bigrams one is left, and two words that are one edit apart share one
of the three that come first in any common order, at the same place or at the next one. The order is by frequency, rarest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlex.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What words consist of once they are in lower case.
LETTERS = "a-zÀ-ÿ"
#: One run of so many, by checksum, loses a code point.
DELETES = 97
#: Bigrams kept of a word: one more than an edit can touch.
RAREST = 3
#: Words under one bigram, place and length from which on they are told apart by what is left without a code point, too.
HOT = 128


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """Rows (word, n): words of least_chars code points and least_n occurrences over whole texts, with seeded deletions.

    A run whose checksum with its row's key is divisible by 97 loses one code point. A null text has no words, a null key is
    written as nothing; rows that repeat a key count each. Very long texts are taken whole. An empty table gives no rows.
    """
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(plain, F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    h, size = F.crc32(F.concat("k", F.lit(":"), "run")), F.char_length("run")
    at = F.pmod(F.col("h"), size).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, size))
    found = runs.withColumn("h", h).select(F.when(F.col("h") % DELETES == 0, cut).otherwise(F.col("run")).alias("word"))
    return found.filter(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _without(word: str | Column, at: str | Column) -> Column:
    """The word without the code point at this place (from 1)."""
    return F.concat(F.substr(word, F.lit(1), at - 1), F.substr(word, at + 1, F.char_length(word)))


def prefixes(vocabulary: DataFrame, rarest: int = RAREST) -> DataFrame:
    """Rows (word, n, size, gram, at): the bigrams of each word that are rarest over all words; ties by bigram, then place."""
    size = F.char_length("word")
    each = vocabulary.select("word", "n", size.alias("size"), F.explode(F.sequence(F.lit(1), size - 1)).alias("at")).withColumn("gram", F.substr("word", F.col("at"), F.lit(2)))
    order = each.groupBy("gram").agg(F.count("*").alias("often"))  # at most the square of the alphabet
    ranked = each.join(order, "gram").groupBy("word").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("often", "gram", "at"))).alias("grams"))
    return ranked.select("word", "n", "size", F.explode(F.slice("grams", 1, rarest)).alias("g")).select("word", "n", "size", "g.gram", "g.at")


def pairs(vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows (word, n, other, other_n), both ways, for all words one edit apart; vocabulary has different words of four bigrams or more.

    Words meet under a bigram, its place and a length: those of the same length at the same place, longer ones by one at the same
    place or the next. Where more than `hot` words meet, they do so under what is left without one code point as well, which
    words one edit apart share, and which few words share: as many as there are places and letters.
    """
    found = common.stored(prefixes(vocabulary), "prefixes")
    spot = ["size", "gram", "at"]
    crowded = common.stored(found.groupBy(*spot).agg(F.count("*").alias("many")).filter(F.col("many") > hot).select(*spot, F.lit(True).alias("crowded")), "crowded")
    places = F.sequence(F.lit(1), F.char_length("word"))
    replaced = F.transform(places, lambda i: F.xxhash64(i, _without("word", i)))
    deleted = F.array_distinct(F.transform(places, lambda i: F.xxhash64(_without("word", i))))
    meets = F.array(*[F.struct((F.col("size") + d).alias("size"), (F.col("at") + s).alias("at"), F.lit(d).alias("longer")) for d, s in ((0, 0), (1, 0), (1, 1))])
    probes = found.select("word", "n", "gram", F.explode(meets).alias("m")).select("word", "n", "m.size", "gram", "m.at", "m.longer")
    a = _keyed(probes, crowded, spot, F.when(F.col("longer") == 0, replaced).otherwise(F.array(F.xxhash64("word")))).alias("a")
    b = _keyed(found.withColumn("longer", F.lit(0)), crowded, spot, F.concat(replaced, deleted)).drop("longer").alias("b")
    # keys are hashes: what meets by chance falls to the verification
    close = ((F.col("a.longer") == 1) | (F.col("a.word") < F.col("b.word"))) & (F.char_length("b.word") == F.char_length("a.word") + F.col("a.longer")) & (F.levenshtein("a.word", "b.word", 1) == 1)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & close).select(F.col("a.word"), F.col("a.n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct()
    return met.select(F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p")).select("p.*")


def _keyed(rows: DataFrame, crowded: DataFrame, spot: list[str], variants: Column) -> DataFrame:
    """Rows (key, word, n, longer): under its spots that aren't crowded, and, once for all that are, under its variants."""
    marked = rows.join(crowded, spot, "left")
    plain = marked.filter("crowded is null").select(F.xxhash64(*spot).alias("key"), "word", "n", "longer")
    rest = marked.filter("crowded").select("word", "n", "longer").distinct()
    return plain.unionByName(rest.select(F.explode(variants).alias("key"), "word", "n", "longer"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for rows (word, form): the end of each chain of forms, which must not run in circles.

    Every round doubles the steps that are known; counts double with each step of a chain, so chains are short.
    """
    now = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = common.stored(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        common.drop_stored(now)
        now = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of words().

    form: the most frequent word one edit away (ties: the first in code-point order), if it is twice as frequent at least; root:
    the last of the chain of forms, the word itself without one. Odd rows: see words().
    """
    vocabulary = common.stored(words(docs, key, text), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = pairs(vocabulary, hot).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.word"))
    found = common.stored(vocabulary.join(near, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
