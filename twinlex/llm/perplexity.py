"""Quality rules: counts on words and lines, and perplexity bands under a modified Kneser-Ney model of characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlex.llm import common

#: Bits of a symbol, and symbols of an n-gram. ASCII characters are symbols of their own, others share what is left by a hash of
#: their code point; digits, and white space but newline, are one symbol each.
BITS, ORDER = 12, 4
MASK = (1 << BITS) - 1
#: Different n-grams of the longest order that are broadcast, some 50 MB whatever the corpus; where the texts hold rarer ones, they are
#: joined. A portable model (train()) holds as many, and a quarter of that for each order below.
MOST_GRAMS = 1 << 22
#: Logarithms of probabilities are whole numbers of such parts, so that sums don't depend on how rows are laid out.
PARTS = 1 << 24
#: How far a language's band goes beyond the quartiles of its log perplexities: in interquartile ranges, and in shares of the median at least.
BAND, LEAST = 1.5, 0.03
#: A text's band is wider by this over the root of its characters: how far a mean over few characters strays by chance.
SHORT = 1.5
#: Up to so many bands are broadcast; more are joined by shuffle.
MOST_LANGUAGES = 10_000
_ASCII = np.array([3 if 48 <= b <= 57 else 2 if b == 10 else 1 if b in (9, 11, 12, 13, 32) else 4 + b for b in range(128)], np.uint64)
_OTHERS = 4 + 128
_MARKS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, and how many characters each text has. Symbol 0 stands before a text."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _ASCII[points & np.uint32(127)]
    other = np.flatnonzero(points >= 128)
    symbols[other] = _OTHERS + (points[other].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(MASK + 1 - _OTHERS)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    n = np.diff(lead[at])
    key = symbols.copy()
    starts = (np.cumsum(n) - n)[n > 0]
    for back in range(1, ORDER):
        before = np.zeros_like(symbols)
        before[back:] = symbols[:-back] if len(symbols) > back else 0
        for k in range(back):  # nothing of the text before
            i = starts + k
            before[i[i < len(symbols)]] = 0
        key |= before << np.uint64(BITS * back)
    # a text shorter than the order lets the loop above reach into the next one only where that has its own start
    return key, n


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    starts, n = common.runs_of(keys)
    return keys[starts], n


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (gram bigint, n bigint) over all texts: summed within each task first, then by Spark."""
    common.share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in common.slices(batches, text):
            k, c = tallied(grams(*common.buffers(batch.column(0)))[0])
            both = np.concatenate([keys, k])
            order = np.argsort(both, kind="stable")
            starts, _ = common.runs_of(both[order])
            if len(starts):
                keys, n = both[order][starts], np.add.reduceat(np.concatenate([n, c])[order], starts)
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].astype(np.int64)), pa.array(n[i : i + (1 << 16)])], ["gram", "n"])

    return docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """For each order from the longest on: sorted hashes of the n-grams seen, their log-probabilities; and of the contexts, their log back-off weights."""

    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_b: list[np.ndarray]

    def log_prob(self, grams: np.ndarray, level: int = 0) -> np.ndarray:
        """Natural logarithms of the probabilities of the last symbols given those before."""
        if level == len(self.keys):
            return np.full(len(grams), -BITS * np.log(2), np.float32)
        keys = self.keys[level]
        if not len(keys):
            return self.log_prob(grams, level + 1)
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out = self.log_p[level][at]
        miss = np.flatnonzero(keys[at] != grams)
        if len(miss):
            rest = grams[miss]
            context = rest >> np.uint64(BITS)
            c = np.minimum(np.searchsorted(self.contexts[level], context), len(self.contexts[level]) - 1)
            weight = np.where(self.contexts[level][c] == context, self.log_b[level][c], np.float32(0))
            out[miss] = weight + self.log_prob(rest & np.uint64((1 << BITS * (ORDER - level - 1)) - 1), level + 1)
        return out


@dataclass
class Level:
    """The n-grams of one order that a model holds, sorted: their counts, what all n-grams of their contexts count, and the order's three discounts."""

    keys: np.ndarray
    n: np.ndarray
    total: np.ndarray
    discounts: list[float]


def discounts(t: list[int]) -> list[float]:
    """What n-grams counted once, twice, and more often lose: t holds how many are counted 1 to 4 times. A step without evidence loses half of it."""
    y = t[0] / (t[0] + 2 * t[1]) if t[0] + t[1] else 0.0
    return [min(max(i - (i + 1) * y * t[i] / t[i - 1], 0.0), float(i)) if t[i - 1] and t[i] else 0.5 * i for i in (1, 2, 3)]


def fit(levels: list[Level]) -> Model:
    """Interpolated modified Kneser-Ney, the longest order first: lower orders count the different symbols before an n-gram.

    A context backs off by what its n-grams lose and by all that those left out count, so that probabilities sum to 1.
    """
    none = lambda: [np.empty(0, np.uint64) for _ in levels]
    model = Model(none(), none(), none(), none())
    for level in reversed(range(ORDER)):
        at = levels[level]
        k, c, total = at.keys, at.n.astype(np.float64), at.total.astype(np.float64)
        if not len(k):
            continue
        take = np.choose(np.minimum(at.n, 3) - 1, at.discounts)
        context = k >> np.uint64(BITS)
        starts, sizes = common.runs_of(context)
        group = np.repeat(np.arange(len(starts)), sizes)
        weight = (total[starts] - np.bincount(group, c) + np.bincount(group, take)) / total[starts]
        below = np.exp(model.log_prob(k & np.uint64((1 << BITS * (ORDER - level - 1)) - 1), level + 1).astype(np.float64))
        p = (c - take) / total + weight[group] * below
        model.keys[level], model.contexts[level] = k, context[starts]
        model.log_p[level] = np.log(np.maximum(p, 1e-30)).astype(np.float32)
        model.log_b[level] = np.log(np.maximum(weight, 1e-30)).astype(np.float32)
    return model


def count_steps(table: DataFrame, most: int) -> tuple[int | None, int, dict[int, int]]:
    """Of rows (gram, n): the lowest count from which on at most `most` n-grams are found (None: none are), how many have less, and how many
    n-grams there are of each step by the step's lowest count.

    Counts fall into steps of a sixteenth of a power of two, small ones into one each, and a step is taken as a whole: what is found
    doesn't depend on the order of rows.
    """
    step = F.floor(F.log2("n") * 16)
    steps = table.groupBy(step.alias("step")).agg(F.count("*").alias("grams"), F.min("n").alias("n")).collect()  # some 700 rows
    have, least = 0, None
    for row in sorted(steps, key=lambda r: -r.n):
        if have + row.grams > most:
            break
        have, least = have + row.grams, row.n
    return least, sum(r.grams for r in steps) - have, {r.n: r.grams for r in steps}


def at_least(least: int | None) -> Column:
    return F.lit(False) if least is None else F.col("n") >= least


def held(table: DataFrame, most: int) -> Level:
    """What a portable model holds of all n-grams of an order, rows (gram, n): those from the lowest count on that at most `most` reach.

    A context has a symbol's number of n-grams at most, and so have the windows.
    """
    least, _, by_count = count_steps(table, most)
    context = Window.partitionBy(F.shiftright("gram", BITS))
    rows = table.withColumn("total", F.sum("n").over(context)).filter(at_least(least)).toArrow()
    keys, n, total = (rows.column(c).to_numpy() for c in ("gram", "n", "total"))
    order = np.argsort(keys)
    return Level(keys[order].astype(np.uint64), n[order], total[order], discounts([by_count.get(i, 0) for i in range(1, 5)]))


def shorter(level: int) -> Column:
    """Of the column gram, an n-gram of a level: all symbols but the first."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * (ORDER - level - 1)) - 1))


def train(docs: DataFrame, text: str = "text", most: int = MOST_GRAMS) -> Model:
    """A model of bounded size for other texts. Counts over every text, order by order; the driver gets the n-grams that the model holds.

    The mass of those left out backs off. judge() doesn't use it: probabilities() are those of all n-grams.
    """
    table, levels = common.stored(counts(docs, text), "ngrams"), []
    for level in range(ORDER):
        levels.append(held(table, most >> 2 * level))
        below = common.stored(table.groupBy(shorter(level).alias("gram")).agg(F.count("*").alias("n")), "ngrams") if level < ORDER - 1 else None
        common.drop_stored(table)
        table = below
    return fit(levels)


def probabilities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (gram, n, log_p): every n-gram of the longest order in the texts, its count, and the logarithm of its probability in PARTS.

    Interpolated modified Kneser-Ney as fit() has it, with nothing left out: each order is a window over contexts, which have a
    symbol's number of n-grams at most, and a join with the order below, whose n-grams are found under as many.
    """
    tables = [common.stored(counts(docs, text), "ngrams")]
    for level in range(ORDER - 1):
        tables.append(common.stored(tables[-1].groupBy(shorter(level).alias("gram")).agg(F.count("*").alias("n")), "ngrams"))
    context = Window.partitionBy(F.shiftright("gram", BITS))
    below = None
    for level in reversed(range(ORDER)):
        table = tables[level]
        seen = {r.n: r["count"] for r in table.filter("n <= 4").groupBy("n").count().collect()}
        take = discounts([seen.get(i, 0) for i in range(1, 5)])
        own = F.col("n") - F.when(F.col("n") == 1, take[0]).when(F.col("n") == 2, take[1]).otherwise(take[2])
        lost = sum(F.count(F.when(test, 1)).over(context) * F.lit(d) for test, d in zip((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2), take, strict=True))
        rows = table.select("gram", "n", own.alias("own"), lost.alias("lost"), F.sum("n").over(context).alias("total"))
        if below is None:
            rows = rows.withColumn("below", F.lit(2.0**-BITS))
        else:
            rows = rows.withColumn("shorter", shorter(level)).join(below.select(F.col("gram").alias("shorter"), F.col("p").alias("below")), "shorter")
        whole = common.stored(rows.select("gram", "n", ((F.col("own") + F.col("lost") * F.col("below")) / F.col("total")).alias("p")), "ngram-odds")
        for done in (table, below):
            if done is not None:
                common.drop_stored(done)
        below = whole
    return below.select("gram", "n", F.round(F.log(F.greatest("p", F.lit(1e-30))) * PARTS).cast("int").alias("log_p"))


def measures(texts: pa.Array, grams_held: np.ndarray, log_p: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """For each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, log_p (of the n-grams held, sorted ones).

    And all n-grams that aren't held, text after text, with where each text's begin (one more than texts).
    """
    raw, at = common.buffers(texts)
    n_docs = len(at) - 1
    inside = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    words, n = common.spaced_words(raw, at)
    doc = np.repeat(np.arange(n_docs), n)
    repeat = np.zeros(n_docs, np.int64)
    if len(words) > 2:
        coded = pc.dictionary_encode(words)
        ids, base = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        pair = ids[:-1] * base + ids[1:]
        if base >= 1 << 21:
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * base + ids[2:]
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        order = whole[np.lexsort((key[whole], doc[whole]))]
        k, d = key[order], doc[order]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.empty(0, bool)
        again = order[~(first & np.append(first[1:], True))]
        edge = np.bincount(again, minlength=len(words) + 3) - np.bincount(again + 3, minlength=len(words) + 3)
        repeat = np.bincount(doc[np.cumsum(edge)[: len(words)] > 0], minlength=n_docs)
    lines = pc.split_pattern(common.strings(raw, at), "\n")
    flat = lines.flatten()
    line_doc = np.repeat(np.arange(n_docs), np.diff(lines.offsets.to_numpy()))
    with_word = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
    line_ids = pc.dictionary_encode(flat).indices.to_numpy().astype(np.int64)
    owner = line_doc[with_word]
    different = np.unique(owner * max(len(flat), 1) + line_ids[with_word]) // max(len(flat), 1)
    dup = np.bincount(owner, minlength=n_docs) - np.bincount(different, minlength=n_docs)
    keys, chars = grams(raw, at)
    at_key = np.minimum(np.searchsorted(grams_held, keys), max(len(grams_held) - 1, 0))
    known = grams_held[at_key] == keys if len(grams_held) else np.zeros(len(keys), bool)
    each = np.where(known, log_p[at_key], 0) if len(grams_held) else np.zeros(len(keys), np.int64)
    stop = np.concatenate([[0], np.cumsum(chars)])
    found = {"n_words": n.astype(np.int64), "word_chars": chars - inside(blank), "n_symbols": inside(_MARKS[raw]), "n_dup_lines": dup, "n_repeat_words": repeat}
    found |= {"n_chars": chars, "log_p": np.diff(np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[stop])}
    return found, keys[~known], np.concatenate([[0], np.cumsum(~known)])[stop]


def measured(docs: DataFrame, odds: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_GRAMS) -> DataFrame:
    """Rows (key, lang, measures, log_perplexity (NaN without characters), base_failed), one for each row of docs.

    odds are the probabilities() of the same texts. The most frequent `most` n-grams are broadcast; the others of a text are listed
    with it and joined with theirs, each of which is listed as often as it was counted at most. The sums are the same for any `most`.
    """
    spark = docs.sparkSession
    common.share_package(spark)
    least, left, _ = count_steps(odds, most)
    top = odds.filter(at_least(least)).select("gram", "log_p").toArrow()
    grams_held, log_p = (top.column(c).to_numpy() for c in ("gram", "log_p"))
    order = np.argsort(grams_held)
    shared = spark.sparkContext.broadcast((grams_held[order].astype(np.uint64), log_p[order]))
    row, rest, more = common.fresh(docs.select(key), "_row", "_rest", "_more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            if batch.num_rows:
                found, others, at = measures(batch.column(3), *shared.value)
                others = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(others.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *[pa.array(v) for v in found.values()], others], [key, "lang", row, *found, rest])

    kind = docs.schema[key].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "log_p")
    rows = docs.select(F.col(key), F.col(lang).cast("string").alias("lang"), F.monotonically_increasing_id().alias(row), F.col(text).alias("text"))
    rows = common.stored(rows.mapInArrow(run, f"`{key}` {kind}, lang string, `{row}` bigint, {', '.join(f'{c} bigint' for c in names)}, `{rest}` array<bigint>"), "measures")
    total = F.col("log_p")
    if left:
        rare = odds.filter(~at_least(least)).select("gram", F.col("log_p").alias("_odds"))
        listed = rows.select(row, F.explode(rest).alias("gram"))
        rows = rows.join(listed.join(rare, "gram").groupBy(row).agg(F.sum("_odds").alias(more)), row, "left")
        total = total + F.coalesce(more, F.lit(0))
    log_perplexity = F.when(F.col("n_chars") > 0, -total / F.col("n_chars") / PARTS).otherwise(float("nan"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.select(key, "lang", *names[:5], log_perplexity.alias("log_perplexity"), base_failed.alias("base_failed"))
    return common.stored(rows, "perplexities") if left else rows


def bands(rows: DataFrame, width: float = BAND) -> DataFrame:
    """Rows (lang, low, high): a language's quartiles of log perplexity, moved outward by `width` interquartile ranges.

    Only texts that pass the base rules count, or all texts of a language of which none passes. A band goes
    beyond the quartiles by a share LEAST of the median at least.
    """
    usable = rows.filter(~F.isnan("log_perplexity"))
    q = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000)
    found = usable.groupBy("lang").agg(F.coalesce(q(F.when(~F.col("base_failed"), F.col("log_perplexity"))), q(F.col("log_perplexity"))).alias("q"))
    reach = F.greatest(width * (F.col("q")[2] - F.col("q")[0]), LEAST * F.col("q")[1])
    return found.select("lang", (F.col("q")[0] - reach).alias("low"), (F.col("q")[2] + reach).alias("high"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", width: float = BAND, most: int = MOST_GRAMS) -> DataFrame:
    """measured() rows with low, high and kept: passes the base rules, and its log perplexity lies within its language's band.

    One row for each row of docs. Null and empty texts have no words and fail the base rules; a null language is one of its
    own; repeated rows are judged each; an empty table gives an empty result.
    """
    rows = measured(docs, probabilities(docs, text), key, text, lang, most)
    slack = SHORT / F.sqrt(F.greatest("word_chars", F.lit(1)))
    limits = common.stored(bands(rows, width), "bands")
    limits = limits.withColumnRenamed("lang", "_lang")
    if limits.count() <= MOST_LANGUAGES:
        limits = F.broadcast(limits)
    inside = F.col("log_perplexity").between(F.col("low") - slack, F.col("high") + slack)
    return rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
