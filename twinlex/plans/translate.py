"""Translation of a table of sentences with any scorer: normalize, encode, search, decode. The network itself is plugged in."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlex.functions import filters, numeric
from twinlex.functions.normalize import normalize
from twinlex.operators import batching, vocabulary
from twinlex.operators.vocabulary import Vocabulary
from twinlex.plans import files

#: From rows (item, beam, src array<int>, tokens array<int>) to the same with logits array<double> for the next token.
Scorer = Callable[[DataFrame], DataFrame]


def search(sources: DataFrame, scorer: Scorer, work: str, size: int = 4, alpha: float = 1.0, a: float = 1.5, b: int = 10, cap: int = 254, forbidden: tuple[int, ...] = (batching.PAD, batching.BOS, batching.UNK, batching.TO_AM, batching.TO_EN)) -> DataFrame:
    """Beam search over sources(item, src): rows (item, tokens, score), the best hypothesis of each item.

    All items advance together, one written table a step in the folder `work`: the beams that go on, and the hypotheses that end
    in it. An item leaves when `size` hypotheses have ended; what is still open at its bound is closed there. What an item may
    take is bounded by its own source, so results don't depend on the other items. With size 1 this is greedy decoding. `cap`
    bounds every item. The steps' tables are deleted at the end.
    """
    spark, run = sources.sparkSession, f"{work}/{uuid.uuid4().hex}"

    def kept(rows: DataFrame, path: str) -> DataFrame:
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    bound = F.least(F.lit(cap), F.floor(F.size("src") * a + b)).cast("int")
    items = kept(sources.select("item", "src", bound.alias("bound")), f"{run}/items")
    beams = items.select("item", F.lit(0).alias("beam"), F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("tokens"), "bound", F.lit(0).cast("bigint").alias("had"))
    longest = items.agg(F.max("bound")).first()[0] or 0
    paths: list[str] = []
    for step in range(longest):
        scored = scorer(beams.select("item", "beam", "score", "tokens").join(items.select("item", "src"), "item"))
        paths.append(f"{run}/step-{step}")
        done = kept(_advanced(numeric.continued(scored.select("item", "beam", "score", "tokens", "logits"), size, forbidden), beams, size, step, alpha), paths[-1])
        beams = done.filter("not ended").drop("ended")
        if beams.isEmpty():
            break
    empty = F.array().cast("array<int>")
    if paths:
        ended = spark.read.schema(done.schema).parquet(*paths).filter("ended")
        best = ended.groupBy("item").agg(F.max_by(F.struct("tokens", "score"), F.struct("score", F.size("tokens"))).alias("h"))
        out = items.select("item").join(best, "item", "left").select("item", F.coalesce("h.tokens", empty).alias("tokens"), F.col("h.score").alias("score"))
    else:
        out = items.select("item", empty.alias("tokens"), F.lit(None).cast("double").alias("score"))
    found = kept(out, f"{run}-found")
    files.delete(spark, run)
    return found


def _advanced(ranked: DataFrame, beams: DataFrame, size: int, step: int, alpha: float) -> DataFrame:
    """One step for numeric.continued() rows: rows like beams, and ended, true for hypotheses, whose score is final.

    Of an item's continuations an end among the first `size` is taken until the item has `size` of them; then nothing goes on.
    """
    state = beams.filter("beam = 0").select("item", "bound", "had")
    so_far = Window.partitionBy("item").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.col("token") == batching.EOS) & (F.col("rank") <= size)
    rows = ranked.join(state, "item").withColumns({"nth": F.count_if(end).over(so_far), "slot": F.count_if(F.col("token") != batching.EOS).over(so_far)})
    rows = rows.withColumn("taken", end & (F.col("had") + F.col("nth") <= size))
    rows = rows.withColumn("had", F.col("had") + F.count_if("taken").over(Window.partitionBy("item")))
    rows = rows.withColumn("going", (F.col("token") != batching.EOS) & (F.col("slot") <= size) & (F.col("had") < size)).filter("taken or going")
    ended = F.col("taken") | (F.col("bound") <= step + 1)
    score = F.when(ended, F.col("total") / numeric.length_penalty(F.lit(step + 1), alpha)).otherwise(F.col("total"))
    tokens = F.when(F.col("taken"), F.col("tokens")).otherwise(F.concat("tokens", F.array("token")))
    return rows.select("item", (F.col("slot") - 1).cast("int").alias("beam"), score.alias("score"), tokens.alias("tokens"), "bound", "had", ended.alias("ended"))


def translate(rows: DataFrame, learnt: Vocabulary, scorer: Scorer, direction: str, work: str, max_len: int = 128, **options) -> DataFrame:
    """Rows (idx, text, output) in any order, idx and text as given; blank texts have empty outputs."""
    source, target = batching.LANGUAGES[direction]
    spark = rows.sparkSession
    clean = rows.select(F.col("idx").alias("item"), "text", normalize(F.coalesce("text", F.lit("")), source).alias("clean"))
    ids = clean.withColumn("ids", vocabulary.encoded(F.col("clean"), learnt, spark))
    framed = ids.select("item", batching.truncated_source(F.col("ids"), learnt.lang_id(target), max_len).alias("src"))
    found = search(framed, scorer, work, cap=max_len - batching.FRAME, **options)
    out = rows.join(found.select(F.col("item").alias("idx"), vocabulary.decoded(F.col("tokens"), learnt, spark).alias("decoded")), "idx", "left")
    return out.select("idx", "text", filters.blank_as_empty(F.coalesce("text", F.lit("")), F.coalesce("decoded", F.lit(""))).alias("output"))
