"""Near copies: groups of texts whose sets of five-word shingles have a Jaccard similarity of at least 4/5.

SimHash fingerprints of the shingles bring the closest texts together first, compared by their bits; each of their links is
verified by the whole sets. For links beyond the fingerprints' radius, every set is put into one order, rarer shingles first:
two sets as alike as this share a shingle among the first fifth of both. Texts that meet under a shingle are first held against
one of them, so that a group of near copies costs a row a text; only texts that stand in different groups then are compared
pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlex.llm import common, simhash

#: Words of a shingle.
WIDTH = 5
#: One text in _SAMPLE tells which shingles are frequent, at most _FREQUENT of them. This only sets their order, never the result.
_SAMPLE, _FREQUENT = 64, 1 << 20
#: Sets that a value may well be in, by the sample, before it counts as hot: what meets under it is found by aggregates, not in one task.
_HOT = 4096
_KNOWN = 1 << 18
#: Rows of one or two short columns that are broadcast at most; beyond, they are joined by shuffle.
_FEW = 1 << 18
#: Bits of a set's parities, at least and at most.
_BITS, _MOST_BITS = 1024, 1 << 20
#: 64-bit numbers of the shorter parities that a join compares by itself, before a pair becomes a row.
_SKETCH = 8
#: How often the sets under a value are held against one of them, before those that are still in different groups are compared in pairs.
_TURNS = 1


def hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The XXH64 values of a text's shingles in order; a shorter text is one shingle, a text without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space alone
    hash_of = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1) if words else 0
    return np.fromiter((hash_of(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n)


def parities(h: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of values fall on it. Two sets differ by at least as many values as these by bits.

    There are as many bits as values, up to a power of two, so that unlike sets differ by more bits than alike ones can.
    """
    bits = min(max(_BITS, 1 << (max(len(h), 1) - 1).bit_length()), _MOST_BITS)
    return np.packbits(np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def differ(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """By how many bits parities differ, pair by pair; the longer ones are folded onto as many bits as the shorter ones have."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for pair in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == pair).all(axis=1))
        least = int(pair.min())
        fold = lambda rows, n: np.bitwise_xor.reduce(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, n // least, least), axis=1)
        for i in range(0, len(at), max(1, (32 << 20) // int(pair.max()))):
            part = at[i : i + max(1, (32 << 20) // int(pair.max()))]
            x, y = fold([a[j] for j in part], int(pair[0])), fold([b[j] for j in part], int(pair[1]))
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def sketch(odd: bytes) -> bytes:
    """Parities folded onto _SKETCH 64-bit numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.int64).reshape(-1, _SKETCH), axis=0).tobytes()


def frequent(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several texts of a sample share, sorted, and in how many of them they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            sets = [np.unique(hashes(t.as_py(), width)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], ["h"])

    some = docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(_SAMPLE)) == 0).distinct()
    counts = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    rows = counts.orderBy(F.desc("n"), "h").limit(_FREQUENT).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Rows (key, sid, n, fp, odd, front, n_rare, sketch), one for each row of docs: the set's id and size, the text's fingerprint, the set's parities, its
    first fifth in the order of all sets, and how many values of that aren't hot (parities and front are left out where a task has
    already given them for a copy)."""
    spark = docs.sparkSession
    common.share_package(spark)
    shared = spark.sparkContext.broadcast(frequent(docs, text, width))

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.memory("copies")
        often, count = shared.value
        known: set[int] = set()
        for batch in common.slices(batches):
            if not batch.num_rows:
                continue
            sids, sizes, prints, odd, fronts, rare, short = [], [], [], [], [], [], []
            for t in batch.column(1):
                every = hashes(t.as_py(), width)
                h = np.unique(every)
                sid = xxhash.xxh64_intdigest(h.tobytes())
                front, parity, n_rare = h[:0], None, 0
                if sid not in known:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known.add(sid)
                    level = np.zeros(len(h), np.int64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                        level = np.where(often[at] == h, count[at], 0)
                    first = np.argsort(level, kind="stable")[: len(h) // 5 + 1]
                    front, parity, n_rare = h[first], parities(h), int((level[first] * _SAMPLE <= _HOT).sum())
                sids.append(sid)
                sizes.append(len(h))
                prints.append(simhash.majority(every))
                odd.append(parity)
                fronts.append(front)
                rare.append(n_rare)
                short.append(None if parity is None else np.frombuffer(sketch(parity), np.int64).tolist())
            ends = np.cumsum([0, *map(len, fronts)])
            front = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(fronts).view(np.int64)))
            whole = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), whole(sids), pa.array(sizes, pa.int64()), whole(prints), pa.array(odd, pa.binary()), front, pa.array(rare, pa.int32()), pa.array(short, pa.list_(pa.int64()))], [key, "sid", "n", "fp", "odd", "front", "n_rare", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, sid bigint, n bigint, fp bigint, odd binary, front array<bigint>, n_rare int, sketch array<bigint>")


def may_be_alike(a: Column, b: Column) -> Column:
    """Whether sizes and places let sets be alike whose fronts first meet there: a, b are size * 2^32 + place.

    At the first value that two sets share, all before it are in one of them only: at most a ninth of both sizes' sum.
    """
    size, at = (lambda x: F.shiftright(x, 32)), (lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))
    return (5 * F.least(size(a), size(b)) >= 4 * F.greatest(size(a), size(b))) & (9 * (at(a) + at(b)) <= size(a) + size(b))


def few(rows: DataFrame) -> DataFrame:
    """A written table of short rows, to be broadcast if it has no more than _FEW."""
    return F.broadcast(rows) if rows.limit(_FEW + 1).count() <= _FEW else rows


def verified(pairs: DataFrame, found: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """The pairs (u, v) of ids of sets with a Jaccard similarity of at least 4/5, written.

    Such sets differ by a ninth of both sizes' sum at most. Parities rule most others out before whole sets are made again from
    one text of each, for the ids that are asked for alone.
    """
    ends = lambda rows: common.stored(rows.select(F.explode(F.array("u", "v")).alias("sid")).distinct(), "asked")
    pairs = common.stored(pairs, "copy-pairs")
    named = ends(pairs)
    short = common.stored(found.filter("odd is not null").join(few(named), "sid", "left_semi").dropDuplicates(["sid"]).select("sid", "n", "odd", key), "copy-ends")
    end = lambda rows, x, *names: rows.select(F.col("sid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names])

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = 9 * differ(*(c.to_pylist() for c in batch.columns[3:])) <= batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(on))

    @common.frugal
    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            raw = [np.unique(hashes(t.as_py(), width)).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64).view(np.int64)), pa.array(raw, pa.binary())], ["sid", "hs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                alike.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(alike, pa.bool_()))

    near = pairs.join(end(short, "u", "n", "odd"), "u").join(end(short, "v", "n", "odd"), "v")
    likely = common.stored(near.select("u", "v", F.expr("n_u + n_v"), "odd_u", "odd_v").mapInArrow(may, "u bigint, v bigint"), "copy-candidates")
    asked = ends(likely)
    one = common.stored(short.join(few(asked), "sid", "left_semi").select(F.col(key).alias("_one")).distinct(), "copy-keys")
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(few(one), F.col("_key").eqNullSafe(F.col("_one")), "left_semi").select("text").distinct()
    whole = common.stored(texts.mapInArrow(whole_sets, "sid bigint, hs binary").join(few(asked), "sid", "left_semi").dropDuplicates(["sid"]), "copy-sets")
    out = likely.join(end(whole, "u", "hs"), "u").join(end(whole, "v", "hs"), "v").select("u", "v", "hs_u", "hs_v").mapInArrow(run, "u bigint, v bigint")
    links = common.stored(out, "copy-links")
    for table in (pairs, named, short, likely, asked, one, whole):
        common.drop_stored(table)
    return links


def printed(found: DataFrame) -> DataFrame:
    """Pairs (u, v) of ids of sets whose fingerprints are equal, each with the least id, and those that hold fingerprints within the radius together."""
    first = found.groupBy("fp").agg(F.min("sid").alias("first"))
    same = found.select("fp", "sid").distinct().join(first, "fp").filter("sid <> first").select(F.col("first").alias("u"), F.col("sid").alias("v"))
    near = simhash.links(first.select("fp"))
    ends = near.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return same.unionByName(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v")


def met(found: DataFrame) -> DataFrame:
    """Rows (h, sid, where, lead, lead_where): the values that stand in the fronts of different sets, with each of these and the one of least id.

    where is the set's size * 2^32 + the value's place in its front. Nearly all values are in one set alone, so they are dealt out by
    value once, and what meets is small. Hot values are aggregated and joined back instead, so that no task gathers all sets
    that have one.
    """

    def points(part: Column, offset: Column) -> DataFrame:
        where = F.shiftleft(F.col("n"), 32).bitwiseOR((F.col("at") + offset).cast("bigint"))
        return found.filter("odd is not null").select("sid", "n", "n_rare", F.posexplode(part).alias("at", "h")).select("h", "sid", where.alias("where"))

    point = F.struct("sid", "where")
    rare = points(F.slice("front", F.lit(1), F.col("n_rare")), F.lit(0)).repartition("h")
    group = Window.partitionBy("h")
    several = F.min("sid").over(group) < F.max("sid").over(group)
    rare = rare.withColumn("_several", several).filter("_several").drop("_several").withColumn("_lead", F.min(point).over(group))
    hot = points(F.slice("front", F.col("n_rare") + 1, F.size("front")), F.col("n_rare"))
    leads = hot.groupBy("h").agg(F.min(point).alias("_lead"), F.max("sid").alias("_last")).filter("_lead.sid < _last").drop("_last")
    both = rare.unionByName(hot.join(leads, "h"))
    return common.stored(both.select("h", "sid", "where", F.col("_lead.sid").alias("lead"), F.col("_lead.where").alias("lead_where")), "met-sets")


def joined(roots: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (sid, root), written, once the links of new (u, v) hold too: only the groups that they join are worked out again."""
    of = lambda x: roots.select(F.col("sid").alias(x), F.col("root").alias(f"root_{x}"))
    ends = new.join(few(of("u")), "u", "left").join(few(of("v")), "v", "left")
    moved = common.components(ends.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")))
    moved = common.stored(moved.select(F.col("node").alias("root"), F.col("root").alias("_to")), "copy-moved")
    first = moved.join(roots.select("sid"), F.col("root") == F.col("sid"), "left_anti").select(F.col("root").alias("sid"), F.col("_to").alias("root"))
    whole = roots.join(few(moved), "root", "left").select("sid", F.coalesce("_to", "root").alias("root"))
    out = common.stored(whole.unionByName(first), "copy-roots")
    common.drop_stored(moved)
    return out


def _rooted(near: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (h, sid, where, root): where sets stand, each with the least id of those that links connect with it so far."""
    return near.select("h", "sid", "where").join(few(roots), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Rows (key, sid), one for each row of docs, and rows (sid, component_id): the smallest key of those that links connect.

    A link is a Jaccard similarity of at least 4/5 of the sets of shingles; no link between different sets is lost, but for those
    between sets that other links connect anyway.
    """
    found = common.stored(sets(docs, key, text, width), "shingle-sets")
    near = met(found)
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    star = near.filter((F.col("sid") != F.col("lead")) & may_be_alike(F.col("where"), F.col("lead_where"))).select(*pair("sid", "lead"))
    links = verified(star.unionByName(printed(found)).distinct(), found, docs, key, text, width)
    roots = common.stored(common.components(links).withColumnRenamed("node", "sid"), "copy-roots")
    tables = [links, roots]
    for turn in range(_TURNS):  # another set of each value's leads, for those in other groups than its own
        rooted = _rooted(near, roots)
        lead = F.min_by(F.struct("sid", "where", "root"), F.xxhash64("sid", F.lit(turn))).alias("_lead")
        leads = rooted.groupBy("h").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), lead).filter("_low < _high").select("h", "_lead")
        star = rooted.join(leads, "h").filter((F.col("root") != F.col("_lead.root")) & may_be_alike(F.col("where"), F.col("_lead.where")))
        new = verified(star.select(*pair("sid", "_lead.sid")).distinct(), found, docs, key, text, width)
        roots = joined(roots, new)
        tables += [new, roots]
    rooted = _rooted(near, roots)
    apart = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h")
    sketches = found.filter("odd is not null").select("sid", "sketch").dropDuplicates(["sid"])
    left = common.stored(rooted.join(apart, "h", "left_semi").join(sketches, "sid"), "sets-apart")
    side = lambda x: left.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("sid", "where", "root", "sketch")])
    a, b = side("a"), side("b").withColumnRenamed("h", "h_b")
    apart_by = sum((F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(_SKETCH)), F.lit(0))
    size = F.shiftright("where_a", 32) + F.shiftright("where_b", 32)
    alike = (F.col("root_a") < F.col("root_b")) & may_be_alike(F.col("where_a"), F.col("where_b")) & (9 * apart_by <= size)
    across = a.join(b, (F.col("h") == F.col("h_b")) & alike).select(*pair("sid_a", "sid_b")).distinct()
    more = verified(across, found, docs, key, text, width)
    whole = joined(roots, more)
    least = found.groupBy("sid").agg(F.min(key).alias("least"))
    rows = least.join(whole, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = rows.groupBy("root").agg(F.min("least").alias("component_id"))
    of = common.stored(rows.join(smallest, "root").select("sid", "component_id"), "copy-classes")
    for table in (near, left, more, whole, *tables):
        common.drop_stored(table)
    return found.select(key, "sid"), of


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with one row of each group of texts that links connect: the one with the smallest key. Rows that repeat that key stay together.

    Texts with equal sets, and so all without words (null, empty, blank), are copies; a text of fewer words than a shingle is one
    shingle. A null key is never the smallest while another is there. All columns stay as they are; an empty table stays empty.
    """
    found, of = classes(docs, key, text, width)
    (gone_key,) = common.fresh(docs, "_gone")
    gone = common.stored(found.join(of, "sid").groupBy(key).agg(F.bool_or(F.col(key).eqNullSafe(F.col("component_id"))).alias("kept")).filter("not kept").select(F.col(key).alias(gone_key)), "copy-gone")
    return docs.join(few(gone), F.col(key).eqNullSafe(F.col(gone_key)), "left_anti")
