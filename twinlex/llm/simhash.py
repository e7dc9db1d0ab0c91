"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by bit-sliced comparison within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlex.llm import common

RADIUS = 3
#: Bits of the five segments; two fingerprints within three bits agree on two segments at least.
SEGMENTS = (13, 13, 13, 13, 12)
#: Fingerprints of one block; a larger bucket is compared block by block.
BLOCK = 4096
_TASKS = 1 << 15
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 values of all word shingles, repeats included. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space alone
    hash_of = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1) if words else 0
    return majority(np.fromiter((hash_of(b" ".join(words[i : i + width]), seed) for i in range(n)), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The number whose bits are those of over half the values; of none: 0."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (key, fp bigint), one for each row of docs."""
    common.share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical bit planes [64, words]: bit l of word w of plane p is bit p of fingerprint 64 w + l. A multiple of 64 is expected."""
    bits = np.unpackbits(np.ascontiguousarray(fps, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(planes: np.ndarray, word: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each task, the lanes of planes[:, word] within the radius of the query fingerprint, as a bit mask.

    The 64 distances of a word are kept as carry-save counters, one bit of all 64 in each machine word, with a sticky
    overflow. A task whose lanes have all overflowed is abandoned.
    """
    size = max(1, radius.bit_length())
    over, live = ~lanes, np.arange(len(word))
    counts = [np.zeros(len(word), np.uint64) for _ in range(size)]
    out = np.zeros(len(word), np.uint64)
    for p in range(64):
        carry = planes[p, word] ^ (np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1)))
        for c in counts:
            c_new = c & carry
            c ^= carry
            carry = c_new
        over |= carry
        if p % 8 == 7:
            on = over != _FULL
            if not on.all():
                live, word, query, over = live[on], word[on], query[on], over[on]
                counts = [c[on] for c in counts]
                if not len(live):
                    return out
    for high in range(radius + 1, 1 << size):  # values the counters can hold beyond the radius
        same = _FULL
        for b, c in enumerate(counts):
            same = same & (c if high >> b & 1 else ~c)
        over |= same
    out[live] = ~over
    return out


class Forest:
    """Union-find that takes arrays of pairs; most pairs fall together at once after a few unions."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            r = self.up[x]
            if (r == self.up[r]).all():
                return r
            self.up[x] = x = self.up[r]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.roots(a), self.roots(b)
            on = a != b
            if not on.any():
                return
            a, b = a[on], b[on]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def linked(groups: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as fingerprint pairs, of the links within runs of equal groups."""
    ids, place = np.unique(fps, return_inverse=True)
    forest = Forest(len(ids))
    starts, sizes = common.runs_of(groups)
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return ids[:0], ids[:0]
    words = (sizes + 63) // 64
    first_word = np.cumsum(words) - words
    row = np.repeat(starts - 64 * first_word, 64 * words) + np.arange(64 * words.sum())  # padding lanes repeat the next rows; masks hide them
    planes = planes_of(fps[np.minimum(row, len(fps) - 1)])
    # one task for each member and each word of its group that has later members
    member_group = np.repeat(np.arange(len(starts)), sizes)
    local = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin = (local + 1) // 64
    n_tasks = np.maximum(words[member_group] - begin, 0)
    ends = np.cumsum(n_tasks)
    lo = 0
    while lo < len(n_tasks):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _TASKS, "right")))
        n = n_tasks[lo:hi]
        who = np.repeat(np.arange(lo, hi), n)
        w = np.repeat(begin[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = member_group[who]
        high = np.minimum(sizes[g] - 64 * w, 64)
        low = np.clip(local[who] + 1 - 64 * w, 0, 64)
        mask = (_FULL >> (64 - high).astype(np.uint64)) & np.where(low >= 64, np.uint64(0), _FULL << np.minimum(low, 63).astype(np.uint64))
        on = mask != 0
        who, w, g, mask = who[on], w[on], g[on], mask[on]
        at = starts[g] + local[who]
        hits = near(planes, first_word[g] + w, fps[at], mask, radius)
        found = np.flatnonzero(hits)
        lane = np.unpackbits(hits[found].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        t, bit = np.nonzero(lane)
        t = found[t]
        forest.join(place[at[t]], place[starts[g[t]] + 64 * w[t] + bit])
        lo = hi
    roots = forest.roots(np.arange(len(ids)))
    on = roots != np.arange(len(ids))
    return ids[on], ids[roots[on]]


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between different fingerprints within the radius; they connect all that any link connects.

    Every fingerprint goes to ten buckets, one for each pair of the five segments. Buckets are counted first; one with more
    than `block` fingerprints is cut into blocks by hash and each pair of blocks is compared on its own, so that a task
    holds two blocks at most.
    """
    if radius > 3:
        raise ValueError("the five segments find links of up to three bits")
    shifts = [sum(SEGMENTS[:i]) for i in range(len(SEGMENTS))]
    part = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in zip(shifts, SEGMENTS, strict=True)]
    tables = [
        F.lit(t << 26).cast("long").bitwiseOR(F.shiftleft(part[i], 13)).bitwiseOR(part[j]) for t, (i, j) in enumerate(combinations(range(5), 2))
    ]
    spread = distinct.select("fp", F.explode(F.array(*tables)).alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks)
    grouped = (
        spread.join(sizes, "bucket")
        .select("fp", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("other"))
        .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "fp")
    )
    common.share_package(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            u, v = linked(rows[0], rows[1].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        kept = [np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            kept = [np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, batch.columns, strict=True)]
            if len(kept[0]) >= 1 << 17:
                cut = int(np.searchsorted(kept[0], kept[0][-1]))  # the last group may go on
                if cut:
                    yield out([k[:cut] for k in kept])
                    kept = [k[cut:] for k in kept]
        if len(kept[0]):
            yield out(kept)

    return grouped.repartition("part").sortWithinPartitions("part").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = 3) -> DataFrame:
    """Rows (key, fp bigint, component_id): one for each row of docs, with the smallest key of its component.

    Equal fingerprints fall together before anything is compared, so that groups of copies cost one row each. Null and
    empty texts have the fingerprint 0 and are linked like any other. A null key is never the smallest while another is
    there; rows that repeat a key stay. An empty table gives an empty result.
    """
    fps = common.stored(fingerprints(docs, key, text, width), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min(key).alias("least"))
    roots = common.components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the one with the smallest key. Rows that repeat that key stay together."""
    found = near_duplicates(docs, key, text, radius)
    (kept_key,) = common.fresh(docs, "_kept")
    kept = found.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(kept_key)).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col(kept_key)), "left_semi")
