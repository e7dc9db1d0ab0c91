"""Suffix-array dedup: removal of every byte that lies in a long string which also starts earlier in the corpus.

Two equal strings of LENGTH bytes share an anchor: the smallest hash of GRAM bytes within them stands at the same place in
both. So all comparisons happen among the contexts of equal anchors, spread over the cluster by the anchor's hash. Contexts
that are equal as a whole fall together; of the different ones, a suffix array with longest previous factors tells which
strings start earlier elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlex.llm import common

LENGTH, GRAM = 100, 32
#: Different contexts of one anchor that are sorted together; a larger group is resolved string by string.
GROUP = 4096
#: One text in _SAMPLE tells which anchors may be that frequent, _HOT of them at most: their contexts are dealt out one by one. This sets
#: where rows go, never the result.
_SAMPLE, _HOT = 64, 1 << 18
_BLOCK = 1 << 20
_CHUNK = 4 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE, _TABLE = np.uint64(0x9E3779B97F4A7C15 | 1), np.random.default_rng(100).integers(0, 2**64, 256, np.uint64)
_FIRST_KEY = -(1 << 63)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any substring of a block, from sums of table values times powers of an odd base, modulo 2^64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if n not in _powers:
            _powers.clear()
            up = np.full(n + 1, _BASE)
            up[0] = 1
            down = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
            down[0] = 1
            _powers[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, self.down = _powers[n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        m = max(0, len(self.sums) - size)
        return _mix((self.sums[size:] - self.sums[:m]) * self.down[:m])


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + width]; shorter by width - 1."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[:n], x[width - have : width - have + n])


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in raw of the anchors of all texts of `length` bytes or more, with the hash of the gram and of the context.

    A place is an anchor if its gram has the smallest hash in some string of `length` bytes, or one as small. Works block by
    block with a margin, so that memory doesn't follow the longest text.
    """
    width, margin = length - gram + 1, 2 * length
    doc_of_block = lambda p: np.searchsorted(at, p, "right") - 1
    places, grams, contexts = [], [], []
    for b in range(0, len(raw), _BLOCK):
        low, high = max(0, b - margin), min(len(raw), b + _BLOCK + margin)
        data = raw[low:high]
        if len(data) < length:
            continue
        whole = Hashes(data if len(data) == _BLOCK + 2 * margin else np.pad(data, (0, max(0, _BLOCK + 2 * margin - len(data)))))
        h = whole.grams(gram)[: len(data) - gram + 1].copy()
        inner = at[(at > low) & (at < high)] - low
        for back in range(1, gram):  # grams that reach into the next text
            cut = inner - back
            h[cut[(cut >= 0) & (cut < len(h))]] = _NONE
        pad = np.full(width - 1, _NONE)
        least = _slide(np.concatenate([h, pad]), width, np.minimum)
        most = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum)
        at_place = np.flatnonzero((most == h) & (h != _NONE))
        at_place = at_place[(at_place + low >= b) & (at_place + low < b + _BLOCK)]
        doc = doc_of_block(at_place + low)
        at_place = at_place[at[doc + 1] - at[doc] >= length]
        doc = doc_of_block(at_place + low)
        start = np.maximum(at_place - (width - 1), at[doc] - low)
        end = np.minimum(at_place + length, at[doc + 1] - low)
        places.append(at_place + low)
        grams.append(h[at_place])
        contexts.append(_mix(whole.of(start, end) + (at_place - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + (end - start).astype(np.uint64)))
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(places, np.int64), join(grams, np.uint64), join(contexts, np.uint64)


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(_FIRST_KEY).to_numpy(zero_copy_only=False).astype(np.int64)


_OCCURRENCE = ["h", "s", "c", "k", "pt", "stop"]


def hot_anchors(docs: DataFrame, length: int, gram: int, group: int) -> np.ndarray:
    """The anchors, sorted, that a sample of the texts has so often that more than `group` contexts are likely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            _, h, c = anchors(*common.buffers(batch.column(0)), length, gram)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], ["h", "c"])

    some = docs.select("text").filter(F.pmod(F.xxhash64(F.lit("hot"), "text"), F.lit(_SAMPLE)) == 0)
    counts = some.mapInArrow(run, "h bigint, c bigint").distinct().groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") * _SAMPLE > group)
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(_HOT).select("h").toArrow().column("h").to_numpy().view(np.uint64))


def occurrences(docs: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Rows (h, s, c, k, pt, stop): anchors with gram and context hash, key, and place * 2^32 + tag of the text; s is the context of hot anchors, else 0.

    Of equal contexts within a slice of a task only the first is sent on; the others are known to be repeats and are sent as
    ready spans (stop is set), so that copies cost little and a hot anchor sends one row a slice and context.
    """

    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in common.slices(batches):
            raw, at = common.buffers(batch.column(1))
            key = _keys(batch.column(0))
            tag = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
            place, h, c = anchors(raw, at, length, gram)
            doc = np.searchsorted(at, place, "right") - 1
            inside = place - at[doc]
            order = np.lexsort((inside, key[doc], c, h))
            place, h, c, doc, inside = place[order], h[order], c[order], doc[order], inside[order]
            starts, sizes = common.runs_of(_mix(h) + c)
            first = np.repeat(starts, sizes)
            late = (key[doc] != key[doc[first]]) | (inside != inside[first])
            d, begin = doc[late], np.maximum(inside[late] - (length - gram), 0)
            a, b = common.merged(at[d] + begin, np.minimum(at[d] + inside[late] + length, at[d + 1]))
            d = np.searchsorted(at, a, "right") - 1
            cut = np.flatnonzero(b > at[d + 1])  # spans of neighbouring texts that touch
            while len(cut):
                a, b = np.concatenate([a, at[d[cut] + 1]]), np.concatenate([b, b[cut]])
                b[cut] = at[d[cut] + 1]
                d = np.searchsorted(at, a, "right") - 1
                cut = np.flatnonzero(b > at[d + 1])
            kept = ~late
            own = np.where(np.isin(h[kept], hot), c[kept] | np.uint64(1), np.uint64(0)) if len(hot) else np.zeros(kept.sum(), np.uint64)
            rows = [
                np.concatenate([h[kept].view(np.int64), _mix((a + key[d]).astype(np.uint64)).view(np.int64)]),
                np.concatenate([own.view(np.int64), np.zeros(len(a), np.int64)]),
                np.concatenate([c[kept].view(np.int64), np.zeros(len(a), np.int64)]),
                np.concatenate([key[doc[kept]], key[d]]),
                np.concatenate([inside[kept] << 32 | tag[doc[kept]], (a - at[d]) << 32 | tag[d]]),
            ]
            stop = np.concatenate([np.zeros(kept.sum(), np.int64), b - at[d]])
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(stop, mask=stop == 0)], _OCCURRENCE)

    return docs.mapInArrow(run, "h bigint, s bigint, c bigint, k bigint, pt bigint, stop bigint")


def grouped(found: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """What follows from equal anchors: rows (k, tag, start, stop) to remove where h is null, and else rows whose context must be compared (start is the anchor's place, n the contexts of its group).

    A hot anchor's contexts lie in different tasks, which don't count them: they go string by string, as those of a large group.
    """
    by_context = Window.partitionBy("h", "s", "c").orderBy("k", "pt")
    by_gram = Window.partitionBy("h", "s")
    place = F.shiftright("pt", 32)
    rows = found.repartition("h", "s").withColumn("at", place)
    rows = rows.withColumn("k0", F.first("k").over(by_context)).withColumn("at0", F.first("at").over(by_context)).withColumn("nth", F.row_number().over(by_context))
    rows = rows.withColumn("n", F.when(F.col("s") != 0, group + 1).otherwise(F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(by_gram)))
    ready, late = F.col("stop").isNotNull(), (F.col("k") != F.col("k0")) | (F.col("at") != F.col("at0"))
    wanted = rows.filter(ready | late | (F.col("n") > 1))
    tag = F.col("pt").bitwiseAND(F.lit(0xFFFFFFFF))
    remove = ready | late
    return wanted.select(
        "k",
        tag.alias("tag"),
        F.when(ready | ~late, F.col("at")).otherwise(F.greatest(F.col("at") - (length - gram), F.lit(0))).alias("start"),
        F.when(ready, F.col("stop")).when(late, F.col("at") + length).alias("stop"),
        F.when(~remove, F.col("h")).alias("h"),
        F.when(~remove, F.col("n")).alias("n"),
    )


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, k, tag): k is the key with null as the smallest, tag tells texts with equal keys apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("bigint").alias("key"), whole.alias("text"), F.coalesce(F.col(key).cast("bigint"), F.lit(_FIRST_KEY)).alias("k"), F.crc32(whole.cast("binary")).alias("tag"))


def contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """Rows (h, h2, k, tag, start, bytes, single): the contexts to compare. Of a group beyond `group`, each string of `length` bytes instead: h and h2 are its 128-bit hash, single is set."""
    lists = wanted.groupBy("k", "tag").agg(F.collect_list(F.struct("start", "h", "n")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _CONTEXT]
            for text, k, tag, at in zip(*(batch.column(i) for i in (0, 1, 2, 3)), strict=True):
                data, k, tag = text.as_buffer(), k.as_py(), tag.as_py()
                view, seen = memoryview(data), set()
                for p, h, n in sorted({(x["start"], x["h"], x["n"]) for x in at.as_py()}):
                    low, high = max(0, p - (length - gram)), min(len(view), p + length)
                    if n <= group:
                        out_rows = [(h, 0, low, bytes(view[low:high]), False)]
                    else:
                        hashes = [s for s in range(low, high - length + 1) if s not in seen]
                        seen.update(hashes)
                        out_rows = [(*_single(view[s : s + length]), s, None, True) for s in hashes]
                    for h_row, h2, s, part, single in out_rows:
                        for column, value in zip(out, (h_row, h2, k, tag, s, part, single), strict=True):
                            column.append(value)
                    if len(out[0]) > 1 << 14:
                        yield _context_batch(out)
                        out = [[] for _ in _CONTEXT]
            yield _context_batch(out)

    return docs.join(lists, ["k", "tag"]).select("text", "k", "tag", "at").mapInArrow(run, "h bigint, h2 bigint, k bigint, tag bigint, start bigint, part binary, single boolean")


_CONTEXT = ["h", "h2", "k", "tag", "start", "part", "single"]


def _single(view: memoryview) -> tuple[int, int]:
    import xxhash

    whole = xxhash.xxh3_128_intdigest(view, 100)
    return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)


def _context_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], _CONTEXT)


def order_to_depth(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of data, sorted by `length` bytes and cut to `starts`, and for each entry whether it agrees with the one before in all of them.

    Prefix doubling from words of eight bytes; only suffixes that are still tied are sorted again. Suffixes must not be
    compared beyond the end of data: each of starts has `length` bytes behind it.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rank = np.zeros(n, np.uint64)
    for i in range(8):
        rank = rank << np.uint64(8) | padded[i : i + n]
    order = np.argsort(rank, kind="stable")
    new = np.concatenate([[True], np.diff(rank[order]) != 0])
    ranks = np.empty(n, np.int64)
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 8
    while width < length:
        step = min(width, length - width)
        group = ranks[order]
        tied = np.concatenate([group[1:] == group[:-1], [False]])
        tied[1:] |= tied[:-1].copy()
        where = np.flatnonzero(tied)
        at = order[where]
        after = ranks[np.minimum(at + step, n - 1)]
        key = ranks[at] << 32 | after
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[where] = at
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.empty(0, bool)
        ranks = ranks.copy()
        ranks[at] = where[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] if len(at) else 0
        width += step
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    order = order[wanted[order]]
    return order, np.concatenate([[False], ranks[order[1:]] == ranks[order[:-1]]]) if len(order) else np.empty(0, bool)


def previous_smaller(keys: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each entry the nearest one before with a smaller key, within its run of agreeing entries; else -1. By pointer jumping."""
    at = np.where(same, np.arange(len(keys)) - 1, -1)
    live = np.flatnonzero(at >= 0)
    while len(live):
        live = live[keys[at[live]] >= keys[live]]
        at[live] = at[at[live]]
        live = live[at[live] >= 0]
    return at


def longest_previous(keys: np.ndarray, same: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factors in suffix order, cut off at `length`: how far each suffix agrees with one of a smaller key.

    The best such neighbour is the previous or the next smaller one in suffix order. Entries agree in `length` bytes within a
    run of `same`, in fewer beyond it, which counts as 0 here.
    """
    back = previous_smaller(keys, same)
    turned = np.concatenate([[False], same[1:][::-1]]) if len(same) else same
    ahead = previous_smaller(keys[::-1], turned)[::-1]
    return np.where((back >= 0) | (ahead >= 0), length, 0)


def compared(rows: DataFrame, length: int) -> DataFrame:
    """Spans (k, tag, start, stop) of contexts whose strings start earlier in another context of the anchor."""

    def spans(k: np.ndarray, tag: np.ndarray, start: np.ndarray, parts: list[bytes]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        n = np.maximum(sizes - length + 1, 0)
        of = np.repeat(np.arange(len(parts)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = (np.cumsum(sizes) - sizes)[of] + inside
        order, same = order_to_depth(data, begin, length)
        back = np.empty(len(data), np.int64)
        back[begin] = np.arange(len(begin))
        entry = back[order]
        # the order of strings in the corpus: by key, then place; equal places are the same string seen twice
        _, key_rank = np.unique(k, return_inverse=True)
        rank = key_rank[of[entry]].astype(np.int64) << 32 | (start[of] + inside)[entry]
        late = np.zeros(len(begin), bool)
        late[entry] = longest_previous(rank, same, length) >= length
        on = np.flatnonzero(late)
        lead = on[np.concatenate([[True], (np.diff(on) > 1) | (np.diff(of[on]) > 0)])] if len(on) else on
        last = on[np.concatenate([(np.diff(on) > 1) | (np.diff(of[on]) > 0), [True]])] if len(on) else on
        c = of[lead]
        return pa.RecordBatch.from_arrays([pa.array(k[c]), pa.array(tag[c]), pa.array(start[c] + inside[lead]), pa.array(start[c] + inside[last] + length)], ["k", "tag", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            kept.append(batch)
            size += batch.column(4).nbytes
            if size < _CHUNK:
                continue
            table = pa.Table.from_batches(kept)
            h = table.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut:
                yield from resolve(table.slice(0, cut))
            kept = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.column(4).nbytes for b in kept)
        if kept:
            yield from resolve(pa.Table.from_batches(kept))

    def resolve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, k, tag, start = (table.column(i).to_numpy() for i in range(4))
        parts = table.column(4).to_pylist()
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        groups = np.append(common.runs_of(h)[0], len(h))
        i = 0
        while i < len(groups) - 1:
            done = ends[groups[i] - 1] if groups[i] else 0
            j = max(i + 1, int(np.searchsorted(ends[groups[1:] - 1], done + _CHUNK, "right")))
            a, b = groups[i], groups[j]
            yield spans(k[a:b], tag[a:b], start[a:b], parts[a:b])
            i = j

    pieces = rows.filter("not single").select("h", "k", "tag", "start", "part").repartition("h").sortWithinPartitions("h")
    several = pieces.mapInArrow(run, "k bigint, tag bigint, start bigint, stop bigint")
    single = rows.filter("single").select("h", "h2", "k", "tag", "start")
    first = single.groupBy("h", "h2").agg(F.min(F.struct("k", "start")).alias("first"))
    late = single.join(first, ["h", "h2"]).filter(F.struct("k", "start") != F.col("first"))
    return several.unionByName(late.select("k", "tag", "start", (F.col("start") + length).alias("stop")))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row for each row of docs: (key, n_bytes, spans array<struct<start, stop>>, kept binary), in UTF-8 bytes of the text.

    spans are the maximal runs of bytes covered by a string of `length` bytes that also starts earlier: in a text with a
    smaller key, or in the same text further up, overlaps included; judged on the texts as given. kept is what is left.
    Null texts are empty, and empty and short texts have no spans; a null key is the smallest. Rows that repeat key and text
    are one text; of different texts with equal keys, the smaller place is the earlier one, and equal places are ties, of
    which neither is removed on account of the other. An empty table gives an empty result.
    """
    common.share_package(docs.sparkSession)
    base = keyed(docs, key, text)
    hot = hot_anchors(base, length, gram, group)
    found = common.stored(grouped(occurrences(base.select("k", "text"), length, gram, hot), length, gram, group), "repeats")
    parts = common.stored(contexts(base, found.filter("h is not null").select("k", "tag", "start", "h", "n"), length, gram, group), "contexts")
    spans = found.filter("h is null").select("k", "tag", "start", "stop").unionByName(compared(parts, length))
    lists = spans.groupBy("k", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, every = [], []
            for text, at in zip(batch.column(1), batch.column(2), strict=True):
                view = memoryview(text.as_buffer())
                found = at.as_py() or []
                a = np.array([s["start"] for s in found], np.int64)
                b = np.minimum(np.array([s["stop"] for s in found], np.int64), len(view))
                a, b = common.merged(a, b)
                edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(view)]
                kept.append(b"".join(view[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                every.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            sizes = pa.array([len(t.as_buffer()) for t in batch.column(1)], pa.int64())
            span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(every, pa.list_(span)), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"])

    return base.join(lists, ["k", "tag"], "left").select("key", "text", "at").mapInArrow(run, f"`{key}` bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
