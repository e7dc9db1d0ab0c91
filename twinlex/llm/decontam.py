"""Benchmark decontamination: an FM-index per shard of documents, searched backward for the windows of benchmark items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlex.llm import common

WINDOW = 13
#: Text positions between two sampled suffix positions.
SAMPLE = 16
#: Characters of benchmark text that are searched for together, some 80 MB of phrases in a worker; a longer benchmark is searched for block by block.
BLOCK_CHARS = 4 << 20
#: Separators become a space, A-Z become a-z; bytes from 0x80 on belong to words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, bytes, np.ndarray]:
    """All words, how many each text has, the bytes they were taken from, and where each text starts in these."""
    raw, at = common.buffers(texts)
    plain = raw.tobytes().translate(_WORDS)
    return *common.spaced_words(plain, at), plain, at


class Wavelet:
    """A wavelet matrix over small integers: rank of a symbol in a prefix, for arrays of symbols and prefixes."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels = []
        self.size = len(symbols)
        for bit in reversed(range(max(1, (n_symbols - 1).bit_length()))):
            ones = (symbols >> bit & 1).astype(np.uint8)
            padded = np.pad(ones, (0, 64 - len(ones) % 64))
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((bit, words, before, len(ones) - int(ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for bit, words, before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            a, b = self._ones(words, before, low), self._ones(words, before, high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for bit, words, before, zeros in self.levels:
            w = at >> 6
            one = (words[w] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(words, before, at)
            at = np.where(one, zeros + ones, at - ones)
            out |= one.astype(np.int64) << bit
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of an integer text that ends in its only smallest symbol, by prefix doubling of what is still tied."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 1
    while True:
        group = rank[order]
        tied = np.concatenate([group[1:] == group[:-1], [False]])
        tied[1:] |= tied[:-1].copy()
        where = np.flatnonzero(tied)
        if not len(where):
            return order
        at = order[where]
        after = rank[np.minimum(at + width, n - 1)]
        by = np.lexsort((after, rank[at]))
        at, after, first = at[by], after[by], rank[at[by]]
        order[where] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (after[1:] != after[:-1])])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[at] = where[lead]
        width *= 2


class FMIndex:
    """Counts and finds phrases in a text of symbols from 1 on; 0 ends the text."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE) -> None:
        text = np.append(text, 0)
        order = suffix_order(text)
        self.last = Wavelet(text[order - 1], n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        kept = order % sample == 0
        self.known = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]
        self.size, self.sample = len(text), sample

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of phrases (its first `lengths` symbols; 0 can't match), the range of suffixes that begin with it."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for back in range(int(lengths.max(initial=0))):
            on = np.flatnonzero((lengths > back) & (low < high))
            symbol = phrases[on, lengths[on] - 1 - back]
            ok = symbol > 0
            low[on[~ok]] = high[on[~ok]]
            on, symbol = on[ok], symbol[ok]
            low[on] = self.first[symbol] + self.last.rank(symbol, low[on])
            high[on] = self.first[symbol] + self.last.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the last sampled position."""
        out, steps, live = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        while len(live):
            here = self.known[at + 1] > self.known[at]
            out[live[here]] = self.positions[self.known[at[here]]] + steps
            live, at, steps = live[~here], at[~here], steps + 1
            symbol = self.last.access(at)
            at = self.first[symbol] + self.last.rank(symbol, at)
        return out


class Phrases:
    """The different windows of a block of benchmark items, and the items each stands in."""

    def __init__(self, items: list[str], texts: pa.Array, window: int) -> None:
        words, n, _, _ = words_of(texts)
        self.items, self.window = items, window
        coded = pc.dictionary_encode(words)
        self.words = coded.dictionary.cast(pa.large_string())
        ids = coded.indices.to_numpy().astype(np.int64) + 2  # 0 ends a text, 1 parts its runs
        ends = np.cumsum(n)
        many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        item = np.repeat(np.arange(len(n)), many)
        begin = (ends - n)[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(n[item], window)
        place = np.arange(window)
        rows = np.where(place < length[:, None], ids[np.minimum(begin[:, None] + place, max(len(ids) - 1, 0))] if len(ids) else 0, 0)
        self.rows, phrase = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.empty(0, np.int64))
        self.lengths = (self.rows > 0).sum(axis=1)
        pairs = np.unique(np.stack([phrase.ravel(), item]), axis=1) if len(item) else np.empty((2, 0), np.int64)
        self.of = pairs[1]
        self.of_start = np.searchsorted(pairs[0], np.arange(len(self.rows) + 1))
        two = self.rows[:, 1:] > 0 if window > 1 else np.empty((0, 0), bool)
        self.bigrams = np.unique((self.rows[:, :-1] << 32 | self.rows[:, 1:])[two]) if window > 1 else np.empty(0, np.int64)
        self.least = int(self.lengths.min(initial=window))

    def find(self, words: pa.Array, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in a shard: first word, words, and phrase of each.

        Only runs of words whose neighbours follow each other in some window, and that are as long as the shortest window, can
        hold an occurrence; the index is built over these.
        """
        none = np.empty(0, np.int64)
        if not len(words) or not len(self.rows):
            return none, none, none
        ids = pc.fill_null(pc.index_in(words, self.words), -2).to_numpy().astype(np.int64) + 2
        pair = np.zeros(len(ids) - 1, bool)
        both = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0) & (doc_of[1:] == doc_of[:-1]))
        if len(both) and len(self.bigrams):
            follow = ids[both] << 32 | ids[both + 1]
            pair[both] = self.bigrams[np.minimum(np.searchsorted(self.bigrams, follow), len(self.bigrams) - 1)] == follow
        starts, sizes = common.runs_of(np.concatenate([[0], np.cumsum(~pair)]))
        keep = (sizes >= self.least) & (ids[starts] > 0)
        starts, sizes = starts[keep], sizes[keep]
        if not len(starts):
            return none, none, none
        ends = np.cumsum(sizes + 1)
        from_word = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes - 1), sizes + 1)
        text = ids[np.minimum(from_word, len(ids) - 1)]
        text[ends - 1] = 1
        index = FMIndex(text, len(self.words) + 2)
        low, high = index.search(self.rows, self.lengths)
        many = high - low
        phrase = np.repeat(np.arange(len(many)), many)
        rows = np.repeat(low, many) + np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many)
        return from_word[index.locate(rows)], self.lengths[phrase], phrase


def mark(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: (key, text, n_words, n_hit, spans, item_ids).

    spans array<struct<start int, end int>> are the maximal runs of hit words, in code points of the text, from the first to
    behind the last character, to be cut out; item_ids array<string> are the items with a window in the text, sorted.
    A window is `window` words in a row of an item, or the whole item if it has fewer words. Null and empty texts have no
    words; items without words match nothing; a null item key is shown as the empty string; equal keys count once.
    Rows that repeat a key are searched each for itself. Columns beyond those named are not read.
    """
    spark = docs.sparkSession
    common.share_package(spark)
    bench = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    n_blocks = max(1, -(-int(bench.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    kind = docs.schema[key].dataType.simpleString()
    now = docs.select(F.col(key), F.col(text).alias(text), F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("item_ids"))
    schema = f"`{key}` {kind}, `{text}` string, n_words bigint, n_hit bigint, spans array<struct<start: int, end: int>>, item_ids array<string>"
    for block in range(n_blocks):
        rows = (bench if n_blocks == 1 else bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)).collect()  # about block_chars at most
        phrases = spark.sparkContext.broadcast(Phrases([r.item for r in rows], pa.array([r.text for r in rows], pa.string()), window))
        now = now.mapInArrow(_searcher(phrases, block > 0), schema)
    return now


def _searcher(phrases, again: bool):
    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.memory("decontam")
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = list(common.slices(iter([batch.select([0, 1])]), batch.schema.names[1]))
            found = [_search(phrases.value, p.column(1)) for p in parts]
            n_words = np.concatenate([f[0] for f in found])
            hits, names = [h for f in found for h in f[1]], [x for f in found for x in f[2]]
            if again:
                for i, (old, ids) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                    if old:
                        hits[i] = sorted({*hits[i], *_words_in(batch.column(1)[i].as_py(), old)})
                        names[i] = sorted({*names[i], *ids})
            spans = [_spans(t.as_py(), h) if h else [] for t, h in zip(batch.column(1), hits, strict=True)]
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), pa.array(list(map(len, hits)), pa.int64()), pa.array(spans, pa.list_(span)), pa.array(names, pa.list_(pa.string()))], batch.schema.names)

    return run


def _search(phrases: Phrases, texts: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """For each text: words, the hit words' numbers, the items."""
    words, n, _, _ = words_of(texts)
    doc_of = np.repeat(np.arange(len(n)), n)
    begin, size, phrase = phrases.find(words, doc_of)
    hits: list[list[int]] = [[] for _ in n]
    names: list[list[str]] = [[] for _ in n]
    if len(begin):
        starts, ends = common.merged(begin, begin + size)
        first = np.cumsum(n) - n
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):  # spans of two texts may touch
            while a < b:
                d = int(doc_of[a])
                stop = min(b, int(first[d] + n[d]))
                hits[d].extend(range(a - int(first[d]), stop - int(first[d])))
                a = stop
        pairs = np.unique(np.stack([doc_of[begin], phrase]), axis=1)
        for d, p in pairs.T.tolist():
            names[d].extend(phrases.items[i] for i in phrases.of[phrases.of_start[p] : phrases.of_start[p + 1]])
        names = [sorted(set(x)) for x in names]
    return n.astype(np.int64), hits, names


def _bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, in code points."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_WORDS), np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return point[np.flatnonzero(inside[1:] & ~inside[:-1])], point[np.flatnonzero(~inside[1:] & inside[:-1])]


def _spans(text: str, hits: list[int]) -> list[dict[str, int]]:
    starts, ends = _bounds(text)
    at = np.array(hits)
    lead = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    last = np.append(lead[1:] - 1, len(at) - 1)
    return [{"start": int(starts[a]), "end": int(ends[b])} for a, b in zip(at[lead], at[last], strict=True)]


def _words_in(text: str, spans: list[dict[str, int]]) -> list[int]:
    starts, _ = _bounds(text)
    return [i for s in spans for i in range(int(np.searchsorted(starts, s["start"])), int(np.searchsorted(starts, s["end"])))]


def digest(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of mark()'s rows."""
    return marked.select(
        key, "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("item_ids")).cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def contaminated():
    """Benchmark words make up a twentieth of the text's words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def item_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
