"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often id pairs meet in a corpus.

Each byte of a text is given its owner, a token of A and one of B, by np.repeat over the tokens' lengths. Where both owners
change at once both tokenizers end a token, which cuts the text into groups. All A-B pairs of a group are links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlex.llm import common

#: Chunks that a worker remembers, besides those of the texts at hand, and the longest of them in bytes.
_MEMO, _LONG = 350_000, 48
#: Links of a group from which on its ids are made distinct before they are paired.
_LARGE = 512
#: Id pairs whose counts are broadcast at once (12 bytes each), and those that a task sums up before it passes them on.
BLOCK_PAIRS, _HELD = 4_000_000, 2_000_000
#: Bytes of text looked at together.
_SLICE = 2 << 20
#: Bits of an id within a link, as A's id stands above B's; above both stands a row of a slice.
_BITS = 26
_SIZES = ("n_a", "n_b", "n_groups", "n_links")


def overlaps(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The owner pairs (a, b) that share a byte, in order, and which of them begin a group. Both lengths have the same sum."""
    own_a, own_b = np.repeat(np.arange(len(len_a)), len_a), np.repeat(np.arange(len(len_b)), len_b)
    new_a, new_b = np.diff(own_a, prepend=-1) != 0, np.diff(own_b, prepend=-1) != 0
    at = np.flatnonzero(new_a | new_b)
    return own_a[at], own_b[at], (new_a & new_b)[at]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    """Aligns texts chunk by chunk and remembers short chunks.

    A chunk begins at a space whose character before is surely no white space: there A's pre-tokenizer always cuts, and no
    piece of B has a space inside, so both end a token there. A model with such pieces is refused.
    """

    def __init__(self, path_a: str, path_b: str, most: int = _MEMO) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), most
        self.a.encode_special_tokens = True
        to_byte = {c: b for b, c in _byte_letters().items()}
        plain = lambda t: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
        self.bytes_a = _table([plain(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())])
        piece = self.b.id_to_piece
        if any(" " in piece(i).replace("▁", " ").lstrip(" ") for i in range(len(self.b))):
            raise ValueError("B has pieces with a space inside")
        self.bytes_b = _table([bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(len(self.b))])
        if max(len(self.bytes_a[0]), len(self.bytes_b[0])) > 1 << _BITS:
            raise ValueError(f"ids must fit in {_BITS} bits")
        self.said = _table([b"%d%c" % (i, sign) for t in (self.bytes_a, self.bytes_b) for i in range(len(t[0])) for sign in b",|;"])
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes, self.good = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.first, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.weights, self.marks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.first_mark = np.zeros(0, np.int64)

    def learn(self, chunks: list[bytes]) -> None:
        """Align new chunks, all of them at once, and add them to what is known."""
        texts = [c.decode() for c in chunks]
        ids, cuts = [], []
        for lists in ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)):
            cuts.append(np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int64, cuts[-1][-1]))
        want, whole = np.fromiter(map(len, chunks), np.int64, len(chunks)), np.frombuffer(b"".join(chunks), np.uint8)
        good = np.ones(len(chunks), bool)
        for (size, start, raw), own, cut in zip((self.bytes_a, self.bytes_b), ids, cuts, strict=True):
            same = np.diff(np.concatenate([[0], np.cumsum(size[own])])[cut]) == want
            own = own[np.repeat(same, np.diff(cut))]
            other = raw[_ranges(start[own], size[own])] != whole[np.repeat(same, want)]
            same[np.repeat(np.flatnonzero(same), want[same])[other]] = False
            good &= same
        # from here on those that differ have no tokens
        part = [np.repeat(np.arange(len(chunks)), np.diff(c)) for c in cuts]
        ids_a, ids_b = ids[0][good[part[0]]], ids[1][good[part[1]]]
        of_a = part[0][good[part[0]]]
        a, b, begins = overlaps(self.bytes_a[0][ids_a], self.bytes_b[0][ids_b])
        group = np.cumsum(begins) - 1
        n_groups = int(group[-1]) + 1 if len(group) else 0
        group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        group_a[a], group_b[b] = group, group
        n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        chunk_of = of_a[np.searchsorted(group_a, np.arange(n_groups))] if n_groups else np.zeros(0, np.int64)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        links = n_a * n_b
        small = np.flatnonzero(links <= _LARGE)
        which_a = np.flatnonzero(links[group_a] <= _LARGE)
        g = group_a[which_a]
        left, right = np.repeat(ids_a[which_a], n_b[g]), ids_b[_ranges(first_b[g], n_b[g])]
        key, weight, of = left << _BITS | right, np.ones(len(left), np.int64), np.repeat(chunk_of[g], n_b[g])
        for i in np.setdiff1d(np.arange(n_groups), small).tolist():  # long runs without a common end: few different ids
            x, m = np.unique(ids_a[first_a[i] : first_a[i] + n_a[i]], return_counts=True)
            y, n = np.unique(ids_b[first_b[i] : first_b[i] + n_b[i]], return_counts=True)
            key = np.append(key, (x[:, None] << _BITS | y[None, :]).ravel())
            weight = np.append(weight, (m[:, None] * n[None, :]).ravel())
            of = np.append(of, np.full(len(x) * len(y), chunk_of[i]))
        order = np.argsort(of, kind="stable")
        many = np.bincount(of, minlength=len(chunks))
        count = lambda where, weights=None: np.bincount(where, weights, minlength=len(chunks)).astype(np.int64)
        sizes = np.stack([count(of_a), count(part[1][good[part[1]]]), count(chunk_of), count(of, weight)], axis=1)
        # in which order ids are said: those of a group's A, then those of its B; with the sign that follows each
        mark = np.zeros(len(ids_a) + len(ids_b), np.int32)
        mark[np.arange(len(ids_a)) + first_b[group_a]] = 3 * ids_a
        mark[np.arange(len(ids_b)) + (first_a + n_a)[group_b]] = 3 * (ids_b + len(self.bytes_a[0]))
        mark[first_a + n_a + first_b - 1] += 1
        mark[first_a + n_a + first_b + n_b - 1] += 2
        marks = sizes[:, 0] + sizes[:, 1]
        self.first_mark = np.append(self.first_mark, len(self.marks) + np.cumsum(marks) - marks)
        self.marks = np.append(self.marks, mark)
        at = len(self.good)
        self.first = np.append(self.first, len(self.pairs) + np.cumsum(many) - many)
        self.many, self.good, self.sizes = np.append(self.many, many), np.append(self.good, good), np.concatenate([self.sizes, sizes])
        self.pairs, self.weights = np.append(self.pairs, key[order]), np.append(self.weights, weight[order])
        self.known.update(zip(chunks, range(at, at + len(chunks)), strict=True))

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], list[np.ndarray], list[np.ndarray]]:
        """For each text: sizes (n_a, n_b, n_groups, n_links), its groups as ASCII text, its different links in order and how many of each."""
        raw, at = _spaced(*common.buffers(texts))
        starts = _cuts(raw, at)
        n = np.diff(np.searchsorted(starts, at))
        coded = pc.dictionary_encode(common.strings(raw, np.append(starts, len(raw))).cast(pa.large_binary()))
        chunks = coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.clear()
        if new := [c for c in chunks if c not in self.known]:
            self.learn(new)
        where = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        for c in new:
            if len(c) > _LONG:
                del self.known[c]
        entry = where[coded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(n)), n)
        bad = np.zeros(len(n), bool)
        bad[doc[~self.good[entry]]] = True
        bad |= np.diff(at) <= 1  # the space alone
        entry, doc = entry[~bad[doc]], doc[~bad[doc]]
        sizes = np.zeros((len(n), 4), np.int64)
        np.add.at(sizes, doc, self.sizes[entry])
        size, start, raw = self.said
        mark = self.marks[_ranges(self.first_mark[entry], self.sizes[entry, 0] + self.sizes[entry, 1])]
        text, ends = raw[_ranges(start[mark], size[mark])].tobytes(), np.concatenate([[0], np.cumsum(size[mark])])[np.cumsum(sizes[:, 0] + sizes[:, 1])].tolist()
        said = [text[i : max(i, j - 1)] for i, j in zip([0, *ends], ends, strict=False)]  # without the last sign
        # equal chunks of a text fall together before their links are taken out
        both, times = np.unique(doc << 32 | entry, return_counts=True)
        doc, entry = both >> 32, both & 0xFFFFFFFF
        many = self.many[entry]
        take = _ranges(self.first[entry], many)
        key, weight = np.repeat(doc, many) << 2 * _BITS | self.pairs[take], self.weights[take] * np.repeat(times, many)
        order = np.argsort(key)
        key = key[order]
        first, _ = common.runs_of(key)
        weight = np.add.reduceat(weight[order], first) if len(first) else weight
        key = key[first]
        split = np.searchsorted(key, np.arange(1, len(n)) << 2 * _BITS)
        return sizes, said, np.split(key & (1 << 2 * _BITS) - 1, split), np.split(weight, split)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, all others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, starts and all bytes of the tokens of a vocabulary."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return size, np.cumsum(size) - size, np.frombuffer(b"".join(parts), np.uint8)


def _spaced(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a space before each."""
    return np.insert(raw, at[:-1], 32), at + np.arange(len(at))


def _cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text, and at each space behind an ASCII sign or a two-byte letter, but for a text's last byte."""
    cut = raw == 32
    before, lead = np.concatenate([[32], raw[:-1]]), np.concatenate([[32, 32], raw[:-2]])[: len(raw)]
    cut &= ((before > 32) & (before < 127)) | ((before >= 128) & (before < 192) & (lead >= 0xC3) & (lead < 0xE0))
    cut[at[1:][at[1:] > 0] - 1] = False
    cut[at[:-1]] = True
    return np.flatnonzero(cut)


def _aligner(path_a: str, path_b: str) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
    loaded = common.memory("alignment")
    if (path_a, path_b) not in loaded:
        loaded[path_a, path_b] = Aligner(path_a, path_b)
    return loaded[path_a, path_b]


def _blobs(parts: list[np.ndarray], kind: str) -> pa.Array:
    return pa.array([np.ascontiguousarray(x, kind).tobytes() for x in parts], pa.large_binary())


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, weights), one for each row of docs.

    pairs has the text's different links in order as little-endian 64-bit integers, A's id << 26 | B's; weights has as many
    32-bit counts. A text without tokens (null, empty, or not the same bytes again) has zeros, '' and no links. Very long texts
    are one row each; rows that repeat a key stay; other columns aren't read; an empty table gives an empty result.
    """
    common.share_package(docs.sparkSession)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in common.slices(batches, size=_SLICE):
            sizes, said, pairs, weights = aligner.align(batch.column(1))
            digests = pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in said], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sizes.T), digests, _blobs(pairs, "<i8").cast(pa.binary()), _blobs(weights, "<u4").cast(pa.binary())], [key, *_SIZES, "groups_sha256", "pairs", "weights"])

    kind = docs.schema[key].dataType.simpleString()
    whole = ", ".join(f"{n} bigint" for n in _SIZES)
    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, {whole}, groups_sha256 string, pairs binary, weights binary")


def counted(rows: DataFrame) -> DataFrame:
    """How many rows of aligned() hold each link: rows (a int, b int, n bigint). Tasks sum up before Spark does."""
    common.share_package(rows.sparkSession)

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((key >> _BITS).astype(np.int32)), pa.array((key & (1 << _BITS) - 1).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                more = np.frombuffer(b"".join(batch.column(0).slice(i, 256).to_pylist()), "<i8")
                key, back = np.unique(np.concatenate([key, more]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n, np.ones(len(more))]), len(key)).astype(np.int64)
                if len(key) > _HELD:
                    yield out(key, n)
                    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out(key, n)

    return rows.select("pairs").mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", block: int = BLOCK_PAIRS) -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each row of docs, over all of its links.

    n_best: links whose count is the highest of their A id; count_sum: the counts of all links, added up. Texts are aligned once
    and written with their links. The counts of all id pairs then go out in blocks of about `block` pairs, cut between A ids: as
    many broadcasts as that takes, each of bounded size, and a pass over the written links for each. Odd rows: see aligned().
    """
    rows = common.stored(aligned(docs, path_a, path_b, key, text).withColumn("_row", F.monotonically_increasing_id()), "links")
    counts = common.stored(counted(rows), "pair-counts")
    by_a = counts.groupBy("a").agg(F.count("*").alias("n")).orderBy("a").toArrow()  # one row for each id of A at most
    ids, n = by_a.column("a").to_numpy(), by_a.column("n").to_numpy()
    edges = [ids[i] for i in np.flatnonzero(np.diff((np.cumsum(n) - n) // block, prepend=-1))] or [0]
    spans = list(zip(edges, [*edges[1:], 1 << _BITS], strict=True))
    parts = []
    for low, high in spans:
        table = counts.filter((F.col("a") >= int(low)) & (F.col("a") < int(high))).toArrow()
        pair = table.column("a").to_numpy().astype(np.int64) << _BITS | table.column("b").to_numpy()
        order = np.argsort(pair)
        parts.append(_looked_up(rows, pair[order], table.column("n").to_numpy()[order], int(low), int(high), keep=len(spans) == 1))
    columns = [key, *_SIZES, "n_best", "count_sum", "groups_sha256"]
    if len(parts) == 1:
        return parts[0].select(*columns)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    summed = every.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(summed, "_row").select(*columns)


def _looked_up(rows: DataFrame, pair: np.ndarray, n: np.ndarray, low: int, high: int, keep: bool) -> DataFrame:
    """n_best and count_sum over the links whose A id lies from low to below high; pair and n hold the counts of all of these."""
    starts, _ = common.runs_of(pair >> _BITS)
    best = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(n)))) == n if len(n) else np.zeros(0, bool)
    sent = rows.sparkSession.sparkContext.broadcast((pair, n, best))
    kept = [c for c in rows.columns if c not in ("pairs", "weights")] if keep else ["_row"]

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            sums = np.zeros((batch.num_rows, 2), np.int64)
            for i, (links, weights) in enumerate(zip(batch.column("pairs"), batch.column("weights"), strict=True)):
                own = np.frombuffer(links.as_buffer(), "<i8")
                i0, i1 = np.searchsorted(own, [low << _BITS, high << _BITS])
                if i0 < i1:
                    at, w = np.searchsorted(pair, own[i0:i1]), np.frombuffer(weights.as_buffer(), "<u4")[i0:i1].astype(np.int64)
                    sums[i] = (w[best[at]].sum(), (w * n[at]).sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums.T)], [*kept, "n_best", "count_sum"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "pairs", "weights").mapInArrow(run, f"{kinds}, n_best bigint, count_sum bigint")
