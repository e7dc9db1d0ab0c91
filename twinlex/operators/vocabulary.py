"""Joint subword vocabulary: pieces counted by Spark, merges learnt from the counts, encoding and decoding by Arrow UDFs."""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

SPECIALS = ("<pad>", "<s>", "</s>", "<unk>", "<2am>", "<2en>")
BYTES = tuple(f"<0x{b:02X}>" for b in range(256))
FIRST_BYTE = len(SPECIALS)
SPACE = "▁"
ASCII_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Pieces whose ids a worker remembers.
_MEMO = 1 << 18
#: Rows of a batch that are Python objects at a time.
_ROWS = 64
_APART = r"\p{P}\p{N}!-/:-@\[-`{-~"
PIECE = f"[{_APART}]|{SPACE}[^{SPACE}{_APART}]*|[^{SPACE}{_APART}]+"


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def pieces(text: Column) -> Column:
    """array<string>: words with a mark in place of the space before them; marks and digits stand alone."""
    composed = F.coalesce(_compose(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)
    marked = F.replace(composed, F.lit(" "), F.lit(SPACE))
    return F.regexp_extract_all(F.when(marked.startswith(SPACE) | (marked == ""), marked).otherwise(F.concat(F.lit(SPACE), marked)), F.lit(PIECE), F.lit(0))


def piece_counts(texts: DataFrame, text: str, least: int = 1) -> DataFrame:
    """Rows (piece, n): how often each piece occurs, from `least` times on."""
    return texts.select(F.explode(pieces(F.col(text))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


@dataclass(frozen=True)
class Vocabulary:
    """Tokens in the order of their ids: specials, bytes, single characters, then one for each merge."""

    tokens: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]
    _memo: dict[str, list[int]] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        if lacking := [t for t in SPECIALS if t not in self.tokens[: len(SPECIALS)]]:
            raise ValueError(f"vocabulary lacks special tokens {lacking}")

    @cached_property
    def id_of(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @cached_property
    def rank_of(self) -> dict[tuple[str, str], int]:
        return {m: i for i, m in enumerate(self.merges)}

    def lang_id(self, lang: str) -> int:
        return self.id_of[f"<2{lang}>"]

    @staticmethod
    def is_byte(token_id: int) -> bool:
        return FIRST_BYTE <= token_id < FIRST_BYTE + 256

    def token(self, token_id: int) -> str:
        return self.tokens[token_id] if 0 <= token_id < len(self.tokens) else "<unk>"

    def encode_piece(self, piece: str) -> list[int]:
        if (known := self._memo.get(piece)) is None:
            if len(self._memo) >= _MEMO:
                self._memo.clear()
            known = self._memo[piece] = self._merge(piece)
        return known

    def kind(self, token_id: int) -> str:
        """special, byte or text."""
        return "special" if token_id < FIRST_BYTE else "byte" if self.is_byte(token_id) else "text"

    def inspect(self, text: str) -> list[tuple[str, int, str]]:
        """(token, id, kind) of a text's tokens, cut as pieces() cuts them."""
        marked = unicodedata.normalize("NFC", text).replace(" ", SPACE)
        alone = lambda c: unicodedata.category(c)[0] in "PN" or c in ASCII_MARKS
        parts: list[str] = []
        for c in marked if marked.startswith(SPACE) or not marked else SPACE + marked:
            if c == SPACE or alone(c) or not parts or alone(parts[-1][0]):
                parts.append(c)
            else:
                parts[-1] += c
        return [(self.token(i), i, self.kind(i)) for p in parts for i in self.encode_piece(p)]

    def _merge(self, piece: str) -> list[int]:
        parts = list(piece)
        while len(parts) > 1:
            ranked = [(self.rank_of.get(pair, len(self.merges)), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False))]
            rank, at = min(ranked)
            if rank == len(self.merges):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out: list[int] = []
        for p in parts:
            out.extend([self.id_of[p]] if p in self.id_of else [FIRST_BYTE + b for b in p.encode()])
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids but for the six specials; bytes are put together, the leading space goes."""
        raw = b"".join(bytes([i - FIRST_BYTE]) if self.is_byte(i) else self.token(i).replace(SPACE, " ").encode() for i in ids if i >= len(SPECIALS))
        return raw.decode("utf-8", "replace").removeprefix(" ")

    def to_json(self) -> str:
        return json.dumps({"tokens": self.tokens, "merges": self.merges}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        raw = json.loads(text)
        return cls(tuple(raw["tokens"]), tuple(map(tuple, raw["merges"])))


#: Symbols of a block of pieces that merges go through: what they compare stays in the cache.
_SYMBOLS = 1 << 18


class _Pieces:
    """Pieces as blocks of symbols, a separator (0) behind each piece, with the pieces' counts.

    A symbol takes two bytes where all ids do; no piece is an object. Pieces of one character have nothing to merge and are left out.
    """

    def __init__(self, counts: Iterable[tuple[str, int]], size: int) -> None:
        self.blocks: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        rows, places, several = iter(counts), {}, []
        while part := list(islice(rows, 1 << 13)):
            text = "".join(p for p, _ in part)
            for c in set(text):
                places.setdefault(c, len(places) + 1)
            if part := [x for x in part if len(x[0]) > 1]:
                points, at = np.unique(np.frombuffer("".join(p for p, _ in part).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
                ends = np.cumsum([len(p) for p, _ in part])
                block = np.insert(np.array([places[chr(c)] for c in points], np.uint32)[at], ends, 0)
                several.append((block.astype(np.uint16) if len(places) < 1 << 16 else block, self._narrow(np.array([n for _, n in part], np.int64))))
            if sum(len(b) for b, _ in several) >= _SYMBOLS:
                self._close(several)
        self._close(several)
        self.alphabet = sorted(places)
        first = len(SPECIALS) + len(BYTES)
        ids = np.zeros(len(places) + 1, np.uint16 if max(size, first + len(places)) < 1 << 16 else np.uint32)
        for i, c in enumerate(self.alphabet):
            ids[places[c]] = first + i
        for i, block in enumerate(self.blocks):
            self.blocks[i] = ids[block]

    @staticmethod
    def _narrow(counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.min_scalar_type(int(counts.max())))

    def _close(self, several: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if several:
            self.blocks.append(np.concatenate([b for b, _ in several]))
            self.counts.append(np.concatenate([c for _, c in several]))
            several.clear()

    @staticmethod
    def _pairs(block: np.ndarray, at: np.ndarray, n: np.ndarray) -> dict[tuple[int, int], int]:
        """How often each pair of neighbours occurs that begins at these places, by the count of each place's piece."""
        left, right = block[at].astype(np.int64), block[at + 1].astype(np.int64)
        inside = (left > 0) & (right > 0)
        keys, which = np.unique(left[inside] << 32 | right[inside], return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, which, n[inside].astype(np.int64))
        return {(k >> 32, k & 0xFFFFFFFF): x for k, x in zip(keys.tolist(), sums.tolist(), strict=True)}

    def _counted(self, i: int, at: np.ndarray) -> dict[tuple[int, int], int]:
        """_pairs of a block's places."""
        return self._pairs(self.blocks[i], at, self.counts[i][np.searchsorted(np.flatnonzero(self.blocks[i] == 0), at)])

    def pairs(self) -> dict[tuple[int, int], int]:
        total: dict[tuple[int, int], int] = defaultdict(int)
        for i, block in enumerate(self.blocks):
            for pair, n in self._counted(i, np.arange(len(block) - 1)).items():
                total[pair] += n
        return total

    def merge(self, pair: tuple[int, int], new: int) -> dict[tuple[int, int], int]:
        """Put new in place of a pair, from left to right in each piece; by how much the counts of pairs change."""
        change: dict[tuple[int, int], int] = defaultdict(int)
        for i, block in enumerate(self.blocks):
            at = np.flatnonzero((block[:-1] == pair[0]) & (block[1:] == pair[1]))
            if not len(at):
                continue
            if pair[0] == pair[1]:  # of places in a row every other one
                begins = np.concatenate([[True], np.diff(at) > 1])
                run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            around = np.unique(np.concatenate([at - 1, at, at + 1]))
            for old, n in self._counted(i, around[(around >= 0) & (around < len(block) - 1)]).items():
                change[old] -= n
            keep = np.ones(len(block), bool)
            keep[at + 1] = False
            block[at] = new
            self.blocks[i] = block[keep]
            at = at - np.arange(len(at))
            around = np.unique(np.concatenate([at - 1, at]))
            for fresh, n in self._counted(i, around[around >= 0]).items():
                change[fresh] += n
        return change


def learn(counts: dict[str, int] | Iterable[tuple[str, int]], size: int, least: int) -> Vocabulary:
    """Merge the most frequent pair of neighbours again and again, until `size` tokens or no pair occurs `least` times.

    counts: different pieces, each with its count, in any order. They are kept as blocks of numbers, and a merge goes through
    all of them. Of equally frequent pairs the first by ids goes first.
    """
    pieces = _Pieces(counts.items() if isinstance(counts, dict) else counts, size)
    tokens = [*SPECIALS, *BYTES, *pieces.alphabet]
    ids = {t: i for i, t in enumerate(tokens)}
    total = pieces.pairs()
    heap = [(-n, pair) for pair, n in total.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(tokens) < size:
        n, pair = heapq.heappop(heap)
        if -n != total.get(pair, 0):  # it has changed since: put back with its present count
            if total.get(pair, 0) > 0:
                heapq.heappush(heap, (-total[pair], pair))
            continue
        if -n < max(least, 1):
            break
        joined = tokens[pair[0]] + tokens[pair[1]]
        new = ids.get(joined)
        if new is None:
            new = ids[joined] = len(tokens)
            tokens.append(joined)
        merges.append((tokens[pair[0]], tokens[pair[1]]))
        for changed, by in pieces.merge(pair, new).items():
            total[changed] += by
            if by > 0:
                heapq.heappush(heap, (-total[changed], changed))
        total.pop(pair, None)
    return Vocabulary(tuple(tokens), tuple(merges))


def train(texts: DataFrame, text: str, size: int, least: int) -> Vocabulary:
    """From the pieces of all texts: what the driver gets is one row for each different piece, a partition at a time."""
    return learn(((r.piece, r.n) for r in piece_counts(texts, text).toLocalIterator()), size, least)


def encoded(text: Column, vocabulary: Vocabulary, spark, shared: Broadcast | None = None) -> Column:
    """array<int> without specials. Pieces are cut in the JVM; the merges are broadcast once, or by the caller: columns that share them share a worker's memo."""
    shared = shared or spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(lists: pa.Array) -> pa.Array:
        one, ids, ends = shared.value.encode_piece, array("i"), [0]
        for at in range(0, len(lists), _ROWS):
            part = lists.slice(at, _ROWS)
            found = iter(part.flatten().to_pylist())
            for n in part.value_lengths().fill_null(0).to_pylist():
                for p in islice(found, n):
                    ids.extend(one(p))
                ends.append(len(ids))
        values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=lists.is_null())

    return encode(pieces(text))


def decoded(ids: Column, vocabulary: Vocabulary, spark) -> Column:
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(StringType())
    def decode(lists: pa.Array) -> pa.Array:
        one = shared.value.decode
        parts = [pa.array([None if x is None else one(x) for x in lists.slice(at, _ROWS).to_pylist()], pa.string()) for at in range(0, len(lists), _ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode(ids)


def use_by_class(ids: DataFrame, column: str, size: int) -> DataFrame:
    """Rows (kind, in_vocabulary, used, n): how many of a class's ids there are, how many occur, and how often, for the classes special, byte and text."""
    kind = lambda c: F.when(c < FIRST_BYTE, "special").when(c < FIRST_BYTE + 256, "byte").otherwise("text")
    counts = ids.select(F.explode(column).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    found = counts.groupBy(kind(F.col("id")).alias("_kind")).agg(F.count("*").alias("used"), F.sum("n").alias("n"))
    sizes = [("special", FIRST_BYTE), ("byte", 256), ("text", size - FIRST_BYTE - 256)]
    every = ids.sparkSession.createDataFrame(sizes, "kind string, in_vocabulary bigint")
    none = F.lit(0).cast("bigint")
    return every.join(found, F.col("kind") == F.col("_kind"), "left").select("kind", "in_vocabulary", F.coalesce("used", none).alias("used"), F.coalesce("n", none).alias("n"))


def column_stats(rows: DataFrame, text: str, ids: str) -> DataFrame:
    """One row: sentences, tokens_per_sentence, chars_per_token, byte_fallback_rate, unk_rate."""
    tokens, byte = F.sum(F.size(ids)), F.sum(F.size(F.filter(ids, lambda i: i.between(FIRST_BYTE, FIRST_BYTE + 255))))
    unknown = F.sum(F.size(F.filter(ids, lambda i: i == SPECIALS.index("<unk>"))))
    per = lambda a, b, digits: F.coalesce(F.round(a / F.greatest(b, F.lit(1)), digits), F.lit(0.0))
    n = F.count("*")
    return rows.agg(n.alias("sentences"), per(tokens, n, 3).alias("tokens_per_sentence"), per(F.sum(F.length(text)), tokens, 3).alias("chars_per_token"), per(byte, tokens, 6).alias("byte_fallback_rate"), per(unknown, tokens, 6).alias("unk_rate"))
