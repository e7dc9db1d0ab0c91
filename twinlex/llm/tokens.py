"""Whole texts to ids of a public tokenizer, with a bounded memo of white-space words."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from twinlex.llm import common

class WordEncoder:
    """Encodes texts by a tokenizers file whose pieces never span ASCII white space and never depend on what is beyond it.

    That holds if the normalizer treats white space as a boundary and the pre-tokenizer drops it, as with word_bpe_49k.json.
    The ids are those of Tokenizer.encode(text, add_special_tokens=False); each different word is encoded once as long as
    the memo lasts: it holds the last `most` different words at least and twice as many at most.
    """

    def __init__(self, path: str, most: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and how many each text has. Null: none."""
        words, n = common.spaced_words(*_plain(*common.buffers(texts)))
        at = np.concatenate([[0], np.cumsum(n)])
        if not len(words):
            return np.empty(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        coded = pc.dictionary_encode(words)
        if len(self.memo) > self.most:
            self.memo, self.older = {}, self.memo
        memo, older, different = self.memo, self.older, coded.dictionary.to_pylist()
        parts = [memo.get(w) or older.get(w) for w in different]
        if new := [i for i, part in enumerate(parts) if part is None]:
            texts_new = [different[i] for i in new]
            for i, e in zip(new, self.tokenizer.encode_batch_fast(texts_new, add_special_tokens=False), strict=True):
                parts[i] = array("I", e.ids).tobytes()
        memo.update(zip(different, parts, strict=True))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        table, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        many = size[which]
        ends = np.cumsum(many)
        ids = table[np.repeat(first[which] - ends + many, many) + np.arange(ends[-1])]
        stop = np.concatenate([[0], ends])[np.cumsum(n)]
        return ids, np.diff(stop, prepend=0)


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(97, 123)])
_MARK = ~_BLANK & ~_ALNUM & (np.arange(256) > 32) & (np.arange(256) < 127) & ~np.isin(np.arange(256), range(65, 91))


def _plain(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the same ids but fewer different words: ASCII letters in lower case, marks behind a word parted from it.

    The tokenizer does both itself. Case is left alone where it could matter: beside the combining marks that have composed
    forms in one case only, and where a special token may stand.
    """
    text = raw.tobytes()
    if b"<|" in text or b"\xcc" in text:
        return raw, at
    raw = np.frombuffer(text.lower(), np.uint8)
    mark, alnum = _MARK[raw], _ALNUM[raw]
    starts = np.flatnonzero(mark[1:] & alnum[:-1]) + 1
    other = np.flatnonzero(~mark)
    doc_end = at[np.minimum(np.searchsorted(at, starts, "right"), len(at) - 1)]
    inside = at[np.searchsorted(at, starts, "right") - 1] != starts
    nxt = np.searchsorted(other, starts)
    end = np.minimum(np.where(nxt < len(other), other[np.minimum(nxt, max(len(other) - 1, 0))], len(raw)) if len(other) else len(raw), doc_end)
    starts = starts[inside & ((end == doc_end) | _BLANK[raw[np.minimum(end, len(raw) - 1)]])]
    return np.insert(raw, starts, 32), at + np.searchsorted(starts, at)


def encoder(path: str, most: int = 250_000) -> WordEncoder:
    """One for each worker process, as long as it works for no other operator; worker threads are switched off, as Spark runs one task for each core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    loaded = common.memory("tokens")
    if (path, most) not in loaded:
        loaded[path, most] = WordEncoder(path, most)
    return loaded[path, most]


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text, and the lengths with it."""
    return np.insert(ids, np.cumsum(n), end), n + 1


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ready(spark: SparkSession) -> None:
    common.share_package(spark)
