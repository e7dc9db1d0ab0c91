"""LM scoring: masked pseudo-likelihood under a network that predicts each word from the words on both sides of it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlex.llm import common

#: Words to either side, classes of words, words of a class, size of a word's vector and of the hidden layer.
REACH, CLASSES, MEMBERS, WIDTH, HIDDEN = 2, 64, 64, 16, 32
#: Passes over the corpus; each takes another share of every text's words, all of them together every word once.
ROUNDS = 3
#: Words whose counts tasks hold (16 bytes each); the counts of rarer ones are joined.
KNOWN = 1 << 20
_BATCH = 2048
_BLOCK = 4096
_GROUPS = 32
_SCORE = 1 << 15


def kinds(words: pa.Array) -> np.ndarray:
    """1 to 63 by a word's length, first and last byte. Words must not be empty."""
    sizes = pc.binary_length(words).to_numpy().astype(np.int64)
    starts = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    return 1 + (sizes * 7 + data[starts[:-1]].astype(np.int64) * 13 + data[starts[1:] - 1].astype(np.int64) * 29) % (MEMBERS - 1)


@dataclass
class Vocabulary:
    """The most frequent words have ids from MEMBERS on, by rank; the ids 1 to 63 are kinds of other words, 0 is beyond a text.

    Other words are told apart within their kind by their own counts: a word seen n times has n + 1 shares of its kind, and one
    share is left for words never seen. whole holds the logarithms of the kinds' shares; counts, rows (word, h, n), grows with the
    input and is only joined. known holds the sorted hashes of the most frequent words, KNOWN at most, and the logarithms of their
    shares, so that few words are left to join.
    """

    words: pa.Array
    whole: np.ndarray
    known: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0))
    counts: DataFrame | None = None
    indexed: DataFrame | None = None

    def of(self, words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.empty(0, np.int64)
        found = pc.index_in(words, self.words).fill_null(-1).to_numpy().astype(np.int64)
        return np.where(found < 0, kinds(pc.fill_null(words, "")), found + MEMBERS)

    def read(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All words of the texts, their ids, and how many words each text has."""
        raw, at = common.buffers(texts)
        words, n = common.spaced_words(raw.tobytes().lower(), at)  # bytes: ASCII letters only
        return words, self.of(words), n

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.read(texts)[1:]

    def local(self) -> Vocabulary:
        """What tasks need: all but the table."""
        return Vocabulary(self.words, self.whole, self.known)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (word, h, n) over all texts, summed within each task first; h is the word's hash."""
    common.share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(waiting).group_by("word", use_threads=False).aggregate([("n", "sum")])

        def out() -> Iterator[pa.RecordBatch]:
            for part in merged().to_batches(max_chunksize=1 << 15) if waiting else []:
                yield pa.RecordBatch.from_arrays([part.column("word").cast(pa.string()), part.column("n_sum")], ["word", "n"])

        for batch in common.slices(batches, text):
            raw, at = common.buffers(batch.column(0))
            words, _ = common.spaced_words(raw.tobytes().lower(), at)
            if not len(words):
                continue
            coded = pc.dictionary_encode(words)
            waiting.append(pa.table({"word": coded.dictionary, "n": pa.array(np.bincount(coded.indices.to_numpy()).astype(np.int64))}))
            size += len(coded.dictionary)
            if size > 1 << 19:
                waiting = [merged().rename_columns({"word": "word", "n_sum": "n"})]
                size = len(waiting[0])
                if size > 1 << 18:
                    yield from out()
                    waiting, size = [], 0
        yield from out()

    counted = docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.select("word", F.xxhash64("word").alias("h"), "n")


def _hashes(words: pa.Array) -> np.ndarray:
    """As Spark's xxhash64 has them."""
    spelt = words.to_numpy(zero_copy_only=False)  # objects, twice as fast as to_pylist()
    return np.frombuffer(b"".join([xxhash.xxh64_digest(w, 42) for w in spelt]), ">i8").astype(np.int64)


def index(docs: DataFrame, words: Vocabulary, key: str, text: str) -> DataFrame:
    """Rows (key, row, n, ids, gain, rare), one for each row of docs: words, their ids as 16-bit numbers, and of those outside the vocabulary
    the sum of the known logarithms of shares, and the hashes of the others.

    Texts are cut into words here once; training and scoring read what is written.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words.local())
    (row,) = common.fresh(docs.select(key), "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in common.slices(batches):
            if not batch.num_rows:
                continue
            spelt, ids, n = words.read(batch.column(1))
            rare = ids < MEMBERS
            coded = pc.dictionary_encode(spelt.filter(pa.array(rare)))
            hashed = _hashes(coded.dictionary)
            stop = np.concatenate([[0], np.cumsum(n)])
            of_rare = np.concatenate([[0], np.cumsum(rare)])[stop]
            have, gain = words.known
            found = np.minimum(np.searchsorted(have, hashed), max(len(have) - 1, 0))
            told = have[found] == hashed if len(have) else np.zeros(len(hashed), bool)
            of = coded.indices.to_numpy()
            each = np.concatenate([[0.0], np.cumsum(np.where(told, gain[found], 0.0)[of] if len(have) else np.zeros(len(of)))])
            left = ~told[of]
            others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)])[of_rare], pa.int32()), pa.array(hashed[of[left]]))
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * stop).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), blobs, pa.array(np.diff(each[of_rare])), others], [key, row, "n", "ids", "gain", "rare"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).alias("text"), F.monotonically_increasing_id().alias(row))
    return common.stored(rows.mapInArrow(run, f"`{key}` {kind}, `{row}` bigint, n bigint, ids binary, gain double, rare array<bigint>"), "word-ids")


def _ids(batch: pa.RecordBatch, n: str = "n", ids: str = "ids") -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(ids, words of each text, first row, rows) of parts of a batch of bounded size."""
    sizes, column = batch.column(batch.schema.names.index(n)).to_numpy(), batch.column(batch.schema.names.index(ids))
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = min(len(sizes), max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right"))))
        yield np.frombuffer(b"".join(column.slice(i, j - i).to_pylist()), "<u2").astype(np.int64), sizes[i:j], i, j - i
        i = j


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """The most frequent words. A histogram of the counts on a log scale tells from which count on words can be among them, so
    that tasks don't each send as many words as the vocabulary holds."""
    most = (CLASSES - 1) * MEMBERS
    counts = common.stored(word_counts(docs, text), "word-counts")
    step = F.floor(F.log2("n") * 8)
    have, least = 0, 0
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect(), reverse=True)  # a few hundred rows
    for row in steps:
        have, least = have + row.words, row.n
        if have >= most:
            break
    rows = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    found = Vocabulary(pa.array([r.word for r in rows], pa.large_string()), np.zeros(MEMBERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = np.zeros(MEMBERS, np.int64)
        for batch in batches:
            ids = found.of(batch.column(0).cast(pa.large_string()))
            other = np.flatnonzero(ids < MEMBERS)
            np.add.at(shares, ids[other], batch.column(1).to_numpy()[other] + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(MEMBERS)), pa.array(shares)], ["kind", "shares"])

    shares = np.ones(MEMBERS)
    for row in counts.select("word", "n").mapInArrow(run, "kind bigint, shares bigint").groupBy("kind").agg(F.sum("shares").alias("shares")).collect():  # MEMBERS rows
        shares[row.kind] += row.shares
    fits = [r.n for r, words in zip(steps, np.cumsum([r.words for r in steps]), strict=True) if words <= KNOWN]
    known = counts.filter(F.col("n") >= fits[-1] if fits else F.lit(False)).groupBy("h").agg(F.max("n").alias("n")).toArrow()
    h, n = known.column("h").to_numpy(), known.column("n").to_numpy()
    order = np.argsort(h)
    return Vocabulary(found.words, np.log(shares), (h[order], np.log1p(n[order])), counts)


def contexts(ids: np.ndarray, n: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """[words, 2 REACH]: the ids around each word, or around those at the places `at`; 0 where a word's text has ended."""
    # REACH zeros stand before each text, and behind the last one
    place = np.repeat(np.arange(1, len(n) + 1) * REACH, n)
    place += np.arange(len(ids))
    spread = np.zeros(len(ids) + (len(n) + 1) * REACH, np.int64)
    spread[place] = ids
    if at is not None:
        place = place.take(at)
    out = np.empty((len(place), 2 * REACH), np.int64)
    for c, step in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        out[:, c] = spread.take(place + step)
    return out


def targets(n: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Where the words stand that a round trains on, for texts of n words each. Every word has its place in one of the rounds.

    Those are the places of a text whose sum with its number of words leaves `turn`.
    """
    first = (turn - n) % rounds
    many = np.maximum(n - first + rounds - 1, 0) // rounds
    return np.repeat(np.cumsum(n) - n + first - rounds * (np.cumsum(many) - many), many) + rounds * np.arange(many.sum())


class Network:
    """Vectors of the words around, a hidden layer, then a softmax over classes and one over the words of the class."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 0) -> None:
        shapes = [(CLASSES * MEMBERS, WIDTH), (2 * REACH * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, MEMBERS), (CLASSES, MEMBERS)]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([(rng.normal(0, s, int(np.prod(shape)))) for shape, s in zip(shapes, (0.3, 0.15, 0, 0.1, 0, 0.1, 0), strict=True)])
        self.flat = np.array(flat, np.float32)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        self.vectors, self.w, self.b, self.wc, self.bc, self.wm, self.bm = (p.reshape(s) for p, s in zip(np.split(self.flat, cuts[:-1]), shapes, strict=True))

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.vectors.take(context, axis=0).reshape(len(context), -1)
        h = x @ self.w
        h += self.b
        return x, _tanh(h)

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """A block of words at a time, so that what is worked on stays in the processor's cache."""
        by = _by_class(target)
        out = np.empty(len(target), np.float32)
        for i in range(0, len(by), _BATCH):
            part = by[i : i + _BATCH]
            out[part] = self._log_prob(context.take(part, axis=0), target.take(part))
        return out

    def _log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, h = self.hidden(context)
        cls, member = target >> 6, target & (MEMBERS - 1)
        every = np.arange(len(cls))
        z = h @ self.wc
        z += self.bc
        out = z[every, cls]
        out -= _log_sum(z)
        z = self.bm.take(cls, axis=0)
        for c, a, b in _runs(cls):
            z[a:b] += h[a:b] @ self.wm[c]
        out += z[every, member]
        out -= _log_sum(z)
        return out

    def train(self, context: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rate: float = 0.1) -> None:
        """One Adagrad step on a minibatch; memory holds the sums of squared gradients."""
        n = len(target)
        by = _by_class(target)
        context, target = context.take(by, axis=0), target.take(by)
        x, h = self.hidden(context)
        cls, member, every = target >> 6, target & (MEMBERS - 1), np.arange(n)
        grad_c = h @ self.wc
        grad_c += self.bc
        _softmax(grad_c)
        grad_c[every, cls] -= 1
        grad_h = grad_c @ self.wc.T
        runs = _runs(cls)
        g = self.bm.take(cls, axis=0)
        for c, a, b in runs:
            g[a:b] += h[a:b] @ self.wm[c]
        _softmax(g)
        g[every, member] -= 1
        ones = np.ones(n, np.float32)
        grad_m, grad_b = np.zeros_like(self.wm), np.zeros_like(self.bm)
        for c, a, b in runs:
            part = g[a:b]
            grad_h[a:b] += part @ self.wm[c].T
            np.matmul(h[a:b].T, part, out=grad_m[c])
            np.matmul(ones[a:b], part, out=grad_b[c])
        # classes without a word here have gradients of 0, which leave them as they are
        grad_wc, grad_bc = h.T @ grad_c, ones @ grad_c
        h *= h
        np.subtract(1, h, out=h)
        grad_h *= h  # now the gradient before tanh
        grad_x = grad_h @ self.w.T
        grad_w = x.T @ grad_h
        for p, m, d in ((self.wm, memory[5], grad_m), (self.bm, memory[6], grad_b), (self.w, memory[1], grad_w), (self.b, memory[2], ones @ grad_h), (self.wc, memory[3], grad_wc), (self.bc, memory[4], grad_bc)):
            d /= np.float32(n)
            p -= _step(m, d, rate)
        around = context.ravel()
        order = np.argsort(around.astype(np.uint16), kind="stable")
        starts, _ = common.runs_of(around.take(order))
        ids = around.take(order.take(starts))
        d = np.add.reduceat(grad_x.reshape(-1, WIDTH).take(order, axis=0), starts, axis=0)
        d /= np.float32(n)
        seen = memory[0].take(ids, axis=0)
        self.vectors[ids] -= _step(seen, d, rate)
        memory[0][ids] = seen

    def memory(self) -> list[np.ndarray]:
        return [np.full_like(p, 1e-4) for p in (self.vectors, self.w, self.b, self.wc, self.bc, self.wm, self.bm)]


def _by_class(target: np.ndarray) -> np.ndarray:
    return np.argsort((target >> 6).astype(np.uint16), kind="stable")


def _runs(cls: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, start, end) of the runs of sorted classes."""
    starts, sizes = common.runs_of(cls)
    return list(zip(cls[starts].tolist(), starts.tolist(), (starts + sizes).tolist(), strict=True))


def _step(m: np.ndarray, d: np.ndarray, rate: float) -> np.ndarray:
    """What Adagrad takes off for the gradient d; m, the sum of squares, is added to."""
    t = d * d
    m += t
    np.add(m, 1e-8, out=t)
    np.sqrt(t, out=t)
    np.divide(d, t, out=t)
    t *= rate
    return t


def _tanh(x: np.ndarray) -> np.ndarray:
    """In its place: 1 - 2 / (exp(2 x) + 1), in two thirds of np.tanh's time. Beyond 20 nothing changes any more."""
    np.clip(x, -20, 20, out=x)
    x += x
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1
    return x


def _exp(z: np.ndarray) -> np.ndarray | None:
    """exp of z in its place. Rows are moved by their largest values, which are returned then, only where they could overflow or vanish."""
    top = None
    if z.size and not (z.max() < 60 and z.min() > -60):
        top = z.max(axis=1)
        z -= top[:, None]
    np.exp(z, out=z)
    return top


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Overwrites z."""
    top = _exp(z)
    out = np.log(z @ np.ones(z.shape[1], z.dtype))
    return out if top is None else top + out


def _softmax(z: np.ndarray) -> None:
    """In its place."""
    _exp(z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]


def _train_round(rows: DataFrame, net: Network, turn: int, rounds: int) -> Network:
    """Every task trains a copy of the network on its texts, rows (n, ids); the copies are averaged by the words they saw.

    Copies are added up in _GROUPS groups first, block by block, so that no task gathers a block of all copies, and what a block's
    last task reads doesn't grow with the tasks.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(net.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, waiting = Network(shared.value), 0, []
        memory = own.memory()
        for batch in batches:
            for ids, n, _, _ in _ids(batch):
                at = targets(n, turn, rounds)
                waiting.append((contexts(ids, n, at), ids[at]))
                if sum(len(t) for _, t in waiting) < 1 << 15:
                    continue
                seen += _learn(own, memory, waiting, seen)
                waiting = []
        seen += _learn(own, memory, waiting, seen)
        if seen:
            starts = range(0, len(own.flat), _BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([i // _BLOCK for i in starts], pa.int32()), pa.array([float(seen)] * len(starts)), pa.array([own.flat[i : i + _BLOCK].tobytes() for i in starts], pa.binary())], ["block", "seen", "part"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, weight = None, np.zeros(0), 0.0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "seen", "part"])

        for batch in batches:
            names = batch.schema.names
            for b, seen, part in zip(*(batch.column(names.index(c)).to_pylist() for c in ("block", "seen", "part")), strict=True):
                values = np.frombuffer(part, np.float32) * seen
                if b != block:
                    if block is not None:
                        yield out()
                    block, total, weight = b, values.astype(np.float64), seen
                else:
                    total, weight = total + values, weight + seen
        if block is not None:
            yield out()

    schema = "block int, seen double, part binary"
    copies = rows.select("n", "ids").mapInArrow(run, schema).withColumn("task", F.spark_partition_id())
    some = copies.repartition("block", F.col("task") % _GROUPS).sortWithinPartitions("block", "task").mapInArrow(average, schema)
    whole = some.repartition("block").sortWithinPartitions("block", "seen").mapInArrow(average, schema)
    found = sorted((r.block, r.part) for r in whole.collect())  # one network
    return Network(np.concatenate([np.frombuffer(p, np.float32) for _, p in found])) if found else net


def _learn(net: Network, memory: list[np.ndarray], waiting: list[tuple[np.ndarray, np.ndarray]], seed: int) -> int:
    if not waiting:
        return 0
    context, target = np.concatenate([c for c, _ in waiting]), np.concatenate([t for _, t in waiting])
    order = np.random.default_rng(seed).permutation(len(target))
    for i in range(0, len(order), _BATCH):
        net.train(context.take(order[i : i + _BATCH], axis=0), target.take(order[i : i + _BATCH]), memory)
    return len(target)


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, key: str = "doc_id") -> tuple[Vocabulary, Network]:
    """Vocabulary and network from all words of all texts. Each round starts all tasks from the average of the round before."""
    common.share_package(docs.sparkSession)
    words, net = vocabulary(docs, text), Network()
    words.indexed = index(docs, words, key, text)
    for turn in range(rounds):
        net = _train_round(words.indexed, net, turn, rounds)
    return words, net


def score(docs: DataFrame | None, words: Vocabulary, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, log_likelihood, mean_log_prob), one for each row of docs; of the texts trained on, if docs is None.

    log_likelihood sums, over every word of a text, the log-probability of the word given those on both sides: the network's for
    words of the vocabulary, and for others the network's for their kind and the word's own within the kind. Null and empty
    texts have no words, the sum 0 and no mean. Rows that repeat a key are scored each, equal texts alike; a very long text is
    scored whole, part by part; an empty table gives an empty result. Other columns aren't read.
    """
    indexed = words.indexed if docs is None else index(docs, words, key, text)
    common.share_package(indexed.sparkSession)
    shared = indexed.sparkSession.sparkContext.broadcast((words.whole, net.flat))
    row = indexed.columns[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, flat = shared.value
        own = Network(flat)
        for batch in batches:
            for ids, n, first, rows in _ids(batch):
                around = contexts(ids, n)
                each = [own.log_prob(around[i : i + _SCORE], ids[i : i + _SCORE]) for i in range(0, len(ids), _SCORE)]
                each = np.concatenate([np.empty(0), *each], dtype=np.float64)
                rare = ids < MEMBERS
                each[rare] -= whole[ids[rare]]
                ends, stop = np.concatenate([[0.0], np.cumsum(each)]), np.cumsum(n)
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pc.add(pa.array(ends[stop] - ends[stop - n]), part.column(4))], [key, row, "n_tokens", "log_likelihood"])

    kind = indexed.schema[key].dataType.simpleString()
    scored = indexed.select(key, row, "n", "ids", "gain").mapInArrow(run, f"`{key}` {kind}, `{row}` bigint, n_tokens bigint, log_likelihood double")
    gains = words.counts.groupBy("h").agg(F.log1p(F.max("n")).alias("gain"))
    asked = indexed.select(row, F.explode("rare").alias("h"))
    gained = asked.join(gains, "h").groupBy(row).agg(F.sum("gain").alias("gain"))
    total = F.col("log_likelihood") + F.coalesce("gain", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return scored.join(gained, row, "left").select(key, "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_prob"))
