"""Quality classifier by positive-unlabelled learning: a small network that minimises the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlex.llm import common

#: Trusted positives that are fitted on, in expectation: the one bounded sample. Unlabelled texts and statistics are taken over all texts.
POSITIVES = 12_000
#: Rounds of training, each over all texts: to tell positives from unlabelled texts, for the class prior; and for the risk itself.
PRIOR_ROUNDS, ROUNDS = 2, 6
#: Texts that a task learns from together; passes over them in a round, and steps of a round at least, where there are few, for the prior and for the risk.
CHUNK, PRIOR_EFFORT, EFFORT = 16_384, (2, 60), (8, 400)
HIDDEN, _BATCH, _RATE, _DECAY = 24, 512, 5e-3, 3e-4
#: Groups in which tasks' sums meet before the driver adds them up.
_GROUPS = 32
THRESHOLD = 0.3
FOLDS = 5
_CLASSES = 8
#: Bytes of text whose features are taken together: several arrays of as many integers are held at once.
_SLICE = 1 << 20
#: Kinds of bytes: letters of either case, digits, white space but newline, newline, ends of sentences, other marks, beyond ASCII.
_CLASS = np.array([7 if b >= 128 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b == 10 else 3 if b in (9, 11, 12, 13, 32) else 5 if b in b".,;:" else 6 for b in range(256)], np.int64)
N_FEATURES = 128 + _CLASSES + 14


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text, of nothing but its bytes and words. Null and empty texts: zeros.

    Shares lie between 0 and 1, and whatever has no bound is a logarithm, so that no text's numbers leave the range of half
    precision, to which all are rounded: what is learnt from is stored that way.
    """
    raw, at = common.buffers(texts)
    n_docs = len(at) - 1
    size = np.diff(at)
    doc = np.repeat(np.arange(n_docs), size)
    one = np.maximum(size, 1)[:, None]
    low = raw < 128
    letters = np.bincount(doc[low] * 128 + raw[low], minlength=n_docs * 128).reshape(n_docs, 128)
    kinds = np.bincount(doc * _CLASSES + _CLASS[raw], minlength=n_docs * _CLASSES).reshape(n_docs, _CLASSES)
    words, n = common.spaced_words(raw, at)
    many = np.maximum(n, 1)
    of = np.repeat(np.arange(n_docs), n)
    add = lambda x, i=of: np.bincount(i, weights=x, minlength=n_docs)
    extra = np.zeros((n_docs, 14))
    if len(words):
        coded = pc.dictionary_encode(words)
        ids = coded.indices.to_numpy().astype(np.int64)
        long = pc.utf8_length(coded.dictionary).to_numpy().astype(np.float64)[ids]
        lone = pc.match_substring_regex(coded.dictionary, "^[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+$").to_numpy(zero_copy_only=False)[ids]
        tail = pc.match_substring_regex(coded.dictionary, "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]{2,}$").to_numpy(zero_copy_only=False)[ids]
        same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (of[1:] == of[:-1])])
        every, counts = np.unique(of * len(coded.dictionary) + ids, return_counts=True)
        owner = every // len(coded.dictionary)
        top = np.zeros(n_docs)
        np.maximum.at(top, owner, counts)
        pair = ids[:-1] * len(coded.dictionary) + ids[1:]
        pair = pair[of[1:] == of[:-1]]
        pair_doc = of[1:][of[1:] == of[:-1]]
        order = np.lexsort((pair, pair_doc))
        p, d = pair[order], pair_doc[order]
        first = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]) if len(p) else np.empty(0, bool)
        mean = add(long) / many
        extra[:, :9] = np.stack(
            [np.log1p(mean), np.log1p(np.sqrt(np.maximum(add(long * long) / many - mean * mean, 0))), np.bincount(owner, minlength=n_docs) / many, top / many, add(same) / many, add(first, d) / np.maximum(many - 1, 1), add(lone) / many, add(tail) / many, np.log1p(n)],
            axis=1,
        )
    lines = pc.split_pattern(common.strings(raw, at), "\n")
    flat, n_lines = lines.flatten(), np.diff(lines.offsets.to_numpy())
    line_doc = np.repeat(np.arange(n_docs), n_lines)
    line_ids = pc.dictionary_encode(flat).indices.to_numpy().astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    different = np.unique(np.stack([line_doc[filled], line_ids[filled]]), axis=1)[0]
    n_filled = np.maximum(np.bincount(line_doc[filled], minlength=n_docs), 1)
    extra[:, 9] = np.bincount(different, minlength=n_docs) / n_filled
    extra[:, 10] = np.log1p(size / n_filled)
    extra[:, 11] = np.log1p(n_filled)
    extra[:, 12] = np.log1p(kinds[:, 5] / many)
    extra[:, 13] = np.log1p((kinds[:, 6] + kinds[:, 1]) / np.maximum(kinds[:, 0] + kinds[:, 7], 1))
    return np.concatenate([np.sqrt(letters / one), kinds / one, extra], axis=1).astype(np.float16).astype(np.float32)


@dataclass
class Model:
    """A network of one hidden layer over features less their mean, by their scale; weights holds it flat."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def __post_init__(self) -> None:
        if not all(np.isfinite(x).all() for x in (self.mean, self.scale, self.weights, self.prior)):
            raise FloatingPointError("the classifier's parameters aren't finite")

    def score(self, x: np.ndarray) -> np.ndarray:
        _, _, z = forward(self.normal(x), parts(self.weights))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)


def parts(flat: np.ndarray) -> list[np.ndarray]:
    """Weights and biases of the hidden layer, then of the output, as views of the flat weights."""
    a, b, c = N_FEATURES * HIDDEN, N_FEATURES * HIDDEN + HIDDEN, N_FEATURES * HIDDEN + 2 * HIDDEN
    return [flat[:a].reshape(N_FEATURES, HIDDEN), flat[a:b], flat[b:c], flat[c:]]


def start(seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / N_FEATURES) ** 0.5, N_FEATURES * HIDDEN), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    return np.concatenate(w).astype(np.float32)


def forward(x: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = x @ w[0] + w[1]
    h = np.maximum(a, 0)
    return a, h, h @ w[2] + w[3][0]


def risk(z: np.ndarray, n_p: int, prior: float | None) -> tuple[float, np.ndarray]:
    """Value and gradient by z, the logits of n_p positives and then of unlabelled texts, with the logistic loss.

    The non-negative unbiased risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). Where the estimated negative risk is below
    0, the gradient is the one that makes it rise again, so that the network can't win by fitting the trusted positives as
    negatives of the unlabelled texts. Without a prior, the risk of telling positives from unlabelled texts, both weighed alike.
    """
    s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))  # d softplus(z)/dz; softplus(z) is the loss of a negative, softplus(-z) of a positive
    loss, n_u = np.logaddexp(0, z), len(z) - n_p
    if prior is None:
        return float((loss[:n_p] - z[:n_p]).mean() + loss[n_p:].mean()), np.concatenate([(s[:n_p] - 1) / n_p, s[n_p:] / n_u])
    positive, negative = prior * (loss[:n_p] - z[:n_p]).mean(), loss[n_p:].mean() - prior * loss[:n_p].mean()
    g = np.concatenate([-prior * s[:n_p] / n_p, s[n_p:] / n_u])
    if negative < 0:
        return float(positive), -g
    g[:n_p] += prior * (s[:n_p] - 1) / n_p
    return float(positive + negative), g


class Learner:
    """Adam over minibatches of all positives in turn and of the unlabelled texts given."""

    def __init__(self, flat: np.ndarray, positive: np.ndarray, prior: float | None, rate: float, seed: int) -> None:
        self.flat, self.positive, self.prior, self.rate, self.rng = flat.copy(), positive, prior, rate, np.random.default_rng(seed)
        self.m, self.v, self.steps, self.seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0

    def chunk(self, unlabelled: np.ndarray, passes: int, least: int) -> None:
        self.seen += len(unlabelled)
        batch = min(_BATCH, len(unlabelled))
        n_steps = max(1, len(unlabelled) // batch)
        for _ in range(max(passes, -(-least // n_steps))):
            order = self.rng.permutation(len(unlabelled))
            for k in range(n_steps):
                self.step(self.positive[self.rng.integers(0, len(self.positive), min(batch, 4 * len(self.positive)))], unlabelled[order[k * batch : (k + 1) * batch]])

    def step(self, positive: np.ndarray, unlabelled: np.ndarray) -> None:
        x, w = np.concatenate([positive, unlabelled]), parts(self.flat)
        a, h, z = forward(x, w)
        _, g = risk(z, len(positive), self.prior)
        g = g.astype(np.float32)
        grad_h = g[:, None] * w[2] * (a > 0)
        grad = np.concatenate([(x.T @ grad_h + _DECAY * w[0]).ravel(), grad_h.sum(axis=0), h.T @ g + _DECAY * w[2], g.sum(keepdims=True)])
        self.steps += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        pace = self.rate * (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        self.flat -= (pace * self.m / (np.sqrt(self.v) + 1e-8)).astype(np.float32)


def held_out(key: str = "doc_id", folds: int = FOLDS) -> Column:
    """crc32 of the key as text, modulo folds, is 0. A null key: of the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def table_of(docs: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (x binary, mine): the features of every row of docs as half-precision numbers, and whether its key is trusted. trusted is bounded."""

    @common.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.memory("quality")
        for batch in common.slices(batches, "text", _SLICE):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in features(batch.column(0)).astype(np.float16)], pa.binary()), batch.column(1)], ["x", "mine"])

    marked = trusted.select("_key", F.lit(True).alias("_mine"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(marked), "_key", "left")
    return common.stored(rows.select("text", F.coalesce("_mine", F.lit(False)).alias("mine")).mapInArrow(run, "x binary, mine boolean"), "features")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, N_FEATURES).astype(np.float32)


def _summed(rows: DataFrame, task, size: int) -> np.ndarray:
    """The sum of what task(batches) returns in each task, `size` numbers each: added up in _GROUPS groups, then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.memory("quality")
        values = task(batches)
        if values is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(values, np.float64).tobytes()], pa.binary())], ["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    each = rows.mapInArrow(run, "part binary").withColumn("task", F.spark_partition_id())
    groups = each.repartition(_GROUPS, F.col("task") % _GROUPS).sortWithinPartitions("task").select("part").mapInArrow(add, "part binary")
    return sum((np.frombuffer(r.part, np.float64) for r in groups.collect()), np.zeros(size))


def _rounds(rows: DataFrame, blank: Model, positive: np.ndarray, prior: float | None, rounds: int, effort: tuple[int, int]) -> Model:
    """Each round, every task trains a copy of the network on all its unlabelled texts; copies are averaged by texts."""
    spark, model = rows.sparkSession, Model(blank.mean, blank.scale, start(), blank.prior)
    for r in range(rounds):
        shared, rate = spark.sparkContext.broadcast((model, model.normal(positive))), _RATE * (1 - r / rounds)

        def task(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate, r=r) -> np.ndarray | None:
            model, positive = shared.value
            own, waiting = Learner(model.weights, positive, prior, rate, r), []
            for batch in batches:
                if batch.num_rows:
                    waiting.append(model.normal(_matrix(batch.column(0))))
                if sum(map(len, waiting)) >= CHUNK:
                    own.chunk(np.concatenate(waiting), *effort)
                    waiting = []
            if waiting:
                own.chunk(np.concatenate(waiting), effort[0], 0 if own.seen else effort[1])
            return np.append(own.flat.astype(np.float64) * own.seen, own.seen) if own.seen else None

        total = _summed(rows.select("x"), task, len(model.weights) + 1)
        model = Model(blank.mean, blank.scale, (total[:-1] / max(total[-1], 1)).astype(np.float32), blank.prior)
        shared.unpersist()
    return model


def share_of_positives(of_positives: np.ndarray, of_unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The class prior: the least ratio, over all thresholds, of unlabelled texts to positives that score as high or higher.

    Whatever share of the unlabelled texts is positive passes a threshold as positives do, so no ratio is below the prior but by
    chance; and where only positives score, the ratio is the prior. Both shares are counts in bins of the score, rising; each
    share's error with probability 1 - doubt is added, so that thin tails don't win.
    """
    n_p, n_u = max(of_positives.sum(), 1), max(of_unlabelled.sum(), 1)
    q_p, q_u = np.cumsum(of_positives[::-1]) / n_p, np.cumsum(of_unlabelled[::-1]) / n_u
    error = np.sqrt(np.log(4 / doubt) / (2 * n_p)) + np.sqrt(np.log(4 / doubt) / (2 * n_u))
    usable = q_p > 0
    if not usable.any():
        return 0.5
    q_p, q_u = q_p[usable], q_u[usable]
    best = np.argmin((q_u + error) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES) -> Model:
    """Fit on labelled positives and on all texts as unlabelled ones, taking labels only from rows outside the held-out fold.

    About `positives` trusted texts are taken, by a hash of the key; they are bounded, so they are broadcast. All else is done in
    tasks over all texts, whose features are written once: means and scales, the rounds of training, and the scores that the
    class prior is estimated from, with no label but the trusted positives': half of these train a network to tell positives
    from unlabelled texts, the other half is held against all unlabelled texts. Null keys and labels are left out; equal keys
    are all trusted. Without positives or texts the model has no say: its score is one half everywhere.
    """
    common.share_package(docs.sparkSession)
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).filter((F.col("_label") == 1) & F.col("_key").isNotNull() & ~held_out("_key")).select("_key").distinct()
    chance = int((1 << 30) * min(1.0, positives / max(known.count(), 1)))
    trusted = known.filter(F.pmod(F.xxhash64(F.lit("positive"), "_key"), F.lit(1 << 30)) < chance)
    rows = table_of(docs, trusted, key, text)
    positive = _matrix(rows.filter("mine").select("x").toArrow().column("x").combine_chunks())

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * N_FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)).astype(np.float64)
                total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x)]])
        return total

    total = _summed(rows.select("x"), moments, 2 * N_FEATURES + 1)
    n = max(total[-1], 1)
    mean = total[:N_FEATURES] / n
    scale = np.sqrt(np.maximum(total[N_FEATURES:-1] / n - mean * mean, 0)) + 1e-3
    blank = Model(mean.astype(np.float32), scale.astype(np.float32), np.zeros_like(start()), 0.5)
    if len(positive) and total[-1]:
        positive = positive[np.lexsort(positive.T[:8])]  # whatever order the tasks ended in
        teach, check = (positive[::2], positive[1::2]) if len(positive) > 1 else (positive, positive)
        judge = _rounds(rows, blank, teach, None, PRIOR_ROUNDS, PRIOR_EFFORT)
        shared = docs.sparkSession.sparkContext.broadcast(judge)
        bins = lambda x, model: np.histogram(model.score(x), bins=1000, range=(0, 1))[0].astype(np.float64)

        def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            return sum((bins(_matrix(b.column(0)), shared.value) for b in batches if b.num_rows), np.zeros(1000))

        blank.prior = share_of_positives(bins(check, judge), _summed(rows.select("x"), spread, 1000))
        blank = _rounds(rows, blank, positive, blank.prior, ROUNDS, EFFORT)
    common.drop_stored(rows)
    return blank


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0): one row for each row of docs, in every column.

    A null text counts as empty; an empty text gets the score of its all-zero features; ties, repeated rows and null keys are
    scored like any other row; an empty table gives an empty result. Columns that have one of `names` are replaced: give others
    to keep them.
    """
    common.share_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        common.memory("quality")
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [shared.value.score(features(b.column(0))) for b in common.slices(iter([batch]), size=_SLICE)]
        return pa.array(np.concatenate([np.empty(0), *parts]))

    return docs.withColumn(names[0], judge(F.col(text))).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
