import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinlex.llm import common, masked_lm, near_copies, packing, token_store, tokens

VOCABULARY = tokens.vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def plain_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_memo_gives_the_library_ids(library):
    rng = random.Random(3)
    alphabet = [*"aAbZ09 \n\t.,,;!?'\"-<|>*#|éÉßİiIjJ漢😀ſK", "̱", "̌", "̈", "̇", " ", "　", "\x1c", "\x85", "'s", "'T", "<|endoftext|>", "word", "The", "don't", "##", "..."]
    encoder = tokens.WordEncoder(VOCABULARY, 50)
    for turn in range(60):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(40)]
        if turn % 2:
            texts = [t and t.replace("<|", "").translate({0x331: None, 0x30C: None, 0x308: None, 0x307: None}) for t in texts]
        ids, n = encoder.encode(pa.array(texts, pa.string()))
        parts = np.split(ids, np.cumsum(n)[:-1])
        assert [p.tolist() for p in parts] == [plain_ids(library, t) for t in texts]


# ------------------------------------------------------------------ token files


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for values in ([0], [0, 0, 0], [5], np.cumsum(rng.integers(0, 3, 2000)), np.cumsum(rng.integers(0, 100_000, 3000)), [0] * 600 + [10**12]):
        values = np.array(values, np.int64)
        ef = token_store.EliasFano.build(values)
        assert ef.values().tolist() == values.tolist()
        for i in rng.integers(0, len(values), 40):
            assert ef[int(i)] == values[i]
        a, b = sorted(rng.integers(0, len(values) + 1, 2).tolist())
        assert ef.values(a, b).tolist() == values[a:b].tolist()
    dense = token_store.EliasFano.build(np.arange(0, 640_000, 64))
    assert dense.low.nbytes + dense.high.nbytes < 10_000 * 9 / 8 + 64  # 2 + log2(64) bits each


def test_token_files_read_back(spark, library, odd_docs, odd_rows, no_docs):
    manifest = token_store.write(odd_docs, common.new_path(spark, "ids"), VOCABULARY, 2)
    found = token_store.read(manifest).collect()
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[1] is not None))
    start, expected = 0, Counter()
    starts = defaultdict(list)
    for k, t in ordered:
        ids = [*plain_ids(library, t), 2]
        expected[k, len(ids), np.array(ids, "<u4").tobytes()] += 1
        starts[k].append(start)
        start += len(ids)
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in found) == expected
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append(r.start)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in starts.items()}
    reader = token_store.Reader(manifest.first()["file"])
    assert [reader.document(i)[-1] for i in range(reader.n_docs)] == [2] * reader.n_docs
    assert token_store.read(token_store.write(no_docs, common.new_path(spark, "ids"), VOCABULARY, 2)).count() == 0
    with pytest.raises(Exception, match="more than 1 bytes"):
        token_store.write(odd_docs, common.new_path(spark, "ids"), VOCABULARY, 2, width=1)


# ------------------------------------------------------------------ packing


def test_packing_places_every_piece_once(spark, library, odd_docs, odd_rows, no_docs):
    for capacity in (4096, 64):
        rows = packing.pack(odd_docs, VOCABULARY, 1, capacity).collect()
        expected = Counter()
        for k, t in odd_rows:
            ids = [*plain_ids(library, t), 1]
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                expected[k, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == expected
        by_sequence = defaultdict(list)
        for r in rows:
            by_sequence[r.sequence_id].append((r.offset, r.length))
        for parts in by_sequence.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(r.length for r in rows)
        assert len(by_sequence) <= 1.1 * total / capacity + 1
    assert packing.pack(no_docs, VOCABULARY, 1).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def plain_rounds(lengths, capacity):
    """The same rounds, each as one walk down the row with a stack of free slots: {id: (sequence, offset)}, and the sequences."""
    left, gaps, out, n_seq = dict(enumerate(lengths)), {}, {}, 0
    while left:
        if not gaps:
            more = -(-sum(left.values()) // capacity)
            gaps = {n_seq + i: capacity for i in range(more)}
            n_seq += more
        top, low = max(left.values()), min(left.values())
        row = [(-n, 1, i, 0) for i, n in left.items()]
        for seq, gap in gaps.items():
            if gap >= low:
                many = max(gap // top, 1)
                row += [(-(gap // many), 0, seq, slot) for slot in range(many)]
        free, taken = [], defaultdict(list)
        for _, kind, who, slot in sorted(row):
            if kind == 0:
                free.append((who, slot))
            elif free:
                seq, slot = free.pop()
                taken[seq].append((slot, who))
        gaps = {seq: gap for seq, gap in gaps.items() if gap >= low} if taken else {}
        for seq, found in taken.items():
            for _, who in sorted(found):
                out[who] = (seq, capacity - gaps[seq])
                gaps[seq] -= left.pop(who)
    return out, n_seq


def test_rounds_match_a_walk_with_a_stack_and_pack_well(spark):
    rng = np.random.default_rng(1)
    for lengths in (np.clip(rng.lognormal(2.5, 1, 1500).astype(int), 1, 100), rng.choice([51, 34, 33, 17, 16], 300), np.array([100])):
        rows = common.stored(spark.createDataFrame(list(enumerate(lengths.tolist())), "id bigint, length int").repartition(3), "lengths")
        found = {r.id: (r.sequence_id, r.offset) for r in packing.assigned(rows, 100).collect()}
        expected, n_seq = plain_rounds(lengths.tolist(), 100)
        assert found == expected
        assert len({s for s, _ in found.values()}) <= 1.07 * best_fit_decreasing(lengths.tolist(), 100) + 1


def test_rests_of_partitions_meet_as_in_one_row():
    rng = np.random.default_rng(2)
    for _ in range(60):
        step = rng.choice([-1, 1], int(rng.integers(1, 60)))
        whole, cuts = packing.sweep(step), np.sort(rng.integers(0, len(step) + 1, 4))
        found, left, ranks = np.full(len(step), -1), [], {}
        for part, at in enumerate(np.split(np.arange(len(step)), cuts)):
            partner = packing.sweep(step[at])
            found[at[partner >= 0]] = at[partner[partner >= 0]]
            rest = at[partner < 0]
            left.append((part, int((step[rest] < 0).sum()), int((step[rest] > 0).sum())))
            ranks.update({(part, kind, r): i for kind, sign in ((0, 1), (1, -1)) for r, i in enumerate(rest[step[rest] == sign])})
        ends = defaultdict(dict)
        for part, kind, first, n, link in packing.across(left):
            for j in range(n):
                ends[link + (j if kind else n - 1 - j)][kind] = ranks[part, kind, first + j]
        for pair in ends.values():
            found[pair[0]], found[pair[1]] = pair[1], pair[0]
        assert (found == whole).all()


def test_lengths_beyond_capacity_are_refused(spark):
    with pytest.raises(ValueError, match="between 1 and 10"):
        packing.place(spark.createDataFrame([(1, 0, 11)], "doc_id bigint, piece int, length bigint"), 10)


# ------------------------------------------------------------------ masked language model


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    net = masked_lm.Network(rng.normal(0, 0.2, len(masked_lm.Network().flat)))
    context, target = rng.integers(0, 200, (6, 4)), rng.integers(0, 200, 6)
    loss = lambda flat: -float(masked_lm.Network(flat).log_prob(context, target).astype(np.float64).mean())
    before = net.flat.astype(np.float64)
    stepped = masked_lm.Network(net.flat)
    memory = [np.zeros_like(m) for m in net.memory()]
    stepped.train(context, target, memory, rate=1.0)  # the first Adagrad step from nothing is the gradient's sign
    moved = stepped.flat.astype(np.float64) - before
    for i in rng.choice(np.flatnonzero(np.abs(moved) > 0.99), 12, replace=False):
        up, down = before.copy(), before.copy()
        up[i] += 3e-2
        down[i] -= 3e-2
        slope = loss(up) - loss(down)
        assert abs(slope) < 2e-6 or np.sign(slope) == -np.sign(moved[i])


def test_probabilities_sum_to_one():
    net = masked_lm.Network(seed=3)
    every = np.arange(masked_lm.CLASSES * masked_lm.MEMBERS)
    context = np.tile([[5, 70, 0, 300]], (len(every), 1))
    assert np.exp(net.log_prob(context, every).astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)


def test_contexts_stay_within_texts():
    found = masked_lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([3, 0, 2]))
    assert found.tolist() == [[0, 0, 2, 3], [0, 1, 3, 0], [1, 2, 0, 0], [0, 0, 5, 0], [0, 4, 0, 0]]


def test_training_beats_the_start_and_tells_order(spark):
    rng = random.Random(1)
    sentence = lambda: " ".join(f"a{(k := rng.randrange(40))} b{k} c{k}" for _ in range(40))
    rows = [(i, sentence()) for i in range(300)] + [(1000, " ".join(rng.choice("abc") + str(rng.randrange(40)) for _ in range(120)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    words, net = masked_lm.train(docs)
    mean = lambda n: {r.doc_id: r.mean_log_prob for r in masked_lm.score(docs, words, n).collect()}
    before, after = mean(masked_lm.Network()), mean(net)
    assert np.mean(list(after.values())) > np.mean(list(before.values())) + 1
    assert after[1000] < np.mean([v for k, v in after.items() if k < 1000]) - 0.3


def test_every_word_of_every_text_trains(spark):
    docs = spark.createDataFrame([(i, "five words are a text") for i in range(20)], "doc_id bigint, text string")
    _, net = masked_lm.train(docs)
    assert not np.array_equal(net.flat, masked_lm.Network().flat)
    n = np.arange(40)
    places = [masked_lm.targets(n, turn, masked_lm.ROUNDS) for turn in range(masked_lm.ROUNDS)]
    assert np.sort(np.concatenate(places)).tolist() == list(range(n.sum()))


def test_rare_words_of_one_kind_score_apart(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "CLASSES", 2)  # a vocabulary of 64 words
    rows = [(i, " ".join(f"word{k}" for k in range(64))) for i in range(9)]
    rows += [(20 + i, "qaz") for i in range(4)] + [(30, "qbz"), (31, "qaz word1 qbz"), (None, "qbz"), (30, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    words = masked_lm.vocabulary(docs)
    monkeypatch.undo()
    assert len(words.words) == 64
    net = masked_lm.Network()
    found = masked_lm.score(docs, words, net).collect()
    counts = Counter(w for _, t in rows for w in t.split())
    kind = lambda w: int(masked_lm.kinds(pa.array([w], pa.large_string()))[0])
    shares = 1 + sum(n + 1 for w, n in counts.items() if w in ("qaz", "qbz"))
    assert kind("qaz") == kind("qbz")

    def expected(text):
        spelt = text.split()
        if not spelt:
            return 0.0
        ids, n = words.ids(pa.array([text]))
        own = [math.log((counts[w] + 1) / shares) if w.startswith("q") else 0.0 for w in spelt]
        return float(net.log_prob(masked_lm.contexts(ids, n), ids).sum()) + sum(own)

    assert len(found) == len(rows)
    assert all(abs(r.log_likelihood - e) < 1e-4 for r, e in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)), [expected(t) for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0], len(r[1].split())))], strict=True))
    by_text = {r.doc_id: r.log_likelihood for r in found if r.n_tokens == 1}
    assert by_text[20] > by_text[30] + 0.3


def test_scores_of_odd_and_empty_tables(odd_docs, odd_rows, no_docs):
    words, net = masked_lm.train(odd_docs, rounds=1)
    rows = masked_lm.score(odd_docs, words, net).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((k, len((t or "").encode().split())) for k, t in odd_rows)
    assert all((r.mean_log_prob is None and r.log_likelihood == 0) if not r.n_tokens else abs(r.log_likelihood - r.n_tokens * r.mean_log_prob) < 1e-6 * r.n_tokens + 1e-6 and r.mean_log_prob < 0 for r in rows)
    words, net = masked_lm.train(no_docs, rounds=1)
    assert masked_lm.score(no_docs, words, net).count() == 0 and masked_lm.score(odd_docs, words, net).count() == len(odd_rows)


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages_against_their_operators(spark, odd_docs, tmp_path):
    import corpus_pipeline as pipeline

    folder = str(tmp_path)
    docs = odd_docs
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)] + [(306, 0)], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    phrase = " ".join(docs.filter("doc_id = 8").first().text.split()[:15])
    spark.createDataFrame([(1, phrase)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = common.stored(stage(spark, now, folder), name)
        if name != "pack":
            assert out.columns == docs.columns
        kept[name] = (now, out)
        now = out
    before, lines = kept["drop_lines"]
    assert before.count() == lines.count() and lines.filter("n_chars <> length(coalesce(text, ''))").count() == 0
    before, single = kept["drop_near_duplicates"]
    found, of = near_copies.classes(before)
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in of.collect()} and found.count() == before.count()
    assert {tuple(r) for r in single.collect()} <= {tuple(r) for r in before.collect()}
    before, clean = kept["decontaminate"]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in clean.collect()}
    assert gone <= {8} or all(phrase.split()[3] in (r.text or "") for r in before.filter(F.col("doc_id").isin(list(gone))).collect())
    packed = kept["pack"][1]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert Counter((r.doc_id, r.piece) for r in pipeline.run(spark, folder).collect()) == Counter((r.doc_id, r.piece) for r in packed.collect())
