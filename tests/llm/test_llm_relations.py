"""Exact search, spelling variants and cross-tokenizer alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinlex.llm import alignment, spelling, tokens, vector_index

BOTH = [tokens.vocabulary_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]

# ------------------------------------------------------------------ exact search


def brute_search(rows, k, every, scale=64):
    """For each query row the sorted (score, key) of all other rows."""
    good = []
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((key, [int(np.floor(scale * x)) for x in v]))
    out = Counter()
    for i, (key, v) in enumerate(good):
        if key % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), other) for j, (other, w) in enumerate(good) if j != i)
            out.update((key, rank + 1, other, -s) for rank, (s, other) in enumerate(found[:k]))
    return out


def check_search(spark, rows, k, every, **more):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, ids string, ring int").repartition(3)
    found = vector_index.search(table, k=k, every=every, **more).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_search(rows, k, every)


def test_search_over_clusters_copies_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 6)) * rng.uniform(0.3, 3, (12, 1))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, 6)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)]  # copies, ties and queries among them
    rows += [(2000, None), (2001, [None] * 6), (2002, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (2003, [float("inf")] * 6), (2004, []), (2020, [0.5, 0.5]), (None, [1.0] * 6), (40, rows[40][1]), (40, rows[41][1]), (40, rows[40][1])]
    for name, value in (("RING", 4), ("FIRST", 2), ("WIDER", 3), ("QUERIES", 20)):
        monkeypatch.setattr(vector_index, name, value)
    check_search(spark, rows, 5, 10)


def test_search_of_few_and_no_rows(spark):
    check_search(spark, [(0, [1.0, -1.0]), (20, [0.5, 0.25]), (7, [0.1, 0.2])], 20, 20)
    check_search(spark, [(3, [1.0])], 20, 20)
    check_search(spark, [(3, None)], 20, 20)


def test_bounds_hold_and_leave_rings_out():
    rng = np.random.default_rng(1)
    x = np.floor(64 * (rng.normal(0, 1, (20, 8))[rng.integers(0, 20, 4000)] + rng.normal(0, 0.02, (4000, 8))))
    d = vector_index.Directory.fitted(x[:500].copy(), 4000)
    ring, away = d.ring_of(x)
    square = (x * x).sum(axis=1)
    d.fill([(r, int((ring == r).sum()), away[ring == r].min(), away[ring == r].max(), square[ring == r].max()) for r in np.unique(ring).tolist()])
    q, bound = x[:50], d.bounds(x[:50])
    score = q @ x.T
    for i, r in enumerate(d.rings):
        assert (score[:, ring == r].max(axis=1) <= bound[:, i]).all()
    tenth = np.sort(score, axis=1)[:, -10]
    assert (bound < tenth[:, None]).mean() > 0.3
    assert np.bincount(d.shelf, np.bincount(ring)[d.rings]).max() <= 2048


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        vector_index.search(spark.createDataFrame([(0, [1e30])], "vec_id bigint, embedding array<double>")).collect()


# ------------------------------------------------------------------ spelling variants


def brute_variants(rows, deletes=97):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % deletes else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        around = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for c in letters for j in (i, i + 1) if j <= len(w)}
        near[w] = sorted((o for o in around - {w} if o in n), key=lambda o: (-n[o], o))
    form = {w: o[0] if o and n[o[0]] >= 2 * n[w] else None for w, o in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


def misspelt(rng, base):
    i, c = rng.randrange(len(base)), rng.choice("abéß÷")
    return rng.choice([base[:i] + base[i + 1 :], base[:i] + c + base[i:], base[:i] + c + base[i + 1 :]])


@pytest.fixture(scope="module")
def spelt_rows(odd_rows):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdeéßÿ", k=rng.randint(5, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "ababab", "bababa"]
    rows = []
    for i in range(160):
        own = [misspelt(rng, w) if rng.random() < 0.4 else w for w in rng.choices(base, k=60)]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in own)))
    return [*rows, (500, "plinthe " * 40 + "plinthes " * 15 + "plinthesy " * 6), *odd_rows]


@pytest.mark.parametrize("hot", [128, 1])
def test_variants_match_brute_force(spark, spelt_rows, hot):
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in spelt_rows], "doc_id bigint, text string, word string, n int, k string").repartition(3)
    found = spelling.variants(table, hot=hot).collect()
    assert len(found) == len({r.word for r in found})
    assert {tuple(r) for r in found} == brute_variants(spelt_rows)
    assert any(r.root != r.form for r in found if r.form)


def test_variants_of_no_rows(no_docs):
    assert spelling.variants(no_docs).count() == 0


def test_crowded_bigrams_are_told_apart(spark):
    """One bigram, place and length for all words: pairs compared follow the words, not their square."""
    rng = random.Random(1)
    vocabulary = {"zq" + "".join(rng.choices("abc", k=7)) for _ in range(900)}
    near = spelling.pairs(spark.createDataFrame([(w, 3) for w in vocabulary], "word string, n bigint"), hot=20)
    close = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) == 1
    assert {(r.word, r.other) for r in near.collect()} == {(a, b) for a in vocabulary for b in vocabulary if close(a, b)}


# ------------------------------------------------------------------ cross-tokenizer alignment


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BOTH[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=BOTH[1])


def brute_alignment(a, b, text):
    """n_a, n_b, n_groups, Counter of links, digest: by byte offsets of whole texts."""
    none = (0, 0, 0, Counter(), "")
    if not text:
        return none
    byte_of = {c: n for n, c in alignment._byte_letters().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return none
    ends = [np.cumsum([len(p) for p in parts]).tolist() for parts in (parts_a, parts_b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, links, i, j = [], Counter(), 0, 0
    for cut in cuts:
        x, y = [], []
        while i < len(ids_a) and ends[0][i] <= cut:
            x.append(ids_a[i])
            i += 1
        while j < len(ids_b) and ends[1][j] <= cut:
            y.append(ids_b[j])
            j += 1
        groups.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
        links.update((p, q) for p in x for q in y)
    return len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def brute_alignments(a, b, rows):
    own = [(k, brute_alignment(a, b, t)) for k, t in rows]
    n = Counter(link for _, x in own for link in x[3])
    best = defaultdict(int)
    for (p, _), c in n.items():
        best[p] = max(best[p], c)
    return Counter((k, *x[:3], x[3].total(), sum(m for link, m in x[3].items() if n[link] == best[link[0]]), sum(m * n[link] for link, m in x[3].items()), x[4]) for k, x in own)


def test_aligner_matches_whole_texts(libraries):
    rng = random.Random(3)
    alphabet = [*"aAbZ09 \n\t\r.,,;!?'\"-<|>*#|éÉßİiIjJ漢😀ſKà ", " ", "  ", "   ", " ", "　", "\x1c", "\x85", "'s", "'T", "<|endoftext|>", "<s>", "<0x41>", "word", " The", " don't", "##", "...", "é"]
    aligner = alignment.Aligner(*BOTH, most=300)
    for turn in range(40):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(50)]
        if turn % 4 == 0:
            texts[3] = (texts[3] or "a") + " ▁x \x00"
        sizes, said, pairs, weights = aligner.align(pa.array(texts, pa.string()))
        for t, size, s, p, w in zip(texts, sizes.tolist(), said, pairs, weights, strict=True):
            n_a, n_b, n_groups, links, digest = brute_alignment(*libraries, t)
            assert size == [n_a, n_b, n_groups, links.total()], t
            assert (hashlib.sha256(s).hexdigest() if s else "") == digest
            assert dict(zip(p.tolist(), w.tolist(), strict=True)) == {x << alignment._BITS | y: m for (x, y), m in links.items()}


def test_long_groups_are_counted_whole(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "_LARGE", 3)
    aligner = alignment.Aligner(*BOTH)
    texts = ["=" * 701, "x" + "-" * 90 + " " * 33 + "end", "Donaudampfschifffahrt " * 5, "漢字😀" * 30]
    sizes, said, pairs, weights = aligner.align(pa.array(texts))
    for t, size, p, w in zip(texts, sizes.tolist(), pairs, weights, strict=True):
        links = brute_alignment(*libraries, t)[3]
        assert size[3] == links.total()
        assert dict(zip(p.tolist(), w.tolist(), strict=True)) == {x << alignment._BITS | y: m for (x, y), m in links.items()}


@pytest.mark.parametrize("block", [alignment.BLOCK_PAIRS, 40])
def test_alignments_match_brute_force(libraries, odd_docs, odd_rows, block):
    found = alignment.alignments(odd_docs, *BOTH, block=block).collect()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in names) for r in found) == brute_alignments(*libraries, odd_rows)


def test_alignments_of_no_rows(no_docs):
    assert alignment.alignments(no_docs, *BOTH).count() == 0
