import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinlex.llm import common, line_dedup, simhash, suffix_dedup


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


# ------------------------------------------------------------------ suffix arrays


def brute_repeats(rows, length):
    """Digest by (key, text): every string of `length` bytes and where it first starts."""
    least = -(1 << 63)
    texts = sorted({(least if k is None else k, (t or "").encode()) for k, t in rows})
    first = {}
    for k, b in texts:
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], (k, s)), (k, s))
    out = {}
    for k, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] != (k, s):
                gone[s : s + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[k, b] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def check_repeats(docs, rows, **options):
    expected, least = brute_repeats(rows, 100), -(1 << 63)
    found = suffix_dedup.digest(suffix_dedup.repeats(docs, **options)).collect()
    assert Counter((r[0], *r[1:]) for r in found) == Counter((k, *expected[least if k is None else k, (t or "").encode()]) for k, t in rows)


def test_suffix_dedup_removes_later_copies(odd_docs, odd_rows):
    check_repeats(odd_docs, odd_rows)


def test_suffix_dedup_resolves_large_groups_string_by_string(odd_docs, odd_rows):
    check_repeats(odd_docs, odd_rows, group=2)


def test_suffix_dedup_deals_out_hot_anchors(spark, monkeypatch):
    """A passage that stands among different words in every text, so that its anchors are hot in the sample."""
    rng = np.random.default_rng(7)
    passage = "".join(rng.choice(list("abcdefgh "), 130))
    noise = lambda: "".join(rng.choice(list("ijklmnop "), rng.integers(0, 160)))
    rows = [(i, noise() + passage[: rng.integers(40, 131)] + noise()) for i in range(60)] + [(100 + i, rows_text) for i, rows_text in enumerate([passage] * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "_SAMPLE", 1)
    assert len(suffix_dedup.hot_anchors(suffix_dedup.keyed(docs, "doc_id", "text"), 100, 32, 4))
    check_repeats(docs, rows, group=4)
    check_repeats(docs, rows, group=40)


def test_suffix_dedup_without_rows(no_docs):
    assert suffix_dedup.repeats(no_docs).count() == 0


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 101, 30_000).astype(np.uint8)
    at = np.array([0, 50, 12_000, 12_000, 30_000])
    whole = suffix_dedup.anchors(raw, at)
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 4096)
    parts = suffix_dedup.anchors(raw, at)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_longest_previous_factor_matches_definition():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(0, 2, 400), np.tile(rng.integers(0, 9, 60), 4)]).astype(np.uint8)
    length = 20
    starts = np.arange(len(data) - length + 1)
    order, same = suffix_dedup.order_to_depth(data, starts, length)
    keys = order[:]
    got = np.zeros(len(starts), bool)
    got[order] = suffix_dedup.longest_previous(keys, same, length) >= length
    seen, expected = set(), []
    for s in starts:
        expected.append(bytes(data[s : s + length]) in seen)
        seen.add(bytes(data[s : s + length]))
    assert got.tolist() == expected


# ------------------------------------------------------------------ lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def variants():
    base = "the quick brown fox jümps over the lazy dog, again and again"
    out = [base, base[1:], base[:-1] + "x", base.replace("fox", "fax"), base.replace("fox", "f o x"), base.upper(), base + "yz", "zz" + base, base.replace("lazy", "crazy"), base[:20] + base[22:], base[:30] + "qq" + base[30:], base[:10] + "q" + base[10:50] + base[51:]]
    return out + ["short line", "a wholly different line of text, of forty characters and more", "é" * 45, "é" * 44 + "e"]


@pytest.mark.parametrize("least", [1, 40])
def test_line_classes_match_brute_force(spark, least):
    texts = variants() + ["twelve chars", "twelve char.", "twelve  char", "eleven char", "eleven cha.", "short lime", "sh"]
    docs = spark.createDataFrame([(i, t + "\n" + texts[(i * 7) % len(texts)]) for i, t in enumerate(texts)], "doc_id bigint, text string")
    first, copies = {}, Counter()
    for i, t in enumerate(texts):
        for no, line in enumerate((t, texts[(i * 7) % len(texts)])):
            if len(line) >= least:
                first.setdefault(line, (i, no))
                copies[line] += 1
    links = [(first[a], first[b]) for a in first for b in first if first[a] < first[b] and min(len(a), len(b)) >= 12 and edits(a, b) <= 2]
    degree = Counter(x for pair in links for x in pair)
    roots = union_find(first.values(), links)
    found = {(r.first["key"], r.first["line_no"]): (r.n_copies, r.n_links, (r.class_first["key"], r.class_first["line_no"])) for r in line_dedup.classes(docs, least_chars=least).collect()}
    assert found == {place: (copies[line], degree[place], roots[place]) for line, place in first.items()} and len(links) > 10


def test_copies_of_short_lines_fall_together(spark):
    texts = ["a\nAll rights reserved.\n\nb", "All rights reserved.\na\n", "All rights reserved!\naa", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    place = lambda p: (p["key"], p["line_no"])
    found = {place(r.first): (r.n_copies, r.n_links, place(r.class_first)) for r in line_dedup.classes(docs, least_chars=1).collect()}
    assert found == {(0, 0): (2, 0, (0, 0)), (0, 1): (2, 1, (0, 1)), (0, 3): (1, 0, (0, 3)), (2, 0): (1, 1, (0, 1)), (2, 1): (1, 0, (2, 1))}
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated(docs, least_chars=1).collect()} == {0: texts[0], 1: "", 2: "aa", 3: None}


def test_edit_scan_matches_levenshtein(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice(list("abé😀"), rng.integers(0, 14)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.choice(list("abé😀"), rng.integers(0, 2)).tolist()
        rows.append((a, "".join(b)))
    found = spark.createDataFrame(rows, "a string, b string").select(*[line_dedup.near(F.col("a"), F.col("b"), m).alias(f"m{m}") for m in (1, 2, 3)]).collect()
    assert [tuple(r) for r in found] == [tuple(edits(a, b) <= m for m in (1, 2, 3)) for a, b in rows]


def test_drop_repeated_keeps_rows_columns_and_first_lines(odd_docs, odd_rows, no_docs):
    found = line_dedup.drop_repeated(odd_docs)
    assert found.columns == odd_docs.columns and found.count() == len(odd_rows)
    texts = defaultdict(list)
    for r in found.collect():
        texts[r.doc_id].append(r.text)
        assert r._tag == r._late == "x"
    assert texts[307] == ["a line that is repeated forty times over, whole"] and texts[300] == [None] and texts[301] == [""]
    assert texts[0][0] == texts[0][1] == texts[0][2]
    assert line_dedup.drop_repeated(no_docs).count() == 0 and line_dedup.classes(no_docs).count() == 0


# ------------------------------------------------------------------ simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(odd_docs, odd_rows, no_docs):
    prints = {t: plain_fingerprint(t) for _, t in odd_rows}
    values = sorted(set(prints.values()))
    roots = union_find(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for k, t in odd_rows:
        if k is not None:
            root = roots[prints[t]]
            least[root] = min(least.get(root, k), k)
    expected = Counter((k, prints[t], least[roots[prints[t]]]) for k, t in odd_rows)
    found = simhash.near_duplicates(odd_docs).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == expected
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == set(least.values())
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


def test_simhash_links_in_small_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2**63, 6, np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(80):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    values = sorted(fps)
    expected = union_find(values, [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3])
    rows = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp bigint")
    edges = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(rows, block=16).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges) and union_find(values, edges) == expected


def test_bit_sliced_distances():
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 2**64, 128, np.uint64)
    fps[::3] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, len(fps[::3])).astype(np.uint64))
    planes, lanes = simhash.planes_of(fps), np.full(2, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for radius in (0, 1, 2, 3):
        hits = simhash.near(planes, np.array([0, 1]), np.full(2, fps[5], np.uint64), lanes, radius)
        got = np.unpackbits(hits.view(np.uint8), bitorder="little").astype(bool)
        assert (got == (np.bitwise_count(fps ^ fps[5]) <= radius)).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (7, 7), (3, 4), (20, 19), (19, 18), (18, 4), (None, 3)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 18: 1, 19: 1, 20: 1, 10: 10, 11: 10}
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in common.components(chain).select("root").distinct().collect()} == {0}
    assert common.components(chain.limit(0)).count() == 0
