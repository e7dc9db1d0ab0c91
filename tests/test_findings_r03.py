"""Results of round 3's findings: what depended on the layout, a cap or a single task, against the plain definition."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlex.functions import normalize
from twinlex.llm import common, line_dedup, masked_lm, perplexity
from twinlex.operators import batching, metrics, vocabulary
from twinlex.plans import build, catalogue, coverage, training
from twinlex.plans.config import Config
from twinlex.sources import readers
from twinlex.streaming import feeds

SMALL = "/root/testdata/sf0.001"


def test_batches_by_length_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(batching, "_SPAN", 40)
    rng = np.random.default_rng(5)
    lengths = [None, *rng.integers(0, 30, 400).tolist(), *[7] * 300]
    rows = spark.createDataFrame(list(enumerate(lengths)), "id long, n int")
    found = [{r.id: r.batch for r in batching.length_sorted(rows.repartition(parts), F.col("n"), 32).collect()} for parts in (1, 3, 5)]
    assert found[0] == found[1] == found[2]
    ordered = sorted((b, -1 if lengths[i] is None else lengths[i]) for i, b in found[0].items())
    assert [n for _, n in ordered] == sorted(-1 if n is None else n for n in lengths)
    assert [b for b, _ in ordered] == [i // 32 for i in range(len(lengths))]
    assert batching.length_sorted(rows.limit(0), F.col("n"), 32).count() == 0


def test_a_vocabulary_without_a_sample_size_learns_from_all_pairs(spark, tmp_path):
    cfg = Config.model_validate(coverage._config(str(tmp_path)).model_dump())
    assert cfg.tokenizer.sample_per_lang is None
    n = 6000
    pairs = spark.range(n).select(F.concat(F.lit("line "), "id").alias("en"), F.concat(F.lit("መስመር "), "id").alias("am"), F.lit("first").alias("source"), F.lit(None).cast("float").alias("score"))
    for name, part in (("train", pairs), ("train_holdout", pairs.limit(10))):
        part.write.parquet(f"{cfg.paths.resolve('data_processed')}/{name}.parquet")
    stats = training.train_vocabulary(spark, cfg)
    assert stats["trained_on_sentences"] == 2 * n and stats["roundtrip_exact"] == 1.0


def test_held_out_lines_are_normalized_by_several_tasks_and_stay_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(build, "HELD_OUT_ROWS", 10)
    cfg = coverage._config(str(tmp_path)).data
    lines = [f"line {i}" for i in range(45)]
    for split in ("dev", "devtest"):
        (tmp_path / "held" / split).mkdir(parents=True)
        for code in ("eng_Latn", "amh_Ethi"):
            (tmp_path / "held" / split / f"{code}.{split}").write_text("\n".join(lines) + "\n")
    sizes, keys = build.write_held_out(spark, cfg, tmp_path, tmp_path / "out")
    saved = spark.read.parquet(str(tmp_path / "out/valid.parquet"))
    assert sizes == {"valid": 45, "test": 45} and len(saved.inputFiles()) == 5 and keys.count() == 45
    assert [r.en_raw for r in readers.in_file_order(saved, {"en_raw": F.col("en_raw")}).orderBy("line_no").collect()] == lines


def test_texts_of_more_rows_than_a_slice_come_back_whole(spark, monkeypatch):
    texts = [None, "", *[f"text {i} é {'x' * (i % 5)}" for i in range(3 * vocabulary._ROWS + 7)]]
    learnt = vocabulary.learn({"▁text": 3, "x": 1}, 300, 1)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    ids = rows.withColumn("ids", vocabulary.encoded(F.col("text"), learnt, spark))
    found = {r.id: r for r in ids.withColumn("back", vocabulary.decoded(F.col("ids"), learnt, spark)).collect()}
    assert [found[i].back for i in range(len(texts))] == texts
    assert found[0].ids is None and all(found[i].ids == [x for _, x, _ in learnt.inspect(t)] for i, t in enumerate(texts) if t)


def test_lines_that_share_a_segment_are_scanned_only_where_they_are_alike(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh é😀"), 30))
    lines = ["one common first segment, long." + word() + word() for _ in range(120)]
    other = list("one common first segment, long." + word() + word())
    near = [*lines[:9], "".join(other)]
    edited = [x[:40] + "Z" + x[41:70] + "Y" + x[70:] for x in near]  # two edits: other neighbours, other place, other length
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, near[-1], *edited])], "doc_id long, text string")
    found = line_dedup.texts(line_dedup.lines(docs, "doc_id", "text", 12))
    assert line_dedup.links(found).count() == len(edited)
    assert line_dedup.candidates(found, 2).distinct().count() < 3 * len(edited)  # of 130 * 129 / 2 pairs that share a segment
    marks = {r.text: r.m for r in docs.select("text", line_dedup.signature(F.col("text")).alias("m")).collect()}
    assert all(((marks[a] ^ marks[b]) & (2**64 - 1)).bit_count() <= 8 for a, b in zip(near, edited, strict=True))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("most", "alphabet"), [(2, "abé😀"), (3, "ab\0")])
def test_lines_of_any_length_are_linked(spark, most, alphabet):
    rng = np.random.default_rng(most)
    rows = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), n)) for n in rng.integers(1, 6, 40).tolist() + rng.integers(6, line_dedup.least_cut(most) + most + 3, 60).tolist()]
    for line in rows[40:]:  # lines that are near others, on both sides of the length from which segments tell
        at = int(rng.integers(0, len(line)))
        rows += [line[:at] + line[at + 1 :], line[:at] + "x" + line[at:], line[1:] + "y", "zz" + line]
    texts = list(dict.fromkeys(rows))
    docs = spark.createDataFrame([(i, f"{x}\n\n{x}") for i, x in enumerate(texts)], "doc_id long, text string")
    links = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if abs(len(a) - len(b)) <= most and _edits(a, b) <= most]
    degree, root = [0] * len(texts), list(range(len(texts)))
    for i, j in links:
        degree[i], degree[j] = degree[i] + 1, degree[j] + 1
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    found = {r.first["key"]: (r.n_copies, r.n_links, r.class_first["key"]) for r in line_dedup.classes(docs, most=most, every_length=True).collect()}
    assert found == {i: (2, degree[i], root[i]) for i in range(len(texts))}
    assert sum(min(len(texts[i]), len(texts[j])) < line_dedup.least_cut(most) <= max(len(texts[i]), len(texts[j])) for i, j in links) > 10
    if most == 2:
        kept = {r.doc_id: r.text for r in line_dedup.drop_repeated(docs, most=most, every_length=True).collect()}
        assert kept == {i: f"{x}\n" if root[i] == i else "" for i, x in enumerate(texts)}


def _by_sql(spark, name, sf_dir):
    """A query's rows and those of its SQL, sorted."""
    import duckdb

    con = duckdb.connect()
    for table in ("lineitem", "events"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    found = catalogue.queries()[name](spark, sf_dir)
    expected = con.execute(f"select {', '.join(found.columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in found.collect()), sorted(expected)


@pytest.mark.parametrize("name", ["local_pair_lines", "line_range", "archive_lines", "archive_head"])
def test_aligned_files_are_put_in_order_by_several_tasks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(coverage, "_ORDERED", 1000)
    parts = coverage._lines(spark, SMALL, f"{tmp_path}/lines")
    assert len(parts["en"]) > 4 and len(parts["am"]) > 2
    found, expected = _by_sql(spark, name, SMALL)
    assert found == expected and found


def test_ordered_row_groups_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(coverage, "_ORDERED", 1000)
    rows = spark.range(5500).select((F.col("id") * 7 % 5501).alias("k"))
    groups = [[r.k for r in part] for part in coverage._whole_groups(rows, "k", f"{tmp_path}/t").rdd.glom().collect() if part]
    assert len(groups) > 2 and all(len(g) % 1000 == 0 for g in groups[:-1])
    assert [k for g in groups for k in g] == sorted(r.k for r in rows.collect())
    found, expected = _by_sql(spark, "ordered_row_groups", SMALL)
    assert found == expected and len(found) > 4


def test_texts_are_composed_and_scored_by_slices(spark):
    n = 2 * normalize._ROWS + 5
    texts = [None, "", *[f"e\u0301 &amp; {i}" for i in range(n)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    found = {r.id: r.t for r in rows.select("id", normalize.compose_and_unescape(F.col("text")).alias("t")).collect()}
    assert [found[i] for i in range(len(texts))] == [None, "", *[f"\xe9 & {i}" for i in range(n)]]
    chars = F.when(F.col("id") > 0, F.split("text", " "))
    tallies = {r.id: r.t for r in rows.select("id", metrics.tallies(chars, F.split("text", " "), 2).alias("t")).collect()}
    assert tallies[0] == [0] * 6 and tallies[1] == [1, 1, 1, 0, 0, 0] and all(tallies[i] == [3, 3, 3, 2, 2, 2] for i in range(2, n + 2))
    assert normalize._compose_and_unescape.evalType == metrics.F.arrow_udf(lambda x: x, "string").evalType  # slices of Arrow arrays, no whole batch of objects


def test_a_run_waits_in_flat_buffers_and_leaves_in_several_frames(spark, monkeypatch):
    monkeypatch.setattr(feeds, "_FRAME", 1000)
    assert "array" not in feeds._WAITING
    found, expected = _by_sql(spark, "stream_best", SMALL.replace("0.001", "0.1"))
    assert found == expected and len(found) > 5000


def test_rare_grams_count_in_full_whatever_is_broadcast(spark):
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("abcde é漢\n"), 300)) for _ in range(12)] + [None, "", "tt"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    whole = perplexity.train(docs)  # so few n-grams are all held
    level = {}
    for i, t in enumerate(texts):
        keys, n = perplexity.grams(*common.buffers(pa.array([t], pa.string())))
        if n[0]:
            level[i] = -whole.log_prob(keys).astype(np.float64).mean()
    found = [{r.doc_id: r for r in perplexity.judge(docs, most=most).collect()} for most in (1 << 22, 24, 0)]
    for each in found:
        assert {i: each[i].log_perplexity for i in level} == pytest.approx(level, rel=1e-5)
        assert {i: r[1:] for i, r in each.items() if i in level} == {i: r[1:] for i, r in found[0].items() if i in level}


def test_words_that_tasks_hold_are_not_joined_and_score_alike(spark, monkeypatch):
    rows = [(i, " ".join(f"word{(i * k) % 97} rare{i % 7} once{i}x{k}" for k in range(40))) for i in range(30)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(masked_lm, "CLASSES", 2)  # a vocabulary of 64 words
    found, left = [], []
    for known in (1 << 20, 300, 0):
        monkeypatch.setattr(masked_lm, "KNOWN", known)
        words = masked_lm.vocabulary(docs)
        words.indexed = masked_lm.index(docs, words, "doc_id", "text")
        left.append(words.indexed.select(F.sum(F.size("rare"))).first()[0])
        with monkeypatch.context() as m:
            m.setattr(masked_lm, "CLASSES", 64)
            found.append({r.doc_id: r.log_likelihood for r in masked_lm.score(None, words, masked_lm.Network()).collect()})
    assert left[0] == 0 < left[1] < left[2] and len(found[0]) == len(rows)
    assert found[1] == pytest.approx(found[0]) and found[2] == pytest.approx(found[0])
