"""Findings of round 4, each held by a case that failed before."""

import random
import tracemalloc
from collections import Counter
from itertools import pairwise
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from twinlex.functions import normalize, registry
from twinlex.operators import vocabulary
from twinlex.plans import catalogue, training
from twinlex.plans.config import HeldOutConfig, TrainingConfig
from twinlex.sources import aligned, readers


def _by_sql(spark, name, sf_dir):
    """The query's rows by DuckDB, and by Spark."""
    import duckdb

    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    return sorted(db.execute(catalogue.oracle_sql()[name]).fetchall()), sorted(map(tuple, catalogue.queries()[name](spark, str(sf_dir)).collect()))


def test_pages_are_unescaped_as_the_sql_does(spark, tmp_path):
    """&quot without a semicolon, where a page was cut off, stays; so does what the SQL doesn't know. The operator still decodes all."""
    pages = ["a &quot<b", "&quot;x&amp;quot; &ampc &amp", "&copy &copy; &middot;&middot", "&lt;&#65; &nbsp; & && &a", "é &", "&amp;amp;&amp&quot;", "", None, "plain"]
    pq.write_table(pa.table({"page_id": list(range(len(pages))), "html": pages}), tmp_path / "pages.parquet")
    want, found = _by_sql(spark, "norm_nfc_unescape", tmp_path)
    assert found == want
    row = spark.createDataFrame([("&quot<&lt;",)], "t string").select(normalize.compose_and_unescape(F.col("t"))).first()
    assert row[0] == '"<<'


def test_the_sql_function_folds_latin_texts_in_full(spark):
    registry.register(spark, "r4_")
    texts = ["Große Maße", "5 µm", "ÀÉÿ", "ẞ ß", "plain", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(F.expr("r4_dedup_key(t)"), normalize.dedup_key(F.col("t"))).collect()
    assert [r[0] for r in found] == [r[1] for r in found] == ["grossemasse", "5μm", "àéÿ", "ssss", "plain", "", None]


def test_held_out_lines_are_cut_alike_without_whole_files(spark, tmp_path):
    """Every line end, with and without one at the file's end, marks of byte order, files in several parts; no value of a plan is a whole file."""
    cases = ["a\nb\n", "a\r\nb\rc", "a\x0b\n\x0c b ", "a\x85", "a\x1e\n", "", "\n", "\n\n", "﻿x\ny", "﻿\nz\x1c\x1d", "ሰላም  ", "a\n\r\n b\x0b\x0b", "é\x85é\r"]
    cut = spark.createDataFrame([(t,) for t in cases], "t string").select(readers.split_lines(F.col("t"))).collect()
    for i, (text, want) in enumerate(zip(cases, cut, strict=True)):
        path = tmp_path / f"file {i}"
        path.write_bytes(text.encode())
        assert [tuple(r) for r in readers.text_lines(spark, str(path)).orderBy("line_no").collect()] == list(enumerate(want[0])), repr(text)
    whole = tmp_path / "parts"
    whole.mkdir()
    for i, text in enumerate(cases):
        (whole / f"part-{i:02}").write_bytes(text.encode())
    assert [tuple(r) for r in readers.text_lines(spark, str(whole)).orderBy("line_no").collect()] == list(enumerate(x for c in cut for x in c[0]))


def test_a_held_out_split_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    """Rows of a split's reading, before and after it is zipped, are lines: none is longer than the longest line."""
    folder = tmp_path / "dev"
    folder.mkdir()
    for code in ("eng_Latn", "amh_Ethi"):
        (folder / f"{code}.dev").write_text("".join(f"{code} line {i}\n" for i in range(20_000)))
    monkeypatch.setattr(readers, "split_lines", None)  # whole texts aren't cut any more
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = readers.read_held_out(spark, HeldOutConfig(local_dir=tmp_path), tmp_path, "dev")
        assert readers.text_lines(spark, str(folder / "eng_Latn.dev")).rdd.getNumPartitions() > 1
        assert rows.filter("en_raw = concat('eng_Latn line ', line_no) and am_raw = concat('amh_Ethi line ', line_no)").count() == rows.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _merged_plainly(counts, size, least):
    """Tokens and merges by the definition: all pairs are counted anew after every merge."""
    alphabet = sorted({c for p in counts for c in p})
    tokens, merges, words = [*vocabulary.SPECIALS, *vocabulary.BYTES, *alphabet], [], [([*p], n) for p, n in counts.items()]
    while len(tokens) < size:
        total = Counter()
        for word, n in words:
            for pair in pairwise(word):
                total[pair] += n
        if not total or max(total.values()) < max(least, 1):
            break
        first = min(total, key=lambda p: (-total[p], *map(tokens.index, p)))
        merges.append(first)
        if "".join(first) not in tokens:
            tokens.append("".join(first))
        for word, _ in words:
            i = 0
            while i < len(word) - 1:
                if (word[i], word[i + 1]) == first:
                    word[i : i + 2] = ["".join(first)]
                i += 1
    return tuple(tokens), tuple(merges)


@pytest.mark.parametrize(("letters", "block"), [("ab", 1 << 18), ("aab▁", 16), ("▁xሀ🙂", 16), ("a", 16)])
def test_a_vocabulary_is_learnt_from_blocks_as_from_pieces(monkeypatch, letters, block):
    monkeypatch.setattr(vocabulary, "_SYMBOLS", block)
    draw = random.Random(letters)
    for _ in range(20):
        counts = {"".join(draw.choices(letters, k=draw.randint(1, 12))): draw.randint(1, 9) for _ in range(draw.randint(0, 40))}
        for least in (0, 3):
            found = vocabulary.learn(iter(counts.items()), 290, least)
            assert (found.tokens, found.merges) == _merged_plainly(counts, 290, least)


def test_learning_holds_no_object_for_each_piece():
    draw = random.Random(4)
    pieces = (("▁" + "".join(draw.choices("abcdefghij", k=10)), 2) for _ in range(60_000))
    tracemalloc.start()
    try:
        assert len(vocabulary.learn(pieces, 300, 2).merges) == 300 - 262 - 11
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_small_blocks_are_counted_by_few_tasks(spark, tmp_path):
    """20,000 blocks of a line index take as many tasks as cores, not one each; the index is the same."""
    path = tmp_path / "lines"
    path.write_bytes(b"".join(b"line %d%s" % (i, (b"\n", b"\r\n", b"\r")[i % 3]) for i in range(60_000)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("r4", "index")
    found = aligned.line_index(spark, str(path), 32)
    stages = [s for j in tracker.getJobIdsForGroup("r4") for s in tracker.getJobInfo(j).stageIds]
    assert len(found.offsets) > 20_000 and max(tracker.getStageInfo(s).numTasks for s in stages) <= spark.sparkContext.defaultParallelism
    with open(path, "rb") as raw:
        ends = [aligned.line_ends(raw, at, at + 32) for at in found.offsets[:2000]]
    assert found.before[:2001] == [sum(ends[:i]) for i in range(2001)] and found.lines == 60_000


def test_both_sides_of_a_cache_share_one_vocabulary(spark, monkeypatch):
    """A worker that encodes both sides holds one vocabulary and one memo of pieces."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    learnt = vocabulary.learn({"▁ab": 3, "▁cd": 2}, 300, 1)
    pairs = spark.createDataFrame([("ab", "cd", "first", 1.0)], "en string, am string, source string, score double")
    row = training.tokenized(pairs, learnt, TrainingConfig(), 42).first()
    assert (row.en_ids, row.am_ids) == (learnt.encode_piece("▁ab"), learnt.encode_piece("▁cd"))
    assert sum(isinstance(x, vocabulary.Vocabulary) for x in sent) == 1
