import io
import json
import random
import tarfile
import zipfile
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from twinlex.plans.config import HeldOutConfig, SourceConfig
from twinlex.sources import aligned, archives, readers


def test_hosted_tables_with_nested_columns(spark, tmp_path):
    rows = [({"en": "a", "am": "ሀ"},), ({"en": None, "am": "ለ"},), ({"en": "c", "am": "ሐ"},)]
    spark.createDataFrame(rows, "translation struct<en: string, am: string>").coalesce(1).write.parquet(str(tmp_path / "set/sub/train"))
    src = SourceConfig(name="x", kind="hf", path="set", subset="sub")
    assert [(r.en, r.am, r.score) for r in readers.read_source(spark, src, tmp_path).orderBy("line_no").collect()] == [("a", "ሀ", None), ("None", "ለ", None), ("c", "ሐ", None)]
    assert readers.read_source(spark, src.model_copy(update={"max_pairs": 2}), tmp_path).count() == 2
    assert readers.read_source(spark, src.model_copy(update={"max_pairs": 0}), tmp_path).count() == 3
    spark.createDataFrame([("q", "r")], "e string, a string").write.json(str(tmp_path / "lines/train"))
    flat = SourceConfig(name="y", kind="hf", path="lines", en_column="e", am_column="a")
    assert [(r.en, r.am) for r in readers.read_source(spark, flat, tmp_path).collect()] == [("q", "r")]


def test_held_out_archive(spark, tmp_path):
    archive = tmp_path / "set.tar.gz"
    with tarfile.open(archive, "w:gz") as tar:
        for split in ("dev", "devtest"):
            for code, text in (("eng_Latn", "one\ntwo\n"), ("amh_Ethi", "ሀ\nለ\n"), ("deu_Latn", "eins\n")):
                data = text.encode()
                info = tarfile.TarInfo(f"root/{split}/{code}.{split}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    cfg = HeldOutConfig(url=archive.as_uri())
    rows = readers.read_held_out(spark, cfg, tmp_path / "raw", "dev").orderBy("line_no").collect()
    assert [(r.en_raw, r.am_raw) for r in rows] == [("one", "ሀ"), ("two", "ለ")]
    with pytest.raises(ValueError, match="lines against"):
        readers.read_held_out(spark, HeldOutConfig(url=archive.as_uri(), am_code="deu_Latn"), tmp_path / "raw2", "dev")
    with pytest.raises(FileNotFoundError, match="lacks"):
        readers.held_out_dir(HeldOutConfig(url=archive.as_uri(), am_code="xxx"), tmp_path / "raw3")
    with pytest.raises(ValueError, match="local_dir"):
        readers.held_out_dir(HeldOutConfig(), tmp_path)


def test_aligned_text_stops_with_the_shortest(spark, tmp_path):
    (tmp_path / "a.en").write_bytes(b"one\r\ntwo\xff\nthree\n")
    (tmp_path / "a.am").write_text("ሀ\nለ\n", encoding="utf-8")
    rows = readers.aligned(spark, en=str(tmp_path / "a.en"), am=str(tmp_path / "a.am")).orderBy("line_no").collect()
    assert [(r.line_no, r.en, r.am) for r in rows] == [(0, "one", "ሀ"), (1, "two�", "ለ")]
    assert readers.aligned(spark, en=str(tmp_path / "a.en"), am=(tmp_path / "a.am").as_uri(), limit="1").count() == 1


def test_shards_of_an_older_schema(spark, tmp_path):
    spark.createDataFrame([("a", "ሀ", "s")], "en string, am string, source string").write.parquet(str(tmp_path / "old"))
    row = readers.read_shards(spark, [str(tmp_path / "old")]).first()
    assert (row.en, row.score, row.key_hash) == ("a", None, None)
    assert readers.first_rows(spark.range(5).select(F.col("id").alias("line_no")), None).count() == 5


def plain_lines(path):
    return [line.rstrip("\n") for line in io.TextIOWrapper(io.BytesIO(path.read_bytes()), encoding="utf-8", errors="replace")]


def odd_text(rng, n, last):
    parts = [rng.choice([b"", b"a", "ሀለ".encode(), b"x" * 90, b"\xe1\x88", b"\xff", b"\x85", " ".encode()]) + rng.choice([b"\n", b"\r\n", b"\r", b"\n"]) for _ in range(n)]
    return b"".join(parts) + last


def plain_index(path, block):
    raw = path.read_bytes()
    ends = [aligned.line_ends(io.BytesIO(raw), i, min(len(raw), i + block)) for i in range(0, len(raw), block)]
    return aligned.LineIndex.counted(ends, len(raw), block, raw[-1:] not in (b"", b"\n", b"\r"))


def test_indexed_lines_are_those_of_a_plain_reader(spark, tmp_path):
    rng = random.Random(4)
    for turn, block in enumerate((1, 2, 7, 64, 1 << 20)):
        en, am, sc = (tmp_path / f"{turn}.{s}" for s in ("en", "am", "scores"))
        en.write_bytes(odd_text(rng, 160, b"" if turn % 2 else b"open"))
        am.write_bytes(odd_text(rng, 150, b"\r"))
        sc.write_bytes(b"1.5\r\n" * 2000)
        index = [plain_index(p, block) for p in (en, am, sc)]
        assert [i.lines for i in index] == [len(plain_lines(p)) for p in (en, am, sc)]
        assert block < 64 or index[0] == aligned.line_index(spark, str(en), block)
        reader = aligned.AlignedReader({s: str(p) for s, p in zip(aligned.SIDES, (en, am, sc), strict=True)} | {"index": json.dumps([asdict(i) for i in index])})
        ranges = reader.partitions()
        rows = [r for p in ranges for b in reader.read(p) for r in b.to_pylist()]
        expected = list(zip(plain_lines(en), plain_lines(am), ["1.5"] * 2000, strict=False))
        assert [(r["en"], r["am"], r["score"]) for r in rows] == expected
        assert [r["line_no"] for r in rows] == list(range(len(expected)))
        assert block > 64 or len(ranges) > 5


def test_bounds_of_line_numbers_reach_the_reader(spark, tmp_path):
    for side in ("en", "am"):
        (tmp_path / f"a.{side}").write_text("".join(f"{side} {i}\n" for i in range(5000)))
    rows = readers.aligned(spark, block=4096, en=str(tmp_path / "a.en"), am=str(tmp_path / "a.am"))
    assert rows.rdd.getNumPartitions() == len((tmp_path / "a.en").read_bytes()) // 4096 + 1
    some = rows.filter("line_no >= 1200 and line_no < 1300")
    assert [r.en for r in some.orderBy("line_no").collect()] == [f"en {i}" for i in range(1200, 1300)]
    assert some.rdd.getNumPartitions() <= 2  # the others aren't even opened
    assert rows.filter("line_no = 4999").first().am == "am 4999"
    assert {r.line_no for r in rows.filter("line_no in (3, 4000) and en <> 'en 3'").collect()} == {4000}
    assert rows.filter("line_no > 9000").count() == 0
    reader = aligned.AlignedReader({"en": str(tmp_path / "a.en"), "am": str(tmp_path / "a.am"), "limit": "30"})
    kept = list(reader.pushFilters([aligned.GreaterThan(("line_no",), 9), aligned.IsNotNull(("en",)), aligned.In(("line_no",), (12, 20))]))
    assert [type(f) for f in kept] == [aligned.IsNotNull, aligned.In]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 9


def test_archives_are_unpacked_once_and_split(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for side in ("en", "am", "scores"):
            z.writestr(f"c.am-en.{side}", "".join(f"{i / 4 if side == 'scores' else side + str(i)}\r\n" for i in range(40)))
        z.writestr("README", "no lines")
    src = SourceConfig(name="x", kind="opus_moses", url=(tmp_path / "a.zip").as_uri())
    rows = readers.read_source(spark, src, tmp_path).orderBy("line_no").collect()
    assert [(r.en, r.am, r.score) for r in rows] == [(f"en{i}", f"am{i}", i / 4) for i in range(40)]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "x.lines").iterdir()}
    assert len(files) == 3 and readers.read_source(spark, src, tmp_path).count() == 40
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "x.lines").iterdir()} == files
    few = readers.read_source(spark, src.model_copy(update={"name": "y", "max_pairs": 3}), tmp_path)
    assert few.count() == 3 and not (tmp_path / "y.lines").exists()


def test_numbers_follow_file_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" for i in range(3)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(4000)))
    rows = readers.numbered(spark.read.text(str(tmp_path / "*.txt"))).orderBy("line_no").collect()
    assert [r.value for r in rows] == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(4000)] and rows[-1].line_no == 4002


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_archive_members_are_read_in_place(spark, tmp_path, mode):
    archive = tmp_path / "set.tar"
    texts = {f"root/dev/{code}.dev": f"{code} {'x' * 3000}\nሀ\n" for code in ("eng_Latn", "amh_Ethi", "fra_Latn")}
    with tarfile.open(archive, mode) as tar:
        for name, text in texts.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    found = archives.texts(spark, str(archive), ["dev/fra_Latn.dev", "dev/eng_Latn.dev"]).collect()
    assert {r.name: r.value for r in found} == {archives.short(n): t for n, t in texts.items() if "amh" not in n}
    assert (archives.offsets(str(archive)) is None) == (mode == "w:gz")
    rows = readers.read_held_out(spark, HeldOutConfig(url=archive.as_uri()), tmp_path / "raw", "dev").orderBy("line_no").collect()
    assert [(r.en_raw[:8], r.am_raw[:8]) for r in rows] == [("eng_Latn", "amh_Ethi"), ("ሀ", "ሀ")] and not (tmp_path / "raw").exists()
    with pytest.raises(Exception, match="lacks"):
        archives.texts(spark, str(archive), ["dev/none.dev"]).collect()
