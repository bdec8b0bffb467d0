import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import versions
from wardline.operators.messages import END, START
from wardline.sources import feeds, paths, sinks


def made(seed, n=300):
    """A byte stream with frames of any length, bytes between them, starts within frames, and a last one that does not end."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        out.append(rng.choice(["", "", "noise", "\r\n"]) + START + f"MSH|{k}" + "x" * rng.choice([0, 3, 40, 900]) + rng.choice(["", "", f"{START}again", "é", "�"]) + END + rng.choice(["\r", "\r", ""]))
    return "".join(out) + rng.choice([f"{START}never ended", f"{START}never ended\r", "noise", ""])


@pytest.mark.parametrize("split", [37, 1000, 1 << 27])
def test_any_split_gives_the_same_frames(spark, tmp_path, split):
    texts = [made(s) for s in range(4)] + ["", START, f"{START}{END}", f"end first{END}{START}one{END}"]
    want = []
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.bin").write_bytes(t.encode() + (b"\xff" if i == 2 else b""))
        want += [(f"f{i}.bin", k, m.replace("�", "")) for k, m in enumerate(re.findall(f"{START}([^{END}]*){END}", t))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = feeds.framed_files(spark, str(tmp_path)).collect()
        if split == 1000:
            assert feeds.frame_records(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.path.rpartition("/")[2], r.place, r.message) for r in got) == sorted(want)


def test_frames_written_and_streamed(spark, tmp_path):
    df = spark.range(50).select(F.concat(F.lit("MSH|"), F.col("id").cast("string")).alias("message"))
    for k in range(3):
        sinks.framed(df.where(F.col("message") != f"MSH|{k}"), "message", str(tmp_path / "in"))
    seen = []
    feeds.framed_stream(spark, str(tmp_path / "in"), lambda b, k: seen.extend(r.message for r in b.collect()), str(tmp_path / "c"), once=True).awaitTermination(120)
    assert len(seen) == 147 and len(set(seen)) == 50


def test_lines_appended_from_a_stream(spark, tmp_path):
    df = spark.range(20).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("even"))
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        sinks.append_lines(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination(120)
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert len(lines) == 20 and sum('"even":null' in r.value for r in lines) == 10


@pytest.mark.parametrize("step", [1, 1 << 40])
def test_as_of_intervals_equals_as_of_snapshots(spark, step):
    rng = random.Random(7)
    held = [{(b, v): rng.choice([1, 1, 1, 2, None]) for b in ("a", None) for v in ("x", "y") if rng.random() > 0.2} for _ in range(40)]
    rows = [(k * 10, b, v, x) for k, s in enumerate(held) for (b, v), x in s.items()] + [(None, "a", "x", 9)]
    at = F.timestamp_seconds("s").cast("timestamp_ntz")
    snapshots = spark.createDataFrame(rows, "s long, bed string, vital string, value int").withColumn("ts", at).drop("s")
    kept = versions.intervals(snapshots, ["bed", "vital"], "ts", ["value"], step)
    assert kept.count() < len(rows)
    asked = spark.createDataFrame([(s, b, v) for s in range(-5, 420, 7) for b in ("a", None, "zz") for v in ("x", "y")], "s long, bed string, vital string").withColumn("now", at)
    got = {(r.s, r.bed, r.vital): (r.value, r.valid_from is not None) for r in versions.as_of(asked, kept, ["bed", "vital"], "now").collect()}
    for (s, b, v), found in got.items():
        snap = held[min(s // 10, 39)] if s >= 0 else {}
        assert found == ((snap[(b, v)], True) if (b, v) in snap else (None, False)), (s, b, v)
    assert len(got) == asked.count()
    # Compaction: neighbours of one key differ, or do not touch.
    spans = sorted((str(r.bed), r.vital, r.valid_from, str(r.valid_to), r.value) for r in kept.collect())
    assert not any(p[:2] == q[:2] and p[3] == str(q[2]) and p[4] == q[4] for p, q in zip(spans, spans[1:], strict=False))
    assert versions.intervals(snapshots.limit(0), ["bed", "vital"], "ts", ["value"], 1).count() == 0


def test_paths(spark):
    plain = ["/a/b.json", "/a//./b.json", "/a/x/../b.json", "\\a\\x\\y\\..\\..\\b.json", "a/../../b", "./b", "/../b", "C:\\runs\\.\\b", "/a/b/.", None]
    df = spark.createDataFrame([(p,) for p in plain], "p string")
    assert [r.n for r in df.select(paths.normal(F.col("p")).alias("n")).collect()] == ["/a/b.json", "/a/b.json", "/a/b.json", "/a/b.json", "../b", "b", "/b", "C:/runs/b", "/a/b", None]


def test_one_name_in_two_folders(spark, tmp_path):
    for f in ("one/day/s.json", "two/day/s.json", "two/t.json"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("{}")
    files = paths.listing(spark, str(tmp_path))
    root = str(tmp_path)
    named = [(1, "day/s.json", None), (2, f"{root}/two/day/s.json", None), (3, "t.json", None), (4, "day/../day/s.json", None), (5, "lost.json", None), (6, None, None), (7, "", None), (8, "t.json", f"{root}/two"), (8, "t.json", f"{root}/two")]
    df = spark.createDataFrame(named, "k int, p string, beside string")
    got = sorted((r.k, r.file and r.file[len(root) :]) for r in paths.resolve(df, files, "p", [f"{root}/one"], ["beside"]).collect())
    assert got == [(1, "/one/day/s.json"), (2, "/two/day/s.json"), (3, None), (4, "/one/day/s.json"), (5, None), (6, None), (7, None), (8, "/two/t.json"), (8, "/two/t.json")]
    swapped = {r.k: r.file and r.file[len(root) :] for r in paths.resolve(df, files, "p", [f"{root}/two", f"{root}/one"]).collect()}
    assert swapped[1] == "/two/day/s.json" and swapped[3] == "/two/t.json"
