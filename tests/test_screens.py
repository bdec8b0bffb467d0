import json
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import dims
from wardline.operators import geometry, screens, versions

CELL = "screen string, at timestamp, bed string, vital string, x int, y int, w int, h int"


def clamp(v, a, b):
    return max(a, min(b, v))


def by_hand(rect, kind, frame, part, vital):
    """One box on one frame, step by step: the box in the frame and where it is read, or None."""
    left, top, fw, fh = frame
    a, b, c, d = rect["x"] - left, rect["y"] - top, rect["x"] - left + rect["w"], rect["y"] - top + rect["h"]
    if rect["w"] <= 0 or rect["h"] <= 0 or c <= 0 or d <= 0 or a >= fw or b >= fh:
        return None
    box = [clamp(a, 0, fw - 1), clamp(b, 0, fh - 1)]
    box += [clamp(c, box[0] + 1, fw), clamp(d, box[1] + 1, fh)]
    read = list(box)
    if kind != "value_widget_bbox_screen":
        w, h = box[2] - box[0], box[3] - box[1]
        sx, sy = sorted(clamp(r, 0.0, 1.0) for r in (part.x1, part.x2)), sorted(clamp(r, 0.0, 1.0) for r in (part.y1, part.y2))
        read[0], read[1] = clamp(box[0] + int(w * sx[0]), box[0], box[2] - 1), clamp(box[1] + int(h * sy[0]), box[1], box[3] - 1)
        read[2], read[3] = clamp(box[0] + int(w * sx[1]), read[0] + 1, box[2]), clamp(box[1] + int(h * sy[1]), read[1] + 1, box[3])
    if vital in ("VTi", "VTe"):
        read[2] = clamp(read[2] + max(round((read[2] - read[0]) * 0.3), 1), read[0] + 1, fw)
    return (*box, *read)


@pytest.mark.parametrize("part", [screens.Slice(), screens.Slice(1.4, 0.2, 0.5, 0.5)])
def test_boxes_on_frames_as_step_by_step(spark, part):
    rng = random.Random(7)
    rows = [(i, rng.choice(["cells", "value_widget_bbox_screen"]), rng.choice(["HR", "VTe"]), *(rng.randint(-60, 160) for _ in range(2)), *(rng.choice([1, 2, 9, 40, 77, 300]) for _ in range(2)), rng.choice([-20, 0, 30]), rng.choice([0, 15]), rng.choice([1, 60, 120]), rng.choice([1, 90])) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, roi_type string, vital string, x long, y long, w long, h long, left int, top int, width int, height int")
    got = {r.i: tuple(r[1:]) for r in screens.on_frame(df, part).select("i", "x1", "y1", "x2", "y2", "rx1", "ry1", "rx2", "ry2").collect()}
    want = {r[0]: by_hand(dict(zip("xywh", r[3:7], strict=True)), r[1], r[7:], part, r[2]) for r in rows}
    assert got == {i: w for i, w in want.items() if w is not None} and len(got) < len(rows)


def test_export_and_load_again(spark):
    rows = [("a", 0, "BED01", "HR", 1, 2, 3, 4), ("a", 0, "BED01", "VTe", -5, 6, 7, 8), ("a", 0, "BED02", "HR", 1, 1, 0, 5), ("a", 0, "BED03", None, 1, 1, 5, 5), ("b", 60, "BED01", "HR", 1, 1, None, 5)]
    df = spark.createDataFrame(rows, CELL.replace("at timestamp", "at int")).withColumn("at", F.timestamp_seconds("at"))
    docs = screens.export(df, ["screen"], "at", title="wall")
    texts = {r.screen: json.loads(r.document) for r in docs.collect()}
    assert texts["a"] == {"generated_at": "1970-01-01T00:00:00.000+00:00", "window_title": "wall", "roi_type": "value_widget_bbox_screen", "items": {"BED01": {"HR": {"x": 1, "y": 2, "w": 3, "h": 4}, "VTe": {"x": -5, "y": 6, "w": 7, "h": 8}}}}
    assert texts["b"]["items"] == {}
    maps = screens.load(docs, ["screen"])
    assert {(r.screen, r.bed, r.vital, r.x, r.y, r.w, r.h) for r in screens.boxes(maps).collect()} == {("a", "BED01", "HR", 1, 2, 3, 4), ("a", "BED01", "VTe", -5, 6, 7, 8)}
    assert maps.count() == 2 and {r.generated_at.timestamp() for r in maps.collect()} == {0.0, 60.0}


def test_odd_maps(spark, tmp_path):
    box = {"x": 1, "y": 1, "w": 5, "h": 5}
    bad = [None, "", "{", "[]", "3", '{"items": []}', '{"items": null}', "{}"]
    odd = {"roi_type": "  Cells ", "items": {"BED01": {"HR": box | {"x": "7"}, "RR": box | {"w": 5.9}, "NO": box | {"w": "5.9"}, "VTe": box | {"y": None}, "PEEP": [1], "else": box, "SpO2": box | {"h": -1}}, "BED99": {"HR": box}, "BED02": 4}}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*bad, json.dumps(odd)])], "i int, document string")
    maps = screens.load(df, ["i"])
    assert [(r.i, r.roi_type, r.generated_at) for r in maps.collect()] == [(len(bad), "cells", None)]
    assert sorted((r.vital, r.x, r.w) for r in screens.boxes(maps).collect()) == [("HR", 7, 5), ("RR", 1, 5)]
    assert screens.validity(maps, ["i"]).count() == 0
    (tmp_path / "m.json").write_text(json.dumps(odd))
    (tmp_path / "n.json").write_text("{broken")
    assert [r.roi_type for r in screens.load_folder(spark, str(tmp_path)).collect()] == ["cells"]


def test_changes_stand_until_the_next_row_of_their_own_key(spark):
    rng = random.Random(3)
    rows = sorted({(k, t): (k, t, rng.choice(["a", "a", "b", None])) for k in ["p", "q", None] for t in rng.sample(range(500), 120)}.values(), key=lambda r: (str(r[0]), r[1]))
    df = spark.createDataFrame(rows + [("p", None, "a")], "k string, t int, v string").withColumn("t", F.timestamp_seconds("t"))
    want, last = [], {}
    for k, t, v in rows:
        if k not in last or last[k][2] != v:
            if k in last:
                last[k][3] = t
            last[k] = [k, t, v, None]
            want.append(last[k])
    got = versions.changes(df, ["k"], "t", ["v"]).select("k", F.unix_seconds("valid_from"), "v", F.unix_seconds("valid_to")).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, want)) and len(want) < len(rows)


def test_frames_without_a_map_are_split_evenly(spark):
    maps = screens.load(spark.createDataFrame([("s", '{"generated_at": "2024-01-01T01:00:00Z", "items": {"BED01": {"HR": {"x": 1, "y": 1, "w": 5, "h": 5}}}}'), ("s", '{"generated_at": "2024-01-01T02:00:00Z", "items": {}}')], "screen string, document string"), ["screen"])
    frames = spark.createDataFrame([(1, "s", "2024-01-01 00:30:00Z"), (2, "s", "2024-01-01 01:00:00Z"), (3, "s", "2024-01-01 03:00:00Z"), (4, None, "2024-01-01 01:00:00Z"), (5, "s", None), (6, "s", "2024-01-01 00:30:00Z")], "id int, screen string, at string")
    width = F.when(F.col("id") == 6, 0).otherwise(1920)
    frames = frames.withColumns({"at": F.col("at").cast("timestamp"), "left": F.lit(0), "top": F.lit(0), "width": width, "height": F.lit(1080)})
    got = screens.cells(frames, screens.validity(maps, ["screen"]), ["screen"], "at", header=60).select("id", "source", "bed", "vital", "x1", "y1", "x2", "y2").collect()
    even = {(r.bed, r.vital, r.x1, r.y1, r.x2, r.y2) for r in geometry.grid(spark, 1920, 1080, 60).collect()}
    assert len(even) == len(dims.BEDS) * len(dims.VITAL_NAMES)
    for i in (1, 4, 5):
        assert {tuple(r[2:]) for r in got if r.id == i} == even and {r.source for r in got if r.id == i} == {"split"}
    assert [tuple(r[1:]) for r in got if r.id == 2] == [("exported", "BED01", "HR", 1, 1, 6, 6)]
    assert not [r for r in got if r.id in (3, 6)]


def test_capture_rectangle(spark):
    df = spark.sql("select named_struct('left', l, 'top', 0, 'width', w, 'height', 5) r, named_struct('left', 9, 'top', 9, 'width', 9, 'height', 9) f from values (1, 5), (null, 5), (1, 0), (1, null) t(l, w) union all select null, named_struct('left', 9, 'top', 9, 'width', 9, 'height', 9)")
    assert sorted(r[0] for r in df.select(screens.capture(F.col("r"), F.col("f"))["left"]).collect()) == [1, 9, 9, 9, 9]


@pytest.mark.parametrize("tile", [7, 64, 10_000])
def test_overlaps_equal_all_pairs(spark, tile):
    rng = random.Random(11)

    def made(n):
        out = []
        for i in range(n):
            x, y = rng.randint(-50, 150), rng.randint(-50, 150)
            out.append((rng.choice("ab"), i, x, y, x + rng.choice([0, -3, 5, 40, 130]), y + rng.choice([1, 20, 90])))
        return out

    a, b = made(70), made(60)
    left = spark.createDataFrame([*a, ("a", 99, None, 0, 5, 5)], "k string, i int, x1 int, y1 int, x2 int, y2 int")
    right = spark.createDataFrame(b, "k string, j int, u1 int, v1 int, u2 int, v2 int")
    want = []
    for k, i, x1, y1, x2, y2 in a:
        for m, j, u1, v1, u2, v2 in b:
            w, h = min(x2, u2) - max(x1, u1), min(y2, v2) - max(y1, v1)
            if k == m and w > 0 and h > 0:
                want.append((i, j, w * h))
    met = screens.overlaps(left, right, ["k"], tile)
    assert sorted(tuple(r) for r in met.select("i", "j", "area").collect()) == sorted(want) and want
    assert "Cartesian" not in met._jdf.queryExecution().toString() and "NestedLoop" not in met._jdf.queryExecution().toString()
